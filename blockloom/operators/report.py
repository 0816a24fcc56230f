"""Quality overview of a block table, summaries of a model, and the data behind its plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import NUMERIC, BlockTable, clean, present
from .evaluate import concordance, correlation_table
from .models import Model


def _absent(df: DataFrame, c: str):
    return ~present(c) if isinstance(df.schema[c].dataType, NUMERIC) else F.col(f"`{c}`").isNull()


def overview(table: BlockTable) -> DataFrame:
    """One row: n_rows, n_features, n_blocks, complete_rows, missing_cells, constant_features, numeric_features."""
    df, cols = table.df, table.columns
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
    whole = reduce(lambda a, b: a & b, [~_absent(df, c) for c in cols])
    missing = reduce(lambda a, b: a + b, [F.when(_absent(df, c), 1).otherwise(0) for c in cols])
    constant = reduce(lambda a, b: a + b, [F.when((F.min(clean(c)) == F.max(clean(c))) & (F.count(clean(c)) > 0), 1).otherwise(0) for c in numeric], F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.when(whole, 1).otherwise(0)).alias("complete_rows"), F.sum(missing).alias("missing_cells"), constant.cast("bigint").alias("constant_features")).select(
        "n_rows", F.lit(len(cols)).cast("bigint").alias("n_features"), F.lit(len(table.blocks)).cast("bigint").alias("n_blocks"), "complete_rows", "missing_cells", "constant_features", F.lit(len(numeric)).cast("bigint").alias("numeric_features")
    )


def blocks_overview(table: BlockTable) -> DataFrame:
    """block, n_features, n_numeric, missing_cells, missing_rate, constant_features; one pass over the rows."""
    df, cells = table.df, []
    for b, cols in table.blocks.items():
        numeric = [c for c in cols if isinstance(df.schema[c].dataType, NUMERIC)]
        missing = F.sum(reduce(lambda a, x: a + x, [F.when(_absent(df, c), 1).otherwise(0) for c in cols]))
        constant = reduce(lambda a, x: a + x, [F.when((F.min(clean(c)) == F.max(clean(c))) & (F.count(clean(c)) > 0), 1).otherwise(0) for c in numeric], F.lit(0))
        cells.append(F.struct(F.lit(b).alias("block"), F.lit(len(cols)).cast("bigint").alias("n_features"), F.lit(len(numeric)).cast("bigint").alias("n_numeric"), missing.alias("missing_cells"), (missing / (F.count("*") * len(cols))).alias("missing_rate"), constant.cast("bigint").alias("constant_features")))
    return df.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def class_counts(table: BlockTable) -> DataFrame:
    """level, n of every class."""
    return table.df.where(F.col(table.target).isNotNull()).groupBy(F.col(table.target).cast("string").alias("level")).agg(F.count("*").alias("n"))


def target_distribution(table: BlockTable, top: int = 5) -> DataFrame:
    """level, n, share of the most frequent classes; for a number its n, mean, sd, min and max."""
    if table.task_type == "regr":
        y = clean(table.target)
        return table.df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.min(y).alias("min"), F.max(y).alias("max"))
    counts = class_counts(table)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("level", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "level").limit(top)


def issues(table: BlockTable, missing: float = 0.2, complete: float = 0.8, least_class: int = 5) -> DataFrame:
    """severity, issue, detail of what a fit would stumble on."""
    spark, o, out = table.df.sparkSession, overview(table).first(), []
    if o["missing_cells"]:
        rate = o["missing_cells"] / max(o["n_rows"] * o["n_features"], 1)
        out.append(("warning" if rate >= missing else "info", "missing_values", f"{rate:.3f} of all cells"))
    if o["n_rows"] and o["complete_rows"] / o["n_rows"] < complete:
        out.append(("warning", "few_complete_rows", f"{o['complete_rows']} of {o['n_rows']}"))
    if o["constant_features"]:
        out.append(("warning", "constant_numeric_features", str(o["constant_features"])))
    out += [("error", "no_numeric_features", r["block"]) for r in blocks_overview(table).where("n_numeric = 0").collect()]
    if table.target and table.task_type == "classif":
        out += [("warning", "small_class", r["level"]) for r in class_counts(table).where(F.col("n") < least_class).orderBy("n", "level").collect()]  # the reader gets one line for each
    if table.target and table.task_type == "regr" and not (target_distribution(table).first()["sd"] or 0) > 0:
        out.append(("error", "constant_target", table.target))
    return spark.createDataFrame(out, "severity string, issue string, detail string")


def model_summary(model: Model, spark: SparkSession, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """overview, components, blocks, weights and, with a selection's summary, stability (full outer join by feature)."""
    out = {
        "overview": spark.createDataFrame([(model.prefix, len(model.weights), len(model.blocks), sum(map(len, model.blocks.values())), model.metric)], "kind string, n_components int, n_blocks int, n_features int, metric string"),
        "components": model.components_table(spark),
        "blocks": model.blocks_table(spark),
        "weights": model.weights_table(spark),
    }
    if summary is not None:
        stable = None
        for key in model.stable:
            own = model.weights_table(spark, f"stable_{key}").select("component", "block", "feature", F.col("weight").alias(f"stable_{key}"))
            stable = own if stable is None else stable.join(own, ["component", "block", "feature"], "full")
        out["stability"] = summary if stable is None else summary.join(stable, ["component", "block", "feature"], "full")
    return out


def draw_means(draws: DataFrame, reference: DataFrame, component: str, level: float = 0.95, method: str = "ci", threshold: float = 0.5) -> DataFrame:
    """block, feature, mean, low, high, freq of a component's draws, each replicate's blocks turned to the reference's side; filtered by interval, frequency or none."""
    own = draws.where(F.col("component") == component).join(F.broadcast(reference.where(F.col("component") == component).select("block", "feature", F.col("weight").alias("ref"))), ["block", "feature"], "left")
    sign = own.groupBy("replicate", "block").agg(F.corr("weight", "ref").alias("r")).select("replicate", "block", F.when(F.col("r") < 0, -1.0).otherwise(1.0).alias("sign"))
    turned = own.join(sign, ["replicate", "block"]).withColumn("w", F.col("weight") * F.col("sign"))
    a = (1 - level) / 2
    out = turned.groupBy("block", "feature").agg(F.avg("w").alias("mean"), F.percentile("w", a).alias("low"), F.percentile("w", 1 - a).alias("high"), F.avg(F.when(F.abs("w") > 1e-12, 1.0).otherwise(0.0)).alias("freq"))
    if method == "ci":
        out = out.where((F.col("low") > 0) | (F.col("high") < 0))
    elif method == "frequency":
        out = out.where(F.col("freq") >= threshold)
    return out.orderBy("block", F.desc(F.abs("mean")), "feature")


def weight_intervals(weights: list[DataFrame]) -> DataFrame:
    """component, block, feature, n, mean, low, high over models, each turned to the first model's side."""
    every = reduce(DataFrame.unionByName, [w.withColumn("model", F.lit(i)) for i, w in enumerate(weights)])
    first = every.where("model = 0").select("component", "block", "feature", F.col("weight").alias("ref"))
    both = every.join(first, ["component", "block", "feature"])
    sign = both.groupBy("model", "component", "block").agg(F.when(F.sum(F.col("weight") * F.col("ref")) < 0, -1.0).otherwise(1.0).alias("sign"))
    got = both.join(sign, ["model", "component", "block"]).withColumn("w", F.col("weight") * F.col("sign")).groupBy("component", "block", "feature").agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"))
    half = 1.96 * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n")
    return got.select("component", "block", "feature", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def weights_data(model: Model, spark: SparkSession, component: int = 1, top_n: int = 20, source: str = "raw") -> DataFrame:
    """For a bar plot: the component's largest weights by block, in order."""
    w = model.weights_table(spark, source).where((F.col("component") == model.names[component - 1]) & (F.col("weight") != 0))
    by = Window.partitionBy("block").orderBy(F.desc(F.abs("weight")), "feature")
    return w.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_n).orderBy("block", "rank")


def variance_data(model: Model, spark: SparkSession) -> DataFrame:
    """For variance and scree plots: component, block (total for all), ev and its running sum."""
    rows = model.blocks_table(spark).select("component", "block", F.col("ev_block").alias("ev")).unionByName(model.components_table(spark).select("component", F.lit("total").alias("block"), "ev"))
    return rows.withColumn("ev_cumulative", F.sum("ev").over(Window.partitionBy("block").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))


def scree_data(model: Model, spark: SparkSession) -> DataFrame:
    """component, objective, and the objectives' running sum."""
    run = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return model.components_table(spark).select("component", "objective", F.sum("objective").over(run).alias("objective_cumulative"))


def heatmap_data(model: Model, table: BlockTable, method: str = "pearson") -> DataFrame:
    """a, b, r between all score columns."""
    scores = model.transform(table)
    return correlation_table(scores, [c for c in scores.columns if c.startswith(model.prefix)], method)


def network_data(model: Model, table: BlockTable, cutoff: float = 0.3, method: str = "pearson") -> DataFrame:
    """Edges between blocks' scores: a, b, r with a large enough absolute r."""
    return heatmap_data(model, table, method).where(F.abs("r") >= cutoff)


def scores_data(model: Model, table: BlockTable, component: int = 1) -> DataFrame:
    """Concordance of each pair of a component's block scores: a, b, n, r, ccc, slope."""
    cols = [f"{model.prefix}{component}_{b}" for b in model.blocks if b not in model.hidden]
    return concordance(model.transform(table), [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]])
