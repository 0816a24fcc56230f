"""Block-structured tables: a DataFrame, named groups of its columns, a target and a row id."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DecimalType)


def present(col: str | Column) -> Column:
    """Neither null nor NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def clean(col: str) -> Column:
    """As a double, with null in place of NaN."""
    return F.nullif(F.col(col).cast("double"), F.lit(float("nan")))


@dataclass(frozen=True)
class BlockTable:
    """df with blocks {name: columns}; disjoint, unique and without the target.

    task_type is classif, regr or clust; levels are a target's classes, kept also where a row
    filter leaves none of their rows.
    """

    df: DataFrame
    blocks: Mapping[str, tuple[str, ...]]
    target: str | None = None
    task_type: str = "auto"
    row_id: str = "row_id"
    positive: str | None = None
    label: str = ""
    levels: tuple[str, ...] = ()
    roles: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        blocks = {b: tuple(c for c in cols if c != self.target) for b, cols in self.blocks.items()}
        seen: dict[str, str] = {}
        for b, cols in blocks.items():
            if not cols:
                raise ValueError(f"block {b} has no columns")
            for c in cols:
                if c in seen:
                    raise ValueError(f"blocks must be disjoint across blocks: {c} is in {seen[c]} and {b}")
                seen[c] = b
        missing = [c for c in [*seen, *([self.target] if self.target else [])] if c not in self.df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing[:20])}" + (" ..." if len(missing) > 20 else ""))
        object.__setattr__(self, "blocks", blocks)
        if self.task_type == "auto":
            kind = None if self.target is None else self.df.schema[self.target].dataType
            object.__setattr__(self, "task_type", "clust" if kind is None else "classif" if isinstance(kind, (T.StringType, T.BooleanType)) else "regr")

    @property
    def columns(self) -> list[str]:
        return [c for cols in self.blocks.values() for c in cols]

    def with_df(self, df: DataFrame) -> BlockTable:
        return replace(self, df=df)

    def block_columns(self, base: str) -> list[str]:
        """Columns that a feature has become: itself, or its encoded dummies base.level."""
        at = re.compile(re.escape(base) + r"(\.|$)")
        return [c for c in self.df.columns if at.match(c)]

    def block_data(self, *names: str) -> DataFrame:
        """Row id and the named blocks' columns (all blocks without names), which must be numeric."""
        cols = [c for b in names or self.blocks for c in self.blocks[b]]
        bad = [c for c in cols if not isinstance(self.df.schema[c].dataType, NUMERIC)]
        if bad:
            raise TypeError(f"not numeric: {', '.join(bad)}")
        return self.df.select(self.row_id, *cols)

    def filter(self, condition) -> BlockTable:
        return self.with_df(self.df.filter(condition))

    def renamed(self, names: Mapping[str, str]) -> BlockTable:
        """Renames columns and keeps blocks and target in step."""
        blocks = {b: tuple(names.get(c, c) for c in cols) for b, cols in self.blocks.items()}
        df = self.df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in self.df.columns])
        return replace(self, df=df, blocks=blocks, target=names.get(self.target, self.target))

    def resolved(self) -> BlockTable:
        """Only numeric columns whose variance is finite and over 1e-12; blocks left empty go.  One aggregate."""
        cols = [c for c in self.columns if isinstance(self.df.schema[c].dataType, NUMERIC)]
        got = self.df.agg(*[F.var_samp(clean(c)).alias(c) for c in cols]).first() if cols else {}
        good = {c for c in cols if got[c] is not None and got[c] == got[c] and EPS < got[c] < float("inf")}
        lost = [c for c in self.columns if c not in good]
        if lost:
            warnings.warn(f"{len(lost)} columns don't vary or aren't numeric: {', '.join(lost[:10])}", stacklevel=2)
        blocks = {b: tuple(c for c in own if c in good) for b, own in self.blocks.items()}
        return replace(self, blocks={b: own for b, own in blocks.items() if own})


def expanded(columns: list[str], blocks: Mapping[str, Iterable[str]]) -> dict[str, tuple[str, ...]]:
    """blocks with the columns base.level in place of a base that is no column any more."""
    dummies = lambda base: [c for c in columns if c.startswith(f"{base}.")]
    return {b: tuple(x for c in own for x in ([c] if c in columns else dummies(c) or [c])) for b, own in blocks.items()}


def from_flat(df: DataFrame, blocks: Mapping[str, Iterable[str]], target: str | None = None, row_id: str | None = None, **more) -> BlockTable:
    """A BlockTable of one flat table; a missing row id is added under a name that no column has.

    A name in blocks that is no column stands for the dummies that it has become, name.level.  An
    added row id holds for one evaluation of df only: give one, or write the table first, where
    folds and replicates are to be the same again.
    """
    blocks = expanded(df.columns, blocks)
    if row_id is None:
        row_id = "row_id"
        while row_id in df.columns:
            row_id = f"_{row_id}"
        df = df.withColumn(row_id, F.monotonically_increasing_id())
    return BlockTable(df, {b: tuple(c) for b, c in blocks.items()}, target, row_id=row_id, **more)


def from_blocks(parts: Mapping[str, DataFrame], row_id: str, target: DataFrame | None = None, target_name: str = "target", sep: str = "__", **more) -> BlockTable:
    """Several tables, joined on an explicit row id; their columns become <block><sep><column>."""
    whole, blocks = None, {}
    for i, (name, df) in enumerate(parts.items(), 1):
        name = name or f"block_{i}"
        names = {c: f"{name}{sep}{c}" for c in df.columns if c != row_id}
        blocks[name] = tuple(names.values())
        df = df.withColumnsRenamed(names)
        whole = df if whole is None else whole.join(df, row_id)
    if target is not None:
        free = target_name
        while free in whole.columns:
            free = f".{free}"
        own = next(c for c in target.columns if c != row_id)
        whole, target_name = whole.join(target.select(row_id, F.col(own).alias(free)), row_id), free
    return BlockTable(whole, blocks, target_name if target is not None else None, row_id=row_id, **more)


#: Fixed values of the synthetic tables: each feature's loadings on the three latent factors.
LOADINGS = {
    "block_a": ((1.2, 0.4, 0.0), (1.0, 0.3, 0.2), (0.9, 0.5, 0.1), (0.7, 0.2, 0.0), (0.5, 0.4, 0.2), (0.3, 0.1, 0.1)),
    "block_b": ((0.8, 0.0, 1.0), (0.7, 0.2, 0.9), (0.6, 0.1, 0.7), (0.4, 0.0, 0.8), (0.3, 0.2, 0.6), (0.2, 0.1, 0.5)),
    "block_c": ((0.1, 1.1, 0.8), (0.2, 1.0, 0.7), (0.3, 0.9, 0.5), (0.2, 0.8, 0.4), (0.0, 0.7, 0.3), (0.1, 0.6, 0.2)),
}
#: Sites and their shifts, noise, and the factors' and noise's part in response and class.
SITE_SHIFT, NOISE = {"A": 0.0, "B": 0.2 * 0.6, "C": -0.2 * 0.6}, 0.35
RESPONSE, CLASS = (1.0, 0.7, -0.4, 0.4), (1.0, 0.5, -0.3, 0.3)


def _uniform(seed: int, draw: int) -> Column:
    """In (0, 1), by row_id, seed and draw alone, so that it doesn't depend on partitions."""
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.lit(draw), F.col("row_id")), F.lit(11))
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def _normal(seed: int, draw: int) -> Column:
    """A standard normal draw, from two uniform ones."""
    return F.sqrt(-2 * F.log(_uniform(seed, 2 * draw))) * F.cos(2 * F.pi() * _uniform(seed, 2 * draw + 1))


def synthetic(spark: SparkSession, n: int = 90, seed: int = 1, task_type: str = "clust") -> BlockTable:
    """Three blocks of six features over three latent factors, with drawn sites that shift them, a response and three classes."""
    z = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *[_normal(seed, i).alias(f"z{i}") for i in range(3)])
    site = F.element_at(F.array(*map(F.lit, SITE_SHIFT)), (F.floor(3 * _uniform(seed, 9)) + 1).cast("int"))
    z = z.withColumn("site_batch", site)
    shift = F.create_map(*[F.lit(x) for pair in SITE_SHIFT.items() for x in pair])[F.col("site_batch")]
    mixed = lambda loads: sum((x * F.col(f"z{i}") for i, x in enumerate(loads)), F.lit(0.0))
    cols, draw = {}, 10
    for b, rows in LOADINGS.items():
        for j, loads in enumerate(rows, 1):
            cols[f"{b}_{j}"] = mixed(loads) + shift + NOISE * _normal(seed, draw)
            draw += 1
    raw, score = (mixed(x[:3]) + x[3] * _normal(seed, draw + i) for i, x in enumerate((RESPONSE, CLASS)))
    df = z.withColumns(cols | {"raw": raw, "score": score})
    cut = df.agg(F.avg("raw").alias("m"), F.stddev_samp("raw").alias("s"), F.expr("percentile(score, array(1/3D, 2/3D))").alias("q")).first()
    df = df.withColumn("response", (F.col("raw") - cut["m"]) / cut["s"])
    df = df.withColumn("subtype", F.when(F.col("score") <= cut["q"][0], "Basal").when(F.col("score") <= cut["q"][1], "Her2").otherwise("LumA"))
    target = {"classif": "subtype", "regr": "response"}.get(task_type)
    blocks = {b: tuple(f"{b}_{j}" for j in range(1, 7)) for b in LOADINGS}
    return BlockTable(df.drop("z0", "z1", "z2", "raw", "score"), blocks, target, task_type if target else "clust", levels=("Basal", "Her2", "LumA") if target == "subtype" else ())


def adapter(df: DataFrame, prefixes: Mapping[str, str], target: str | None = None, response: int | str | None = None, responses: tuple[str, ...] = ()) -> BlockTable:
    """A wide table whose blocks are told by column prefixes, as measured omics or spectral sets come; response picks one of several targets by number or name."""
    if response is not None:
        target = responses[response - 1] if isinstance(response, int) else response
        df = df.drop(*[r for r in responses if r != target])
    return from_flat(df, {b: [c for c in df.columns if c.startswith(p)] for b, p in prefixes.items()}, target)


def embeddings_design(spark: SparkSession, sf_dir: str) -> BlockTable:
    """Design of four blocks of sixteen dimensions; label is the class."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cols = {f"b{b}_{j}": F.col("embedding")[16 * b + j].cast("double") for b in range(4) for j in range(16)}
    df = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("label"), *[c.alias(k) for k, c in cols.items()])
    return BlockTable(df, {f"b{b}": tuple(f"b{b}_{j}" for j in range(16)) for b in range(4)}, "label", "classif")


ORDERS_BLOCKS = {
    "line": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "ord": ("o_totalprice", "o_day"),
    "part": ("p_size", "p_retailprice"),
    "party": ("c_acctbal", "s_acctbal"),
}
#: The rows of the orders design, in SQL that Spark and DuckDB share.
ORDERS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS row_id, l_returnflag, c_mktsegment, r_name, l_quantity, l_extendedprice, l_discount, l_tax,
 o_totalprice, CAST(datediff({days}) AS DOUBLE) AS o_day, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, c_acctbal, s_acctbal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def orders_design(spark: SparkSession, sf_dir: str) -> BlockTable:
    """Design of lineitem with its order, part, customer and supplier; l_returnflag is the class."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "part", "customer", "supplier", "nation", "region")}
    # Orders meet their customers before lineitem does: its rows are shuffled by part and by order, and not by customer as well.
    buyer = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    bought = t["orders"].join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    df = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    df = df.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("o_day")
    own = [c for cols in ORDERS_BLOCKS.values() for c in cols if c not in ("o_day", "p_size")]
    df = df.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_returnflag", "c_mktsegment", "r_name", *own, day, F.col("p_size").cast("double").alias("p_size"))
    return BlockTable(df, ORDERS_BLOCKS, "l_returnflag", "classif")


TASKS = {
    "synthetic_blocks": lambda spark, sf_dir: synthetic(spark),
    "synthetic_classif": lambda spark, sf_dir: synthetic(spark, task_type="classif"),
    "synthetic_regr": lambda spark, sf_dir: synthetic(spark, task_type="regr"),
    "embeddings": embeddings_design,
    "orders": orders_design,
}


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name, with null for what one of them lacks."""
    return a.unionByName(b, allowMissingColumns=True)


def melted(df: DataFrame, keys: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each of cols: keys, the column's name and its value as a double."""
    return df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def spread(df: DataFrame, keys: list[str], name: str, levels: list[str]) -> DataFrame:
    """A row for each key with the number of rows of each level, 0 where there is none; levels are given, so no pass looks for them."""
    return df.groupBy(*keys).pivot(name, levels).count().na.fill(0, levels)


def write_table(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Parquet, JSON or CSV; CSV gets arrays joined by semicolons."""
    if form == "csv":
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        df = df.withColumns({c: F.concat_ws(";", F.transform(c, lambda x: x.cast("string"))) for c in arrays})
        options.setdefault("header", True)
    df.write.format(form).options(**options).mode("overwrite").save(path)


class RunLog:
    """An append-only log of model states and payloads: Parquet, partitioned by run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, run_id: str, kind: str, content: str) -> None:
        row = self.spark.createDataFrame([(run_id, kind, content)], "run_id string, kind string, content string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").partitionBy("run_id").parquet(self.path)

    def last(self, kind: str, run_id: str | None = None) -> str | None:
        """The newest entry, of run_id if there is one of it."""
        df = self.spark.read.parquet(self.path).where(F.col("kind") == kind)
        order = [F.desc(F.col("run_id") == run_id)] if run_id else []
        row = df.orderBy(*order, F.desc("at")).first()
        return row["content"] if row else None
