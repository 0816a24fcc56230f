"""The library's own queries over the test tables, with their SQL counterparts.

Doubles are rounded to six places on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, inference, knn, preprocess, report, tuning
from ..operators.models import MBsPCA, MBsPLS, MBsPLSXY, Model
from ..operators.moments import moments
from ..sources import tables
from ..sources.tables import BlockTable, embeddings_design, orders_design
from ..streaming import scoring

QUERIES: dict = {}
ORACLES: dict = {}

ORDERS = "o AS (" + tables.ORDERS_SQL.format(days="'day', DATE '1992-01-01', o_orderdate::DATE") + ")"
COLUMNS = [c for cols in tables.ORDERS_BLOCKS.values() for c in cols]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _base(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- tables and quality --------------------------------------------------------------------------

_missing = " + ".join(f"sum(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END)" for c in COLUMNS)
_whole = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in COLUMNS)
_constant = " + ".join(f"CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END" for c in COLUMNS)


@query("qc_overview", f"WITH {ORDERS} SELECT count(*) AS n_rows, {len(COLUMNS)}::BIGINT AS n_features, 4::BIGINT AS n_blocks, count(*) FILTER (WHERE {_whole}) AS complete_rows, ({_missing})::BIGINT AS missing_cells, ({_constant})::BIGINT AS constant_features, {len(COLUMNS)}::BIGINT AS numeric_features FROM o")
def qc_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview(orders_design(spark, sf_dir))


@query("qc_blocks", f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{b}' AS block, {len(c)}::BIGINT AS n_features, {len(c)}::BIGINT AS n_numeric, count(*) * {len(c)} - ({' + '.join(f'count({x})' for x in c)}) AS missing_cells, {r('(count(*) * ' + str(len(c)) + ' - (' + ' + '.join(f'count({x})' for x in c) + ')) / (count(*) * ' + str(len(c)) + ')')} AS missing_rate, ({' + '.join(f'CASE WHEN min({x}) = max({x}) THEN 1 ELSE 0 END' for x in c)})::BIGINT AS constant_features FROM o" for b, c in tables.ORDERS_BLOCKS.items()))
def qc_blocks(spark, sf_dir):
    return rounded(report.blocks_overview(orders_design(spark, sf_dir)))


@query("qc_target", f"SELECT l_returnflag AS level, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM lineitem GROUP BY l_returnflag")
def qc_target(spark, sf_dir):
    return rounded(report.target_distribution(orders_design(spark, sf_dir)))


@query("qc_target_regr", f"SELECT count(o_totalprice) AS n, {r('avg(o_totalprice)')} AS mean, {r('stddev_samp(o_totalprice)')} AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def qc_target_regr(spark, sf_dir):
    o = _base(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id").withColumn("k", F.col("o_custkey").cast("double"))
    return rounded(report.target_distribution(BlockTable(o, {"a": ("k",)}, "o_totalprice")))


ODD = "q AS (SELECT s_suppkey AS row_id, CASE WHEN s_acctbal > 3000 THEN s_acctbal END AS x, 1.0::DOUBLE AS k, s_nationkey::VARCHAR AS y FROM supplier)"


@query("qc_issues", f"""WITH {ODD}, n AS (SELECT count(*) AS n, count(x) AS whole FROM q)
SELECT CASE WHEN (n - whole) / (2 * n) >= 0.2 THEN 'warning' ELSE 'info' END AS severity, 'missing_values' AS issue, printf('%.3f of all cells', (n - whole) / (2 * n)) AS detail FROM n WHERE n > whole
UNION ALL SELECT 'warning', 'few_complete_rows', whole || ' of ' || n FROM n WHERE whole / n < 0.8
UNION ALL SELECT 'warning', 'constant_numeric_features', '1'
UNION ALL SELECT 'warning', 'small_class', y FROM q GROUP BY y HAVING count(*) < 5""")
def qc_issues(spark, sf_dir):
    x = F.when(F.col("s_acctbal") > 3000, F.col("s_acctbal"))
    q = _base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), x.alias("x"), F.lit(1.0).alias("k"), F.col("s_nationkey").cast("string").alias("y"))
    return report.issues(BlockTable(q, {"a": ("x",), "b": ("k",)}, "y", "classif"))


@query("from_flat", "SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier")
def from_flat(spark, sf_dir):
    s = _base(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double"))
    return tables.from_flat(s, {"money": ["s_acctbal"], "place": ["s_nationkey"]}, row_id="s_suppkey").block_data()


@query("block_project", f"WITH {ORDERS} SELECT row_id, p_size, p_retailprice, c_acctbal, s_acctbal FROM o")
def block_project(spark, sf_dir):
    return orders_design(spark, sf_dir).block_data("part", "party")


@query("row_subset", f"WITH {ORDERS} SELECT row_id, l_quantity, l_returnflag FROM o WHERE l_quantity > 45")
def row_subset(spark, sf_dir):
    return orders_design(spark, sf_dir).filter("l_quantity > 45").df.select("row_id", "l_quantity", "l_returnflag")


@query("block_features", "SELECT unnest(['c_mktsegment.BUILDING', 'c_mktsegment.FURNITURE', 'c_mktsegment.HOUSEHOLD', 'c_mktsegment.MACHINERY']) AS feature")
def block_features(spark, sf_dir):
    c = _base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_mktsegment")
    t = preprocess.Encode()
    table = BlockTable(c, {"a": ("c_acctbal",), "b": ("c_mktsegment",)})
    return spark.createDataFrame([(x,) for x in t.fit(table).transform(table).block_columns("c_mktsegment")], "feature string")


def _shared(spark: SparkSession) -> str:
    """A new folder where driver and executors can write; a temporary one only where both are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="blockloom-")
    return f"{at.rstrip('/')}/core-{os.urandom(8).hex()}"


def _stored_orders(spark: SparkSession, sf_dir: str, *cols: str) -> BlockTable:
    """The orders design (row id and cols, without blocks, if cols are given), written to the shared folder once: a fit reads it several times, and its joins shuffle more than it holds.

    On a cluster without a shared folder it stays a query.
    """
    t = orders_design(spark, sf_dir)
    df = t.df.select(t.row_id, *cols) if cols else t.df
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local["):
        at = _shared(spark)
        df.write.parquet(at)
        df = spark.read.schema(df.schema).parquet(at)
    return BlockTable(df, {}) if cols else t.with_df(df)


@query("csv_round_trip", "SELECT s_suppkey, s_acctbal, s_nationkey || ';' || s_suppkey AS keys FROM supplier")
def csv_round_trip(spark, sf_dir):
    s = _base(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.array("s_nationkey", "s_suppkey").alias("keys"))
    at = _shared(spark)
    tables.write_table(s, at, "csv")
    return spark.read.schema("s_suppkey bigint, s_acctbal double, keys string").csv(at, header=True)


@query("run_log", "SELECT 'r1' AS run_id, 'second' AS content UNION ALL SELECT 'r2', 'third'")
def run_log(spark, sf_dir):
    log = tables.RunLog(spark, _shared(spark))
    for run, content in (("r1", "first"), ("r1", "second"), ("r2", "third")):
        log.append(run, "model", content)
    return spark.createDataFrame([(r, log.last("model", r)) for r in ("r1", "r2")], "run_id string, content string")


@query("from_blocks", "SELECT c_custkey AS row_id, c_acctbal AS money__c_acctbal, c_nationkey AS place__c_nationkey, c_mktsegment AS target FROM customer")
def from_blocks(spark, sf_dir):
    c = _base(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_id")
    return tables.from_blocks({"money": c.select("row_id", "c_acctbal"), "place": c.select("row_id", "c_nationkey")}, "row_id", c.select("row_id", "c_mktsegment")).df


@query("synthetic_tasks")
def synthetic_tasks(spark, sf_dir):
    return tables.synthetic(spark, task_type="classif").df


@query("union_rows", "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_rows(spark, sf_dir):
    return tables.union_rows(_base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment"), _base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("melt", "SELECT s_suppkey, unnest(['s_nationkey', 's_acctbal']) AS feature, unnest([s_nationkey::DOUBLE, s_acctbal]) AS value FROM supplier")
def melt(spark, sf_dir):
    return tables.melted(_base(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("pivot", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N, count(*) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY l_linestatus")
def pivot(spark, sf_dir):
    return tables.spread(_base(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"])


# -- preprocessing -------------------------------------------------------------------------------


def _scaled(method: str) -> str:
    cells = []
    for cols in tables.ORDERS_BLOCKS.values():
        ssq = "sqrt(" + " + ".join(f"sum({c} * {c}) OVER ()" for c in cols) + ")"
        for c in cols:
            value = {"unit_ssq": f"{c} / ({ssq} * sqrt({len(cols)}))", "feature_sd": f"{c} / (stddev_samp({c}) OVER () * sqrt({len(cols)}))", "feature_zscore": f"({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () * sqrt({len(cols)}))"}[method]
            cells.append(f"{r(('1000 * ' if method == 'unit_ssq' else '') + value)} AS {c}")
    return f"WITH {ORDERS} SELECT row_id, {', '.join(cells)} FROM o"


for _method in ("unit_ssq", "feature_sd", "feature_zscore"):

    @query(f"scale_{_method}", _scaled(_method))
    def scale(spark, sf_dir, method=_method):
        t = _stored_orders(spark, sf_dir)
        got = preprocess.BlockScaling(method).fit(t).transform(t).df
        return rounded(got.select("row_id", *[(F.col(c) * (1000 if method == 'unit_ssq' else 1)).alias(c) for c in COLUMNS]))


_site = ", ".join(f"{r(f'{c} - avg({c}) OVER (PARTITION BY r_name) + avg({c}) OVER ()')} AS {c}" for c in COLUMNS)


@query("site_partial", f"WITH {ORDERS} SELECT row_id, {_site} FROM o")
def site_partial(spark, sf_dir):
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.PartialCorrection("r_name").fit(t).transform(t).df.select("row_id", *COLUMNS))


_flag = "FILTER (WHERE l_returnflag = 'A')"
_controls = ", ".join(r(f"{c} - avg({c}) {_flag} OVER (PARTITION BY r_name) + avg({c}) {_flag} OVER ()") + f" AS {c}" for c in COLUMNS)


@query("site_partial_subgroup", f"WITH {ORDERS} SELECT row_id, {_controls} FROM o")
def site_partial_subgroup(spark, sf_dir):
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.PartialCorrection("r_name", subgroup=("l_returnflag", ("A",))).fit(t).transform(t).df.select("row_id", *COLUMNS))


_pooled = ", ".join(f"sqrt(sum((n - 1) * v_{c}) / sum(n)) AS s_{c}, sum(n * m_{c}) / sum(n) AS a_{c}" for c in COLUMNS)
_batches = ", ".join(f"avg({c}) AS m_{c}, var_samp({c}) AS v_{c}" for c in COLUMNS)
_plain = ", ".join(r(f"({c} - m_{c}) / sqrt(v_{c}) * s_{c} + a_{c}") + f" AS {c}" for c in COLUMNS)


@query("site_combat_plain", f"WITH {ORDERS}, b AS (SELECT r_name, count(*) AS n, {_batches} FROM o GROUP BY 1), w AS (SELECT {_pooled} FROM b) SELECT row_id, {_plain} FROM o JOIN b USING (r_name), w")
def site_combat_plain(spark, sf_dir):
    """Without shrinkage, where SQL can follow."""
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.ComBat("r_name", eb=False).fit(t).transform(t).df.select("row_id", *COLUMNS))


@query("site_partial_covariates")
def site_partial_covariates(spark, sf_dir):
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.PartialCorrection("r_name", ("c_mktsegment",), ridge=1.0).fit(t).transform(t).df.select("row_id", *COLUMNS))


@query("site_combat")
def site_combat(spark, sf_dir):
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.ComBat("r_name").fit(t).transform(t).df.select("row_id", *COLUMNS))


@query("site_quantile_repair")
def site_quantile_repair(spark, sf_dir):
    t = _stored_orders(spark, sf_dir)
    return rounded(preprocess.QuantileRepair("r_name").fit(t).transform(t).df.select("row_id", *COLUMNS))


_levels = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("encode", "SELECT c_custkey AS row_id, c_acctbal, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"c_mktsegment.{v}\"" for v in _levels) + " FROM customer")
def encode(spark, sf_dir):
    c = _base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_mktsegment")
    t = BlockTable(c, {"a": ("c_acctbal",), "b": ("c_mktsegment",)})
    return preprocess.Encode().fit(t).transform(t).df


@query("label_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('N') GROUP BY 1")
def label_filter(spark, sf_dir):
    t = BlockTable(_stored_orders(spark, sf_dir, "l_returnflag").df, {}, "l_returnflag", "classif")
    return preprocess.LabelFilter(("N",), invert=True).fit(t).transform(t).df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("suffix", "SELECT s_suppkey AS row_id, s_acctbal AS s_acctbal_sfx FROM supplier")
def suffix(spark, sf_dir):
    t = BlockTable(_base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_acctbal"), {"a": ("s_acctbal",)})
    return preprocess.Suffix().fit(t).transform(t).df


@query("resolve_blocks", f"WITH {ORDERS} SELECT unnest([{', '.join(repr(c) for c in COLUMNS)}]) AS feature, unnest([{', '.join(f'var_samp({c}) > 1e-12' for c in COLUMNS)}]) AS kept FROM o")
def resolve_blocks(spark, sf_dir):
    t = orders_design(spark, sf_dir)
    kept = t.resolved().columns
    return spark.createDataFrame([(c, c in kept) for c in t.columns], "feature string, kept boolean")


# -- aggregates, ranks, correlations -------------------------------------------------------------

_four = ("l_quantity", "l_discount", "p_retailprice", "c_acctbal")


@query("gram", f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) / 1e6, 4) + 0.0 AS g FROM o" for a in _four for b in _four))
def gram(spark, sf_dir):
    m = moments(orders_design(spark, sf_dir).df, _four)
    got = spark.createDataFrame([(a, b, float(m.g[i, j]) / 1e6) for i, a in enumerate(_four) for j, b in enumerate(_four)], "a string, b string, g double")
    return got.withColumn("g", F.round("g", 4) + 0.0)


@query("average_rank", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0::DOUBLE AS s_nationkey FROM supplier")
def average_rank(spark, sf_dir):
    return evaluate.ranked(_base(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"])


_pairs = [(a, b) for i, a in enumerate(_four) for b in _four[i + 1 :]]


@query("pearson", f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM o" for a, b in _pairs))
def pearson(spark, sf_dir):
    return rounded(evaluate.correlation_table(orders_design(spark, sf_dir).df, list(_four)))


_rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _four)


@query("spearman", f"WITH {ORDERS}, k AS (SELECT {_rk} FROM o) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM k" for a, b in _pairs))
def spearman(spark, sf_dir):
    return rounded(evaluate.correlation_table(_stored_orders(spark, sf_dir, *_four).df, list(_four), "spearman"))


@query("concordance", f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r(f'corr({a}, {b})')} AS r, {r(f'2 * covar_samp({a}, {b}) / (var_samp({a}) + var_samp({b}) + (avg({a}) - avg({b})) ** 2)')} AS ccc, {r(f'regr_slope({b}, {a})')} AS slope FROM o" for a, b in _pairs))
def concordance(spark, sf_dir):
    return rounded(evaluate.concordance(orders_design(spark, sf_dir).df, _pairs))


@query("concordance_missing", f"WITH {ORDERS}, v AS (SELECT l_quantity AS a, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM o WHERE l_discount > 0.01 AND c_acctbal > 0 AND l_discount <> 0.05), w AS (SELECT a, b FROM v) SELECT 'a' AS a, 'b' AS b, count(*) AS n, {r('corr(w.a, w.b)')} AS r, {r('2 * covar_samp(w.a, w.b) / (var_samp(w.a) + var_samp(w.b) + (avg(w.a) - avg(w.b)) ** 2)')} AS ccc, {r('regr_slope(w.b, w.a)')} AS slope FROM w")
def concordance_missing(spark, sf_dir):
    d = F.col("l_discount")
    df = orders_design(spark, sf_dir).df.select(F.when((d > 0.01) & (d != 0.05), F.col("l_quantity")).when(d == 0.05, F.lit(float("nan"))).alias("a"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return rounded(evaluate.concordance(df, [("a", "b")]))


@query("mean_z_score", f"WITH {ORDERS} SELECT row_id, {r('((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () + (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()) / 2')} AS lc FROM o")
def mean_z_score(spark, sf_dir):
    return rounded(evaluate.mean_z_score(orders_design(spark, sf_dir).df, "row_id", ["l_quantity", "c_acctbal"], "lc"))


# -- projection and evaluation with stated weights -----------------------------------------------

_w = [{"line": [0.6, 0.0, 0.8, 0.0], "party": [0.8, -0.6]}, {"line": [0.0, 0.0, 0.6, 0.8], "party": [0.6, 0.8]}]
_p = [{"line": [0.5, 0.1, 0.7, 0.2], "party": [0.7, -0.5]}, {"line": [0.1, 0.2, 0.5, 0.7], "party": [0.5, 0.6]}]
_names = {"line": ("l_quantity", "l_discount", "l_tax", "p_size"), "party": ("c_acctbal", "s_acctbal")}


def _stated() -> Model:
    arrays = lambda rows: [{b: np.array(v) for b, v in x.items()} for x in rows]
    return Model(dict(_names), arrays(_w), arrays(_p), [0.0, 0.0], [{b: 0.0 for b in _names}] * 2, [0.0, 0.0], [float("nan")] * 2)


def _deflated() -> str:
    """CTEs that take components out one after another, with the scores of each."""
    every = [c for v in _names.values() for c in v]
    ctes, before = [ORDERS], "o"
    for k in range(2):
        scores = ", ".join(" + ".join(f"{c} * {x}" for c, x in zip(cols, _w[k][b], strict=True)) + f" AS LV{k + 1}_{b}" for b, cols in _names.items())
        kept = ["row_id", *every, *[f"LV{j + 1}_{b}" for j in range(k) for b in _names]]
        ctes.append(f"t{k} AS (SELECT {', '.join(kept)}, {scores} FROM {before})")
        left = ", ".join(f"{c} - LV{k + 1}_{b} * {y} AS {c}" for b, cols in _names.items() for c, y in zip(cols, _p[k][b], strict=True))
        ctes.append(f"d{k} AS (SELECT row_id, {left}, {', '.join(f'LV{j + 1}_{b}' for j in range(k + 1) for b in _names)} FROM t{k})")
        before = f"d{k}"
    return "WITH " + ", ".join(ctes)


@query("project", _deflated() + " SELECT row_id, " + ", ".join(f"{r(f'LV{k + 1}_{b}')} AS LV{k + 1}_{b}" for k in range(2) for b in _names) + " FROM d1")
def project(spark, sf_dir):
    t = orders_design(spark, sf_dir)
    cols = [c for v in _names.values() for c in v]
    return rounded(_stated().transform(t.df.select("row_id", *cols)))


@query("project_saved", _deflated() + " SELECT row_id, " + ", ".join(f"{r(f'LV{k + 1}_{b}')} AS LV{k + 1}_{b}" for k in range(2) for b in _names) + " FROM d1")
def project_saved(spark, sf_dir):
    at = _shared(spark)
    _stated().save(spark, at)
    return rounded(Model.load(spark, at).transform(orders_design(spark, sf_dir).df.select("row_id", *[c for v in _names.values() for c in v])))


@query("project_flipped", _deflated() + " SELECT row_id, " + ", ".join(f"{r(f'{-1 if k else 1} * LV{k + 1}_{b}')} AS LV{k + 1}_{b}" for k in range(2) for b in _names) + " FROM d1")
def project_flipped(spark, sf_dir):
    return rounded(_stated().flipped([1, -1]).transform(orders_design(spark, sf_dir).df.select("row_id", *[c for v in _names.values() for c in v])))


@query("append_scores", _deflated() + f" SELECT row_id, l_quantity, s_acctbal, {r('LV1_line')} AS LV1_line, {r('LV1_party')} AS LV1_party FROM t0")
def append_scores(spark, sf_dir):
    return rounded(_stated().transform(orders_design(spark, sf_dir), append=True).select("row_id", "l_quantity", "s_acctbal", "LV1_line", "LV1_party"))


def _stable_sql() -> str:
    """Scores under the stated weights, deflated by the loadings that these have on the rows themselves."""
    ctes, before, every = [ORDERS], "o", [c for v in _names.values() for c in v]
    for k in range(2):
        scores = ", ".join(" + ".join(f"{c} * {x}" for c, x in zip(cols, _w[k][b], strict=True)) + f" AS LV{k + 1}_{b}" for b, cols in _names.items())
        ctes.append(f"t{k} AS (SELECT {', '.join(['row_id', *every, *[f'LV{j + 1}_{b}' for j in range(k) for b in _names]])}, {scores} FROM {before})")
        left = ", ".join(f"{c} - LV{k + 1}_{b} * sum({c} * LV{k + 1}_{b}) OVER () / sum(LV{k + 1}_{b} * LV{k + 1}_{b}) OVER () AS {c}" for b, cols in _names.items() for c in cols)
        ctes.append(f"d{k} AS (SELECT row_id, {left}, {', '.join(f'LV{j + 1}_{b}' for j in range(k + 1) for b in _names)} FROM t{k})")
        before = f"d{k}"
    return "WITH " + ", ".join(ctes) + " SELECT row_id, " + ", ".join(f"{r(f'LV{k + 1}_{b}')} AS LV{k + 1}_{b}" for k in range(2) for b in _names) + " FROM d1"


@query("stable_scores", _stable_sql())
def stable_scores(spark, sf_dir):
    cols = [c for v in _names.values() for c in v]
    t, model = _stored_orders(spark, sf_dir, *cols), _stated()
    stable = model.with_stable("ci", model.weights, moments(t.df, cols))
    return rounded(stable.transform(t.df.select("row_id", *cols), "stable_ci"))


_scores = [f"LV{k + 1}_{b}" for k in range(2) for b in _names]
_score_pairs = [(a, b) for i, a in enumerate(_scores) for b in _scores[i + 1 :]]


@query("plot_heatmap", _deflated() + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM d1" for a, b in _score_pairs))
def plot_heatmap(spark, sf_dir):
    return rounded(report.heatmap_data(_stated(), orders_design(spark, sf_dir)))


@query("plot_network", _deflated() + ", e AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM d1" for a, b in _score_pairs) + ") SELECT * FROM e WHERE abs(r) >= 0.05")
def plot_network(spark, sf_dir):
    return rounded(report.network_data(_stated(), orders_design(spark, sf_dir), 0.05))


@query("plot_scores", _deflated() + f" SELECT 'LV1_line' AS a, 'LV1_party' AS b, count(*) AS n, {r('corr(LV1_line, LV1_party)')} AS r, {r('2 * covar_samp(LV1_line, LV1_party) / (var_samp(LV1_line) + var_samp(LV1_party) + (avg(LV1_line) - avg(LV1_party)) ** 2)')} AS ccc, {r('regr_slope(LV1_party, LV1_line)')} AS slope FROM d1")
def plot_scores(spark, sf_dir):
    return rounded(report.scores_data(_stated(), orders_design(spark, sf_dir)))


_weight_rows = ", ".join(f"('{b}', '{c}', {x}::DOUBLE, {y}::DOUBLE)" for b, cols in _names.items() for c, x, y in zip(cols, _w[0][b], _p[0][b], strict=True))


@query("plot_weights", f"WITH v(block, feature, weight, loading) AS (VALUES {_weight_rows}) SELECT 'LC_01' AS component, block, feature, weight, loading, row_number() OVER (PARTITION BY block ORDER BY abs(weight) DESC, feature)::INT AS rank FROM v WHERE weight <> 0")
def plot_weights(spark, sf_dir):
    return report.weights_data(_stated(), spark)


_ev = [({"line": 0.25, "party": 0.5}, 0.375), ({"line": 0.125, "party": 0.25}, 0.1875)]


def _explained() -> Model:
    model = _stated()
    model.ev_block, model.ev_comp, model.objectives = [x for x, _ in _ev], [x for _, x in _ev], [0.75, 0.5]
    return model


_ev_rows = ", ".join(f"('LC_{k + 1:02d}', '{b}', {x}::DOUBLE)" for k, (own, whole) in enumerate(_ev) for b, x in {**own, "total": whole}.items())


@query("plot_variance", f"WITH v(component, block, ev) AS (VALUES {_ev_rows}) SELECT component, block, ev, sum(ev) OVER (PARTITION BY block ORDER BY component) AS ev_cumulative FROM v")
def plot_variance(spark, sf_dir):
    return report.variance_data(_explained(), spark)


@query("plot_scree", "SELECT * FROM (VALUES ('LC_01', 0.75::DOUBLE, 0.75::DOUBLE), ('LC_02', 0.5::DOUBLE, 1.25::DOUBLE)) v(component, objective, objective_cumulative)")
def plot_scree(spark, sf_dir):
    return report.scree_data(_explained(), spark)


@query("model_summary", "SELECT * FROM (VALUES ('LC_01', 0.75::DOUBLE, 0.375::DOUBLE, NULL::DOUBLE, 0.375::DOUBLE), ('LC_02', 0.5::DOUBLE, 0.1875::DOUBLE, NULL::DOUBLE, 0.5625::DOUBLE)) v(component, objective, ev, p_value, ev_cumulative)")
def model_summary(spark, sf_dir):
    return report.model_summary(_explained(), spark)["components"]


_ss = {b: " + ".join(f"sum({c} * {c})" for c in cols) for b, cols in _names.items()}


@query("oos_ev", _deflated() + ", " + ", ".join(f"s{i} AS (SELECT {', '.join(f'{v} AS {b}' for b, v in _ss.items())} FROM {t})" for i, t in enumerate(("o", "d0", "d1"))) + " " + " UNION ALL ".join(f"SELECT {k + 1} AS component, '{b}' AS block, {r(f'(s{k}.{b} - s{k + 1}.{b}) / s0.{b}')} AS ev FROM s0, s1, s2" for k in range(2) for b in _names))
def oos_ev(spark, sf_dir):
    payload = evaluate.evaluate(_stated(), orders_design(spark, sf_dir))
    return rounded(spark.createDataFrame([(k + 1, b, v) for k, row in enumerate(payload["ev_block"]) for b, v in row.items()], "component int, block string, ev double"))


@query("oos_correlation", _deflated() + " " + " UNION ALL ".join(f"SELECT {k + 1} AS component, {r(f'abs(corr(LV{k + 1}_line, LV{k + 1}_party))')} AS mac FROM d1" for k in range(2)))
def oos_correlation(spark, sf_dir):
    payload = evaluate.evaluate(_stated(), orders_design(spark, sf_dir))
    return rounded(spark.createDataFrame([(k + 1, v) for k, v in enumerate(payload["mac"])], "component int, mac double"))


_all = " + ".join(f"s{{0}}.{b}" for b in _names)


@query("measures", _deflated() + ", " + ", ".join(f"s{i} AS (SELECT {', '.join(f'{v} AS {b}' for b, v in _ss.items())} FROM {t})" for i, t in enumerate(("o", "d0", "d1"))) + f" SELECT 'mac' AS measure, {r('(abs(corr(LV1_line, LV1_party)) + abs(corr(LV2_line, LV2_party))) / 2')} AS score FROM d1 UNION ALL SELECT 'ev', {r(f'(({_all.format(0)}) - ({_all.format(2)})) / (2 * ({_all.format(0)}))')} FROM s0, s1, s2 UNION ALL SELECT 'block_ev', " + r(" + ".join(f"(s0.{b} - s2.{b}) / (4 * s0.{b})" for b in _names)) + " FROM s0, s1, s2")
def measures(spark, sf_dir):
    payload = evaluate.evaluate(_stated(), orders_design(spark, sf_dir))
    return rounded(spark.createDataFrame([(n, evaluate.measure(payload, n)["score"]) for n in ("mac", "ev", "block_ev")], "measure string, score double"))


# -- draws, folds, windows -----------------------------------------------------------------------

DRAWS = "d AS (SELECT l_suppkey % 40 AS replicate, 'LC_0' || (l_linenumber % 2 + 1) AS component, l_returnflag AS block, 'f' || (l_partkey % 7) AS feature, l_discount - 0.03 * (l_partkey % 7) AS weight FROM lineitem)"
SUMMARY = f"""WITH {DRAWS}, s AS (SELECT component, block, feature, avg(weight) AS mean, stddev_samp(weight) AS sd, quantile_cont(weight, 0.025) AS low, quantile_cont(weight, 0.975) AS high, count(*) FILTER (WHERE abs(weight) > 1e-12) AS n_selected FROM d GROUP BY ALL),
e AS (SELECT component, count(DISTINCT replicate) AS n_eff FROM d GROUP BY 1),
y AS (SELECT s.component, block, feature, mean, sd, low, high, n_selected, n_eff, n_selected / n_eff AS freq FROM s JOIN e ON s.component = e.component)"""


def _draws(spark, sf_dir) -> DataFrame:
    k = F.col("l_partkey") % 7
    return _base(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("replicate"), F.concat(F.lit("LC_0"), F.col("l_linenumber") % 2 + 1).alias("component"), F.col("l_returnflag").alias("block"), F.concat(F.lit("f"), k).alias("feature"), (F.col("l_discount") - 0.03 * k).alias("weight"))


def _summary(spark, sf_dir) -> DataFrame:
    d = _draws(spark, sf_dir)
    return inference.summarize_draws(d, d.select("component", "block", "feature").distinct())


@query("draws_summary", SUMMARY + f" SELECT component, block, feature, {r('mean')} AS mean, {r('sd')} AS sd, {r('low')} AS low, {r('high')} AS high, n_selected, n_eff, {r('freq')} AS freq FROM y")
def draws_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir))


@query("stable_ci", SUMMARY + f" SELECT component, block, feature, {r('mean')} AS mean FROM y WHERE (low >= 0 OR high <= 0) AND abs(mean) > 1e-3")
def stable_ci(spark, sf_dir):
    return rounded(inference.select_stable(_summary(spark, sf_dir)).select("component", "block", "feature", "mean"))


@query("interval_with_zero", SUMMARY + f" SELECT component, block, feature, {r('low')} AS low, {r('high')} AS high FROM y WHERE low <= 0 AND high >= 0")
def interval_with_zero(spark, sf_dir):
    return rounded(_summary(spark, sf_dir).where(inference.overlaps_zero()).select("component", "block", "feature", "low", "high"))


@query("latent_correlation", f"""WITH {DRAWS}, w AS (SELECT component, block, feature, abs(avg(weight)) AS w FROM d GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY component, block ORDER BY w, feature) AS rk FROM w),
p AS (SELECT a.component, a.block, b.block AS other, corr(a.w, b.w) AS r, corr(a.rk, b.rk) AS s FROM k a JOIN k b ON a.component = b.component AND a.feature = b.feature AND a.block < b.block GROUP BY ALL)
SELECT {r('avg(abs(r))')} AS pearson, {r('avg(abs(s))')} AS spearman, {r('sqrt(sum(r * r))')} AS frobenius FROM p""")
def latent_correlation(spark, sf_dir):
    w = _draws(spark, sf_dir).groupBy("component", "block", "feature").agg(F.avg("weight").alias("weight"))
    got = (inference.latent_correlation(w), inference.latent_correlation(w, "spearman"), inference.latent_correlation(w, metric="frobenius"))
    return rounded(spark.createDataFrame([got], "pearson double, spearman double, frobenius double"))


@query("stable_frequency", SUMMARY + f" SELECT component, block, feature, {r('freq')} AS freq FROM y WHERE freq >= 0.6")
def stable_frequency(spark, sf_dir):
    return rounded(inference.select_stable(_summary(spark, sf_dir), "frequency").select("component", "block", "feature", "freq"))


@query("top_features", SUMMARY + f" SELECT component, block, feature, {r('mean')} AS mean, row_number() OVER (PARTITION BY component, block ORDER BY abs(mean) DESC, feature)::INT AS rank FROM y QUALIFY rank <= 3")
def top_features(spark, sf_dir):
    return rounded(inference.top_features(_summary(spark, sf_dir), 3).select("component", "block", "feature", "mean", "rank"))


_REFERENCE = f"WITH {DRAWS}, ref AS (SELECT component, block, feature, avg(weight) AS ref FROM d WHERE replicate < 20 GROUP BY ALL)"


@query("bootstrap_means", _REFERENCE + f""", j AS (SELECT d.replicate, d.block, d.feature, d.weight, ref.ref FROM d JOIN ref USING (component, block, feature) WHERE d.component = 'LC_01'),
s AS (SELECT replicate, block, CASE WHEN corr(weight, ref) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM j GROUP BY ALL), t AS (SELECT block, feature, weight * sign AS w FROM j JOIN s USING (replicate, block)),
y AS (SELECT block, feature, avg(w) AS mean, quantile_cont(w, 0.025) AS low, quantile_cont(w, 0.975) AS high, avg(CASE WHEN abs(w) > 1e-12 THEN 1.0 ELSE 0.0 END) AS freq FROM t GROUP BY ALL)
SELECT block, feature, {r('mean')} AS mean, {r('low')} AS low, {r('high')} AS high, {r('freq')} AS freq FROM y WHERE freq >= 0.5""")
def bootstrap_means(spark, sf_dir):
    d = _draws(spark, sf_dir)
    reference = d.where("replicate < 20").groupBy("component", "block", "feature").agg(F.avg("weight").alias("weight"))
    return rounded(report.draw_means(d, reference, "LC_01", method="frequency"))


@query("weight_intervals", f"""WITH {DRAWS}, w AS (SELECT replicate AS model, component, block, feature, avg(weight) AS weight FROM d WHERE replicate < 4 GROUP BY ALL),
j AS (SELECT w.*, f.weight AS ref FROM w JOIN w f ON f.model = 0 AND f.component = w.component AND f.block = w.block AND f.feature = w.feature),
s AS (SELECT model, component, block, CASE WHEN sum(weight * ref) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM j GROUP BY ALL),
y AS (SELECT component, block, feature, count(*) AS n, avg(weight * sign) AS mean, 1.96 * coalesce(stddev_samp(weight * sign), 0) / sqrt(count(*)) AS half FROM j JOIN s USING (model, component, block) GROUP BY ALL)
SELECT component, block, feature, n, {r('mean')} AS mean, {r('mean - half')} AS low, {r('mean + half')} AS high FROM y""")
def weight_intervals(spark, sf_dir):
    d = _draws(spark, sf_dir)
    each = [d.where(F.col("replicate") == i).groupBy("component", "block", "feature").agg(F.avg("weight").alias("weight")) for i in range(4)]
    return rounded(report.weight_intervals(each))


FOLDS = "f AS (SELECT l_linenumber AS fold, 'LC_0' || (l_suppkey % 3 + 1) AS component, count(*)::INT AS n_test, avg(l_discount) AS mac, avg(l_tax) AS ev, NULL::DOUBLE AS ev_block, NULL AS block FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_linenumber, 'LC_0' || (l_suppkey % 3 + 1), count(*)::INT, NULL, NULL, avg(l_tax), l_returnflag FROM lineitem GROUP BY 1, 2, l_returnflag)"


def _folds(spark, sf_dir) -> DataFrame:
    keys = [F.col("l_linenumber").alias("fold"), F.concat(F.lit("LC_0"), F.col("l_suppkey") % 3 + 1).alias("component")]
    li, n = _base(spark, sf_dir, "lineitem"), F.count("*").cast("int").alias("n_test")
    whole = li.groupBy(*keys).agg(n, F.avg("l_discount").alias("mac"), F.avg("l_tax").alias("ev"))
    part = li.groupBy(*keys, F.col("l_returnflag").alias("block")).agg(n, F.avg("l_tax").alias("ev_block"))
    return whole.unionByName(part, allowMissingColumns=True)


@query("fold_means", f"WITH {FOLDS} SELECT component, block, count(DISTINCT fold) AS n_folds, {r('sum(sqrt(n_test) * mac) / sum(sqrt(n_test)) FILTER (WHERE mac IS NOT NULL)')} AS mac, {r('stddev_samp(mac)')} AS mac_sd, {r('coalesce(sum(sqrt(n_test) * ev), sum(sqrt(n_test) * ev_block)) / sum(sqrt(n_test))')} AS ev FROM f GROUP BY component, block")
def fold_means(spark, sf_dir):
    return rounded(evaluate.aggregate_folds(_folds(spark, sf_dir)))


@query("metric_summary", f"WITH {FOLDS} SELECT component, {r('avg(mac)')} AS mean, {r('stddev_samp(mac)')} AS sd, {r('quantile_cont(mac, 0.5)')} AS median, {r('quantile_cont(mac, 0.05)')} AS q05, {r('quantile_cont(mac, 0.95)')} AS q95, {r('min(mac)')} AS min, {r('max(mac)')} AS max, count(mac) AS n, count(*) AS n_total, count(*) - count(mac) AS n_failed FROM f GROUP BY component")
def metric_summary(spark, sf_dir):
    return rounded(evaluate.metric_summary(_folds(spark, sf_dir), "mac", ("component",)))


@query("fisher_p", f"WITH {FOLDS}, k AS (SELECT component, count(*) AS n, -sum(ln(mac)) AS x FROM f WHERE block IS NULL GROUP BY 1) SELECT component, {r('exp(-x) * list_sum(list_transform(range(0, n), lambda i: x ** i / factorial(i::INT)))')} AS p_value FROM k")
def fisher_p(spark, sf_dir):
    folds = _folds(spark, sf_dir).withColumn("p_value", F.col("mac"))
    return rounded(spark.createDataFrame(list(evaluate.combine_p(folds, "fisher").items()), "component string, p_value double"))


@query("running", f"WITH {FOLDS} SELECT component, fold, {r('sum(ev) OVER (PARTITION BY component ORDER BY fold ROWS UNBOUNDED PRECEDING)')} AS ev_cumulative, {r('max(mac) OVER (PARTITION BY component ORDER BY fold ROWS UNBOUNDED PRECEDING)')} AS mac_monotone FROM f WHERE block IS NULL")
def running(spark, sf_dir):
    got = evaluate.running(_folds(spark, sf_dir).where("block is null"), "fold", ("ev",), ("mac",), ("component",))
    return rounded(got.select("component", "fold", "ev_cumulative", "mac_monotone"))


# -- nearest neighbours --------------------------------------------------------------------------

NEIGHBOURS = """WITH g AS (SELECT max(c_acctbal) - min(c_acctbal) AS span FROM customer),
p AS (SELECT s_suppkey AS test_id, c_custkey AS train_id, c_mktsegment, c_nationkey, (0.0 + abs(s_acctbal - c_acctbal) / span + CASE WHEN s_nationkey = c_nationkey THEN 0.0 ELSE 1.0 END) / 2 AS dist FROM supplier, customer, g),
nn AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS nn FROM p QUALIFY nn <= 5)"""


def _sides(spark, sf_dir):
    test = _base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("test_id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    train = _base(spark, sf_dir, "customer").select(F.col("c_custkey").alias("train_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("string").alias("nation"), "c_mktsegment", "c_nationkey")
    return test, train


@query("knn_neighbours", NEIGHBOURS + f" SELECT test_id, train_id, {r('dist')} AS dist, nn::INT AS nn FROM nn")
def knn_neighbours(spark, sf_dir):
    test, train = _sides(spark, sf_dir)
    return rounded(knn.neighbours(test, train, ["balance"], ["nation"]))


_segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


_most = "greatest(" + ", ".join(f"p{i}" for i in range(len(_segments))) + ")"


@query("knn_classify", NEIGHBOURS + ", pr AS (SELECT test_id, " + ", ".join(f"coalesce(sum(1 / (dist + 1e-12)) FILTER (WHERE c_mktsegment = '{v}'), 0) / sum(1 / (dist + 1e-12)) AS p{i}" for i, v in enumerate(_segments)) + " FROM nn GROUP BY test_id) SELECT test_id, " + ", ".join(f"{r(f'p{i}')} AS prob_{v}" for i, v in enumerate(_segments)) + ", CASE " + " ".join(f"WHEN p{i} > {_most} - 1e-9 THEN '{v}'" for i, v in enumerate(_segments)) + " END AS response FROM pr")
def knn_classify(spark, sf_dir):
    test, train = _sides(spark, sf_dir)
    return rounded(knn.classify(test, train, "c_mktsegment", ["balance"], ["nation"], levels=_segments))


@query("knn_regress", NEIGHBOURS + f" SELECT test_id, {r('avg(c_nationkey)')} AS response, {r('sqrt(greatest(avg(c_nationkey * c_nationkey) - avg(c_nationkey) ** 2, 0))')} AS se FROM nn GROUP BY test_id")
def knn_regress(spark, sf_dir):
    test, train = _sides(spark, sf_dir)
    return rounded(knn.regress(test, train, "c_nationkey", ["balance"], ["nation"], weights="uniform"))


@query("knn_impute", f"""WITH s AS (SELECT s_suppkey AS row_id, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance, s_nationkey::VARCHAR AS nation FROM supplier),
p AS (SELECT a.row_id, b.row_id AS other, b.balance, CASE WHEN a.nation = b.nation THEN 0.0 ELSE 1.0 END AS dist FROM s a JOIN s b ON a.balance IS NULL AND b.balance IS NOT NULL),
nn AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, other) <= 5),
fill AS (SELECT row_id, sum(balance / (dist + 1e-12)) / sum(1 / (dist + 1e-12)) AS value FROM nn GROUP BY row_id)
SELECT s.row_id, {r('coalesce(balance, value)')} AS balance, nation FROM s LEFT JOIN fill ON s.row_id = fill.row_id""")
def knn_impute(spark, sf_dir):
    s = _base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    t = BlockTable(s, {"a": ("balance",), "b": ("nation",)})
    return rounded(knn.KnnImpute(5).fit(t).transform(t).df)


# -- fits, tests, selection, tuning --------------------------------------------------------------


def _ready(spark, sf_dir) -> BlockTable:
    t = embeddings_design(spark, sf_dir)
    return preprocess.BlockScaling("feature_zscore", False).fit(t).transform(t)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a three-component model of the embeddings' blocks."""
    t = _ready(spark, sf_dir)
    return rounded(MBsPLS(3).fit(t).transform(t))


query("mbspls_scores")(flagship)


@query("mbspls_c_matrix")
def mbspls_c_matrix(spark, sf_dir):
    t = _ready(spark, sf_dir)
    return rounded(MBsPLS(2, np.full((4, 2), 2.0), metric="frobenius").fit(t).weights_table(spark))


@query("mbspls_permuted")
def mbspls_permuted(spark, sf_dir):
    return rounded(MBsPLS(2, permutations=20).fit(_ready(spark, sf_dir)).components_table(spark))


@query("mbsplsxy_scores")
def mbsplsxy_scores(spark, sf_dir):
    t = _ready(spark, sf_dir)
    return rounded(MBsPLSXY(2).fit(t).transform(t))


@query("mbspca_scores")
def mbspca_scores(spark, sf_dir):
    t = _ready(spark, sf_dir)
    return rounded(MBsPCA(2).fit(t).transform(t))


@query("oos_permutation")
def oos_permutation(spark, sf_dir):
    t = _ready(spark, sf_dir)
    got = inference.permutation_test(MBsPLS(1).fit(t), t, 100)
    return spark.createDataFrame([(k + 1, x["stat"], x["p_value"]) for k, x in enumerate(got)], "component int, stat double, p_value double")


@query("oos_bootstrap")
def oos_bootstrap(spark, sf_dir):
    t = _ready(spark, sf_dir)
    got = inference.bootstrap_test(MBsPLS(1).fit(t), t, 100)
    return spark.createDataFrame([(k + 1, x["stat"], x["low"], x["high"]) for k, x in enumerate(got)], "component int, stat double, low double, high double")


@query("stability_selection")
def stability_selection(spark, sf_dir):
    t, e = _ready(spark, sf_dir), MBsPLS(1)
    return rounded(inference.StabilitySelection(30).fit(t, e.fit(t), e)[1])


@query("tuned_sparsity")
def tuned_sparsity(spark, sf_dir):
    _, log = tuning.SequentialTuner(2, budget=10).fit(_ready(spark, sf_dir))
    return spark.createDataFrame([(x["component"], float(x["score"]), [float(v) for v in x["c"]]) for x in log], "component int, score double, c array<double>")


@query("nested_cv")
def nested_cv(spark, sf_dir):
    rows = tuning.NestedCV(outer=3, tuner=tuning.SequentialTuner(1, budget=6)).run(embeddings_design(spark, sf_dir))
    return tuning.NestedCV.collect(spark, rows)[0]


def _invariants(model: Model, table: BlockTable, spark: SparkSession) -> DataFrame:
    """component, block: whether weights are a unit, within their bound and non-negative in explained variance, and whether scores of different components are uncorrelated."""
    got, rows = model.transform(table), []
    both = got.agg(*[F.sum(F.col(f"`{model.prefix}1_{b}`") * F.col(f"`{model.prefix}2_{b}`")).alias(f"c{i}") for i, b in enumerate(table.blocks)], *[F.sum(F.col(f"`{model.prefix}{k}_{b}`") ** 2).alias(f"s{k}{i}") for i, b in enumerate(table.blocks) for k in (1, 2)]).first()
    for k, name in enumerate(model.names):
        for i, b in enumerate(table.blocks):
            w = model.weights[k][b]
            bound = float(model.c[list(model.blocks).index(b), k])
            apart = abs(both[f"c{i}"]) <= 1e-6 * max((both[f"s1{i}"] * both[f"s2{i}"]) ** 0.5, 1e-12)
            rows.append((name, b, bool(abs(np.linalg.norm(w) - 1) < 1e-6), bool(np.abs(w).sum() <= bound + 1e-6), bool(-1e-9 <= model.ev_block[k][b] <= 1 + 1e-9), bool(apart)))
    return spark.createDataFrame(rows, "component string, block string, unit boolean, bounded boolean, explained boolean, uncorrelated boolean")


INVARIANTS = "SELECT component, block, true AS unit, true AS bounded, true AS explained, true AS uncorrelated FROM (VALUES ('LC_01'), ('LC_02')) a(component), (VALUES ('b0'), ('b1'), ('b2'), ('b3')) b(block)"


@query("mbspls_invariants", INVARIANTS)
def mbspls_invariants(spark, sf_dir):
    t = _ready(spark, sf_dir)
    return _invariants(MBsPLS(2).fit(t), t, spark)


@query("mbspca_invariants", INVARIANTS.replace("LC_", "PC_"))
def mbspca_invariants(spark, sf_dir):
    t = _ready(spark, sf_dir)
    return _invariants(MBsPCA(2).fit(t), t, spark)


@query("pipeline_scores")
def pipeline_scores(spark, sf_dir):
    t = embeddings_design(spark, sf_dir)
    p = tuning.Pipeline([preprocess.BlockScaling()], MBsPLS(2), learner=tuning.kmeans(3)).fit(t)
    return p.transform(t).groupBy("cluster").agg(F.count("*").alias("n"))


def _stream_folder(spark, sf_dir, at) -> str:
    """A folder with the embeddings' files and no others: a stream reads folders."""
    _base(spark, sf_dir, "embeddings").write.parquet(f"{at}/in")
    return f"{at}/in"


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """Scores of the embeddings read as a stream, through a file sink in the shared folder."""
    t = embeddings_design(spark, sf_dir)
    model = MBsPLS(1).fit(t)
    at = _shared(spark)
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf_dir, at))
    cols = [F.col("embedding")[i].cast("double").alias(f"b{i // 16}_{i % 16}") for i in range(64)]
    scored = scoring.score_stream(source.select(F.col("vec_id").alias("row_id"), *cols), model).select("row_id", *[f"LV1_b{b}" for b in range(4)])
    scored.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{at}/out"))
