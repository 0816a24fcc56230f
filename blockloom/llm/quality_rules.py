"""Quality rules whose thresholds come from quantile sketches per language and source.

Every document gets a few integer measures.  A sketch of a measure is a histogram over
log-linear bins (a value keeps its leading six bits), so it is a table of counts: sketches merge
by adding counts, give the same quantiles in whatever order rows come, and a quantile is off by
at most a 32nd of its value.  Sketches are kept per (lang, source) and merged to those of the
language and of everything.  A group's quantiles are drawn towards its language's, and these
towards everything's, as if each had ``prior`` more documents like the wider group's; so there is
no size at which a group's thresholds change at once.

A rate may reach the ninth decile, widened by ``reach`` times its distance from the median.  The
mean size of words may lie outside the quartiles by ``reach`` times the distance between them.  No
distance has a least value.  Instead, what chance may add in a text of its size doesn't count: the
square root of the events allowed times ``reach`` and as many events as ``reach`` says, or ``reach``
standard errors of a mean of word sizes that spread by one character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

SYMBOLS = "#*$%&|<>"
#: Measure, what is counted, of how many, and the factor that makes it a whole number.
RATES = (
    ("symbol_rate", "n_symbols", "word_chars", 1000),
    ("dup_line_rate", "n_dup_lines", "n_word_lines", 1000),
    ("repeat_rate", "n_repeat_words", "n_words", 1000),
)
#: What one event adds to the count: a window of three words that is found twice, six words.
EVENT = {"n_symbols": 1, "n_dup_lines": 1, "n_repeat_words": 6}
MEAN = ("word_size", "word_chars", "n_words", 100)
#: Name, numerator and denominator of the quantiles that sketches give.
QUANTILES = (("q25", 1, 4), ("q50", 1, 2), ("q75", 3, 4), ("q90", 9, 10))


def text_measures(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines of a text."""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line and WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            until = 0  # words before it are counted
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, lines


def measured(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """One row a document: doc_id, lang, source, row_key (a long column named by key, or null) and the counts of text_measures."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_measures(x.as_py() or "") for x in batch.column(4)]
            cols = {k: batch.column(i) for i, k in enumerate(("doc_id", "lang", "source", "row_key"))}
            cols |= {k: pa.array([f[i] for f in found], pa.int64()) for i, k in enumerate(names)}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id bigint, lang string, source string, row_key bigint, " + ", ".join(f"{k} bigint" for k in names)
    own = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"))]
    carried = (F.lit(None) if key is None else F.col(f"`{key}`")).cast("bigint").alias("row_key")
    return docs.select(*own, carried, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _ratio(top: str, under: str, factor: int) -> Column:
    """Null where there is nothing to divide by."""
    return F.expr(f"({factor} * {top}) div nullif({under}, 0)")


def bin_of(value: Column) -> Column:
    """The least value of the bin: all but the leading six bits set to zero."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.expr("1").cast("bigint") * 0 + F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(stats: DataFrame) -> DataFrame:
    """Mergeable sketches: counts per (lang, source, measure, bin); partial sums come before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _ratio(*rule).alias("value")) for k, *rule in (*RATES, MEAN)]))
    rows = stats.where("n_words > 0").select("lang", "source", pairs.alias("m")).select("lang", "source", "m.measure", bin_of(F.col("m.value")).alias("bin"))
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """The quantiles' bins of the sketches merged up to keys, with the number of documents."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    found = [F.min(F.when(d * F.col("upto") >= n * F.col("total"), F.col("bin"))).alias(q) for q, n, d in QUANTILES]
    return run.groupBy(*keys, "measure").agg(*found, F.max("total").alias("total"))


def thresholds(sketch: DataFrame, prior: int, reach: int) -> DataFrame:
    """One row per (lang, source): hi_ of each rate, and lo_ and hi_ of the mean, by its group's quantiles drawn towards the wider groups'."""
    keys, names = ("lang", "source"), [q for q, *_ in QUANTILES]
    wide = lambda by, df: df.select(*by, "measure", *[F.col(c).alias(f"wide_{c}") for c in names])

    def drawn(own: DataFrame, wider: DataFrame, *by: str) -> DataFrame:
        a, b = own.alias("a"), wider.alias("b")
        same = F.col("a.measure") == F.col("b.measure")
        for k in by:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        towards = [F.expr(f"(total * {q} + {prior} * wide_{q}) div (total + {prior})").alias(q) for q in names]
        return a.join(b, same).select(*[f"a.{k}" for k in keys if k in own.columns], "a.measure", "total", *towards)

    by_lang = drawn(quantiles(sketch, "lang"), wide((), quantiles(sketch)))
    group = drawn(quantiles(sketch, *keys), wide(("lang",), by_lang), "lang")
    of = lambda k, value, name: F.max(F.when(F.col("measure") == k, value)).alias(name)
    rate = F.col("q90") + reach * (F.col("q90") - F.col("q50"))
    spread = reach * (F.col("q75") - F.col("q25"))
    return group.groupBy(*keys).agg(
        *[of(k, rate, f"hi_{k}") for k, *_ in RATES],
        of(MEAN[0], F.col("q25") - spread, f"lo_{MEAN[0]}"),
        of(MEAN[0], F.col("q75") + spread, f"hi_{MEAN[0]}"),
    )


def _outside(reach: int) -> list[str]:
    """SQL, which Spark and DuckDB share, for each rule that rejects a document; squares are taken of floating-point numbers."""
    out = []
    for k, top, under, factor in RATES:
        over = f"({factor} * {top} - {under} * hi_{k} - {factor * reach * EVENT[top]})"
        out.append(f"({over} > 0 AND CAST({over} AS DOUBLE) * {over} > CAST({factor * reach * reach * EVENT[top]} AS DOUBLE) * {under} * hi_{k})")
    k, top, under, factor = MEAN
    for over in (f"(({factor} * {top}) {{div}} {under} - hi_{k})", f"(lo_{k} - ({factor} * {top}) {{div}} {under})"):
        out.append(f"({over} > 0 AND CAST({over} AS DOUBLE) * {over} * {under} > {(factor * reach) ** 2})")
    return out


def quality_rules(docs: DataFrame, text: str = "text", prior: int = 100, reach: int = 3, key: str | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and, if key names a long column, row_key.

    docs needs doc_id, text, lang and source; other columns are not read.  A null or empty text
    has no words and fails.  Null languages and sources form groups of their own, null doc_ids are
    judged like others.  Repeated rows count, and come out, as often as they stand there; ties lie
    in one bin and so on one side of a threshold.  An empty table gives an empty result.
    """
    stats = written(measured(docs, text, key), "quality-measures")
    limits = thresholds(sketches(stats), prior, reach)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    a, b = stats.alias("a"), limits.alias("b")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    outside = F.expr(" OR ".join(_outside(reach)).format(div="div"))
    # Without words a text has failed, and nothing is divided by zero.
    kept = F.when(failed, F.lit(False)).otherwise(~F.coalesce(outside, F.lit(True)))
    return joined.select("doc_id", *out, failed.alias("base_failed"), kept.alias("kept"), *(["row_key"] if key else []))


def _oracle() -> str:
    """The same in DuckDB's SQL."""
    rules = (*RATES, MEAN)
    rates = ", ".join(f"CASE WHEN n_words > 0 THEN {factor} * {top} // nullif({under}, 0) END AS {k}" for k, top, under, factor in rules)
    bins = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, ({k} >> greatest(length(ltrim(bin({k}), '0')) - 6, 0)) << greatest(length(ltrim(bin({k}), '0')) - 6, 0) AS bin FROM rates WHERE n_words > 0" for k, *_ in rules)

    def quant(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        found = ", ".join(f"min(bin) FILTER (WHERE {d} * upto >= {n} * total) AS {q}" for q, n, d in QUANTILES)
        return f"""{name} AS (SELECT {by}measure, {found}, max(total) AS total
 FROM (SELECT {by}measure, bin, sum(count(*)) OVER (PARTITION BY {by}measure ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(count(*)) OVER (PARTITION BY {by}measure) AS total FROM bins GROUP BY {by}measure, bin) GROUP BY {by}measure)"""

    drawn = ", ".join(f"((o.total * o.{q} + 100 * w.{q}) // (o.total + 100))::BIGINT AS {q}" for q, *_ in QUANTILES)
    highs = ", ".join(f"max(q90 + 3 * (q90 - q50)) FILTER (WHERE measure = '{k}') AS hi_{k}" for k, *_ in RATES)
    mean = f"max(q25 - 3 * (q75 - q25)) FILTER (WHERE measure = '{MEAN[0]}') AS lo_{MEAN[0]}, max(q75 + 3 * (q75 - q25)) FILTER (WHERE measure = '{MEAN[0]}') AS hi_{MEAN[0]}"
    return rf"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM t),
win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
wk AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS k FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM wk WHERE k > 1) GROUP BY rid),
stats AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_word_lines
 FROM w LEFT JOIN rep ON rep.rid = w.rid),
rates AS (SELECT *, {rates} FROM stats),
bins AS ({bins}),
{quant("own", "lang, source")},
{quant("bylang", "lang")},
{quant("byall", "")},
lang2 AS (SELECT o.lang, o.measure, {drawn} FROM bylang o JOIN byall w ON o.measure = w.measure),
group2 AS (SELECT o.lang, o.source, o.measure, {drawn} FROM own o JOIN lang2 w ON o.measure = w.measure AND o.lang IS NOT DISTINCT FROM w.lang),
limits AS (SELECT lang, source, {highs}, {mean} FROM group2 GROUP BY lang, source),
judged AS (SELECT r.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CASE WHEN n_words > 0 THEN ({" OR ".join(_outside(3)).format(div="//")}) END AS outside
 FROM stats r LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM r.lang AND l.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(outside, true)) AS kept FROM judged"""


ORACLE = _oracle()
