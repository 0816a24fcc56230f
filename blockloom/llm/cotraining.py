"""Quality and toxicity classifiers by co-training of two views, applied to all documents.

The text view sees which words and marks a document has; the page view its metadata and layout: language,
source, size, lines, and shares of kinds of characters, but no word.  For each target both views
are fitted to a labelled sample and calibrated on labelled documents held out of the fits.  Then,
for some rounds, each view labels all other documents, and those of which it is confident teach
the other view.  At last the calibrated log-odds of both views are combined with weights fitted
on the held-out documents, too.

Only the labelled sample is bounded (``labelled`` documents, those least by hash).  Features of all
documents are written once; each round is one pass over them, which adds up what the fits need of
the confident documents, whatever their number: for the text view, documents by feature and class;
for the page view, gradient and curvature of the loss at its present weights.  These sums have a
fixed size, and weigh ``pseudo`` times as much as the labelled sample, so that fits behave alike
however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .packed import Blob, packed

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
N_NUMBERS = 10
PAGE_BITS = 7
TARGETS = ("quality", "toxic")


def _hashed(token: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(token) >> (32 - bits)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = _hashed(token, BITS)
        return found


def page_numbers(text: str, n_chars: int | None) -> list[float]:
    """Size and layout: no word is looked at, and nothing grows without bound."""
    n = max(len(text), 1)
    lines = text.split("\n")
    used = [x for x in lines if x.strip()]
    words = text.count(" ") + len(lines)
    marks = sum(map(text.count, "#*$%&|<>!"))
    upper = sum(text.count(c) for c in set(text) if c.isupper() and c != c.swapcase())
    return [
        np.log1p(n),
        np.log1p(n_chars if n_chars is not None else n),
        np.log1p(len(lines)),
        np.log1p(n / max(len(used), 1)),
        1 - len(set(used)) / max(len(used), 1),
        min(n / words, 50) / 10,
        marks / n * 10,
        upper / n,
        sum(map(text.count, "0123456789")) / n * 10,
        (text.count(".") + text.count(",")) / words,
    ]


def page_marks(lang: str | None, source: str | None) -> list[int]:
    return [_hashed(x, PAGE_BITS) for x in (f"lang={lang}", f"source={source}")]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sparse:
    """Rows of feature numbers, each present or absent."""

    rows: np.ndarray
    cols: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, r[self.rows], size)


def fit_text(x: Sparse, y: np.ndarray, weight: np.ndarray, more: np.ndarray | None = None, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept: logistic regression over log-count ratios of the features.

    more adds to the counts, not to the regression: documents by class (negative first) and
    feature, with the number of documents of the class in the last column.
    """
    size = 1 << BITS
    more = np.zeros((2, size + 1)) if more is None else more
    seen = x.back((weight > 0).astype(float), size) + more[:, :-1].sum(axis=0)
    pos, neg = x.back(weight * y, size) + more[1, :-1] + 0.5, x.back(weight * (1 - y), size) + more[0, :-1] + 0.5
    ratio = np.log(pos / ((weight * y).sum() + more[1, -1]).clip(1)) - np.log(neg / ((weight * (1 - y)).sum() + more[0, -1]).clip(1))
    ratio[seen < 3] = 0
    w, b, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    scale = weight / max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        r = (_sigmoid(x.dot(w * ratio) + b) - y) * scale
        g, gb = x.back(r, size) * ratio + 1e-5 * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w * ratio, b


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, more: tuple | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept, without penalty.

    more is (weights, gradient, curvature) of a further loss, which counts by its second-order
    approximation at these weights.
    """
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    at, slope, bend = more if more is not None else (w, w, np.zeros((len(w), len(w))))
    for _ in range(25):
        p = _sigmoid(x @ w)
        g = x.T @ ((p - y) * weight) + ridge * w + slope + bend @ (w - at)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9) + bend
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class CoModel:
    """For each target: text weights and intercept, page coefficients, calibration and combination."""

    mean: np.ndarray
    sd: np.ndarray
    text: dict = field(default_factory=dict)
    page: dict = field(default_factory=dict)
    calibration: dict = field(default_factory=dict)
    rate: dict = field(default_factory=dict)

    def page_matrix(self, marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        z = np.clip((numbers - self.mean) / self.sd, -5, 5)
        x = np.zeros((len(z), (1 << PAGE_BITS) + z.shape[1] * 2))
        for j in range(marks.shape[1]):
            x[np.arange(len(z)), marks[:, j]] = 1
        x[:, 1 << PAGE_BITS :] = np.c_[z, z * z]
        return x

    def confident(self, target: str, p: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Which probabilities tell the class, negative and positive: the odds must be so many times the class's own, so that a rare class isn't denied for its rarity."""
        odds, own, least = p / (1 - p), self.rate[target] / (1 - self.rate[target]), sure / (1 - sure)
        return odds * least <= own, odds >= own * least

    def text_weights(self) -> np.ndarray:
        return np.stack([self.text[t][0] for t in TARGETS], axis=1).astype(np.float32).astype(np.float64)

    def combined(self, target: str, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the page view and both."""
        a, b, c = self.calibration[target]
        s, p = a[0] * text + a[1], b[0] * page + b[1]
        return _sigmoid(s), _sigmoid(p), _sigmoid(c[0] * s + c[1] * p + c[2])


#: What every document's features are in a table: packed little-endian arrays.
FEATURES = "doc_id bigint, tokens binary, marks binary, numbers binary"
KINDS = {"tokens": "<i4", "marks": "<i4", "numbers": "<f8"}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and, as bytes, the distinct hashed words, the marks and the numbers of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, cols = batch.slice(at, 1000), ([], [], [])
                for x, lang, source, n_chars in zip(*[part.column(j) for j in range(1, 5)], strict=True):
                    x = x.as_py() or ""
                    cols[0].append(np.unique(np.fromiter(map(cache.__getitem__, set(TOKEN.findall(x.lower()))), "<i4")).tobytes())
                    cols[1].append(np.array(page_marks(lang.as_py(), source.as_py()), "<i4").tobytes())
                    cols[2].append(np.array(page_numbers(x, n_chars.as_py()), "<f8").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in cols]], ["doc_id", *KINDS])

    return _five(docs, text).mapInArrow(run, FEATURES)


def _read(batch: pa.RecordBatch) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Features of a batch of feature rows."""
    flat, sizes = {}, None
    for i, (name, kind) in enumerate(KINDS.items(), 1):
        col = batch.column(i)
        flat[name] = np.frombuffer(b"".join(col.to_pylist()), kind)
        if name == "tokens":
            sizes = pc.binary_length(col).to_numpy() // 4
    n = batch.num_rows
    return Sparse(np.repeat(np.arange(n), sizes), flat["tokens"].astype(np.int64), n), flat["marks"].reshape(n, 2), flat["numbers"].reshape(n, N_NUMBERS)


def _exchanged(table: DataFrame, model: CoModel, known: set, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all documents but the known: (counts, slopes, bends, numbers).

    For each target and class: documents by feature of which the page view is confident, with
    their number last.  For each target: gradient and curvature of the page view's loss on the
    documents of which the text view is confident, and their number.  Each task sums first, then
    some tasks sum these, so what comes to the driver has a fixed size.
    """
    size, width = 1 << BITS, (1 << PAGE_BITS) + 2 * N_NUMBERS + 1
    shapes = ((len(TARGETS), 2, size + 1), (len(TARGETS), width), (len(TARGETS), width, width), (len(TARGETS),))

    def blobs(sums: list[np.ndarray]) -> pa.RecordBatch:
        from pyspark import TaskContext

        floats = np.concatenate([x.ravel() for x in sums[1:]])
        part = TaskContext.get().partitionId() % 32
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed(sums[0].ravel().astype(np.uint64))], pa.binary()), pa.array([floats.tobytes()], pa.binary())], ["part", "counts", "floats"])

    def add(sums: list[np.ndarray], counts: bytes, floats: bytes) -> None:
        sums[0] += Blob(counts)[0].reshape(shapes[0])
        rest, at = np.frombuffer(floats), 0
        for x in sums[1:]:
            x += rest[at : at + x.size].reshape(x.shape)
            at += x.size

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = model.text_weights(), [np.zeros(s) for s in shapes]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                part = part.filter(pa.array([x not in known for x in part.column(0).to_pylist()], pa.bool_()))
                if not part.num_rows:
                    continue
                words, marks, numbers = _read(part)
                x = model.page_matrix(marks, numbers)
                full = np.c_[x, np.ones(len(x))]
                for k, t in enumerate(TARGETS):
                    text, page, _ = model.combined(t, words.dot(weights[:, k]) + model.text[t][1], full @ model.page[t])
                    for value, mask in enumerate(model.confident(t, page, sure)):
                        sums[0][k, value, :-1] += words.back(mask.astype(float), size)
                        sums[0][k, value, -1] += mask.sum()
                    no, yes = model.confident(t, text, sure)
                    told = no | yes
                    z, p = full[told], _sigmoid(full[told] @ model.page[t])
                    sums[1][k] += z.T @ (p - yes[told])
                    sums[2][k] += (z * (p * (1 - p))[:, None]).T @ z
                    sums[3][k] += told.sum()
        yield blobs(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = [np.zeros(s) for s in shapes], False
        for batch in batches:
            for _, counts, floats in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                add(sums, counts, floats)
                any_ = True
        if any_:
            yield blobs(sums)

    schema = "part int, counts binary, floats binary"
    found = table.mapInArrow(look, schema).repartition("part").mapInArrow(total, schema).collect()  # at most 32 rows
    sums = [np.zeros(s) for s in shapes]
    for r in found:
        add(sums, r["counts"], r["floats"])
    return tuple(sums)


def cotrain(table: DataFrame, texts: Sparse, marks: np.ndarray, numbers: np.ndarray, labels: dict[str, np.ndarray], ids: list, rounds: int = 3, pseudo: float = 0.3, sure: float = 0.95) -> CoModel:
    """labels: 0 or 1 for each row of the sample, whose documents are ids; table has features of all documents.

    A quarter of the sample, by hash, is held out for calibration (unless it has no document of
    either class, when all of the sample calibrates).  In each round a view hands over what it is
    ``sure`` of beyond the class's share of the sample; over the rounds its weight grows to ``pseudo`` times the sample's.
    """
    model = CoModel(numbers.mean(axis=0) if len(numbers) else np.zeros(N_NUMBERS), (numbers.std(axis=0) if len(numbers) else np.ones(N_NUMBERS)) + 1e-6)
    x = model.page_matrix(marks, numbers)
    held = np.array([_hashed(f"held {i}", 16) % 4 == 0 for i in ids], bool)
    taught: dict[str, tuple] = {t: (None, None) for t in TARGETS}
    for k in range(rounds + 1):
        for t in TARGETS:
            y, one = labels[t].astype(float), (~held).astype(float)
            model.rate[t] = (y.sum() + 1) / (len(y) + 2)
            more_text, more_page = taught[t]
            w, b = fit_text(texts, y, one, more_text)
            q = fit_dense(x[~held], y[~held], one[~held], more=more_page)
            scores = {"text": texts.dot(w) + b, "page": x @ q[:-1] + q[-1]}
            at = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
            if at.any():
                each = np.ones(int(at.sum()))
                a, c = (fit_dense(scores[v][at][:, None], y[at], each, 1e-2) for v in ("text", "page"))
                both = fit_dense(np.c_[a[0] * scores["text"][at] + a[1], c[0] * scores["page"][at] + c[1]], y[at], each, 1e-2)
            else:
                a = c = np.array([1.0, 0.0])
                both = np.array([0.5, 0.5, 0.0])
            model.text[t], model.page[t], model.calibration[t] = (w, b), q, (a, c, both)
        if k == rounds or not len(ids):
            break
        counts, slopes, bends, told = _exchanged(table, model, set(ids), sure)
        weight = pseudo * (k + 1) / rounds * float((~held).sum())
        for j, t in enumerate(TARGETS):
            by_text = weight / max(told[j], 1.0)
            taught[t] = (counts[j] * (weight / max(counts[j, :, -1].sum(), 1.0)), (model.page[t], slopes[j] * by_text, bends[j] * by_text))
    return model


def _five(docs: DataFrame, text: str) -> DataFrame:
    kinds = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint"}
    own = {c: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()}
    return docs.select(own["doc_id"], F.col(text).cast("string").alias("text"), own["lang"], own["source"], own["n_chars"])


def fit(table: DataFrame, labels: DataFrame, labelled: int = 8000, rounds: int = 3) -> CoModel:
    """Fits the views to features of all documents and at most ``labelled`` labelled documents, those least by hash of doc_id.

    Labels of one document that disagree count as the lesser quality and the greater toxicity; a
    row without doc_id or with a null label is no label.  Of a doc_id that stands for several
    documents, the least by its features is the labelled one, and none of them is exchanged.
    Labelled documents beyond the sample are exchanged as if they had no label.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    ids = table.where("doc_id is not null").select("doc_id").distinct()
    chosen = {r["doc_id"]: r for r in ids.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()}
    keys = table.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id bigint")  # at most ``labelled``
    few = table.join(F.broadcast(keys), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*KINDS)).alias("f")).select("doc_id", "f.*")
    found = few.toArrow().sort_by("doc_id").combine_chunks()
    sample = pa.RecordBatch.from_arrays([found.column(i).combine_chunks() if found.num_rows else pa.array([], pa.int64() if not i else pa.binary()) for i in range(4)], ["doc_id", *KINDS])
    order = sample.column(0).to_pylist()
    y = {t: np.array([chosen[i][t] for i in order], np.int64) for t in TARGETS}
    return cotrain(table, *_read(sample), y, order, rounds)


def score(table: DataFrame, model: CoModel, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, text_quality, page_quality, quality, text_toxic, page_toxic, toxic, kept, for every row of features.

    Repeated rows and null doc_ids are scored like others; an empty table gives an empty result.
    """
    names = [f"{v}{t}" for t in TARGETS for v in ("text_", "page_", "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.text_weights()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words, marks, numbers = _read(part)
                page = model.page_matrix(marks, numbers)
                cols, values = [part.column(0)], {}
                for k, t in enumerate(TARGETS):
                    q = model.page[t]
                    three = model.combined(t, words.dot(weights[:, k]) + model.text[t][1], page @ q[:-1] + q[-1])
                    cols += [pa.array(v) for v in three]
                    values[t] = three[2]
                kept = (values["quality"] >= least_quality) & (values["toxic"] < most_toxic)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept)], ["doc_id", *names, "kept"])

    return table.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", kept boolean")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """Fits to the labels and scores all documents; without any label every score is one half.

    docs needs doc_id and the text; a null text counts as empty, and a null or missing lang,
    source or n_chars as a value of its own.  Other columns are not read.  labels needs doc_id,
    quality and toxic (0 or 1).
    """
    table = written(features(docs, text), "cotraining-features")
    return score(table, fit(table, labels, **options))
