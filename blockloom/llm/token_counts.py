"""Token counts under a unigram model, by one pass over a trie of distinct pre-tokens.

A pre-token is a word with the space mark before it.  The distinct pre-tokens of a batch of
documents are walked in sorted order, which is the depth-first order of their trie: the stack
holds, for each node of the current path, the best (forward) score of a segmentation of the
node's prefix and the tokens it takes, so these are computed once for each shared prefix.  A
node where a pre-token ends is a terminal, and its count is stored for all documents of the batch
and of later ones.  Batches are bounded, and so are the trie and the stored counts; nothing is
shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

SPACE = "▁"


class UnigramCounter:
    """Scores of pieces; a character that no piece covers costs ``unknown`` and one token a UTF-8 byte."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        self.scores = scores
        self.unknown = unknown if unknown is not None else min(scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, scores), default=1)

    def counts(self, pretokens) -> dict[str, int]:
        """Tokens of each pre-token's best segmentation; of equal scores, the one of the longer last piece."""
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        score, tokens, found, before = [0.0], [0], {}, ""
        for word in sorted(pretokens):
            n, at = len(word), 0
            most = min(n, len(before))
            while at < most and word[at] == before[at]:
                at += 1
            del score[at + 1 :], tokens[at + 1 :]
            for end in range(at + 1, n + 1):
                best, took = None, 0
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += score[start]
                        if best is None or s > best:
                            best, took = s, tokens[start] + 1
                if word[end - 1] not in self.scores:
                    s = score[end - 1] + unknown
                    if best is None or s > best:
                        best, took = s, tokens[end - 1] + len(word[end - 1].encode())
                score.append(best)
                tokens.append(took)
            found[word] = tokens[n]
            before = word
        return found


def zipf_scores(model_file: str) -> dict[str, float]:
    """Log-probabilities by rank for the pieces of a model whose ids are in order of rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (i + 2) for i in range(len(pieces))))
    return {p: -math.log(i + 2) - total for i, p in enumerate(pieces)}


class Terminals:
    """Stored counts of pre-tokens: two generations of at most ``size``, so that what is used stays."""

    def __init__(self, counter: UnigramCounter, size: int = 600_000):
        self.counter, self.size, self.now, self.old = counter, size, {}, {}

    def of(self, pretokens: set[str]) -> dict[str, int]:
        """Counts that have, among others, all of pretokens."""
        new = pretokens.difference(self.now)
        if len(self.now) + len(new) > self.size:
            self.old, self.now, new = self.now, {}, pretokens
        kept = {w: self.old[w] for w in new if w in self.old} if self.old else {}
        self.now.update(kept)
        self.now.update(self.counter.counts(new.difference(kept)))
        return self.now


_COUNTERS: dict[str, Terminals] = {}


def counter_for(model_file: str) -> Terminals:
    """One a worker, for all its tasks."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = Terminals(UnigramCounter(zipf_scores(model_file)))
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, text: str = "text", batch_chars: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, n_tokens of every document's whole text.

    A null or empty text has no words and no tokens.  Repeated rows and null doc_ids are rows
    like any other; an empty table gives an empty result; other columns are not read.  A batch
    closes at batch_chars characters, or after one document that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(model_file)

        def done(ids: list, held: list[list[str]]) -> pa.RecordBatch:
            found = counter.of({SPACE + w for words in held for w in words})
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in held], pa.int64()), pa.array([sum([found[SPACE + x] for x in w]) for w in held], pa.int64())], ["doc_id", "n_words", "n_tokens"])

        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, x in zip(batch.column(0), batch.column(1), strict=True):
                x = x.as_py() or ""
                ids.append(doc_id.as_py())
                held.append(WORD.findall(x))
                size += len(x)
                if size >= batch_chars:
                    yield done(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield done(ids, held)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def token_totals(counts: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """Documents, words and tokens per group of keys of docs; partial sums come before the shuffle.

    Rows are matched by doc_id: rows without one count nowhere, and each row of a repeated doc_id
    counts once in the group of each row of docs that has it.  Null keys form groups; empty tables
    give an empty result.
    """
    return counts.join(docs.select("doc_id", *keys), "doc_id").groupBy(*keys).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
