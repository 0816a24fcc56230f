"""SentencePiece merge-type encoding by a prefix table, and decoding.

In a merge-type (BPE) model every prefix of a text has an encoding of its own, and the encoding
of the whole text restricted to its first k tokens is the encoding of the prefix they spell.  So
one token per prefix, its last, describes everything.  The table is filled from left to right:
an Aho-Corasick automaton gives the pieces that end at a position, and the one piece belongs
there whose pair with the last token of the prefix before it is compatible, that is, whose two
strings, joined and encoded alone, come out as these two tokens.  The ids are then read from the
end of the table backwards.

A text is cut where no piece of the vocabulary can span the cut (before a run of the space mark, beside marks that no
piece joins with letters), so that the tables of frequent chunks are made once per worker and
kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Strings that tell whether the model's normaliser changes anything but spaces.
PROBES = ("a  b", " ﬁ①Ａ ", "é\n\tx\u0000", "　y z", "½ſ ")


BEFORE = "before"


class _Rows(dict):
    """Of each token: what is known of its pairs with the tokens after it, and itself at BEFORE."""

    def __missing__(self, token):
        row = self[token] = {BEFORE: token}
        return row


class _Cache(dict):
    """Two generations of at most ``size`` entries; what is used stays."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class PrefixTableEncoder:
    """Encodes as the model's own library does, without sampling and without extra ids.

    Unused pieces change the merge rules; a model that has them is refused.  So would user-defined
    pieces, which the library doesn't tell apart: the caller must know that there are none.
    """

    def __init__(self, model_file: str, cache_size: int = 250_000):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = sp.get_piece_size()
        self.piece_id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        automaton = ahocorasick.Automaton()
        for i in range(self.n):
            if sp.is_unused(i):
                raise ValueError("a model with unused pieces isn't supported")
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                piece = sp.id_to_piece(i)
                self.piece_id[piece], self.score[piece] = i, sp.get_score(i)
                automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.piece = {i: p for p, i in self.piece_id.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain = all(sp.normalize(x) == self._spaced(x) for x in PROBES)
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        self.size = {i: len(p) for i, p in self.piece.items()}
        # Between two characters that stand side by side in no piece nothing can merge: a text
        # may be cut before a run of space marks, and around runs of ASCII marks, unless it has
        # one of the few other characters that stand beside such marks in pieces.
        beside = {p[i : i + 2] for p in self.piece_id for i in range(len(p) - 1)}
        self.cuts = all(x[0] == SPACE for x in beside if x[1] == SPACE)
        known = set(string.ascii_letters + string.digits)
        marks = {c for c in string.punctuation + "\n\t\r" if not any(c in x and (x[0] in known or x[1] in known) for x in beside)}
        odd = {y for x in beside for c, y in (x, x[::-1]) if c in marks and y not in marks and y != SPACE}
        q = re.escape("".join(sorted(marks)))
        spaced = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.odd = re.compile(f"[{re.escape(''.join(sorted(odd)))}]") if odd else re.compile("(?!)")
        self.wide_chunks = re.compile(spaced)
        self.chunks = re.compile(f"{SPACE}+(?:[^{SPACE}{q}]+|[{q}]+)?|[^{SPACE}{q}]+|[{q}]+" if marks else spaced)
        self.rows, self.known = _Rows(), 0
        self.cache = _Cache(self._chunk, cache_size)

    @staticmethod
    def _spaced(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _string(self, token: int) -> str:
        """Of a piece, or of an unknown character, which has its code point's complement."""
        return self.piece[token] if token >= 0 else chr(~token)

    def _merged(self, text: str) -> list[str]:
        """The model's merges, one after another: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, row: dict[int, bool], token: int) -> bool:
        """Whether the strings of the row's token and of token (of token alone, at a start) encode to just these."""
        if self.known > 1_000_000:
            self._forget()
        before, y = row[BEFORE], self._string(token)
        if before is None:
            found = len(y) == 1 or self._merged(y) == [y]
        else:
            x = self._string(before)
            found = x + y not in self.piece_id and self._merged(x + y) == [x, y]
        row[token] = found
        self.known += 1
        return found

    def _forget(self) -> None:
        self.rows, self.known = _Rows(), 0

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix's encoding; index 0 is the empty prefix's, and means nothing."""
        table = self.rows
        last, rows = [0] * (len(text) + 1), [None] * (len(text) + 1)
        rows[0] = table[None]
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if rows[end] is not None:
                continue
            row = rows[end - size]
            if row is None:  # no piece ends there: an unknown character
                before = last[end - size] = ~ord(text[end - size - 1])
                row = rows[end - size] = table[before]
            ok = row.get(token)
            if ok or ok is None and self._compatible(row, token):
                last[end] = token
                rows[end] = table[token]
        for i in range(1, len(last)):
            if rows[i] is None:
                last[i] = ~ord(text[i - 1])
        return last

    def _chunk(self, text: str) -> tuple[list[int], str]:
        """The ids of a chunk, and the same in decimal, joined by spaces."""
        last, at, ids, size = self.last_tokens(text), len(text), [], self.size
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= size[token]
            else:
                ids += [self.byte_id[b] for b in reversed(chr(~token).encode())]
                at -= 1
        ids.reverse()
        return ids, " ".join(map(str, ids))

    def encode_both(self, text: str) -> tuple[list[int], str]:
        text = self._spaced(text) if self.plain else self.sp.normalize(text)
        if not text:
            return [], ""
        if not self.cuts:
            return self._chunk(text)
        cache = self.cache
        cut = self.wide_chunks if self.odd.search(text) else self.chunks
        parts = [cache[c] for c in cut.findall(text)]
        return list(chain.from_iterable(p[0] for p in parts)), " ".join([p[1] for p in parts])

    def encode(self, text: str) -> list[int]:
        return self.encode_both(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)

    @property
    def end_id(self) -> int:
        return self.sp.eos_id()


_ENCODERS: dict[str, PrefixTableEncoder] = {}


def encoder_for(model_file: str) -> PrefixTableEncoder:
    """One encoder for each model and Python worker."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PrefixTableEncoder(model_file)
    return _ENCODERS[model_file]


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes and decodes every document; keeps doc_id and adds what the text became.

    Columns: doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256 and, with_ids, ids
    (array of int) and decoded (string).  A null text counts as empty: only the end id, and an
    empty decoded text.  A row without doc_id keeps its null.  There is no shuffle: repeated
    rows and ties are rows like any other, and an empty table gives an empty result.  Other
    columns of docs, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(model_file)
        end = enc.end_id
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
                for x in part.column(1):
                    ids, decimal = enc.encode_both(x.as_py())
                    ids.append(end)
                    back = enc.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256((f"{decimal} {end}" if decimal else str(end)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_text.append(back)
                cols = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_ids:
                    cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_text, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
