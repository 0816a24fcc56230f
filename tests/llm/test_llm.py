"""The operators against brute-force versions on small tables with nulls, ties, copies and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import chat, compact_windows, cotraining, decontaminate, prefix_encoder, quality_rules, simhash, suffix_dedup, token_counts, token_files
from blockloom.llm.components import components
from blockloom.llm.registry import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and control strings."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "Étude", "日本", "a,b", "</s>", "<|endoftext|>"]
    gen = lambda n: [rng.choice(words) for _ in range(n)]
    shared, texts = gen(60), []
    for i in range(60):
        w = gen(rng.randint(0, 150))
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = shared
        texts.append(" ".join(w) + ("\nsame line\nsame line" if i % 7 == 0 else ""))
    texts += [texts[8], texts[8], texts[9].replace("w", "w", 1) + " tail", None, "", " \n\t", "x", "ab" * 400, "ab" * 300, " ".join(gen(9000))]
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("sign", F.lit("x")).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_prefix_table_equals_the_library():
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    enc, sp = prefix_encoder.PrefixTableEncoder(file, cache_size=50), sentencepiece.SentencePieceProcessor(model_file=file)
    rng, letters = random.Random(1), "aabbcct he▁ \n\t  éß①語😀<s>\x00\rﬁ́ing.,m²)('-01"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert enc.encode(text) == sp.encode(text), text


def test_encoding(docs, rows, empty):
    import sentencepiece

    file = tokenizer_file("piece_bpe_32k.model")
    sp, want = sentencepiece.SentencePieceProcessor(model_file=file), {}
    for i, t, *_ in rows:
        ids = [*sp.encode(t or ""), 2]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert by_id(prefix_encoder.encode_documents(docs, file), "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert prefix_encoder.encode_documents(empty, file).count() == 0


def test_quality_measures(docs, rows, empty):
    got = by_id(quality_rules.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        places = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places), len(w) < 50 or 2 * len(places) > len(w))
        assert got[i][:6] == want and not (want[5] and got[i][6])
    assert quality_rules.quality_rules(empty).count() == 0


def test_sketch_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(v,) for v in (0, 1, 63, 64, 65, 130, 1000)], "v long").select(quality_rules.bin_of(F.col("v"))).collect()]
    assert got == [0, 1, 63, 64, 64, 128, 992]


def test_rejects_what_stands_out(spark):
    rng = random.Random(2)
    plain = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "to"]) + str(rng.randint(0, 99)) for _ in range(80)), "en", "s") for i in range(300)]
    odd = [(1000 + i, " ".join(f"w{rng.randint(0, 999)}###" for _ in range(80)), "en", "s") for i in range(5)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")), "kept")
    assert all(got[i][0] for i, *_ in plain) and not any(got[i][0] for i, *_ in odd)


def test_the_same_text_fares_differently_by_source(spark):
    rng = random.Random(12)
    line = lambda mark: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) + (mark if rng.random() < 0.3 else "") for _ in range(80))
    odd = line("%")
    rows = [(2 * i, line(""), "en", "prose") for i in range(1500)] + [(2 * i + 1, line("%"), "en", "prices") for i in range(1500)] + [(5000, odd, "en", "prose"), (5001, odd, "en", "prices")]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept")
    assert not got[5000][0] and got[5001][0] and all(v[0] for k, v in got.items() if k < 5000)


def test_repeated_lines_are_judged_by_their_number(spark):
    rng = random.Random(13)
    lines = lambda n: [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(8)) for _ in range(n)]
    rows = [(i, "\n".join(lines(12)), "en", "s") for i in range(300)]
    one, many = lines(12), lines(60)
    rows += [(1000, "\n".join([*one, one[0]]), "en", "s"), (1001, "\n".join([*many, *many[:12]]), "en", "s")]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "base_failed", "kept")
    assert got[1000] == (False, True) and got[1001] == (False, False)


def test_cotraining_holds_out(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(900):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        w = [rng.choice(words) + ("%%%" if bad and rng.random() < 0.7 else "") for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["vile", "moronic"])
        docs.append((i, " ".join(w), "en", f"s{i % 5}", None))
        labels.append((i, int(not bad), int(toxic)))
    table = spark.createDataFrame(docs, SCHEMA)
    got = by_id(cotraining.classify(table, spark.createDataFrame(labels[:500], "doc_id long, quality int, toxic int")), "quality", "toxic")
    right = np.mean([[(got[i][0] >= 0.5) == q, (got[i][1] >= 0.5) == t] for i, q, t in labels[500:]], axis=0)
    assert right[0] > 0.95 and right[1] > 0.95
    none = cotraining.classify(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 900
    assert cotraining.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels[:5], "doc_id long, quality int, toxic int")).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 2.0), (1, 4, 2, "user", "d [/USER] \\ </s>", 5.0), (1, 5, 3, "user", "e", 1.0), (2, 1, None, "x]y", None, None), (3, 1, 9, "user", "lost", 1.0), (4, 1, 2, "user", "p", 1.0), (4, 2, 1, "user", "q", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): chat.read_back(r["formatted"]) for r in chat.format_trees(df, 1).collect()}
    assert got == {(1, 4): [("user", "a"), ("assistant", "b"), ("user", "d [/USER] \\ </s>")], (2, 1): [("x]y", "")]}
    assert len(chat.format_trees(df, 2).collect()) == 3
    assert chat.format_trees(df.limit(0)).count() == 0


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\[USER] x", "[/ROLE]", "a\\\\<", "", None, "[ASSISTANT] </s>"]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in ("user", "assistant", None)]
    df = chat.as_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_trees(df).first()
    want = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or ""))
    assert chat.read_back(out["formatted"]) == [(r[2] or "", r[3] or "") for r in want]
    assert [out["formatted"][s["start"] : s["end"]].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for s in out["loss_spans"]] == [t or "" for t in texts]


def test_long_conversation(spark):
    df = chat.as_tree(spark.range(300).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text"))
    assert [t for _, t in chat.read_back(chat.format_trees(df).first()["formatted"])] == [str(i) for i in range(300)]


@pytest.mark.parametrize("seed", [5, 6])
def test_passages_against_brute_force(spark, seed):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    gen = lambda n: [r.choice(voc) for _ in range(n)]
    passages, line, texts = [gen(n) for n in (50, 55, 60, 80, 120)], gen(45), []
    for _ in range(40):
        w = gen(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            w += (r.choice(passages) if r.random() < 0.7 else line) + gen(r.randint(3, 60))
        if r.random() < 0.3 and texts:
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(voc)
        texts.append(w)
    texts += [[], ["x"], gen(5) * 40, gen(5) * 40]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(None, "a b"), (999, None)], "doc_id long, text string").repartition(3)
    got = compact_windows.near_passages(df).collect()
    covered: dict[int, set] = {}
    for g in got:
        covered.setdefault(g["doc_id"], set()).update(range(g["start"], g["end"]))
    first: dict = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                assert set(range(k, k + 50)) <= covered.get(i, set())
    tokens = lambda w, k: {tuple(w[j : j + 5]) for j in range(k, k + 46)}
    for g in got:
        d, own = texts[g["doc_id"]], [tokens(texts[g["leader"]], j) for j in range(len(texts[g["leader"]]) - 49)]
        fine: set = set()
        for k in range(g["start"], g["end"] - 49):
            a = tokens(d, k)
            if any(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in own):
                fine.update(range(k, k + 50))
        if not set(range(g["start"], g["end"])) <= fine:  # a longer passage, similar as a whole
            other, n = texts[g["leader"]], g["end"] - g["start"]
            assert n > 50 and any(_jaccard(d[g["start"] : g["end"]], other[max(0, j) : j + n]) >= 0.8 - 1e-9 for j in range(4 - n, len(other) - 4))
    left = by_id(compact_windows.without_passages(df.where("doc_id is not null")), "text")
    for i, w in enumerate(texts):
        assert (left[i][0] or "").split() == [x for k, x in enumerate(w) if k not in covered.get(i, set())]


def test_cartesian_windows():
    rng = random.Random(1)
    v = [rng.randint(0, 60) for _ in range(200)]
    want = []
    for c in range(200):
        a = b = c
        while a and v[a - 1] > v[c]:
            a -= 1
        while b < 199 and v[b + 1] >= v[c]:
            b += 1
        if b - a + 1 >= 12:
            want.append((a, c, b))
    assert compact_windows.cartesian_windows(np.array(v), 12) == want


@pytest.mark.parametrize("crowd", [4096, 1])
def test_simhash_components(docs, rows, empty, crowd):
    prints = _fingerprints({i: t for i, t, *_ in rows})
    least = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    want = {i: (f"{prints[i]:016x}", least[i]) for i in prints}
    assert by_id(simhash.simhash_components(docs, crowd=crowd), "fingerprint", "component_id") == want
    assert simhash.simhash_components(empty).count() == 0


def test_links_of_random_near_fingerprints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in {f & (1 << 64) - 1 for f in fps}]
    for crowd in (4096, 3):
        got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd)).collect()}
        root = {f: f for f in signed}
        for _ in range(12):
            for a in signed:
                for b in signed:
                    if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                        root[a] = root[b] = min(root[a], root[b])
        assert all(got.get(f, f) == root[f] for f in signed)


def test_components_of_a_chain(spark):
    edges = spark.range(100).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[i] for i in range(101)} == {0} and got[501] == 500
    assert components(edges.limit(0)).count() == 0


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    tok, want, at = Tokenizer.from_file(file), {}, 0
    for i, t, *_ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    for coarse in (2000, 3):
        files = token_files.write_token_files(docs, file, docs_a_part=7, coarse=coarse, shard_bytes=300)
        assert by_id(token_files.read_index(files, spark), "start", "n_tokens", "ids_crc32") == want
    assert files.shards(spark).count() > 5
    assert token_files.read_index(token_files.write_token_files(empty, file), spark).count() == 0
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(files.shards(spark).first()["bytes"], b"another")


def test_byte_bpe_equals_the_library():
    rng, letters = random.Random(2), "ab 's't  \n\n\t\r,.1²é!ŋ<|endoftext|>あ"
    bpe = token_files.ByteBpe(tokenizer_file("byte_bpe_50k.json"), cache_size=40)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["<|endoftext|> a"]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [bpe._bytes(e.ids) for e in bpe.tok.encode_batch(part, add_special_tokens=False)] == bpe.encode_batch(part)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 3000, "batch_bytes": 2000, "part_rows": 20}])
def test_removal_of_repeats(spark, docs, rows, empty, options):
    first: dict = {}
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for i, b in sorted(texts.items()):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert by_id(suffix_dedup.remove_repeats(docs, **options), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    assert (w[suffix_dedup.multikey_order(w)] == w[np.lexsort(w.T[::-1])]).all()


def test_token_counts(docs, rows, empty):
    file = tokenizer_file("piece_bpe_32k.model")
    counter = token_counts.counter_for(file)
    alone = {w: counter.counter.counts([w])[w] for _, t, *_ in rows for w in {"▁" + x for x in WORD.findall(t or "")}}
    want = {i: (len(w := WORD.findall(t or "")), sum(alone["▁" + x] for x in w)) for i, t, *_ in rows}
    got = token_counts.token_counts(docs, file, batch_chars=2000)
    assert by_id(got, "n_words", "n_tokens") == want
    totals = token_counts.token_totals(got, docs, "lang")
    assert totals.agg(F.sum("n_tokens")).first()[0] == sum(v[1] for v in want.values())
    assert token_counts.token_counts(empty, file).count() == 0


def test_stored_counts_outlive_their_generation():
    counter = token_counts.UnigramCounter({"a": -1.0, "b": -1.2, "ab": -1.5})
    stored, r = token_counts.Terminals(counter, size=6), random.Random(3)
    for _ in range(50):
        words = {"".join(r.choice("ab") for _ in range(r.randint(0, 4))) for _ in range(5)}
        got = stored.of(words)
        assert {w: got[w] for w in words} == counter.counts(words) and len(stored.now) <= 6


def test_best_segmentation_by_brute_force():
    scores = {"a": -1.0, "b": -1.2, "ab": -1.5, "aba": -4.0, "ba": -1.1}
    counter = token_counts.UnigramCounter(scores)

    def best(w):
        if not w:
            return 0.0, 0
        ways = [(s + scores[w[i:]], n + 1) for i in range(len(w)) if w[i:] in scores for s, n in [best(w[:i])]]
        return max(ways, key=lambda x: x[0])

    words = ["".join(random.Random(i).choice("ab") for _ in range(i % 9)) for i in range(40)]
    assert counter.counts(words) == {w: best(w)[1] for w in words}
    assert counter.counts(["é"]) == {"é": 2}


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(3)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    items = [(i, " ".join(words(rows[k][1])[5 : 5 + n]).upper()) for i, (k, n) in enumerate([(0, 8), (0, 20), (3, 3), (12, 12), (20, 1)])]
    items += [(50, None), (51, ""), (52, "unheard " * 9), (None, "x"), items[0]]
    rng.shuffle(items)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    want = {}
    for i, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for item, x in items:
            v = words(x)
            for k in range(max(1, len(v) - 7) if v and item is not None else 0):
                g = v[k : k + 8]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        ids.add(str(item))
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2)
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for slice_rows in (200_000, 3):
        assert by_id(decontaminate.decontaminate(docs, bench, slice_rows=slice_rows), *cols) == want
    assert not any(v[4] for v in by_id(decontaminate.decontaminate(docs, bench.limit(0)), *cols).values())
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_pipeline_stages(spark, docs, rows, empty, tmp_path):
    columns = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, rows[1][1]), (2, rows[2][1])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns.columns, name
    kept = {r["doc_id"] for r in now.collect()}
    verdict = {k for k, (v,) in by_id(quality_rules.quality_rules(columns), "kept").items() if v}
    groups = by_id(simhash.simhash_components(columns.where(F.col("doc_id").isin(*verdict))), "component_id")
    assert kept == {k for k, (c,) in groups.items() if c == k} - {rows[1][0], rows[2][0]}  # these are the benchmark's
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(kept)
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


def _jaccard(a, b):
    x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_passages(spark):
    r = random.Random(8)
    gen = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(200):
        p = gen(50)
        q = [*p[: 10 + i % 30], "changed", *p[11 + i % 30 :]]
        assert _jaccard(p, q) >= 0.8
        rows += [(2 * i, " ".join(gen(40) + p + gen(40))), (2 * i + 1, " ".join(gen(30) + q + gen(50)))]
    got = {(x["leader"], x["doc_id"]) for x in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(200)}
    assert len(got) >= 190


def test_long_passage_with_edits_close_together(spark):
    r = random.Random(5)
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    a = gen(300)
    b = list(a)
    for k in range(105, 195, 15):
        b[k] = "changed"
    assert _jaccard(a, b) >= 0.8 and _jaccard(a[120:170], b[120:170]) < 0.8
    got = compact_windows.near_passages(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()
    assert {k for x in got for k in range(x["start"], x["end"])} == set(range(300))


def test_leader_unlike_the_others(spark):
    r, rows = random.Random(6), []
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for i in range(100):
        p = gen(60)
        q = [*p[:30], "changed", *p[31:]]
        rows += [(3 * i, " ".join(gen(40) + p[20:42] + gen(40))), (3 * i + 1, " ".join(gen(40) + p + gen(40))), (3 * i + 2, " ".join(gen(40) + q + gen(40)))]
    got = {(x["leader"], x["doc_id"]) for x in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got & {(3 * i + 1, 3 * i + 2) for i in range(100)}) >= 95


def _covered(got, doc):
    return {k for x in got if x["doc_id"] == doc for k in range(x["start"], x["end"])}


def test_no_partner_is_hidden_by_lesser_documents(spark):
    r, rows, want = random.Random(9), [], set()
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for i in range(60):
        p, at = gen(60), 100 * i
        for k in range(0, 40, 2):  # each shares a part of the passage that is too short for a link
            rows.append((at + k, " ".join(gen(40) + p[k : k + 20] + gen(40))))
        for k in range(3):  # the same word is another one in each
            rows.append((at + 50 + k, " ".join(gen(40) + p[:30] + [f"changed{k}"] + p[31:] + gen(40))))
        want |= {(at + 50, at + 51), (at + 50, at + 52), (at + 51, at + 52)}
    got = {(x["leader"], x["doc_id"]) for x in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got <= want
    assert len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("edit", ["changed", "put in", "left out", "none"])
def test_crowded_signatures_lose_no_link(spark, edit):
    r, rows, want = random.Random(10), [], []
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for i in range(30):
        p, at = gen(50), 200 * i
        for k in range(120):
            s = r.randrange(0, 31)
            rows.append((at + k, " ".join(gen(40) + p[s : s + 20] + gen(40))))
        e = 6 + i
        q = {"changed": [*p[:e], "x", *p[e + 1 :]], "put in": [*p[:e], "x", *p[e:]], "left out": [*p[:e], *p[e + 1 :]], "none": p}[edit]
        if edit == "left out":
            q = [*q, "w"]
        rows += [(at + 150, " ".join(gen(40) + p + gen(40))), (at + 151, " ".join(gen(40) + q + gen(40)))]
        want.append((at + 150, at + 151))
    got = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    pairs = {(x["leader"], x["doc_id"]) for x in got}
    assert pairs <= set(want) and len(pairs) >= 29
    assert all(len(_covered(got, d)) >= 49 for _, d in pairs)


@pytest.mark.parametrize("edit", ["repeated words", "two short repeats", "three words said twice"])
def test_crowded_signatures_lose_no_link_of_repeats(spark, edit):
    r, rows, want = random.Random(14), [], []
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for i in range(30):
        p, at = gen(50), 200 * i
        if edit == "repeated words":  # sets of 30 and 37 shingles
            p = p[:30] + p[:20]
            q = [*p[:38], "x", p[39], "y", *p[41:]]
        elif edit == "two short repeats":
            p[10], p[30:32] = p[9], [p[29]] * 2
            q = [*p[:10], p[9], *p[10:30], *p[31:]]
        else:
            q = [*p[:25], *p[22:47]]
        assert _jaccard(p, q) >= 0.8
        for k in range(120):
            s = r.randrange(0, 31)
            rows.append((at + k, " ".join(gen(40) + p[s : s + 20] + gen(40))))
        rows += [(at + 150, " ".join(gen(40) + p + gen(40))), (at + 151, " ".join(gen(40) + q + gen(40)))]
        want.append((at + 150, at + 151))
    got = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    pairs = {(x["leader"], x["doc_id"]) for x in got}
    # With two repeats, what lies between them is out of line, and its signatures link nothing.
    assert pairs <= set(want) and len(pairs) >= (25 if edit == "two short repeats" else 29)


@pytest.mark.parametrize("crowd", [1, 8, 10**6])
def test_links_are_whole_up_to_copies(spark, crowd):
    r, texts = random.Random(12), []
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for _ in range(6):
        p = gen(60)
        for _ in range(14):
            q, e = list(p), r.choice([20, 30, 40])
            if r.random() < 0.7:
                q[e] = r.choice(["x", "y", "z"])
            texts.append(gen(r.randint(0, 30)) + q[r.choice([0, 0, 25]) :] + gen(r.randint(30, 50)))
    r.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = compact_windows.near_passages(df, crowd=crowd).collect()
    tokens = [[frozenset(tuple(t[j : j + 5]) for j in range(k, k + 46)) for k in range(len(t) - 49)] for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    links, n, missed = {(x["leader"], x["doc_id"]) for x in got}, 0, 0
    for d in range(len(texts)):
        fine = set()
        for k, a in enumerate(tokens[d]):
            if any(near(a, b) for e in range(d) for b in tokens[e] if not a.isdisjoint(b)):
                fine.update(range(k, k + 50))
        n, missed = n + len(fine), missed + len(fine - _covered(got, d))
    assert missed <= 0.01 * n
    if crowd > len(texts):
        pairs = {(e, d) for d in range(len(texts)) for e in range(d) if any(not a.isdisjoint(b) and near(a, b) for a in tokens[d] for b in tokens[e])}
        assert links <= pairs and len(pairs - links) <= 0.02 * len(pairs)


def test_pipeline_takes_passages_out_behind_lesser_documents(spark):
    r, rows = random.Random(13), []
    gen = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    for i in range(20):
        p, at = gen(50), 200 * i
        starts = [r.randrange(0, 31) for _ in range(60)]
        texts = {at + k: gen(40) + p[s : s + 20] + gen(40) for k, s in enumerate(starts)}
        texts |= {at + 100: gen(40) + p + gen(40), at + 101: gen(40) + [*p[:25], "x", *p[26:]] + gen(40)}
        rows += [(k, " ".join(t), "en", "s", 0) for k, t in texts.items()]
    left = by_id(corpus_pipeline.passages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), ""), "text", "n_chars")
    words = {k: len(t.split()) for k, (t, _) in left.items()}
    assert all(n == len(t) for t, n in left.values())
    assert all(words[k] == len(t.split()) for k, t, *_ in rows if k % 200 != 101)
    assert sum(words[200 * i + 101] <= 81 for i in range(20)) >= 19


def test_page_view_counts_capitals_of_the_whole_text():
    text = "a calm opening. " * 300 + "SHOUTING É " * 400
    assert cotraining.page_numbers(text, None)[7] == pytest.approx(9 * 400 / len(text))
    assert cotraining.page_numbers("Ab ß", None)[7] == 0.25 and cotraining.page_numbers("", None)[7] == 0


def test_turns_without_conversation_are_one(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: (chat.read_back(r["formatted"]), r["n_turns"]) for r in chat.format_trees(chat.as_tree(turns)).collect()}
    assert got == {None: ([("user", "a"), ("assistant", "b")], 2), 7: ([("user", "c")], 1)}


def _fingerprints(texts):
    import xxhash

    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().lower().decode())
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    return out


def test_run_of_the_pipeline(spark, tmp_path):
    import duckdb
    import sentencepiece

    r = random.Random(21)
    gen = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    shared, leak, short, texts = gen(60), gen(20), gen(3), {}
    for i in range(120):
        w = gen(r.randint(60, 140))
        if i % 10 == 0:
            w[30:30] = shared
        if i in (7, 8):
            w[20:20] = leak[4:14]
        if i == 9:
            w[20:20] = short
        texts[i] = " ".join(w)
    texts |= {200: texts[3], 201: texts[3] + " end", 202: "few words", 203: " ".join(x + "%%%" for x in gen(80)), 204: None}
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row_key", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, " ".join(short)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        stages.append({x["doc_id"]: x["text"] for x in now.collect()})
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {i for (i,) in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    assert stages[0] == {i: texts[i] for i in kept} and {202, 203, 204}.isdisjoint(kept) and kept >= set(range(120))
    prints, root = _fingerprints(stages[0]), {i: i for i in kept}
    for _ in range(5):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert stages[1] == {i: t for i, t in stages[0].items() if root[i] == i} and 200 not in stages[1]
    for i, t in stages[1].items():
        w = t.split(" ")
        if i % 10 or i == 0 or i >= 120:
            assert stages[2][i] == t
        else:  # the passage goes, and no more than the windows around it that are still similar
            at = next(k for k in range(len(w)) if w[k : k + 60] == shared)
            left = stages[2][i].split(" ")
            a = next(k for k in range(len(w)) if k >= len(left) or left[k] != w[k])
            b = len(w) - (len(left) - a)
            assert at - 6 <= a <= at and at + 60 <= b <= at + 66 and left == w[:a] + w[b:]
    windows = [leak[k : k + 8] for k in range(13)]
    held = lambda t: any(t.split(" ")[k : k + 8] in windows for k in range(len(t.split(" "))))
    assert stages[3] == {i: t for i, t in stages[2].items() if not held(t)} and {7, 8}.isdisjoint(stages[3]) and 9 in stages[3]
    sp, want = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model")), {}
    for i, t in stages[3].items():
        ids = [*sp.encode(t), 2]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert by_id(corpus_pipeline.run(spark, str(tmp_path)), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_verdicts_hold_for_rows_and_not_for_ids(spark, tmp_path):
    r = random.Random(22)
    good = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(90))
    leak = " ".join(f"q{r.randrange(5000)}" for _ in range(12))
    first, fine = good(), good()
    rows = [(1, first), (1, "bad"), (None, "bad"), (None, fine), (2, good() + " " + leak), (2, good()), (None, good() + " " + leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((x["doc_id"] or 0, x["text"]) for x in docs.collect()) == sorted([(1, first), (0, fine), (2, rows[5][1])])


def test_odd_rows_through_every_operator(spark, tmp_path):
    """No doc_id, one doc_id for two texts and for two equal rows, megabytes of text, and columns named like the operators' own."""
    r = random.Random(23)
    voc = [f"w{i}" for i in range(3000)]
    gen = lambda n: " ".join(r.choice(voc) for _ in range(n))
    long = gen(500_000)
    texts = [(None, gen(80)), (None, None), (1, gen(70)), (1, gen(60)), (2, "same " * 60), (2, "same " * 60), (3, long), (4, long), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    for c in ("row_key", "key", "sign", "bucket", "blob", "fp", "row", "spans", "tokens", "marks", "text_hash", "part", "n", "frame", "word", "pos", "measure", "total", "a", "b", "leader", "component_id", "kept", "__id"):
        docs = docs.withColumn(c, F.lit("x"))
    piece, byte = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, texts[0][1]), (1, texts[0][1]), (None, "w1"), (2, None), (3, "")], "item_id long, text string").withColumn("key", F.lit("x"))
    whole = {
        "1": prefix_encoder.encode_documents(docs, piece, with_ids=False),
        "2": quality_rules.quality_rules(docs),
        "3": cotraining.classify(docs, labels),
        "6": simhash.simhash_components(docs),
        "8": suffix_dedup.remove_repeats(docs, with_text=False),
        "9": token_counts.token_counts(docs, piece),
        "10": decontaminate.decontaminate(docs, bench),
        "5": compact_windows.without_passages(docs),
    }
    found = {k: df.collect() for k, df in whole.items()}
    assert {k: len(v) for k, v in found.items()} == {k: len(texts) for k in whole}
    assert {x["doc_id"]: x["n_removed"] == x["n_bytes"] for x in found["8"]}[4] and sum(x["n_removed"] for x in found["8"]) == len(long)
    assert {x["text"] for x in found["5"] if x["doc_id"] in (1, 3)} == {texts[2][1], texts[3][1], long}
    assert [len(x["text"]) for x in found["5"] if x["doc_id"] == 4] == [0]
    assert {x["component_id"] for x in found["6"] if x["doc_id"] == 4} == {3}
    index = token_files.read_index(token_files.write_token_files(docs, byte), spark).collect()
    assert sorted(x["doc_id"] for x in index) == [1, 1, 2, 2, 3, 4, 5]
    ends = sorted((x["start"], x["start"] + x["n_tokens"]) for x in index)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    turns = spark.createDataFrame([(None, None, "user", "a"), (None, 1, None, None), (1, 1, "user", "x"), (1, 1, "user", "x"), (2, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    for c in ("tree", "node", "parent", "score", "leaf", "step", "at", "above"):
        turns = turns.withColumn(c, F.lit("x"))
    out = {x["tree"]: x["n_turns"] for x in chat.digests(chat.format_trees(chat.as_tree(turns)), "tree").collect()}
    assert out == {None: 2, 1: 2, 2: 1}


def test_scores_and_exchange_against_brute_force(spark, docs, rows):
    r = random.Random(31)
    labels = spark.createDataFrame([(i, r.randint(0, 1), r.randint(0, 1)) for i, *_ in rows[:40]], "doc_id long, quality int, toxic int")
    table = cotraining.features(docs).cache()
    model = cotraining.fit(table, labels, rounds=1)
    plain, cache = {}, cotraining._Hashes()
    for i, t, lang, source, n in rows:
        words = sorted({cache[x] for x in cotraining.TOKEN.findall((t or "").lower())})
        z = np.clip((np.array(cotraining.page_numbers(t or "", n)) - model.mean) / model.sd, -5, 5)
        page = np.zeros(1 << cotraining.PAGE_BITS)
        page[cotraining.page_marks(lang, source)] = 1
        plain[i] = (words, np.r_[page, z, z * z, 1])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    got = {x["doc_id"]: x for x in cotraining.score(table, model).collect()}
    assert len(got) == len(rows)
    views = {}
    for i, (words, x) in plain.items():
        for t in cotraining.TARGETS:
            a, b, c = model.calibration[t]
            s = a[0] * (model.text[t][0].astype(np.float32)[words].sum(dtype=float) + model.text[t][1]) + a[1]
            p = b[0] * (x @ model.page[t]) + b[1]
            views[i, t] = (sigmoid(s), sigmoid(p))
            assert np.allclose([got[i][f"text_{t}"], got[i][f"page_{t}"], got[i][t]], [sigmoid(s), sigmoid(p), sigmoid(c[0] * s + c[1] * p + c[2])], atol=1e-6)
    known = set(list(plain)[:40])
    counts, slopes, bends, told = cotraining._exchanged(table, model, known, 0.6)
    for k, t in enumerate(cotraining.TARGETS):
        want, slope, bend, n = np.zeros_like(counts[k]), 0, 0, 0
        for i, (words, x) in plain.items():
            if i in known:
                continue
            text, page = (model.confident(t, v, 0.6) for v in views[i, t])
            for value in (0, 1):
                if page[value]:
                    want[value, words] += 1
                    want[value, -1] += 1
            if any(text):
                p = sigmoid(x @ model.page[t])
                slope, bend, n = slope + x * (p - text[1]), bend + np.outer(x, x) * p * (1 - p), n + 1
        assert (counts[k] == want).all() and told[k] == n and np.allclose(slopes[k], slope) and np.allclose(bends[k], bend)
