"""Near duplicates, repeats and top-k against brute force, with the odd cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weft.llm import simhash, suffix_dedup, topk
from weft.llm.lcp_merge import common_prefix, decode, front_code, merge

DOCS = "doc_id long, text string, fingerprint string, d long"


def table_of(spark, texts, ids=None):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(ids, fps):
    n = len(fps)
    near = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(n)]
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in near[i])])
            changed |= low != comp[i]
            comp[i] = low
    least = {c: min((ids[i] for i in range(n) if comp[i] == c and ids[i] is not None), default=None) for c in set(comp)}
    return sorted((str(ids[i]), f"{fps[i]:016x}", len(near[i]), str(least[comp[i]])) for i in range(n))


def test_simhash_cases(spark):
    draw = random.Random(4)
    base = " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "Eps"]) for _ in range(4000))
    texts = [None, "", " \t", "one", "ONE", "a b", "a b c d", "a b c d", base, base + " zeta", base + " eta", "É é", *["copy of it all"] * 5]
    ids = [10, 11, 12, 13, 14, None, 3, 3, *range(20, 29)]
    got = simhash.near_duplicates(table_of(spark, texts, ids)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.n_near, str(r.component_id)) for r in got) == brute_links(ids, [brute_fingerprint(t) for t in texts])
    assert simhash.near_duplicates(table_of(spark, ["x"]).limit(0)).count() == 0


def test_pigeonhole_finds_all_pairs(spark):
    draw = random.Random(5)
    centres = [draw.getrandbits(64) for _ in range(40)]
    fps = {c ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for c in centres for _ in range(8)} | set(centres)
    signed = [simhash.signed(f) for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bucket in (2048, 2):  # pairing in buckets, and look-ups for crowded ones
        assert {(r.a, r.b) for r in simhash.near_pairs(rows, bucket=bucket).collect()} == want
    n, both = simhash.co_occurrence(rows)
    for m in (1, 2, 3):
        groups = simhash.correlated_groups(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
    large = both / n * 1e10
    chosen = simhash.plan(10**10, large)
    assert sum(t for _, t in chosen) == 2 - len(chosen) + 1


def test_one_each(spark):
    texts = ["the same text here now"] * 3 + ["another thing entirely said"] + ["the same text here now"]
    docs = table_of(spark, texts, [5, 5, 2, 9, None])
    assert sorted(r.doc_id for r in simhash.one_each(docs).collect()) == [2, 9]
    assert simhash.one_each(table_of(spark, ["p q r s"] * 3, [4, 4, 4])).count() == 1


def brute_repeats(texts, length):
    count = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                cover[s : s + length] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], cover.astype(int)))) == 1))
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("ab é") for _ in range(n))
    shared, hot = word(60), word(33)
    texts = [None, "", "ab", shared, word(50) + shared + word(50), word(20) + shared[5:50] + word(30), shared[:40], "a" * 90, "ab" * 50, *[word(9) + hot + word(9) for _ in range(20)], word(200), "dup " * 3]
    texts += [texts[4], texts[4], "x" + texts[4][1:]]
    ids = [*range(len(texts) - 3), 4, None, 77]  # the same row twice, and one without an id
    got = suffix_dedup.without_repeats(table_of(spark, texts, ids), length=20, k=6).collect()
    want = brute_repeats([(t or "").encode() for t in texts], 20)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.without_repeats(table_of(spark, ["x"]).limit(0)).count() == 0


def test_repeats_at_random_lengths(spark):
    for seed in range(3):
        draw = random.Random(seed)
        bits = ["".join(draw.choice("abcd") for _ in range(draw.randint(5, 45))) for _ in range(12)]
        texts = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 9))) for _ in range(40)]
        got = suffix_dedup.without_repeats(table_of(spark, texts), length=32, k=8).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats([t.encode() for t in texts], 32)


def test_texts_over_a_block():
    draw = random.Random(7)
    text = bytes(draw.choices(b"abcdefgh ", k=suffix_dedup.BLOCK * 2 + 12345))
    rows = list(suffix_dedup.text_anchors([b"", text, b"short"]))
    assert {r[0] for r in rows} == {1} and len({r[1] for r in rows}) == len(rows)
    assert rows[0][2] == 0 and rows[-1][3] == len(text) - suffix_dedup.LENGTH
    assert all(a[3] + 1 == b[2] for a, b in zip(rows, rows[1:]))


def test_cut_repeats_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 15 + "x", "s", 16), (2, "z" + "é" * 15, "t", 16), (3, None, "u", 0)], "doc_id long, text string, source string, n_chars long")
    out = suffix_dedup.cut_repeats(docs, length=20, k=6)
    assert out.columns == docs.columns and {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "x", 1), (2, "z", 1), (3, "", 0)}


def brute_passages(texts, words):
    """Of each text: maximal runs and bytes in passages of so many words that another text holds, and the text without them."""
    split = [list(re.finditer(rb"[^ \t\n\r\v\f]+", t)) for t in texts]
    holders = {}
    for i, ws in enumerate(split):
        for s in range(len(ws) - words + 1):
            holders.setdefault(tuple(w[0] for w in ws[s : s + words]), set()).add((i, texts[i]))
    out = []
    for i, ws in enumerate(split):
        cover = [False] * len(ws)
        for s in range(len(ws) - words + 1):
            if len(holders[tuple(w[0] for w in ws[s : s + words])]) > 1:
                cover[s : s + words] = [True] * words
        runs = [list(g) for on, g in groupby(range(len(ws)), cover.__getitem__) if on]
        spans = [(ws[r[0]].start(), ws[r[-1]].end()) for r in runs]
        out.append((len(spans), sum(z - a for a, z in spans), suffix_dedup.cut(texts[i], spans).decode()))
    return out


def test_passages_against_brute_force(spark):
    for seed in range(4):
        draw = random.Random(seed)
        word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randint(1, 4)))
        bits = [[word() for _ in range(draw.randint(2, 14))] for _ in range(14)]
        texts = []
        for _ in range(45):
            ws = [w for _ in range(draw.randint(0, 7)) for w in draw.choice(bits)]
            texts.append("".join(w + draw.choice([" ", "\n", "  "]) for w in ws))
        texts += [texts[3] + "end", " ".join([*bits[0], *bits[1]] * 6 + ["only here", "q"]), None]
        for words in (7, 12):
            want = brute_passages([(t or "").encode() for t in texts], words)
            docs = table_of(spark, texts).withColumn("n_chars", F.lit(0))
            got = suffix_dedup.without_repeats(docs, length=40, k=8, words=words).orderBy("doc_id").collect()
            assert [(r.n_passages, r.passage_bytes) for r in got] == [w[:2] for w in want]
            cut = suffix_dedup.cut_passages(docs, words=words)
            assert cut.columns == docs.columns and [(r.text, r.n_chars) for r in cut.orderBy("doc_id").collect()] == [(w[2], len(w[2])) for w in want]


def test_words_repeated_in_one_document_stay(spark):
    ws = [f"w{i}" for i in range(60)]
    other = [f"o{i}" for i in range(80)]
    texts = [" ".join(ws * 3 + ["x"] + ws), " ".join(other), " ".join(["y", *other, "z"])]
    got = suffix_dedup.cut_passages(table_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in got] == [texts[0], "", "y  z"]


def test_word_codes_over_a_block():
    draw = random.Random(9)
    text = bytes(draw.choices(b"abcdefgh   \n", k=suffix_dedup.BLOCK + 54321)) + b"q" * (suffix_dedup.BLOCK + 7) + b" end"
    whole = suffix_dedup._coded(text)[0].tobytes()
    assert suffix_dedup.word_codes([b"", text, b"a b", b" "])[1] == whole and len(whole) == 8 * len(text.split())
    assert [len(x) for x in suffix_dedup.word_codes([b"", b"a b", b" ", b"c"])] == [0, 16, 0, 8]


def test_merge_of_runs():
    for seed in range(60):
        draw, runs, strings = random.Random(seed), [], []
        for _ in range(draw.randint(1, 7)):
            run = sorted((bytes(draw.choices(b"ab", k=draw.choice([0, 1, 3, 70, 130]))), draw.randrange(99)) for _ in range(draw.randrange(20)))
            strings += run
            runs.append(decode(*front_code(run)))
        out = list(merge(runs))
        assert [s for _, s, _ in out] == sorted(s for s, _ in strings)
        assert all(b[0] == common_prefix(a[1], b[1]) for a, b in zip(out, out[1:]))


def test_top_k(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(0, 1, (300, 6)).astype(np.float32).tolist()
    vectors[7] = vectors[8]  # a tie
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(400, None, "n"), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], "n"), (600, [float("nan")] * 6, "n"), (700, [float("inf")] * 6, "n"), (None, [1.0] * 6, "n"), (800, [1.0, 2.0], "short"), (900, [], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()
    x = np.floor(np.array(vectors, np.float32).astype(float) * 1024).astype(int)
    for q in range(0, 300, 50):
        best = sorted(((-int(x[q] @ x[j]), j) for j in range(300) if j != q))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {r.query_id for r in got} == set(range(0, 300, 50))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    lists = topk.sub_scores(x, x[:1], 3)
    at, scores, share = topk.nra(lists[:, 0], 5)
    assert share <= 1 and sorted(scores)[-5:] == sorted((x @ x[0]).tolist())[-5:]
