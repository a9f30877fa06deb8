"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is a 64-bit majority vote over XXH64 (seed 42) of a document's 3-word shingles. Fingerprints link at a Hamming
distance of at most tau. Copies collapse first: links are sought between distinct fingerprints only.

The search follows the generalised pigeonhole principle: bits are put into m groups, group i gets a threshold t_i with
sum(t_i) = tau - m + 1, and any pair within tau agrees within t_i in some group i (t_i = -1: the group isn't probed). Bits that
are correlated over the corpus go into the same group, and m and the thresholds are chosen by dynamic programming on the number
of probes and the estimated number of candidates. Candidates are verified on the whole fingerprints. Buckets with many distinct
fingerprints aren't paired: their members enumerate the Hamming ball and look it up, which is exact and linear in the members.

Defined cases: a null, empty or white text has fingerprint 0 and links like any other; rows with equal ids are rows of their
own; a null id never is a component's id unless all ids of it are null; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import components, entering, forget, join_hot, table, written

BITS = 64
TAU = 2
#: Buckets with more distinct fingerprints than this are answered by ball look-ups instead of pairing.
BUCKET = 2_048
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not parts:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(parts) - words] + 1))
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k (value 1 << k) is set if set in over half of the hashes."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("simhash")
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def co_occurrence(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, in how many both are set: 64 x 64 numbers a task go to the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k in range(0, len(bits), BLOCK):
                x = bits[k : k + BLOCK].astype(np.float32)
                both += x.T @ x
            n += len(bits)
        ids = np.repeat(np.arange(BITS, dtype=np.int32), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1).astype(np.int32)), pa.array(np.append(np.tile(np.arange(BITS), BITS), -1).astype(np.int32)), pa.array(np.append(both.ravel(), n))], ["i", "j", "n"])

    sums = distinct.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in sums:
        if r.i < 0:
            n = int(r.n)
        else:
            both[r.i, r.j] = r.n
    return n, both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, each of at most ceil(64 / m), by joining the most correlated ones first."""
    if m == 1:
        return [list(range(BITS))]
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    most, of, groups = -(-BITS // m), list(range(BITS)), {k: [k] for k in range(BITS)}
    for _, i, j in sorted(((-corr[i, j], i, j) for i, j in combinations(range(BITS), 2))):
        a, b = of[i], of[j]
        if a != b and len(groups[a]) + len(groups[b]) <= most:
            for k in groups[b]:
                of[k] = a
            groups[a] += groups.pop(b)
    out = sorted(groups.values(), key=len, reverse=True)
    while len(out) > m:  # what is left over fills the groups with room
        loose = out.pop()
        for k in loose:
            min((g for g in out[:m]), key=len).append(k)
    return [sorted(g) for g in out]


def candidates_at(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs of n fingerprints that differ in at most t bits of the group, for t = 0..most.

    Per bit, two fingerprints differ with probability 2p(1-p); each bit is taken given the earlier bit of the group with which it is correlated most."""
    p = np.diag(both) / max(n, 1)
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for k, bit in enumerate(group):
        q = 2 * p[bit] * (1 - p[bit])
        if k:
            pair = both[bit, group[:k]] / max(n, 1)
            phi = (pair - p[bit] * p[group[:k]]) / np.sqrt(np.maximum(p[bit] * (1 - p[bit]) * p[group[:k]] * (1 - p[group[:k]]), 1e-12))
            q *= 1 - min(1.0, float(np.max(phi**2)))
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return list(np.cumsum(dist) * n * n / 2)


def plan(n: int, both: np.ndarray, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, cheapest by probes and candidates over all m and all allocations."""
    from math import comb

    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, tau + 2):
        groups = correlated_groups(n, both, m)
        total = tau - m + 1
        # state: sum of (t_i + 1) so far -> (cost, thresholds)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            near, nxt = candidates_at(n, both, g, tau), {}
            for used, (cost, ts) in states.items():
                for t in range(-1, tau + 1):
                    to = used + t + 1
                    if to > total + m:
                        break
                    more = 0.0 if t < 0 else 2.0 * n * sum(comb(len(g), k) for k in range(t + 1)) + near[t]
                    if to not in nxt or cost + more < nxt[to][0]:
                        nxt[to] = (cost + more, [*ts, t])
            states = nxt
        cost, ts = states[total + m]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts)])
    assert best
    return best[1]


def ball(bits: list[int], t: int) -> list[int]:
    return [signed(sum(1 << b for b in flip)) for k in range(t + 1) for flip in combinations(bits, k)]


def near_pairs(distinct: DataFrame, tau: int = TAU, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) at a distance of at most tau, each once."""
    n, both = co_occurrence(distinct)
    parts = [(g, t) for g, t in plan(n, both, tau) if t >= 0]
    masks = [signed(sum(1 << b for b in g)) for g, _ in parts]
    fp = F.col("fp")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(mask)).alias("key")) for i, mask in enumerate(masks)]))
    index = distinct.select("fp", keys.alias("k")).select("fp", "k.i", "k.key")
    hot = index.groupBy("i", "key").count().where(F.col("count") > bucket).select("i", "key")
    hot = written(hot, "hot-buckets")
    any_hot = bool(hot.take(1))
    if any_hot:
        in_hot = index.join(hot, ["i", "key"], "left_semi").select("fp").distinct()
        index = index.join(hot, ["i", "key"], "left_anti")

    def keys_near(i: int) -> F.Column:
        (g, t), mask = parts[i], masks[i]
        return F.transform(F.array(*[F.lit(x) for x in ball(g, t)]), lambda x: F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(mask)).bitwiseXOR(x).alias("key")))

    probes = distinct.select("fp", F.explode(F.flatten(F.array(*map(keys_near, range(len(parts)))))).alias("k"))
    probes = probes.select(F.col("fp").alias("a"), "k.i", "k.key")
    pairs = probes.join(index.select(F.col("fp").alias("b"), "i", "key"), ["i", "key"]).where("a < b")
    gap = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.where(F.bit_count(gap) <= tau)
    if any_hot:
        flips = [x for x in ball(list(range(BITS)), tau) if x]
        reach = in_hot.select(fp.alias("a"), F.explode(F.array(*[F.lit(x) for x in flips])).alias("x")).select("a", F.col("a").bitwiseXOR(F.col("x")).alias("b"))
        reach = reach.join(distinct.select(fp.alias("b")), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pairs.select("a", "b").unionByName(reach).distinct()
    first = F.lit(True)  # a pair that several groups find counts in the first
    for j, ((_, t), mask) in enumerate(zip(parts, masks)):
        first = first & ((F.col("i") <= j) | (F.bit_count(gap.bitwiseAND(F.lit(mask))) > t))
    return pairs.where(first).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id): one row for each row of docs."""
    return link(written(fingerprints(docs, id_col, text_col), "fingerprints"), tau)


def classes(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """(fp, root, n_near, component_id) of each fingerprint in (doc_id, fp); root names the component."""
    known = written(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "fingerprint-classes")
    pairs = written(near_pairs(known, tau), "fingerprint-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(known.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = written(components(pairs).withColumnRenamed("node", "fp"), "fingerprint-roots")
    all_ = known.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = all_.groupBy("root").agg(F.min("least").alias("component_id"))
    out = written(all_.join(least, "root").select("fp", "root", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id"), "fingerprint-results")
    forget(known, pairs, roots)
    return out


def link(rows: DataFrame, tau: int = TAU) -> DataFrame:
    """near_duplicates() from (doc_id, fp)."""
    out = join_hot(rows, classes(rows, tau), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest id (null ids last), of equal ids the one with the smallest hash of the row."""
    mark = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("simhash")
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "mark", "fp"])

    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, mark long, fp long"), "fingerprints")
    rooted = join_hot(rows, classes(rows, tau).select("fp", "root"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("w"))
    first = written(first.select(F.coalesce("w.doc_id", F.lit(-1)).alias("__weft_id"), F.col("w.no_id").alias("__weft_no_id"), F.col("w.mark").alias("__weft_mark")), "fingerprint-winners")
    keyed = docs.withColumns({"__weft_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "__weft_no_id": F.col(id_col).isNull(), "__weft_mark": mark})
    kept = keyed.join(first, ["__weft_id", "__weft_no_id", "__weft_mark"], "left_semi")
    again = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("__weft_id"), F.col("doc_id").isNull().alias("__weft_no_id"), F.col("mark").alias("__weft_mark")).join(first, ["__weft_id", "__weft_no_id", "__weft_mark"], "left_semi").groupBy("__weft_id", "__weft_no_id", "__weft_mark").count().where("count > 1").take(1)
    if again:  # rows that are equal in all columns
        kept = kept.dropDuplicates(["__weft_id", "__weft_no_id", "__weft_mark"])
    return kept.select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
