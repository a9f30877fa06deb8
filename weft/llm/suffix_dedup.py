"""Exact removal of long repeated byte strings by a sparse suffix order, built with a common-prefix-aware distributed merge sort.

A string of `length` bytes repeats if it starts at two places of the corpus. Every window of that length has an anchor: the
leftmost start with the least hash among the K-byte strings in it. Equal windows have equal anchors at equal places, so:

1. Each text gives its anchors: hash of the K bytes, the first and last window it answers for, a fingerprint of the bytes of all
   these windows (its context). About one start in a hundred is an anchor.
2. An anchor whose hash is unique answers for windows that don't repeat. Anchors of one hash with one context repeat in full.
   What is left, one of each context where a hash has several, is a sparse set of suffixes, and only these go on with bytes.
3. They are sorted twice: by the bytes from the anchor on and then those before it, backwards; and the other way round. Tasks sort
   runs, runs are cut at sampled splitters, exchanged front-coded, and merged by a loser tree that never compares a known common
   prefix again (lcp_merge.py). Common prefixes with neighbours give how far each context agrees to the right and to the left with
   any other, and so which windows repeat, which don't, and which are open (both ends differ within one context).
4. Open windows, and those of the same hash that could equal them, are counted by a 128-bit fingerprint.

All groups are counted with map-side combine; nothing pairs the members of a group, and a context that a third of all documents
share is one suffix. Texts are moved twice: those with suffixes to sort, and all when the bytes are cut.

The same search runs over words: each word (run of bytes without ASCII white space) is a unit of UNIT bytes, its code, and strings are
of `words` units. cut_passages() cuts passages of over 50 words that another document holds too, however short their words and
whatever the white space between them. There, only repeats across documents count: hashes and contexts of one document alone drop
out, and windows of a document with several contexts of one hash are all counted by their fingerprints and documents.

Defined cases: a null or empty text has 0 bytes; texts shorter than `length` are kept whole; a text of any length is read in blocks of
BLOCK bytes that overlap by a window (or, for words, meet at white space); equal rows repeat each other's
bytes, also if their ids are equal or null (as passages, rows of equal id and text are one document); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, few, forget, sliced, table, written
from weft.llm.lcp_merge import common_prefix, decode, front_code, merge

LENGTH = 400
K = 96
#: Passages: words in the shortest that counts, words that an anchor hashes, bytes of a word's code.
WORDS, WORD_K, UNIT = 51, 10, 8
BLOCK = 1 << 20
#: Bytes of suffixes that a task sorts as one run, and that one range of the order holds, about.
RUN_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
#: Keys that are sampled to split the order, at most; half as many ranges. Up to 512 GB of contexts ranges hold RANGE_BYTES, then more.
SAMPLED = 65_536
BETWEEN = b"\xff"  # never in UTF-8

_MUL = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def _powers(n: int = BLOCK) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS.clear()
        for base in (_MUL, pow(_MUL, -1, 1 << 64)):
            x = np.full(max(n, BLOCK) + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def _sums(block: bytes) -> np.ndarray:
    x = np.frombuffer(block, np.uint8).astype(np.uint64)
    x += np.uint64(1)
    x *= _powers(len(block))[0][: len(x)]
    sums = np.empty(len(x) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(x, out=sums[1:])
    return sums


def word_bounds(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words start and end."""
    space = np.concatenate(([True], _SPACE[np.frombuffer(block, np.uint8)], [True]))
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def _coded(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, start) of each word. A code is a hash of the word's bytes, without the high bit of each of its own."""
    a, z = word_bounds(block)
    sums, inverse = _sums(block), _powers(len(block))[1]
    h = (sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h & np.uint64(0x7F7F7F7F7F7F7F7F), a


def word_codes(texts: list[bytes]) -> list[bytes]:
    """Each text as its words' codes."""
    out: list[bytes] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        codes, a = _coded(b"\n".join(held))
        firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in held])))
        cuts = np.searchsorted(a, firsts)
        out.extend(codes[x:y].tobytes() for x, y in zip(cuts, cuts[1:]))
        held.clear()

    for t in texts:
        if size + len(t) > BLOCK and held:
            flush()
            size = 0
        if len(t) <= BLOCK:
            held.append(t)
            size += len(t) + 1
            continue
        parts, at = [], 0
        while at < len(t):  # to the last white space of a block; a word of over a block is read whole
            end = len(t) if len(t) - at <= BLOCK else max(t.rfind(c, at, at + BLOCK) for c in (b" ", b"\n")) + 1
            if end <= at:
                end = next((i for i in range(at + BLOCK, len(t)) if _SPACE[t[i]]), len(t))
            parts.append(_coded(t[at:end])[0].tobytes())
            at = end
        out.append(b"".join(parts))
    if held:
        flush()
    return out


def release() -> None:
    _POWERS.clear()


def block_anchors(block: bytes, length: int, k: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each string of k units of a block of length..BLOCK units, and for each window start the place of its anchor."""
    power, inverse = _powers()
    n = len(block) // unit
    if unit == 1:
        sums = _sums(block)
    else:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.frombuffer(block, np.uint64) * power[:n])))
    h = sums[k:] - sums[:-k]
    h *= inverse[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = (h & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return h.view(np.int64), (low & np.uint64(BLOCK - 1)).astype(np.int64)


def text_anchors(texts: list[bytes], length: int = LENGTH, k: int = K, unit: int = 1) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text's number, anchor's place, first window, last window, hash of the k units, fingerprint of the context), places in units."""
    import xxhash

    context = xxhash.xxh3_64_intdigest
    at, n = 0, len(texts)
    while at < n:
        if len(texts[at]) > BLOCK * unit:  # in blocks that overlap, so that each window lies in one
            text, step, held_row = texts[at], BLOCK - length + 1, None
            for start in range(0, len(text) // unit - length + 1, step):
                for row in _of_block(text[start * unit : (start + BLOCK) * unit], [at], np.array([0]), start, length, k, context, unit):
                    if held_row and held_row[1] == row[1]:  # one anchor of windows in both blocks
                        lo, hi = held_row[2], row[3]
                        c = context(text[lo * unit : (hi + length) * unit])
                        row = (at, row[1], lo, hi, row[4], c - (1 << 64) if c >> 63 else c)
                    elif held_row:
                        yield held_row
                    held_row = row
            if held_row:
                yield held_row
            at += 1
            continue
        held, size, first = [], 0, at
        while at < n and len(texts[at]) // unit <= BLOCK - size:
            held.append(texts[at])
            size += len(texts[at]) // unit
            at += 1
        if size >= length:
            starts = np.concatenate(([0], np.cumsum([len(t) // unit for t in held])[:-1]))
            yield from _of_block(b"".join(held), list(range(first, at)), starts, 0, length, k, context, unit)


def _of_block(block: bytes, numbers: list[int], starts: np.ndarray, shift: int, length: int, k: int, context, unit: int) -> Iterator[tuple]:
    h, place = block_anchors(block, length, k, unit)
    ends = np.append(starts[1:], len(block) // unit)
    window = np.arange(len(place))
    text = np.searchsorted(starts, window, "right") - 1  # the last of the texts that start there, so empty texts have none
    keep = window + length <= ends[text]
    window, text, place = window[keep], text[keep], place[keep]
    if not len(window):
        return
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(new[1:] - 1, len(window) - 1)
    at = starts[text[new]] - shift
    for t, p, a, z, o, x in zip(text[new].tolist(), place[new].tolist(), window[new].tolist(), window[last].tolist(), at.tolist(), h[place[new]].tolist()):
        c = context(block[a * unit : (z + length) * unit])
        yield numbers[t], p - o, a - o, z - o, x, c - (1 << 64) if c >> 63 else c


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def in_units(batch: pa.RecordBatch, unit: int) -> list[bytes]:
    """Texts as bytes, or as their words' codes."""
    return utf8(batch) if unit == 1 else word_codes(utf8(batch))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the row's key (d, th). Rows with equal keys have equal ids and texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    i = F.col(id_col).cast("long")
    return docs.select(i.alias("doc_id"), text.alias("text"), F.coalesce(i, F.lit(-1)).alias("d"), F.xxhash64(text, i.isNull()).alias("th"))


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


ANCHORS = _schema(("d", pa.int64()), ("th", pa.int64()), ("p", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("c", pa.int64()))


def anchors(rows: DataFrame, length: int, k: int, unit: int = 1) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup", release)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found = np.array(list(text_anchors(in_units(batch, unit), length, k, unit)), np.int64).reshape(-1, 6)
                d, th = (batch.column(x).to_numpy(zero_copy_only=False)[found[:, 0]] for x in ("d", "th"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, th, *found[:, 1:].T)], schema=ANCHORS)

    return rows.select("d", "th", "text").mapInArrow(run, "d long, th long, p long, lo long, hi long, h long, c long")


def contexts(rows: DataFrame, wanted: DataFrame, length: int, unit: int = 1) -> DataFrame:
    """The units of each wanted (d, th, p, lo, hi, h, n): text[lo : hi + length], once a key."""
    asked = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("p", "lo", "hi", "h", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup", release)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, out = whole.slice(start, 256), []
                for d, th, text, asked in zip(batch.column("d").to_pylist(), batch.column("th").to_pylist(), in_units(batch, unit), batch.column("asked").to_pylist()):
                    out += [(d, th, x["p"], x["lo"], x["hi"], x["h"], x["n"], text[x["lo"] * unit : (x["hi"] + length) * unit]) for x in asked]
                cols = list(zip(*out)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:7]], pa.array(cols[7], pa.binary())], ["d", "th", "p", "lo", "hi", "h", "n", "bytes"])

    found = rows.select("d", "th", "text").join(asked, ["d", "th"]).mapInArrow(run, "d long, th long, p long, lo long, hi long, h long, n long, bytes binary")
    return found.dropDuplicates(["d", "th", "p"]).withColumn("id", F.monotonically_increasing_id())


def key_of(data: bytes, at: int, forward: bool) -> bytes:
    """A context as a key: from the anchor on, then backwards from it; or the other way round."""
    right, left = data[at:], data[:at][::-1]
    return right + BETWEEN + left if forward else left + BETWEEN + right


def order(ctx: DataFrame, forward: bool, unit: int = 1) -> DataFrame:
    """(id, best, other): of each context, the most units in which it agrees with any other on the first side, and, where it agrees with a neighbour on all of that side, in how many on the other side."""
    spark = ctx.sparkSession
    size = ctx.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)), F.count("*")).first()
    ranges = min(max(1, int(size[0]) // RANGE_BYTES), SAMPLED // 2)
    splitters: list[bytes] = []
    at = ((F.col("p") - F.col("lo")) * unit).alias("at")
    if ranges > 1:
        sample = few(ctx.select("id", "bytes", at), "id", min(SAMPLED, 32 * ranges)).collect()  # bounded: contexts of under 2 * length units
        keys = sorted(key_of(bytes(r.bytes), r.at, forward) for r in sample)
        splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    cuts = spark.sparkContext.broadcast(splitters)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        def out(held: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
            held.sort()
            edges = [0, *[bisect_right(held, s, key=lambda x: x[0]) for s in cuts.value], len(held)]
            for r, (a, z) in enumerate(zip(edges, edges[1:])):
                if z > a:
                    tails, *numbers = front_code(held[a:z])
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([tails], pa.binary()), *[pa.array([x], pa.list_(t)) for x, t in zip(numbers, (pa.int32(), pa.int32(), pa.int64()))]], ["range", "tails", "prefixes", "lengths", "ids"])

        held, size = [], 0
        for batch in batches:
            for data, at, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((key_of(data, at, forward), i))
                size += len(data)
                if size > RUN_BYTES:
                    yield from out(held)
                    held, size = [], 0
        yield from out(held)

    def merged(group: pa.Table) -> pa.Table:
        cols = [group.column(c).to_pylist() for c in ("tails", "prefixes", "lengths", "ids")]
        found, edge = [], [b"", b""]
        before: bytes | None = None
        for n, s, i in merge([decode(*x) for x in zip(*cols)]):
            mid = s.index(BETWEEN)
            if before is None:
                edge[0], n = s, 0
            elif n:
                found[-1][1] = max(found[-1][1], n)
            found.append([i, n, mid])
            before = s
        edge[1] = before or b""
        ids, best, mids = (list(x) for x in zip(*found))
        ends = [None] * len(ids)
        last = list(ends)
        ends[0], last[-1] = edge[0], edge[1]
        return pa.table({"range": pa.array([group.column("range")[0].as_py()] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()), "n": pa.array(best, pa.int64()), "mid": pa.array(mids, pa.int64()), "first": pa.array(ends, pa.binary()), "last": pa.array(last, pa.binary())})

    exchanged = ctx.select("bytes", at, "id").mapInArrow(runs, "range int, tails binary, prefixes array<int>, lengths array<int>, ids array<long>")
    done = written(exchanged.groupBy("range").applyInArrow(merged, "range int, id long, n long, mid long, first binary, last binary"), "suffix-order")
    # neighbours in different ranges: two strings a range
    edges: dict[int, int] = {}
    if ranges > 1:
        last_id, last_key = None, b""
        for r in done.where("first is not null or last is not null").orderBy("range", F.col("first").isNull()).toLocalIterator():
            if r.first is not None:
                if last_id is not None:
                    n = common_prefix(last_key, bytes(r.first))
                    edges[last_id], edges[r.id] = max(edges.get(last_id, 0), n), max(edges.get(r.id, 0), n)
            if r.last is not None:
                last_id, last_key = r.id, bytes(r.last)
    n = F.col("n")
    if edges:
        more = spark.createDataFrame(list(edges.items()), "id long, more long")
        done = done.join(F.broadcast(more), "id", "left")  # two rows a range
        n = F.greatest("n", F.coalesce("more", F.lit(0)))
    full = n > F.col("mid")
    return done.select("id", F.floor(F.least(n, "mid") / unit).alias("best"), F.when(full, F.floor((n - F.col("mid") - 1) / unit)).otherwise(-1).alias("other"))


def window_prints(ctx: DataFrame, length: int, unit: int = 1) -> DataFrame:
    """(d, th, p, s, n, f1, f2): a fingerprint of each window s = p - back, back in lo_back..hi_back, of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup", release)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                cols, prints, out = [batch.column(c).to_pylist() for c in ("d", "th", "p", "lo", "lo_back", "hi_back", "n", "bytes")], [], []
                for d, th, p, lo, a, z, n, data in zip(*cols):
                    for s in range(p - z, p - a + 1):
                        prints.append(hashlib.blake2b(data[(s - lo) * unit : (s - lo + length) * unit], digest_size=16).digest())
                        out.append((d, th, p, s, n))
                ids = np.array(out, np.int64).reshape(-1, 5)
                f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ids.T, *f.T)], ["d", "th", "p", "s", "n", "f1", "f2"])

    return ctx.select("d", "th", "p", "lo", "lo_back", "hi_back", "n", "bytes").mapInArrow(run, "d long, th long, p long, s long, n long, f1 long, f2 long")


def repeated_spans(rows: DataFrame, length: int = LENGTH, k: int = K, unit: int = 1, across: bool = False) -> DataFrame:
    """(d, th, a, z): intervals of the texts (of keyed()), in units, that together are all units in repeated strings; across: in strings that two documents hold."""
    if k > length:
        raise ValueError("k is at most length")
    found = written(anchors(rows, length, k, unit), "anchors")
    doc = F.struct("d", "th")
    several = F.min(doc) != F.max(doc)
    known = found.groupBy("h").agg(F.count("*").alias("times"), (F.min("c") != F.max("c")).alias("mixed"), *[several.alias("several")] * across).where("several" if across else "times > 1").select("h", "mixed")
    found_again = written(found.join(known, "h"), "anchors-repeated")
    forget(found)
    plain = found_again.where("not mixed").select("d", "th", F.col("lo").alias("a"), (F.col("hi") + length).alias("z")).distinct()
    mixed = found_again.where("mixed")
    times = F.when(several, 2).otherwise(1).cast("long") if across else F.count("*")
    one = mixed.groupBy("h", "c").agg(times.alias("n"), F.count("*").alias("times"), F.min(F.struct("d", "th", "p", "lo", "hi")).alias("m")).select("h", "c", "n", "times", "m.*")
    one = written(one, "contexts-once")
    again = mixed.join(one.where("n > 1").select("h", "c"), ["h", "c"]).select("d", "th", F.col("lo").alias("a"), (F.col("hi") + length).alias("z")).distinct()
    ctx = written(contexts(rows, one.drop("c", "times"), length, unit), "contexts")
    right = order(ctx, True, unit)
    left = order(ctx, False, unit)
    near = ctx.select("id", "d", "th", "p", "lo", "hi", "h", "n").join(right.select("id", F.col("best").alias("r"), F.col("other").alias("r_left")), "id").join(left.select("id", F.col("best").alias("l"), F.col("other").alias("l_right")), "id")
    # windows by how far back of the anchor they start; those of one text's context that can repeat are p_lo..p_hi
    near = near.select("id", "d", "th", "p", "lo", "hi", "h", "n", (F.col("p") - F.col("hi")).alias("least"), (F.col("p") - F.col("lo")).alias("most"), "r", "l", "r_left", "l_right")
    near = near.withColumns({"p_lo": F.greatest("least", F.lit(length) - F.col("r")), "p_hi": F.least("most", "l")})
    # certain: with a neighbour that agrees on the whole right side, back <= r_left; on the whole left side, back >= length - l_right
    near = near.withColumns({"sure_hi": F.when(F.col("r_left") >= 0, F.least("most", "r_left")).otherwise(-1), "sure_lo": F.when(F.col("l_right") >= 0, F.greatest("least", F.lit(length) - F.col("l_right"))).otherwise(length + 1)})
    if across:  # a neighbour may be of the same document; then nothing is certain
        mates = one.where("n = 1").groupBy("h", "d", "th").count().where("count > 1").select("h", "d", "th", F.lit(True).alias("mates"))
        near = near.join(mates, ["h", "d", "th"], "left").withColumns({"sure_hi": F.when(F.col("mates"), -1).otherwise(F.col("sure_hi")), "sure_lo": F.when(F.col("mates"), length + 1).otherwise(F.col("sure_lo"))}).drop("mates")
    near = written(near, "contexts-ordered")
    sure = near.where("n = 1 and sure_hi >= least").select("d", "th", "p", (F.col("p") - F.col("sure_hi")).alias("a"), (F.col("p") - F.col("least") + length).alias("z"))
    sure = sure.unionByName(near.where("n = 1 and sure_lo <= most").select("d", "th", "p", (F.col("p") - F.col("most")).alias("a"), (F.col("p") - F.col("sure_lo") + length).alias("z")))
    open_lo, open_hi = F.greatest("p_lo", F.col("sure_hi") + 1), F.least("p_hi", F.col("sure_lo") - 1)
    pending = near.where("n = 1").select("h", open_lo.alias("a"), open_hi.alias("z")).where("a <= z").groupBy("h").agg(F.min("a").alias("o_lo"), F.max("z").alias("o_hi"))
    asked = near.join(pending, "h").select("id", F.greatest("p_lo", "o_lo").alias("lo_back"), F.least("p_hi", "o_hi").alias("hi_back")).where("lo_back <= hi_back")
    prints = written(window_prints(ctx.join(asked, "id"), length, unit), "windows")
    twice = prints.groupBy("f1", "f2").agg(F.count("*").alias("times"), F.max("n").alias("most"), several.alias("several")).where("several or most > 1" if across else "times > 1").select("f1", "f2")
    middle = prints.join(twice, ["f1", "f2"]).select("d", "th", "p", F.col("s").alias("a"), (F.col("s") + length).alias("z"))
    sorted_out = sure.unionByName(middle)
    if across:  # a context that one document alone holds, several times, went on once
        others = mixed.join(one.where("n = 1 and times > 1").select("h", "c", F.col("p").alias("p0")), ["h", "c"]).where("p != p0").select("d", "th", F.col("p0").alias("p"), (F.col("p") - F.col("p0")).alias("shift"))
        sorted_out = sorted_out.unionByName(sorted_out.join(others, ["d", "th", "p"]).select("d", "th", "p", (F.col("a") + F.col("shift")).alias("a"), (F.col("z") + F.col("shift")).alias("z")))
    spans = written(plain.unionByName(again).unionByName(sorted_out.drop("p")), "spans")
    forget(found_again, one, ctx, near, prints)
    return spans


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged intervals of words as intervals of bytes, from the first word's start to the last one's end."""
    if not spans:
        return []
    a, z = word_bounds(text)
    return [(int(a[x]), int(z[y - 1])) for x, y in merged_spans(spans)]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in spans:
        parts.append(text[at:a])
        at = z
    return b"".join([*parts, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, kept_text): one row for each row of docs.

    Strings of `length` bytes are removed; passages of `words` words that another document holds too are counted (maximal runs, and bytes in
    them). kept_text leaves out characters that were cut in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup", release)
        for batch in sliced(batches):
            out = []
            for text, spans in zip(utf8(batch), batch.column("spans").to_pylist()):
                gone = merged_spans([(x["a"], x["z"]) for x in spans or [] if not x["words"]])
                passages = in_bytes(text, [(x["a"], x["z"]) for x in spans or [] if x["words"]])
                rest = cut(text, gone)
                out.append((len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), len(passages), sum(z - a for a, z in passages), rest.decode("utf-8", "ignore")))
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "kept_text"])

    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, k).withColumn("words", F.lit(False)).unionByName(repeated_spans(rows, words, min(words, WORD_K), UNIT, True).withColumn("words", F.lit(True)))
    by_row = spans.groupBy("d", "th").agg(F.collect_set(F.struct("words", "a", "z")).alias("spans"))
    return rows.join(by_row, ["d", "th"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, kept_text string")


def _without(docs: DataFrame, id_col: str, text_col: str, count_col: str, length: int, k: int, words: bool) -> DataFrame:
    names = docs.columns
    rows = docs.withColumns({"__weft_text": F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__weft_i": F.col(id_col).cast("long")})
    rows = rows.withColumns({"__weft_d": F.coalesce("__weft_i", F.lit(-1)), "__weft_th": F.xxhash64("__weft_text", F.col("__weft_i").isNull())})
    spans = repeated_spans(rows.select(F.col("__weft_d").alias("d"), F.col("__weft_th").alias("th"), F.col("__weft_text").alias("text")), length, k, UNIT if words else 1, words)
    by_row = spans.groupBy(F.col("d").alias("__weft_d"), F.col("th").alias("__weft_th")).agg(F.collect_set(F.struct("a", "z")).alias("__weft_spans"))
    at = names.index(text_col)

    def rest(text: bytes, spans: list[dict] | None) -> str:
        found = [(x["a"], x["z"]) for x in spans or []]
        return cut(text, in_bytes(text, found) if words else merged_spans(found)).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("suffix_dedup", release)
        for batch in sliced(batches):
            cols = [batch.column(c) for c in names]
            cols[at] = pa.array([rest(*x) for x in zip(utf8(batch, text_col), batch.column("__weft_spans").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = rows.drop("__weft_text", "__weft_i").join(by_row, ["__weft_d", "__weft_th"], "left").select(*names, "__weft_spans").mapInArrow(run, docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(dict(docs.dtypes)[count_col])) if count_col in names else out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", length: int = LENGTH, k: int = K) -> DataFrame:
    """docs with all repeated bytes cut from the text (and characters cut in part left out), and count_col, if there, as its new length. Null texts become empty."""
    return _without(docs, id_col, text_col, count_col, length, k, False)


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", words: int = WORDS) -> DataFrame:
    """The same for passages of `words` words or more that another document holds too: all occurrences are cut."""
    return _without(docs, id_col, text_col, count_col, words, min(words, WORD_K), True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
