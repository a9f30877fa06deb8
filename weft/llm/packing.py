"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Documents are tokenised, closed with an end id and cut, if longer than a sequence, into pieces of the sequence length. Packing is
best-fit decreasing over counts: the plan handles all pieces of one length at once, so its cost and size depend on the sequence
length only, not on the number of documents. The plan is a table of slots (length, ranks from .. to, first sequence, offset);
a piece takes its slot by its rank among the pieces of its length. Ranks come from counts of (length, bucket), with buckets by a
hash of the piece, so a length that holds most pieces is never sorted in one task.

Defined cases: a null or empty text is one piece holding the end id alone; rows with equal ids are rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import entering, local_env, table, written

SEQUENCE = 4096
END_ID = 1
#: Pieces in one rank bucket, about.
BUCKET_ROWS = 50_000
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """For str.translate: each Latin-1 character as the letters that byte-level BPE writes for its UTF-8 bytes."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    for k, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + k)
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, for tokenizers that drop white space and never join across it.

    Ids of words are kept, so that the library sees each word once; texts in which the library's white space differs from Python's go to it whole."""

    odd = re.compile("[\x1c-\x1f]")
    word = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    tail = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]+)")

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        local_env()
        from tokenizers import Tokenizer

        self.lib, self.kept, self.known = Tokenizer.from_file(path), kept, {}
        self.letters = byte_letters() if self.plain() else None

    def plain(self) -> bool:
        """Whether the library lower-cases, takes runs of letters as words and hands their bytes to BPE, so that words of Latin-1 letters can go to its BPE directly."""
        config = json.loads(self.lib.to_str())
        kinds = lambda part, of: [x["type"] for x in (config[part] or {}).get(of, [])]
        split = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
            and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
            and config["model"]["type"] == "BPE"
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.kept:
            self.known = {}
        known, split, new = self.known, {}, set()
        for w in words:
            if w in known:
                continue
            if w[-1] in ".,!?;:" and (m := self.tail.fullmatch(w)):  # a word of letters, then marks: two words to the library's own splitting
                split[w] = m.groups()
                new.update(x for x in m.groups() if x not in known)
            else:
                new.add(w)
        if self.letters:
            bpe, letters = self.lib.model.tokenize, self.letters
            for w in filter(self.word.fullmatch, new):
                known[w] = array("I", [t.id for t in bpe(w.lower().translate(letters))]).tobytes()
        todo = [w for w in new if w not in known]
        for k in range(0, len(todo), 4096):
            part = todo[k : k + 4096]
            for w, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        for w, (a, b) in split.items():
            known[w] = known[a] + known[b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [None if t and self.odd.search(t) else (t or "").split() for t in texts]
        words = set().union(*(s for s in split if s))
        if len(words) > self.kept:  # more distinct words than are kept: text by text
            return [self.whole(t or "") for t in texts] if len(texts) == 1 else [x for t in texts for x in self.encode([t])]
        words = words.difference(self.known)  # looks up the words; difference_update would go through all that is known
        if words:
            full = len(self.known) + 3 * len(words) > self.kept
            if full:
                self.known = {}
                words = set().union(*(s for s in split if s))
            self.learn(words)
        get = self.known.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def release() -> None:
    _TOKENIZERS.clear()


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("packing", release)
        encoder = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    ids += end
                    rows += [(i, k, k * sequence, min(sequence, len(ids) // 4 - k * sequence), zlib.crc32(ids[4 * k * sequence : 4 * (k + 1) * sequence])) for k in range(-(-len(ids) // (4 * sequence)))]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of all slots, by best-fit decreasing over counts.

    Open sequences with equal contents are one group with a count. For each length, longest first, pieces go to the groups with the
    least room that still holds them; a sequence of room r takes r // length of them before one with more room is touched, as
    best-fit would have it. At most one group is split for a length and room, so the plan is bounded by the sequence length."""
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # room -> [(count, [(length, offset)])]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            fits, groups, rest = room // length, rooms.pop(room), []
            for count, items in groups:
                if not left:
                    rest.append((count, items))
                    continue
                full = min(count, left // fits)
                grown = lambda k, items=items: items + [(length, sequence - room + j * length) for j in range(k)]
                if full:
                    rooms.setdefault(room - fits * length, []).append((full, grown(fits)))
                    left -= full * fits
                if full < count and left:  # fewer than fits are left: one sequence takes them
                    rooms.setdefault(room - left * length, []).append((1, grown(left)))
                    left, full = 0, full + 1
                if full < count:
                    rest.append((count - full, items))
            if rest:
                rooms.setdefault(room, []).extend(rest)
        if left:
            fits = sequence // length
            if full := left // fits:
                rooms.setdefault(sequence - fits * length, []).append((full, [(length, j * length) for j in range(fits)]))
            if over := left % fits:
                rooms.setdefault(sequence - over * length, []).append((1, [(length, j * length) for j in range(over)]))
    slots, rank, base = [], dict.fromkeys(histogram, 0), 0
    for groups in rooms.values():
        for count, items in groups:
            for length, offset in items:
                slots.append((length, rank[length], rank[length] + count, base, offset))
                rank[length] += count
            base += count
    return slots


#: A column of written pieces that spreads rows alike in all else (copies without an id, say) over the rank's buckets.
SALT = "_salt"


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces (a table that rereads alike, with a column length of 1..sequence) with sequence_id and offset."""
    spark = pieces.sparkSession
    by_length = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `sequence` rows
    if not by_length:
        return pieces.drop(SALT).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = np.array(sorted(best_fit(by_length, sequence)), np.int64)
    buckets = max(1, sum(by_length.values()) // BUCKET_ROWS)
    names = [c for c in pieces.columns if c != SALT]
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *[SALT] * (SALT in pieces.columns)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_rank", rank.cast("long")).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    plan = spark.sparkContext.broadcast(slots)  # bounded by the sequence length, whatever the number of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = plan.value
        at = of[:, 0] * (1 << 44) + of[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            slot = of[np.searchsorted(at, length * (1 << 44) + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != SALT) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenises and packs docs; the pieces, a few numbers each, are written to the shared folder so that texts are tokenised once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, str(path), sequence).withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int"))
    return pack(written(pieces, "pieces"), sequence)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
