"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice's nodes are character positions, its edges the vocabulary's pieces. A unigram model adds up the pieces' scores. A BPE
model has no such scores: its merges give the one segmentation whose neighbouring pieces are all compatible (merging the two pieces'
characters gives the two pieces back), so an edge is open if it is compatible with the piece before it, and the same search finds it.
Only positions within the longest piece of the front are kept; when the backpointers of all of them meet in one boundary, the ids up
to it go out. Text is cut where no piece crosses: before a space mark that follows other characters, and at line ends. Such stretches
repeat, so a Python worker keeps the ids of those it has seen.

Ids and decoded texts equal the sentencepiece library's. Defined cases: a null or empty text has no ids; characters without a piece go
to byte pieces (without these, to the unknown id); rows with equal ids are rows of their own; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, local_env, table

SPACE = "▁"
KEPT = 400_000
PARTS_KEPT = 200_000
PAIRS_KEPT = 250_000
STRETCH = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """pieces: text -> (id, score); bytes_: the ids of the 256 byte pieces, or None."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int] | None, unknown: int, bpe: bool) -> None:
        self.pieces, self.bytes_, self.unknown, self.bpe = pieces, bytes_, unknown, bpe
        self.longest = max(map(len, pieces), default=1)
        self.floor = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        #: A tree of the pieces' characters; under the empty string (piece, score) where a piece ends.
        self.tree: dict = {}
        for p, (_, s) in pieces.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, float(s))
        self.inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.cuts = all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or p == "\n") for p in pieces)
        self.splits = bytes_ is not None  # else unknown characters side by side are one id
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def of(cls, path: str, bpe: bool = True) -> Vocabulary:
        local_env()
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        v = cls(pieces, bytes_ if all(map(sp.is_byte, bytes_)) else None, sp.unk_id(), bpe)
        v.table = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        return v

    def merged(self, chars: str) -> list[str]:
        """The BPE merges of a short string: the best-scored neighbours first, the leftmost of equals."""
        parts = list(chars)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                hit = self.pieces.get(parts[i] + parts[i + 1])
                if hit and (best is None or hit[1] > best):
                    best, at = hit[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether b may follow a in a BPE segmentation (a empty: begin it)."""
        key = (a, b)
        hit = self.pairs.get(key)
        if hit is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            hit = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return hit

    def search(self, chars: str) -> Iterator[str]:
        """The pieces of the best path, sent out as soon as all surviving paths agree on them."""
        n, base = len(chars), 0
        # by position - base: (score, the piece that ends there); what lies before base is out
        best: list[tuple[float, str] | None] = [None] * (n + 1 if n <= 4 * self.longest else 6 * self.longest)
        best[0] = (0.0, "")
        tree, pairs, bpe, compatible, none = self.tree, self.pairs, self.bpe, self.compatible, {}
        check = 4 * self.longest
        for j in range(n):
            before = best[j - base]
            if before is None:
                continue
            score, last = before
            node, i = tree.get(chars[j], none), j + 1 - base
            hit = node.get("") or (chars[j], self.floor)  # a piece, or a character without one
            while True:
                if hit is not None:
                    held = best[i]
                    if not bpe:
                        reached = score + hit[1]
                        if held is None or reached > held[0]:
                            best[i] = (reached, hit[0])
                    elif held is None:
                        fits = pairs.get((last, hit[0]))
                        if compatible(last, hit[0]) if fits is None else fits:
                            best[i] = (0.0, hit[0])
                at = i + base
                if at >= n:
                    break
                node = node.get(chars[at])
                if node is None:
                    break
                hit = node.get("")
                i += 1
            if j - base >= check:
                at = self._meeting(best, base, j)
                if at > base:
                    yield from self._back(best, base, at)
                    top = best[at - base][0]
                    ahead = [x and (x[0] - top, x[1]) for x in best[at - base :]]
                    best = ahead + [None] * (at - base)
                    base = at
                    check = 4 * self.longest
                else:  # no agreement yet: more room
                    best += [None] * (2 * self.longest)
                    check += 2 * self.longest
        yield from self._back(best, base, n)

    def _meeting(self, best: list, base: int, front: int) -> int:
        """The last boundary that the paths of all open positions share; base if there is none. All positions up to the front are final, those beyond it are reached from within its last `longest`."""
        places = {p for p in range(max(base, front - self.longest + 1), front + 1) if best[p - base] is not None}
        while len(places) > 1:
            p = max(places)
            places.remove(p)
            places.add(p - len(best[p - base][1]))
            if base in places:
                return base
        return places.pop()

    def _back(self, best: list, base: int, at: int) -> list[str]:
        out = []
        while at > base:
            piece = best[at - base][1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def stretch_ids(self, stretch: str) -> bytes:
        """Ids of a stretch, by its parts: no piece crosses two neighbouring characters that no piece has side by side."""
        inside, at, parts = self.inside, 0, []
        if len(stretch) > 1 and self.splits:
            for i in range(1, len(stretch)):
                if stretch[i - 1 : i + 1] not in inside:
                    parts.append(stretch[at:i])
                    at = i
        if not parts:
            return self.part_ids(stretch)
        parts.append(stretch[at:])
        known = self.known_parts
        if len(known) > PARTS_KEPT:
            known.clear()
        out = []
        for p in parts:
            if p not in known:
                known[p] = self.part_ids(p)
            out.append(known[p])
        return b"".join(out)

    def part_ids(self, stretch: str) -> bytes:
        ids: list[int] = []
        for piece in self.search(stretch):
            hit = self.pieces.get(piece)
            if hit:
                ids.append(hit[0])
            elif self.bytes_:
                ids += [self.bytes_[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:  # neighbouring unknowns are one
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        stretches = STRETCH.findall(marked) if self.cuts else [marked]
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        for s in set(stretches).difference(known):
            known[s] = self.stretch_ids(s)
        return b"".join(map(known.__getitem__, stretches))

    def decode(self, ids: bytes) -> str:
        of = self.table
        text = b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_VOCABULARIES: dict[str, Vocabulary] = {}


def release() -> None:
    _VOCABULARIES.clear()


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.of(path)
    return _VOCABULARIES[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("sentence_piece", release)
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("sentence_piece", release)
        v = vocabulary(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([v.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_ids", "ids_crc32", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded again: how many ids, their checksum, and the decoded text's digest and bytes."""
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    back = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_ids", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"))
