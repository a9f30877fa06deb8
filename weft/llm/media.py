"""Media columns: interleaved document sequences, content-addressed payloads, and their resolution by digest.

A page parses to an ordered array of text and media-reference structs; a reference keeps its position and its caption (the
figcaption of its figure, else its alt text). Payloads lie once in a store keyed by the digest of their stored form. References meet
payloads in a join on the digest: what travels is narrow (digest, position, caption and the payload's features), the bytes stay in the
store's files. A payload is stored as an 8-bit grey PNG of 64 columns, losslessly, and features come from the samples read back.

Defined cases: null or empty HTML gives an empty sequence; a reference without a payload in the store keeps its place with nulls;
a null or empty text is a payload of 64 zero bytes; equal texts give equal values; rows with equal ids are rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, join_hot, table, written

#: Digests that a task remembers to have stored.
REMEMBERED = 100_000
WIDTH = 64
LEVEL = 1
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
BLOCKS = frozenset("p div section article header footer main aside nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote br hr figure body html dl dt dd form".split())
SILENT = frozenset(("script", "style", "noscript", "template", "head"))


class SequenceParser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figures: list[dict] = []  # open figures: the items they began at, and caption text

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.figures[-1]["open"] = True
        elif tag in MEDIA_TAGS:
            at = {k: v or "" for k, v in attrs}
            if at.get("src"):
                self.flush()
                self.items.append({"kind": MEDIA_TAGS[tag], "text": None, "ref": at["src"], "caption": " ".join(at.get("alt", "").split()) or None})
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append({"from": len(self.items), "caption": [], "open": False})

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.figures:
            self.figures[-1]["open"] = False
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.close_figure()

    def close_figure(self) -> None:
        figure = self.figures.pop()
        caption = " ".join("".join(figure["caption"]).split())
        if caption:
            for item in self.items[figure["from"] :]:
                if item["ref"]:
                    item["caption"] = caption

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        (self.figures[-1]["caption"] if self.figures and self.figures[-1]["open"] else self.text).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        while self.figures:
            self.close_figure()
        return [{"position": i, **item} for i, item in enumerate(self.items)]


def sequence(html: str | None) -> list[dict]:
    parser = SequenceParser()
    parser.feed(html or "")
    return parser.finish()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, items): each page's ordered items."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("media")
        of = pa.list_(pa.struct([("position", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "ref", "caption")]]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(t) for t in batch.column(1).to_pylist()], of)], [id_col, "items"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, items {ITEMS}")


def resolved(seqs: DataFrame, store: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, position, kind, caption, digest, and the store's other columns): every reference with its payload's row. store: one row a digest.

    The references are written first, so that pages are parsed once for the counts and the join."""
    items = seqs.select(id_col, F.explode("items").alias("item")).where("item.ref is not null")
    refs = items.select(id_col, "item.position", "item.kind", "item.caption", F.when(F.col("item.ref").startswith(SCHEME), F.substring("item.ref", len(SCHEME) + 1, 64)).otherwise(F.col("item.ref")).alias("digest"))
    return join_hot(written(refs, "media-references"), store, "digest")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload, of a positive multiple of `width` bytes, as rows of grey samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlacing (rows x columns)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, shape = 8, b"", (0, 0)
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlacing")
            shape = (height, width)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(shape[0], shape[1] + 1)
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((shape[0] + 1, shape[1] + 1), np.int64)
    for r, row in enumerate(raw.astype(np.int64)):
        for c in range(shape[1]):
            left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
            base = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            out[r + 1, c + 1] = (row[c + 1] + (0, left, up, (left + up) // 2, base)[row[0]]) % 256
    return out[1:, 1:].astype(np.uint8)


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def described(samples: np.ndarray) -> str:
    """Features of grey samples: mean, deviation, entropy, and the mean steps along rows and columns."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    x = samples.astype(np.int16)
    along = np.abs(np.diff(x, axis=1)).mean() if x.shape[1] > 1 else 0.0
    down = np.abs(np.diff(x, axis=0)).mean() if len(x) > 1 else 0.0
    return f"mean={flat.mean():.4f};dev={flat.std():.4f};entropy={-(some * np.log2(some)).sum():.4f};along={along:.4f};down={down:.4f};rows={len(x)}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, html, digest, media): each text's payload in its stored form, and a page that shows it with its byte count as caption. A task stores a digest once (media is null where it comes again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("media")
        there: set[str] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, html, digests, media = whole.slice(start, 256), [], [], []
                for text in batch.column(1).to_pylist():
                    payload, n = padded(text)
                    image = encode_png(payload)
                    digests.append(hashlib.sha256(image).hexdigest())
                    media.append(None if digests[-1] in there else image)
                    there.add(digests[-1])
                    if len(there) > REMEMBERED:
                        there.clear()
                    html.append(f'<figure><img src="{SCHEME}{digests[-1]}" alt="{escape("text as samples")}"><figcaption>{n}</figcaption></figure>')
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["doc_id", "html", "digest", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, html string, digest string, media binary")


def read_back(store: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): of the stored bytes, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("media")
        for batch in batches:
            out = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                samples = decode_png(media)
                payload = samples.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), described(samples)))
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.where("media is not null").select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media, resolves each document's reference and gives the features of the payload."""
    store = written(stored(docs, id_col, text_col), "media-store")
    out = resolved(sequences(store, "doc_id", "html"), written(read_back(store), "media-features"), "doc_id")
    return out.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
