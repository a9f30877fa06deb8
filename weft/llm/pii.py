"""Personal data in text: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The patterns (e-mail, IP address, card, phone) always stand. The network is trained in numpy on the patterns' spans in at most
SAMPLE_TEXTS texts, and on variants of these: the same places written as the patterns don't know them (VARIANTS of a text). The fit
is bounded: WINDOWS_A_TEXT windows of a text, WINDOWS in all; scans are not. Every span of these kinds holds a digit or an @; characters further than REACH from one have the tag outside
alone, so the network reads the stretches around them, whole texts' worth of them, and nothing else. A stretch is read in overlapping
windows; the windows' emissions are averaged where they overlap and one Viterbi pass over the stretch reconciles them. Spans of the
network that touch no pattern's, have LEAST characters and hold what their kind needs (digits enough, Luhn, an @) are added, under the kinds model_email, model_ip, model_card and model_phone.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no span; rows with equal ids are rows of their own;
a text of any length is read whole; other columns are ignored; an empty table gives an empty result, and nothing to train on gives a network that tags nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, few, table
from weft.llm.crf import Adam, gradients, viterbi
from weft.llm.secret_scan import Span, joined, sampled

SAMPLE_TEXTS = 20_000
WINDOWS, WINDOWS_A_TEXT, VARIANTS = 4_000, 40, 3
REACH, WINDOW, STRIDE = 24, 64, 32
EMBED, HIDDEN, STEPS, BATCH = 8, 16, 240, 128
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"model_{k}" for k in BASE))
TAGS = 1 + 2 * len(BASE)  # outside, then begin and inside of each kind
LEAST = 6

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# runs of digits are taken from their start; a later start in the same run matches no more
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain: the local part is what runs up to the @, from the last match's end at the earliest."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end, "email"
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped."""
    out = list(emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of the text within REACH of a digit or @."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, z = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def windows(a: int, z: int) -> list[tuple[int, int]]:
    return [(s, min(z, s + WINDOW)) for s in range(a, max(a + 1, z - WINDOW + STRIDE), STRIDE)]


SYMBOLS = {c: i + 5 for i, c in enumerate("@.-+() _%:\n,")}
CLASSES = 5 + len(SYMBOLS)  # 0 padding, 1 digit, 2 lower case, 3 upper case, 4 other, then the symbols


def classes(text: str) -> list[int]:
    return [1 if "0" <= c <= "9" else SYMBOLS[c] if c in SYMBOLS else 2 if c.islower() else 3 if c.isupper() else 4 for c in text]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (n x t x HIDDEN) of one direction and what its gradient needs."""
    n, t, _ = x.shape
    h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, t, HIDDEN)), []
    for i in range(t):
        joint = np.concatenate([x[:, i], h], 1)
        g = joint @ w + b
        s, cand = sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
        f, j, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        before, c = c, f * c + j * cand
        tc = np.tanh(c)
        h = o * tc
        out[:, i] = h
        kept.append((joint, f, j, o, cand, before, tc))
    return out, kept


def lstm_back(d_out: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by input, weights and bias."""
    n, t, _ = d_out.shape
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.zeros((n, t, EMBED))
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for i in range(t - 1, -1, -1):
        joint, f, j, o, cand, before, tc = kept[i]
        dh = dh + d_out[:, i]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * before * f * (1 - f), dc * cand * j * (1 - j), dh * tc * o * (1 - o), dc * j * (1 - cand * cand)], 1)
        dw += joint.T @ dg
        db += dg.sum(0)
        back = dg @ w.T
        dx[:, i], dh = back[:, :EMBED], back[:, EMBED:]
        dc = dc * f
    return dx, dw, db


@dataclass
class Model:
    params: dict[str, np.ndarray]

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.params
        x = p["e"][ids]
        ahead, kept_a = lstm(x, p["wa"], p["ba"])
        back, kept_b = lstm(x[:, ::-1], p["wb"], p["bb"])
        h = np.concatenate([ahead, back[:, ::-1]], 2)
        return h @ p["o"] + p["bo"], (h, kept_a, kept_b)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Of each text: spans of the four kinds, by its stretches' best tags."""
        places = [(i, a, z) for i, t in enumerate(texts) for a, z in stretches(t)]
        out: list[list[Span]] = [[] for _ in texts]
        for k in range(0, len(places), 512):
            for (i, a, _), tags in zip(places[k : k + 512], self._tags([texts[i][a:z] for i, a, z in places[k : k + 512]])):
                start = None
                for j, tag in enumerate([*tags, 0]):
                    if start and tag != start[1] + 1:
                        out[i].append((a + start[0], a + j, BASE[start[1] // 2]))
                        start = None
                    if tag and not start:
                        start = (j, int(tag) if tag % 2 else int(tag) - 1)
        return out

    def _tags(self, parts: list[str]) -> list[np.ndarray]:
        spans = [(i, a, z) for i, s in enumerate(parts) for a, z in windows(0, len(s))]
        emit = [np.zeros((len(s), TAGS)) for s in parts]
        times = [np.zeros(len(s)) for s in parts]
        coded = [classes(s) for s in parts]
        for k in range(0, len(spans), 1024):
            some = spans[k : k + 1024]
            ids = np.zeros((len(some), WINDOW), int)
            for r, (i, a, z) in enumerate(some):
                ids[r, : z - a] = coded[i][a:z]
            e, _ = self.forward(ids)
            for r, (i, a, z) in enumerate(some):
                emit[i][a:z] += e[r, : z - a]
                times[i][a:z] += 1
        out = []
        for e, n in zip(emit, times):
            out.append(viterbi((e / n[:, None])[None], self.params["t"], np.array([len(e)]))[0])
        return out


def fit(data: list[tuple[str, list[int]]]) -> Model:
    draw = np.random.default_rng(7)
    size = EMBED + HIDDEN
    params = {"e": draw.normal(0, 0.5, (CLASSES, EMBED)), "wa": draw.normal(0, size**-0.5, (size, 4 * HIDDEN)), "ba": np.zeros(4 * HIDDEN), "wb": draw.normal(0, size**-0.5, (size, 4 * HIDDEN)), "bb": np.zeros(4 * HIDDEN), "o": draw.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
    for j in range(2, TAGS, 2):  # inside follows begin or inside of its kind alone
        params["t"][[i for i in range(TAGS) if i not in (j - 1, j)], j] = -8.0
    params["ba"][:HIDDEN] = params["bb"][:HIDDEN] = 1.0
    model = Model(params)
    if not any(any(tags) for _, tags in data):
        params["o"][:], params["bo"][0] = 0, 10.0
        return model
    n = len(data)
    ids, tags, lengths = np.zeros((n, WINDOW), int), np.zeros((n, WINDOW), int), np.zeros(n, int)
    for i, (s, y) in enumerate(data):
        lengths[i] = len(s)
        ids[i, : len(s)], tags[i, : len(s)] = classes(s), y
    adam = Adam(params, 0.02)
    for _ in range(STEPS):
        rows = draw.integers(0, n, min(BATCH, n))
        emit, (h, kept_a, kept_b) = model.forward(ids[rows])
        _, d_emit, d_trans = gradients(emit, params["t"], tags[rows], lengths[rows])
        d_h = d_emit @ params["o"].T
        dx_a, dwa, dba = lstm_back(d_h[:, :, :HIDDEN], kept_a, params["wa"])
        dx_b, dwb, dbb = lstm_back(d_h[:, ::-1, HIDDEN:], kept_b, params["wb"])
        d_e = np.zeros_like(params["e"])
        np.add.at(d_e, ids[rows].ravel(), (dx_a + dx_b[:, ::-1]).reshape(-1, EMBED))
        adam.step({"e": d_e, "wa": dwa, "ba": dba, "wb": dwb, "bb": dbb, "o": np.einsum("nth,ntk->hk", h, d_emit), "bo": d_emit.sum((0, 1)), "t": d_trans})
    return model


def rewritten(text: str, kind: str, draw: random.Random) -> str:
    """One item as the patterns don't know it."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        name, _, host = text.partition("@")
        return draw.choice((f"{name} @ {host}", f"{name}(@){host}", f"{name}@{host.split('.')[0]}", f"{name} @{host}"))
    if kind == "ip":
        return draw.choice((" . ", "[.]", "(.)", ". ")).join(text.split("."))
    if kind == "card":
        return draw.choice((".", "_", "/", " - ", "  ")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return draw.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[:-10]} {a} {b} {c}", f"({a}) {b} {c}", f"{a} {b} {c}"))


def variants(text: str, seed: int = 0) -> list[tuple[str, Span]]:
    """The text with a pattern's span rewritten, and where that stands."""
    out, draw = [], random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + seed)
    for a, z, k in base_spans(text)[:VARIANTS]:
        new = rewritten(text[a:z], k, draw)
        out.append((text[:a] + new + text[z:], (a, a + len(new), k)))
    return out


def examples(text: str) -> list[tuple[str, list[int]]]:
    """Windows of the text's stretches with the tags of the patterns' spans, and those of the variants' stretches."""
    out = _examples(text, base_spans(text))
    for other, span in variants(text):
        out += _examples(other, [span, *base_spans(other)], span)
    return out


def _examples(text: str, spans: list[Span], near: Span | None = None) -> list[tuple[str, list[int]]]:
    tags = [0] * len(text)
    for a, z, k in spans:
        if not any(tags[a:z]):
            b = 1 + 2 * BASE.index(k)
            tags[a:z] = [b] + [b + 1] * (z - a - 1)
    read = [s for s in stretches(text) if near is None or s[0] < near[1] and near[0] < s[1]]
    return [(text[a:z], tags[a:z]) for s in read for a, z in windows(*s)][:WINDOWS_A_TEXT]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_TEXTS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("pii")
        for batch in batches:
            found = [(i, k, *e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, e in enumerate(examples(t or ""))]
            cols = list(zip(*found)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["i", "k", "x", "y"])

    found = sampled(docs, rows, id_col, text_col).mapInArrow(run, "i long, k int, x string, y array<int>")
    data = few(found, "i", WINDOWS).collect()  # bounded by WINDOWS
    return fit([(r.x, r.y) for r in sorted(data, key=lambda r: (r.i, r.k, r.x))])


def plausible(text: str, kind: str) -> bool:
    """Whether a span that the network reads as this kind holds what makes one: a shape alone, such as 16 digits that fail Luhn, doesn't."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name.strip() and host.strip())
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def all_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the patterns' spans, and these with the network's."""
    return [x[:2] for x in found_spans(texts, model)]


def found_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span], int]]:
    """Of each text the patterns' spans, these with the network's, and how many spans the network finds, with those of the patterns."""
    out = []
    for text, found in zip(texts, model.spans(texts)):
        base = base_spans(text)
        more = [(a, z, f"model_{k}") for a, z, k in found if z - a >= LEAST and plausible(text[a:z], k) and not any(s < z and a < e for s, e, _ in base)]
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))), len(found)))
    return out


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model): one row for each row of docs. n_model: spans that the network finds by itself, the patterns' among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("pii")
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch, out = whole.slice(start, 512), []
                for base, spans, n in found_spans([t or "" for t in batch.column(1).to_pylist()], shared.value):
                    kinds = [k for _, _, k in base]
                    out.append((*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n))
                cols = list(zip(*out)) or [[]] * 7
                types = (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_model"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
