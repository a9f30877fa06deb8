"""Secrets in text: fixed patterns, and a linear-chain conditional random field over tokens for what they miss.

The patterns (assignments, access keys, long hexadecimal runs) always stand. The random field tags tokens as a secret's begin, its
inside, or outside, from the token's shape, the words beside it and features of the whole text; spans it finds apart from the
patterns' are added under the kind `crf`. It is trained on the patterns' own spans in at most SAMPLE_TEXTS texts and on variants of
these: the same places with another keyword or none, other prefixes and other alphabets than the patterns know (VARIANTS of a text), letters alone and short ones too.
Half of the examples are without neighbouring words, so that shape and neighbours both carry weight. The fit is bounded: RUNS_A_TEXT
runs of at most RUN_TOKENS tokens of a text, RUNS in all; scans are not.

Every token of a text is decoded, short ones and those of letters alone too; over two characters between tokens part the chain. Most
tokens need no search: if a token's lead of the tag outside exceeds all that the words and marks beside it and its
neighbours' tags can take from it, it is outside on the best path. The rest is decoded with these as fixed ends, which gives the best path of the whole chain.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no span; rows with equal ids are rows of their own;
a text of any length is decoded whole; other columns are ignored; an empty table gives an empty result, and nothing to train on gives a field that tags nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect, bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import entering, few, sliced, table
from weft.llm.crf import Adam, gradients, viterbi

SAMPLE_TEXTS = 20_000
#: Runs of tokens taken from one sampled text, and from all, at most; tokens of a run in training.
RUNS_A_TEXT, RUNS, RUN_TOKENS = 20, 40_000, 8
VARIANTS = 2
#: Of texts without a pattern's span one in so many gives a run wherever it falls.
PROSE = 2
STEPS = 80
#: Tokens whose shapes a Python worker keeps.
KEPT_TOKENS = 600_000
KINDS = ("assign", "access", "hex", "crf")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(f"({'|'.join([*map(_either, KEYWORDS[:4]), _either('api') + '_?' + _either('key')])})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

TOKEN = re.compile(r"[\w+/-]+(?:==?(?![\w=+/-]))?")
CODE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}")
LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
CONSONANTS = re.compile("[b-df-hj-np-tv-xz]+", re.I | re.A)
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"\w+|[^\w\s]")
WORD = re.compile(r"\w")
HINTS = {w: i for i, ws in enumerate(("password passwd pwd pass passphrase", "secret token bearer auth credential credentials", "key apikey api_key access private", "id user account number no card", "tel phone call fax", "http https www com mail")) for w in ws.split()}
HINT = re.compile(r"(?<!\w)(?:" + "|".join(HINTS) + r")(?!\w)", re.I)
#: Marks beside a token in plain prose: none, space, other than quotes and = or :.
PLAIN_MARKS = (0, 3, 4)
ASSIGNS = re.compile("[\"'`=:]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that are too short are dropped."""
    low, out = text.lower(), []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if DIGIT.search(text) or HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def shape(token: str) -> tuple[int, ...]:
    n = len(token)
    digits = turns = upper = inner = 0
    letters = token.isalpha()
    if not letters:
        digits = sum("0" <= c <= "9" for c in token)
        turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:]))
    if not token.islower():
        if letters and token[1:].islower():
            upper = int("A" <= token[0] <= "Z")
        else:
            upper = sum("A" <= c <= "Z" for c in token)
            inner = sum(a.islower() and b.isupper() for a, b in zip(token, token[1:]))
    lower = n - upper if letters and token.isascii() else sum(map(LOWER.__contains__, token))
    hard = len(max(CONSONANTS.findall(token), key=len, default=""))
    kind = (upper > 0) + 2 * (lower > 0) + 4 * (n > digits + upper + lower)
    return (kind, min(7, n // 4), min(4, 5 * digits // n), min(5, 8 * turns // n), min(5, 6 * len(set(token)) // n), min(3, inner), min(4, hard // 2))


#: Sizes of the features' value sets: seven of shape, two hints, marks before and after, two of the text.
SIZES = (8, 8, 5, 6, 6, 4, 5, 7, 7, 5, 5, 3, 3)
SHAPES = 7
FEATURES = sum(SIZES)
BASES = tuple(int(x) for x in np.cumsum((0, *SIZES[:-1])))


def _mark(c: str) -> int:
    return 0 if not c else 1 if c in "\"'`" else 2 if c in "=:" else 3 if c.isspace() else 4


def beside(text: str, a: int, z: int) -> tuple[int, int]:
    """The hints among the last three words and marks before text[a:z] and the first two after it, of those whole within 40 characters."""
    low, high = max(0, a - 40), min(len(text), z + 40)
    before, after = WORDS.findall(text[low:a]), WORDS.findall(text[z:high])
    if low and WORD.match(text[low - 1]) and before and WORD.match(text[low]):
        before[0] = ""
    if high < len(text) and WORD.match(text[high]) and after and WORD.match(text[high - 1]):
        after[-1] = ""
    first = lambda words: next((HINTS[w] for w in map(str.lower, words) if w in HINTS), 6)
    return first(reversed(before[-3:])), first(after[:2])


def observed(text: str, a: int, z: int, whole: tuple[int, int], plain: bool = False) -> list[int]:
    """The feature numbers of the token text[a:z]; plain: as if there were no words beside it."""
    marks = _mark(text[a - 1 : a]), _mark(text[z : z + 1])
    return [b + v for b, v in zip(BASES, (*shape(text[a:z]), *((6, 6) if plain else beside(text, a, z)), *marks, *whole))]


def open_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens, all tokens of the text. Within a run only one or two marks or spaces part them."""
    runs: list[list[tuple[int, int]]] = []
    for m in TOKEN.finditer(text):
        a, z = m.span()
        if runs and a - runs[-1][-1][1] <= 2:
            runs[-1].append((a, z))
        else:
            runs.append([(a, z)])
    return runs


def text_features(text: str) -> tuple[int, int]:
    """Features of the whole text: how much code-like assignment it holds, and how dense its long tokens with a digit are."""
    codes = sum(1 for _ in CODE.finditer(text)) if DIGIT.search(text) else 0
    return min(2, 200 * (text.count("=") + text.count("{")) // (len(text) + 1)), min(2, 2000 * codes // (len(text) + 1))


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x 3
    trans: np.ndarray  # 3 x 3

    def __post_init__(self) -> None:
        """Scores as leads over the tag outside, and the most that they can be."""
        w, t = self.weights, self.trans
        lead = w[:, 1:] - w[:, :1]
        parts = [lead[b : b + n] for b, n in zip(BASES, SIZES)]
        gain = lambda steps: np.maximum(0, (steps - steps[:, :1]).max(0))
        self.lead, self.whole = lead, [[(a + b).tolist() for b in parts[-1]] for a in parts[-2]]
        self.hints = [[(a + b).tolist() for b in parts[SHAPES + 1]] for a in parts[SHAPES]]
        self.marks = [[(a + b).tolist() for b in parts[SHAPES + 3]] for a in parts[SHAPES + 2]]
        self.by_tags = ((gain(t) + gain(t.T))[1:] + 1e-9).tolist()  # by the neighbours' tags
        most = lambda table, of: [max(table[i][j][k] for i in of for j in of) for k in (0, 1)]
        self.most_hints = [self.hints[6][6], most(self.hints, range(7))]
        self.most_marks = [most(self.marks, PLAIN_MARKS), most(self.marks, range(5))]
        self.known: dict[str, tuple[float, float]] = {}  # tokens' leads by their shape
        self.hinting: set[str] = set()  # those that hold a hint
        self.shapes: dict[tuple[int, ...], tuple[float, float]] = {}

    def learn(self, tokens: set[str]) -> dict[str, tuple[float, float]]:
        """The leads of these tokens, and others, by their shapes."""
        if len(self.known) + len(tokens) > KEPT_TOKENS:
            self.known, self.hinting = {}, set()
        known, shapes = self.known, self.shapes
        for w in tokens.difference(known):
            of = shape(w)
            x = shapes.get(of)
            if x is None:
                x = shapes[of] = tuple(self.lead[[b + v for b, v in zip(BASES, of)]].sum(0).tolist())
            known[w] = x
            if w.lower() in HINTS or not w.isalnum() and HINT.search(w):
                self.hinting.add(w)
        return known

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens, out = set(TOKEN.findall(text)), []
        if not tokens:
            return out
        known = self.learn(tokens)
        whole, hints = text_features(text), [] if self.hinting.isdisjoint(tokens) else [m.span() for m in HINT.finditer(text)]
        base = self.whole[whole[0]][whole[1]]
        place, marks = self.most_hints[bool(hints)], self.most_marks[bool(ASSIGNS.search(text))]
        u, v = (base[k] + place[k] + marks[k] + self.by_tags[k] for k in (0, 1))
        doubtful = {w: x for w in tokens if (x := known[w])[0] + u >= 0 or x[1] + v >= 0}
        if not doubtful:
            return out
        u, v = base[0] + self.by_tags[0], base[1] + self.by_tags[1]
        ends, begins = [z for _, z in hints], [a for a, _ in hints]
        for run in open_runs(text):
            at = last = None
            emits: list[tuple[float, float, float]] = []
            for i, (a, z) in enumerate(run):
                x = doubtful.get(text[a:z])
                if x is None:
                    continue
                m = self.marks[_mark(text[a - 1 : a])][_mark(text[z : z + 1])]
                near = hints and (bisect(ends, a) > bisect_left(begins, a - 40) or bisect(ends, z + 40) > bisect_left(begins, z))
                before, after = beside(text, a, z) if near else (6, 6)
                h = self.hints[before][after]
                p, q = x[0] + m[0] + h[0], x[1] + m[1] + h[1]
                if p + u >= 0 or q + v >= 0:
                    if at is not None and i > last + 1:
                        out += self.decoded(run[at : last + 1], emits, at > 0, True)
                        at = None
                    if at is None:
                        at, emits = i, []
                    emits.append((0.0, p + base[0], q + base[1]))
                    last = i
            if at is not None:
                out += self.decoded(run[at : last + 1], emits, at > 0, last + 1 < len(run))
        return out

    def decoded(self, tokens: list[tuple[int, int]], emits: list[tuple[float, float, float]], before: bool, after: bool) -> list[tuple[int, int]]:
        """Spans of the best path; before, after: whether there is a token, outside, on that side."""
        emit = np.array(emits)
        if before:
            emit[0] += self.trans[0]
        if after:
            emit[-1] += self.trans[:, 0]
        if len(emits) == 1 and emit[0].argmax() == 0:
            return []
        out: list[tuple[int, int]] = []
        start = None
        for (a, z), tag in zip(tokens, viterbi(emit[None], self.trans, np.array([len(tokens)]))[0]):
            if tag != 2 and start is not None:
                out.append(start)
                start = None
            if tag == 1 or tag == 2 and start is None:
                start = (a, z)
            elif tag == 2:
                start = (start[0], z)
        return [*out, start] if start is not None else out


LEADS = ("pwd: ", "passphrase ", "bearer ", "Authorization: Bearer ", "private key ", "credential=", "auth: '", "access ", "", "", "key is ")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/abcdefghijklmnopqrstuvwxyz")
STARTS = ("", "", "", "pat_", "sk-", "xk_live_", "AK")


def variants(text: str, seed: int = 0) -> list[tuple[str, Span]]:
    """The text with a pattern's span replaced by a secret that the patterns miss, and where that stands."""
    out, draw = [], random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + seed)
    for a, z, _ in base_spans(text)[:VARIANTS]:
        alphabet = draw.choice(ALPHABETS)
        size = draw.randint(14, 22) if alphabet == ALPHABETS[0] else draw.randint(16, 44)
        secret = draw.choice(STARTS) + "".join(draw.choice(alphabet) for _ in range(size))
        lead = draw.choice(LEADS)
        at = a + len(lead)
        out.append((text[:a] + lead + secret + ("'" if lead.endswith("'") else "") + text[z:], (at, at + len(secret), "crf")))
    return out


LETTERS = ("abcdefghijklmnopqrstuvwxyz", ALPHABETS[3][:26] + ALPHABETS[3][36:])


def plainer(text: str, seed: int = 0) -> list[tuple[str, Span]]:
    """As variants, with secrets of letters alone and, after a word that tells of them, short ones."""
    out, draw = [], random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) + seed + 1)
    for a, z, _ in base_spans(text)[:VARIANTS]:
        short = draw.random() < 0.4
        lead = draw.choice([x for x in LEADS if x] if short else LEADS)
        secret = "".join(draw.choice(ALPHABETS[4 - draw.randrange(3)] if short else draw.choice(LETTERS[1:] * 2 + LETTERS[:1])) for _ in range(draw.randint(6, 12) if short else draw.randint(12, 36)))
        at = a + len(lead)
        out.append((text[:a] + lead + secret + ("'" if lead.endswith("'") else "") + text[z:], (at, at + len(secret), "crf")))
    return out


def values(text: str) -> list[Span]:
    """The patterns' spans without the names that secrets are assigned to."""
    return [(max(a, ASSIGN.match(text, a).start(2)) if k == "assign" else a, z, k) for a, z, k in base_spans(text)]


def examples(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """(features, tags) of runs, by the patterns' spans, and of the variants' runs."""
    base = values(text)
    mark = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    out = _examples(text, base, mark if base or mark % PROSE == 0 else None)
    for other, span in [*variants(text), *plainer(text)]:
        out += _examples(other, [span, *values(other)], None, span)
    return out


def _examples(text: str, spans: list[Span], prose: int | None, near: Span | None = None) -> list[tuple[list[list[int]], list[int]]]:
    """Windows of RUN_TOKENS about tokens of spans and with digits (near: about this span alone), and one more by the number `prose`."""
    runs = open_runs(text)
    whole, out, starts = text_features(text), [], []
    draw = random.Random(len(text))
    hit = lambda a, z: next((s for s in spans if s[0] < z and a < s[1]), None)
    for run in runs:
        upto = 0
        for i, (a, z) in enumerate(run):
            if i >= upto and (a < near[1] and near[0] < z if near else DIGIT.search(text, a, z) or z - a > 5 and text[a:z].isupper() or spans and hit(a, z)):
                start = max(0, upto, i - draw.randrange(4))
                upto = start + RUN_TOKENS
                starts.append((run, start, hit(a, z) is None))
    starts.sort(key=lambda x: x[2])  # those of spans first
    if prose is not None and runs:
        run = runs[prose // PROSE % len(runs)]
        starts.insert(0, (run, prose // 97 % len(run), True))
    for i, (run, start, _) in enumerate(starts[:RUNS_A_TEXT]):
        tags, last = [], None
        part = run[start : start + RUN_TOKENS]
        for a, z in part:
            now = hit(a, z)
            tags.append(0 if now is None else 2 if now is last else 1)
            last = now
        out.append(([observed(text, a, z, whole, plain=i % 2 == 1) for a, z in part], tags))
    return out


def fit(data: list[tuple[list[list[int]], list[int]]]) -> Model:
    params = {"w": np.zeros((FEATURES, 3)), "t": np.zeros((3, 3))}
    params["t"][0, 2] = -4.0
    if not any(any(tags) for _, tags in data):
        params["w"][:, 0] = 1.0
        return Model(params["w"], params["t"])
    n, t = len(data), RUN_TOKENS
    x, tags, lengths = np.zeros((n, t, len(SIZES)), int), np.zeros((n, t), int), np.zeros(n, int)
    for i, (f, y) in enumerate(data):
        lengths[i] = len(y)
        x[i, : len(y)], tags[i, : len(y)] = f, y
    t = int(lengths.max())
    x, tags = x[:, :t], tags[:, :t]
    adam, flat = Adam(params, 0.1), x.ravel()
    for _ in range(STEPS):
        _, d_emit, d_trans = gradients(params["w"][x].sum(2), params["t"], tags, lengths)
        g = np.stack([np.bincount(flat, np.repeat(d_emit[:, :, k].ravel(), len(SIZES)), FEATURES) for k in range(3)], 1)
        adam.step({"w": g + 1e-4 * params["w"], "t": d_trans + 1e-4 * params["t"]})
    return Model(params["w"], params["t"])


def sampled(docs: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text) of at most `rows` documents in an order by a hash of the id; their ids, bounded by `rows`, are broadcast."""
    ids = few(docs.select(F.col(id_col).cast("long").alias("i")).where("i is not null"), "i", rows).distinct()
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "i", "left_semi")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_TEXTS) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("secret_scan")
        for batch in batches:
            found = [(i, k, *e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, e in enumerate(examples(t or ""))]
            cols = list(zip(*found)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["i", "k", "x", "y"])

    found = sampled(docs, rows, id_col, text_col).mapInArrow(run, "i long, k int, x array<array<int>>, y array<int>")
    data = few(found, "i", RUNS).collect()  # bounded by RUNS
    return fit([(r.x, r.y) for r in sorted(data, key=lambda r: (r.i, r.k))])


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with the field's."""
    base, all_, _ = found_spans(text, model)
    return base, all_


def found_spans(text: str, model: Model) -> tuple[list[Span], list[Span], int]:
    """The patterns' spans, these with the field's, and how many spans the field finds, with those of the patterns."""
    base, own = base_spans(text), model.spans(text)
    more = [(a, z, "crf") for a, z in own if not any(s < z and a < e for s, e, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))), len(own)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf): one row for each row of docs. n_crf: spans that the field finds by itself, the patterns' among them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("secret_scan")
        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base, spans, n = found_spans(text or "", shared.value)
                kinds = [k for _, _, k in base]
                out.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n))
            cols = list(zip(*out)) or [[]] * 6
            types = (*(pa.int64(),) * 3, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def masked(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """text with each stretch that spans cover replaced."""
    parts, at, end = [], 0, -1
    for a, z, _ in sorted(spans):
        if a >= end:
            parts += [text[at:a], by]
        at = end = max(z, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: Model, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with every span masked in the text, and count_col, if there, as its new length."""
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entering("secret_scan")
        for batch in sliced(batches):
            cols = [batch.column(c) for c in names]
            cols[at] = pa.array([t and masked(t, all_spans(t, shared.value)[1]) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(count_col, F.length(text_col).cast(dict(docs.dtypes)[count_col])) if count_col in names else out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
