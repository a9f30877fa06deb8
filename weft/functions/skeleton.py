"""Structure of pages: leaf-path tokens, landmarks, and cuts by depth or attribute. Pure Python, to be run over Arrow batches."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from dataclasses import dataclass, field

from weft.functions.sax import Handler, parse

FOLDABLE = frozenset(("div", "span"))
OPAQUE = frozenset(("script", "style", "noscript", "svg"))
LANDMARKS = ("header", "footer", "nav", "aside", "form", "search")
BY_TAG = {t: t for t in ("header", "footer", "nav", "aside", "search", "main")}
BY_ROLE = {"banner": "header", "contentinfo": "footer", "navigation": "nav", "complementary": "aside", "form": "form", "search": "search", "main": "main"}
#: Class names that bundlers generate.
NOISE = [
    re.compile(r"_[a-z0-9]{5,}", re.I),
    re.compile(r"sc-(?=[a-zA-Z0-9]*[A-Z0-9])[a-zA-Z0-9]{5,}"),
    re.compile(r"css-(?=[a-z0-9]*[0-9])[a-z0-9]{5,8}", re.I),
    re.compile(r"[a-z]+-(?=[a-f0-9]*[0-9])[a-f0-9]{6,8}", re.I),
    re.compile(r"(?=.*[a-z])(?=.*[0-9])[a-z0-9]{6,10}"),
    re.compile(r".*__(?=[a-z0-9]{5,8}$)(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]{5,8}", re.I | re.S),
]


def is_noise_class(name: str) -> bool:
    return any(p.fullmatch(name) for p in NOISE)


def content_hash(raw: str) -> str:
    return hashlib.sha256(re.sub(r"\s+", " ", raw.strip()).encode()).hexdigest()[:16]


def class_list(value: str | None, drop_noise: bool = True) -> list[str]:
    from weft.functions.sorting import alphabetical_key

    names = dict.fromkeys((value or "").split())
    return sorted((c for c in names if not (drop_noise and is_noise_class(c))), key=alphabetical_key)


def bracket(**pairs: str | None) -> str:
    shown = sorted(f"{k}={v}" for k, v in pairs.items() if v)
    return f"[{','.join(shown)}]" if shown else ""


def segment(tag: str, classes: list[str], role: str | None, kind: str | None) -> str:
    dotted = "".join(f".{c}" for c in classes)
    name = dotted if classes and tag in FOLDABLE else tag + dotted
    return name + bracket(role=role, type=kind)


@dataclass
class _Open:
    segment: str
    folds: bool
    children: int = 0
    paths: list[str] = field(default_factory=list)

    def leaves(self) -> list[str]:
        if not self.paths:
            return [self.segment]
        if self.folds and self.children == 1:
            return self.paths
        return [f"{self.segment}>{p}" for p in self.paths]


class _BodyWalk(Handler):
    """Events of the first body alone; later and nested body tags are ignored, their content isn't; opaque elements are single events."""

    def __init__(self, html: str) -> None:
        self.html, self.depth, self.done, self.stray = html, 0, False, 0
        self.opaque: list | None = None  # name, depth, attributes, start, content start

    def opened(self, name: str, attrs: dict[str, str], start: int, end: int) -> None:
        if self.opaque:
            self.opaque[1] += name == self.opaque[0]
        elif not self.depth:
            if name == "body" and not self.done:
                self.depth = 1
                self.enter(name, attrs, start, end)
        elif name == "body":
            self.stray += 1
        elif name in OPAQUE:
            self.opaque = [name, 1, attrs, start, end]
            self.enter_opaque()
        else:
            self.depth += 1
            self.enter(name, attrs, start, end)

    def closed(self, name: str, start: int, end: int) -> None:
        if self.opaque:
            if name == self.opaque[0]:
                self.opaque[1] -= 1
                if not self.opaque[1]:
                    self.leave_opaque(start, end)
                    self.opaque = None
        elif name == "body" and self.stray:
            self.stray -= 1
        elif self.depth:
            self.depth -= 1
            self.leave(name, start, end)
            self.done = self.done or not self.depth

    def genuine(self, name: str, end: int) -> bool:
        """Whether an end tag of this name, rather than an implied end, stops at this offset."""
        return re.search(rf"</\s*{re.escape(name)}\s*>\Z", self.html[max(0, end - len(name) - 3) : end], re.I) is not None

    def enter(self, name: str, attrs: dict[str, str], start: int, end: int) -> None: ...

    def leave(self, name: str, start: int, end: int) -> None: ...

    def enter_opaque(self) -> None: ...

    def leave_opaque(self, start: int, end: int) -> None: ...


class _Tokens(_BodyWalk):
    def __init__(self, html: str, drop_noise: bool, comments: bool) -> None:
        super().__init__(html)
        self.drop_noise, self.comments = drop_noise, comments
        self.stack: list[_Open] = []
        self.tokens: list[str] = []
        self.body_classes: list[str] = []

    def enter(self, name: str, attrs: dict[str, str], start: int, end: int) -> None:
        classes = class_list(attrs.get("class"), self.drop_noise)
        if self.stack:
            self.stack[-1].children += 1
        else:
            self.body_classes, classes = classes, []
        role, kind = attrs.get("role"), attrs.get("type")
        self.stack.append(_Open(segment(name, classes, role, kind), name in FOLDABLE and not (classes or role or kind)))

    def leave(self, name: str, start: int, end: int) -> None:
        leaves = self.stack.pop().leaves()
        if self.stack:
            self.stack[-1].paths.extend(leaves)
        else:
            self.tokens = leaves

    def enter_opaque(self) -> None:
        self.stack[-1].children += 1

    def leave_opaque(self, start: int, end: int) -> None:
        name, _, attrs, _, content = self.opaque
        self.stack[-1].paths.append(name + bracket(role=attrs.get("role"), type=attrs.get("type"), sha=content_hash(self.html[content:start])))

    def comment(self, data: str) -> None:
        if self.comments and self.stack and not self.opaque:
            self.stack[-1].paths.append(f"comment[sha={content_hash(data)}]")


def tokenize(html: str, drop_noise: bool = True, comments: bool = False) -> tuple[list[str], list[str]]:
    """(leaf paths under the first body in document order, the body's classes)."""
    walk = _Tokens(html, drop_noise, comments)
    parse(html, walk)
    return walk.tokens, walk.body_classes


def canonical(tokens) -> str:
    return json.dumps(sorted(set(tokens)), ensure_ascii=False, separators=(",", ":"))


def shape(token: str) -> str:
    out = []
    for part in token.split(">"):
        head, mark, rest = part.partition("[")
        out.append(("*" if head.startswith(".") else head.split(".")[0]) + mark + rest)
    return ">".join(out)


def collapse_anonymous(token: str) -> str:
    parts = token.split(">")
    return token if len(parts) < 3 else ">".join([parts[0], *(p for p in parts[1:-1] if p not in FOLDABLE), parts[-1]])


@dataclass(frozen=True)
class Match:
    type: str
    depth: int
    start: int
    end: int
    inner_start: int
    inner_end: int


class _Matches(_BodyWalk):
    def __init__(self, html: str, types) -> None:
        super().__init__(html)
        self.types, self.stack, self.found = types, [], []

    def enter(self, name: str, attrs: dict[str, str], start: int, end: int) -> None:
        self.stack.append((name, self.types(name, attrs.get("role") or None), start))

    def leave(self, name: str, start: int, end: int) -> None:
        tag, types, began = self.stack.pop()
        if types and self.genuine(tag, end):
            inner = self.html.find(">", began) + 1, self.html.rfind("<", 0, end)
            self.found += [Match(t, len(self.stack), began, end, *inner) for t in types]


def matching_elements(html: str, types) -> list[Match]:
    walk = _Matches(html, types)
    parse(html, walk, decode=False)
    return sorted(walk.found, key=lambda m: m.start)


def shallowest(html: str, types) -> dict[str, Match]:
    best: dict[str, Match] = {}
    for m in matching_elements(html, types):
        if m.type not in best or (m.depth, m.start) < (best[m.type].depth, best[m.type].start):
            best[m.type] = m
    return best


def landmark_types(tag: str, role: str | None) -> list[str]:
    return list(dict.fromkeys(t for t in (BY_TAG.get(tag), BY_ROLE.get(role or "")) if t))


def outermost(matches: list[Match]) -> list[Match]:
    kept: list[Match] = []
    for m in matches:
        if not any(o.start <= m.start and m.end <= o.end and (o.start, o.end) != (m.start, m.end) for o in kept):
            kept.append(m)
    return kept


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans, key=lambda s: s[0]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def excise(html: str, spans: list[tuple[int, int]]) -> str:
    at, parts = 0, []
    for a, z in merge_spans(spans):
        parts.append(html[at:a])
        at = z
    return "".join([*parts, html[at:]])


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_column(starts: list[int], offset: int) -> tuple[int, int]:
    line = bisect.bisect_right(starts, offset)
    return line, offset - starts[line - 1] + 1


def landmarks(html: str) -> tuple[dict[str, list[dict]], str]:
    """({type: instances with offsets and 1-based places}, the page without them; main stays in)."""
    found = matching_elements(html, landmark_types)
    starts, out = line_starts(html), {t: [] for t in (*LANDMARKS, "main")}
    cut = outermost([m for m in found if m.type != "main"])
    for m in [*cut, *outermost([m for m in found if m.type == "main"])]:
        (l1, c1), (l2, c2) = line_column(starts, m.start), line_column(starts, m.end)
        out[m.type].append({"type": m.type, "html": html[m.start : m.end], "startOffset": m.start, "endOffset": m.end, "startLine": l1, "startColumn": c1, "endLine": l2, "endColumn": c2})
    return out, excise(html, [(m.start, m.end) for m in cut])


def page_instances(found: dict[str, list[dict]]) -> list[dict]:
    """A page's landmark instances with their tokens, each signature once, in the order of LANDMARKS."""
    seen, out = set(), []
    for kind in LANDMARKS:
        for x in found[kind]:
            tokens = sorted(set(tokenize(f"<body>{x['html']}</body>")[0]))
            signature = canonical(tokens)
            if tokens and signature not in seen:
                seen.add(signature)
                out.append({"type": kind, "tokens": tokens, "signature": signature, **{k: v for k, v in x.items() if k not in ("html", "type")}})
    return out


class _Blocks(_BodyWalk):
    def __init__(self, html: str, attribute: str) -> None:
        super().__init__(html)
        self.attribute, self.stack, self.spans = attribute, [], []

    def enter(self, name: str, attrs: dict[str, str], start: int, end: int) -> None:
        self.stack.append((name, bool(self.stack) and self.attribute in attrs, start))

    def leave(self, name: str, start: int, end: int) -> None:
        tag, marked, began = self.stack.pop()
        if marked and self.genuine(tag, end):
            self.spans.append((began, end))

    def leave_opaque(self, start: int, end: int) -> None:
        name, _, attrs, began, _ = self.opaque
        if self.attribute in attrs and self.genuine(name, end):
            self.spans.append((began, end))


def remove_blocks(html: str, attribute: str) -> str:
    walk = _Blocks(html, attribute.lower())
    parse(html, walk, decode=False)
    return excise(html, walk.spans)


class _Deep(_BodyWalk):
    """Elements deeper than most within a fragment; the fragment has no body of its own."""

    def __init__(self, html: str, most: int) -> None:
        super().__init__(html)
        self.most, self.level, self.cut, self.spans = most, 0, None, []

    def opened(self, name: str, attrs: dict[str, str], start: int, end: int) -> None:
        if self.opaque:
            self.opaque[1] += name == self.opaque[0]
        elif self.cut:
            self.cut[1] += name == self.cut[0]
        elif name in OPAQUE:
            self.opaque = [name, 1]
        elif self.level >= self.most:
            self.cut = [name, 1, start]
        else:
            self.level += 1

    def closed(self, name: str, start: int, end: int) -> None:
        if self.opaque:
            self.opaque[1] -= name == self.opaque[0]
            if not self.opaque[1]:
                self.opaque = None
        elif self.cut:
            self.cut[1] -= name == self.cut[0]
            if not self.cut[1]:
                if self.genuine(name, end):
                    self.spans.append((self.cut[2], end))
                self.cut = None
        elif self.level:
            self.level -= 1


def cap_depth(html: str, most: int) -> str:
    """Without what lies deeper than `most` elements inside the shallowest main."""
    if not isinstance(most, int) or most < 0:
        raise ValueError(f"the depth is a non-negative integer, not {most}")
    main = shallowest(html, lambda tag, role: ["main"] if "main" in (BY_TAG.get(tag), BY_ROLE.get(role or "")) else []).get("main")
    if not main:
        return html
    walk = _Deep(html[main.inner_start : main.inner_end], most)
    parse(walk.html, walk, decode=False)
    return excise(html, [(main.inner_start + a, main.inner_start + z) for a, z in walk.spans])
