"""Differences of texts, trees and files."""

from __future__ import annotations

import difflib
import json
from collections import Counter

from weft.functions.sax import VOID, Handler, parse
from weft.functions.sorting import alphabetical_key


class _Tree(Handler):
    def __init__(self) -> None:
        self.root: dict = {"name": "#document", "children": []}
        self.open = [self.root]

    def opened(self, name: str, attrs: dict, start: int, end: int) -> None:
        node: dict = {"name": name, "attrs": dict(sorted(attrs.items())), "children": []}
        self.open[-1]["children"].append(node)
        self.open.append(node)

    def closed(self, name: str, start: int, end: int) -> None:
        if len(self.open) > 1:
            self.open.pop()

    def text(self, data: str) -> None:
        if text := " ".join(data.split()):
            self.open[-1]["children"].append(text)


def distilled(html: str) -> dict:
    """The page as a JSON tree: white space collapsed, attributes and the head's children in order of names, head elements as text."""
    walk = _Tree()
    parse(html, walk)

    def shown(node):
        if isinstance(node, str):
            return node
        kids = [shown(c) for c in node["children"]]
        if node["name"] == "head":
            kids.sort(key=lambda k: json.dumps(k, sort_keys=True, ensure_ascii=False))
        if node["name"] in ("title", "link", "script", "style", "iframe"):
            attrs = "".join(f' {k}="{v}"' for k, v in node.get("attrs", {}).items())
            return f"<{node['name']}{attrs}>" + ("" if node["name"] in VOID else "".join(map(str, kids)) + f"</{node['name']}>")
        return {"name": node["name"], **({"attrs": node["attrs"]} if node.get("attrs") else {}), **({"children": kids} if kids else {})}

    return shown(walk.root)


def tree_diff(a: object, b: object) -> dict:
    """Unified diff of two trees' JSON; matches is 1 - |added - removed| / lines of the longer."""
    x, y = (json.dumps(t, indent=1, ensure_ascii=False).split("\n") for t in (a, b))
    lines = list(difflib.unified_diff(x, y, lineterm="", n=3))
    added = sum(s.startswith("+") and not s.startswith("+++") for s in lines)
    removed = sum(s.startswith("-") and not s.startswith("---") for s in lines)
    return {"added": added, "removed": removed, "matches": 1 - abs(added - removed) / max(len(x), len(y)), "diff": "\n".join(lines)}


def frequencies(words: list[str]) -> list[str]:
    count = Counter(words)
    return [f"{w} x{count[w]}" for w in sorted(count, key=alphabetical_key)]


def text_diff(a: str, b: str) -> dict:
    """Of white-space tokens: the ratio of equal ones, and the frequency lines that differ."""
    x, y = a.split(), b.split()
    ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    f, g = frequencies(x), frequencies(y)
    return {"ratio": ratio, "only_a": sorted(set(f) - set(g)), "only_b": sorted(set(g) - set(f))}


def shortened(line: str, width: int = 80) -> str:
    """Too long a line with its middle left out."""
    if len(line) <= width:
        return line
    head = (width - 1) // 2
    return f"{line[:head]}…{line[len(line) - (width - 1 - head) :]}"


def file_diff(a: str, b: str, context: int = 3, width: int = 120) -> str:
    return "\n".join(shortened(s, width) for s in difflib.unified_diff(a.split("\n"), b.split("\n"), "local", "remote", lineterm="", n=context))


def pixel_match(a, b) -> float:
    """The share of equal pixels of two sample arrays on the larger canvas."""
    import numpy as np

    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    canvas = lambda x: np.pad(x.astype(np.int32), [(0, h - x.shape[0]), (0, w - x.shape[1]), *[(0, 0)] * (x.ndim - 2)], constant_values=-1)
    same = canvas(a) == canvas(b)
    return float((same if same.ndim == 2 else same.all(2)).mean())
