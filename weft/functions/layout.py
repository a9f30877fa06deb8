"""Layout types of captured element trees (dicts as parsed from JSON), and the flat rows that stand for the recursive tree."""

from __future__ import annotations

from collections.abc import Sequence

MIN_AREA, MAX_DEPTH, MAX_CHAIN, ROW_OVERLAP, OVERFLOW, SPANNING = 800, 6, 50, 0.5, 1.5, 1.5
OUTER = frozenset(("block", "inline", "run-in"))
INNER = frozenset(("flow", "flow-root", "table", "flex", "grid", "ruby"))
INTERNAL = frozenset("table-row-group table-header-group table-footer-group table-row table-cell table-column-group table-column table-caption ruby-base ruby-text ruby-base-container ruby-text-container".split())
SHORT = {"inline-block": ("inline", "flow-root"), "inline-table": ("inline", "table"), "inline-flex": ("inline", "flex"), "inline-grid": ("inline", "grid")}


def parse_display(value: str) -> dict:
    """A CSS display value as its outer and inner type."""
    words = value.strip().lower().split()
    if words in (["none"], ["contents"]):
        return {"kind": words[0]}
    if len(words) == 1 and words[0] in INTERNAL:
        return {"kind": "internal", "value": words[0]}
    if len(words) == 1 and words[0] in SHORT:
        outside, inside = SHORT[words[0]]
        return {"kind": "box", "outside": outside, "inside": inside, "list_item": False}
    inside = next((w for w in words if w in INNER), "flow")
    outside = next((w for w in words if w in OUTER), "inline" if inside == "ruby" else "block")
    return {"kind": "box", "outside": outside, "inside": inside, "list_item": "list-item" in words}


def viewport_spec(text: str) -> tuple[str, int]:
    name, _, width = text.partition(":")
    if not name.strip() or not width.strip().isdigit() or int(width) < 1:
        raise ValueError(f"a viewport is name:width, not {text!r}")
    return name.strip(), int(width)


DEFAULT_VIEWPORTS = {"pc": 1280, "tablet": 768, "sp": 375}


def rows_of(boxes: Sequence[dict], overlap: float = ROW_OVERLAP) -> list[list[int]]:
    """Places of boxes that share a row: each next by y joins if it overlaps the row so far by a share of the shorter of both."""
    rows: list[list[int]] = []
    top = bottom = 0.0
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i]["y"]):
        a, z = boxes[i]["y"], boxes[i]["y"] + boxes[i]["height"]
        shorter = min(bottom - top, z - a)
        if rows and shorter > 0 and max(0.0, min(bottom, z) - max(top, a)) / shorter >= overlap:
            rows[-1].append(i)
            top, bottom = min(top, a), max(bottom, z)
        else:
            rows.append([i])
            top, bottom = a, z
    return rows


def middle(values: Sequence[float]) -> float:
    v = sorted(values)
    return 0.0 if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def variation(values: Sequence[float]) -> float:
    mean = sum(values) / len(values) if values else 0
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / mean if mean else 0.0


def children_that_count(node: dict, min_area: float = MIN_AREA) -> list[dict]:
    out = []
    for c in node.get("children", []):
        kind = parse_display(c["style"]["display"])["kind"]
        box = c["boundingBox"]
        if kind == "none" or c["style"].get("visibility") == "hidden" or box["width"] * box["height"] < min_area:
            continue
        out += children_that_count(c, min_area) if kind == "contents" else [c]
    return out


def layout_type(node: dict, children: Sequence[dict]) -> tuple[str, float]:
    """(type, confidence) by the first pattern that fits."""
    display = parse_display(node["style"]["display"])
    if node["tagName"] == "TABLE":
        return "table", 1.0
    if display.get("inside") == "table" or display.get("value", "").startswith("table"):
        return "table", 0.9
    own, boxes = node["boundingBox"], [c["boundingBox"] for c in children]
    if boxes and own["width"] > 0 and own["height"] > 0:
        right, below = max(b["x"] + b["width"] for b in boxes), max(b["y"] + b["height"] for b in boxes)
        if right / own["width"] > OVERFLOW or below / own["height"] > OVERFLOW:
            return "unknown", 0.0
    rows = rows_of(boxes)
    sizes = [len(r) for r in rows]
    if len(boxes) > 1 and len(rows) > 1 and max(sizes) > 1:
        spans = any(0 < middle([b[k] for b in boxes]) * SPANNING < b[k] for b in boxes for k in ("width", "height"))
        return ("complex-grid", 0.6) if spans or len(set(sizes)) > 1 else ("simple-grid", 0.85)
    floated = [c["boundingBox"] for c in children if c["style"].get("float", "none") != "none" and c["tagName"] in ("IMG", "FIGURE", "PICTURE")]
    others = [b for b in boxes if not any(b is f for f in floated)]
    meets = lambda a, b: a["x"] < b["x"] + b["width"] and b["x"] < a["x"] + a["width"] and a["y"] < b["y"] + b["height"] and b["y"] < a["y"] + a["height"]
    if any(meets(f, o) for f in floated for o in others):
        return "float-wrap", 0.75
    if len(boxes) > 1 and len(rows) == 1:
        return "horizontal-row", 0.8
    if boxes and set(sizes) == {1}:
        return "vertical-stack", 0.8
    return "unknown", 0.0


def classify(node: dict, max_depth: int = MAX_DEPTH, min_area: float = MIN_AREA) -> list[dict]:
    """The classified tree as rows (path, depth, layoutType, confidence, tagName): the recursion's adjacency, in document order."""
    out: list[dict] = []
    todo = [(node, 0, "0")]
    while todo:
        at, depth, path = todo.pop()
        kids = children_that_count(at, min_area)
        for _ in range(MAX_CHAIN):
            if len(kids) != 1:
                break
            at = kids[0]
            kids = children_that_count(at, min_area)
        inline = sum(parse_display(c["style"]["display"]).get("outside") == "inline" for c in kids)
        if len(kids) < 2 or inline > len(kids) / 2 or depth >= max_depth:
            out.append({"path": path, "depth": depth, "layoutType": "leaf", "confidence": 0.0, "tagName": at["tagName"]})
            continue
        kind, sure = layout_type(at, kids)
        out.append({"path": path, "depth": depth, "layoutType": kind, "confidence": sure, "tagName": at["tagName"]})
        todo += [(c, depth + 1, f"{path}/{i}") for i, c in reversed(list(enumerate(kids)))]
    return out


def result_line(result: dict, boxes: bool = True, inner: str = "all", pretty: bool = False) -> str:
    """A layout result as JSON; inner: HTML of all blocks, of leaves only, or none."""
    import json

    def shown(block: dict) -> dict:
        kids = [shown(c) for c in block.get("children", [])]
        keep = {k: block.get(k) for k in ("layoutType", "tagName", "id", "classList")}
        if boxes:
            keep["boundingBox"] = block.get("boundingBox")
        if inner == "all" or inner == "leaf-only" and not kids:
            keep["innerHTML"] = block.get("innerHTML")
        return {**keep, "attributes": block.get("attributes") or {}, "confidence": block.get("confidence"), "signals": block.get("signals"), "children": kids}

    root = result.get("root")
    return json.dumps({**{k: result.get(k) for k in ("url", "viewport", "mainSelector")}, "root": shown(root) if root else None}, ensure_ascii=False, indent=2 if pretty else None)
