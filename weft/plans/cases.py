"""Worked cases of the functions on pages, sets and values: (name, arguments, result) as JSON.

Most results were written out by hand before the code ran; those of the head's parsers (viewport, robots, refresh, format_detection,
json_ld), shell, knee_depth, inverse_weight, normalize_url and distilled were taken from the code's output and read through, so they
guard against changes rather than prove the functions.

The query computes each case in a Spark task; the SQL holds the results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from weft.functions import diffs, head, layout, sets, skeleton, sorting, urls, values
from weft.operators import findings


def _landmarks(html: str) -> list:
    found, rest = skeleton.landmarks(html)
    return [[[i["type"], i["startLine"], i["startColumn"]] for i in skeleton.page_instances(found)], rest]


def _only(types: list[str]):
    return lambda tag, role: [t for t in skeleton.landmark_types(tag, role) if t in types]


FUNCTIONS = {
    "tokens": lambda html: skeleton.tokenize(html)[0],
    "body_classes": lambda html: skeleton.tokenize(html)[1],
    "noise_class": skeleton.is_noise_class,
    "class_list": skeleton.class_list,
    "segment": skeleton.segment,
    "content_hash": skeleton.content_hash,
    "shape": skeleton.shape,
    "collapse": skeleton.collapse_anonymous,
    "canonical": skeleton.canonical,
    "landmarks": _landmarks,
    "elements": lambda html, types: [skeleton.line_column(skeleton.line_starts(html), m.start) for m in skeleton.matching_elements(html, _only(types))],
    "shallowest": lambda html, types: sorted(skeleton.shallowest(html, _only(types))),
    "merge_spans": lambda spans: [list(x) for x in skeleton.merge_spans([tuple(x) for x in spans])],
    "excise": lambda html, spans: skeleton.excise(html, [tuple(x) for x in spans]),
    "cap_depth": skeleton.cap_depth,
    "remove_blocks": skeleton.remove_blocks,
    "linkage": lambda s: [[a, b, round(h, 6)] for a, b, h in sets.dendrogram([set(x) for x in s])],
    "labels_at": lambda n, merges, at: sets.labels_at(n, [tuple(m) for m in merges], at),
    "clusters": lambda s: sets.structural_clusters([set(x) for x in s]),
    "contained": lambda s: sorted(map(list, sets.contained({i: (set(x), n) for i, (x, n) in enumerate(s)}).items())),
    "comparison_sets": lambda s: [sorted(x) for x in sets.comparison_sets([set(x) for x in s])],
    "auto_cut": lambda heights, upper: round(sets.auto_cut(heights, upper), 6),
    "shell": lambda pages: sorted(sets.shell([[set(t) for t in p] for p in pages])),
    "is_chrome": lambda tokens, shell: sets.is_chrome(set(tokens), set(shell)),
    "knee_depth": lambda s: sets.knee_depth([[set(t) for t in d] for d in s]),
    "reservoir": lambda n, size: sets.reservoir(n, size),
    "viewport": head.viewport,
    "robots": head.robots,
    "referrer": head.referrer,
    "refresh": head.refresh,
    "format_detection": head.format_detection,
    "json_ld": head.json_ld,
    "coerced": head.coerced,
    "meta": lambda html, *path: _at(head.page_meta(html), path),
    "main_characters": lambda html: head.main_content(html)["characters"],
    "provider_ids": head.provider_ids,
    "assembled_tags": head.assembled_tags,
    "anchors": lambda html: [a["href"] for a in head.collect(html)[1]],
    "images": lambda html: [[i["src"], i["lazy"]] for i in head.collect(html)[2]],
    "decode_uri": sorting.decode_uri,
    "decode_component": sorting.decode_component,
    "path_to_url": urls.path_to_url,
    "safe_file_path": urls.safe_file_path,
    "sheet_id": urls.sheet_id,
    "project_id": urls.project_id,
    "last_segment": urls.last_segment,
    "parse_url": lambda url, *keys: [urls.parse_url(url)[k] for k in keys],
    "normalize_url": lambda url, *ignorable: urls.normalize_url(url, tuple(ignorable)),
    "urls_match": urls.urls_match,
    "distilled": diffs.distilled,
    "tree_diff": lambda a, b: [diffs.tree_diff(a, b)[k] for k in ("added", "removed", "matches")],
    "text_diff": lambda a, b: [diffs.text_diff(a, b)[k] for k in ("ratio", "only_a", "only_b")],
    "shortened": diffs.shortened,
    "layout": lambda node: [[r["path"], r["layoutType"]] for r in layout.classify(node)],
    "viewport_spec": lambda text: list(layout.viewport_spec(text)),
    "devices": lambda names: {k: list(v) for k, v in (findings.devices(names) or {}).items()},
    "retry_wait": findings.retry_wait,
    "inverse_weight": lambda u: values.inverse_weight(lambda x: x, 0, 10, u),
}


def _at(tree, path):
    for p in path:
        tree = tree[p]
    return tree


def _box(x, y, w=100, h=100, kids=(), tag="DIV", **style):
    return {"tagName": tag, "style": {"display": "block", **style}, "boundingBox": {"x": x, "y": y, "width": w, "height": h}, "children": list(kids)}


HEAD = (
    '<html lang="en"><head><base href="/b/"><title> A  title </title><meta name="viewport" content="width=device-width, initial-scale=1"><meta property="og:title" content="T"><meta property="og:title" content="U"><meta property="og:image" content="1.png"><meta property="og:image" content="2.png">'
    '<meta http-equiv="refresh" content="5; url=/next"><meta name="unheard-of" content="x"><meta itemprop="name" content="N"><link rel="canonical" href="https://e.com/"><link rel="alternate" type="application/rss+xml" href="feed.xml"><link rel="license" href="l"><link rel="stylesheet" href="a.css"></head>'
    '<body><a href="/p">p</a><a href="mailto:x@y.z">m</a><img src="i.png" loading="lazy"><main><p>four  fi</p></main></body></html>'
)
CASES: list[tuple[str, list, object]] = [
    ("tokens", ["<body><ul><li>a<li>b</ul></body>"], ["body>ul>li", "body>ul>li"]),
    ("tokens", ["<body></body>"], ["body"]),
    ("tokens", ["<p>no body</p>"], []),
    ("tokens", ["<body><p>cut <b"], ["body>p"]),
    ("tokens", ["<body><div><div><div>x</div></div></div></body>"], ["body>div"]),
    ("tokens", ['<body><div class="b a" role="x"><input type="text"></div></body>'], ["body>.a.b[role=x]>input[type=text]"]),
    ("tokens", ["<body><p>1</p></body><body><i>2</i></body>"], ["body>p"]),
    ("tokens", ["<body><script> </script></body>"], ["body>script[sha=e3b0c44298fc1c14]"]),
    ("tokens", ["<body><table><tr><td>1<td>2</table></body>"], ["body>table>tr>td", "body>table>tr>td"]),
    ("body_classes", ['<body class="home css-1abc23 page"><p>1</p></body>'], ["home", "page"]),
    ("noise_class", ["sc-bdVaJa"], True),
    ("noise_class", ["css-1abc23"], True),
    ("noise_class", ["btn__x1y2z3"], True),
    ("noise_class", ["navigation"], False),
    ("class_list", ["b a b _x1y2z3"], ["a", "b"]),
    ("segment", ["div", ["a"], "main", None], ".a[role=main]"),
    ("segment", ["input", [], None, "text"], "input[type=text]"),
    ("content_hash", [" a\n b "], "c8687a08aa5d6ed2"),
    ("shape", ["body>.a.b[role=x]>p.c"], "body>*[role=x]>p"),
    ("collapse", ["body>div>span>p"], "body>p"),
    ("canonical", [["b", "a", "b"]], '["a","b"]'),
    ("landmarks", ["<body>\n<header><nav>x</nav></header><main>m</main>\n <footer>f</footer></body>"], [[["header", 2, 1], ["footer", 3, 2]], "<body>\n<main>m</main>\n </body>"]),
    ("landmarks", ['<body><div role="navigation">n</div><p>t</p></body>'], [[["nav", 1, 7]], "<body><p>t</p></body>"]),
    ("elements", ["<body>\n<nav></nav>\n  <nav></nav></body>", ["nav"]], [[2, 1], [3, 3]]),
    ("shallowest", ["<body><aside><nav></nav></aside><nav></nav></body>", ["nav", "aside"]], ["aside", "nav"]),
    ("merge_spans", [[[5, 7], [0, 2], [1, 4], [7, 8]]], [[0, 4], [5, 8]]),
    ("excise", ["abcdefgh", [[1, 3], [2, 4], [6, 7]]], "aefh"),
    ("cap_depth", ["<body><main><div><p>a</p></div>b</main></body>", 0], "<body><main>b</main></body>"),
    ("cap_depth", ["<body><main><div><p>a</p></div>b</main></body>", 5], "<body><main><div><p>a</p></div>b</main></body>"),
    ("remove_blocks", ["<body data-x><div data-x='no'>a</div><svg data-x></svg>b</body>", "data-x"], "<body data-x>b</body>"),
    ("linkage", [[["a", "b"], ["a", "b"], ["a", "c"], ["z"]]], [[0, 1, 1.0], [0, 2, 0.333333], [0, 3, 0.0]]),
    ("labels_at", [4, [[0, 1, 1.0], [2, 3, 0.5], [0, 2, 0.1]], 0.5], [0, 0, 2, 2]),
    ("clusters", [[["a"], ["b"], ["a"], []]], ["cluster:0", "cluster:1", "cluster:0", "cluster:2"]),
    ("contained", [[[["a", "b"], 1], [["a", "b", "c"], 1], [["x"], 1]]], [[0, 1], [1, 1], [2, 2]]),
    ("comparison_sets", [[["a", str(i)] for i in range(10)]], [[str(i)] for i in range(10)]),
    ("comparison_sets", [[["a", "b"], ["a"]]], [["a", "b"], ["a"]]),
    ("auto_cut", [[0.9, 0.85, 0.2], 0.8], 0.525),
    ("auto_cut", [[1, 1], 0.8], 0.8),
    ("auto_cut", [[1, 0.95, 0.9, 0.85], 0.8], 0.8),
    ("is_chrome", [["a", "b", "c", "d", "e"], ["a", "b", "c", "d"]], True),
    ("is_chrome", [["a", "b", "c"], ["a"]], False),
    ("reservoir", [4, 9], [0, 1, 2, 3]),
    ("reservoir", [4, 0], []),
    ("shell", [[[["a", "b"], ["c"]], [["a"]], [["a"]]]], ["a"]),
    ("knee_depth", [[[["a"], ["a"]], [["a", "b"], ["a", "c"]]]], 1),
    ("viewport", ["width=device-width, initial-scale=1.5, user-scalable=no"], {"raw": "width=device-width, initial-scale=1.5, user-scalable=no", "width": "device-width", "initial_scale": 1.5, "user_scalable": False}),
    ("robots", ["noindex, max-snippet:5"], {"raw": "noindex, max-snippet:5", "noindex": True, "max_snippet": 5}),
    ("refresh", ["5; url=/next"], {"raw": "5; url=/next", "seconds": 5.0, "url": "/next"}),
    ("format_detection", ["telephone=no, email=yes"], {"raw": "telephone=no, email=yes", "telephone": False, "email": True}),
    ("json_ld", ['{"a":1}'], {"raw": '{"a":1}', "parsed": {"a": 1}}),
    ("inverse_weight", [0.25], 5.0),
    ("normalize_url", ["http://A.com/x/index.html?b=1", ".html"], "http://a.com/x/?b=1"),
    ("distilled", ["<html><head><title>t</title></head><body><p>a  b</p></body></html>"], {"name": "#document", "children": [{"name": "html", "children": [{"name": "head", "children": ["<title>t</title>"]}, {"name": "body", "children": [{"name": "p", "children": ["a b"]}]}]}]}),
    ("coerced", ["12", "number"], 12.0),
    ("coerced", ["Yes", "yes"], True),
    ("coerced", ["maybe", "true"], "maybe"),
    ("meta", [HEAD, "title"], "A title"),
    ("meta", [HEAD, "base", "href"], "/b/"),
    ("meta", [HEAD, "html", "lang"], "en"),
    ("meta", [HEAD, "og", "title"], "T"),
    ("meta", [HEAD, "og", "image"], ["1.png", "2.png"]),
    ("meta", [HEAD, "itemprop", "name"], "N"),
    ("meta", [HEAD, "canonical"], "https://e.com/"),
    ("meta", [HEAD, "feeds"], [{"href": "feed.xml", "type": "application/rss+xml"}]),
    ("meta", [HEAD, "stylesheets"], [{"href": "a.css"}]),
    ("meta", [HEAD, "viewport", "initial_scale"], 1.0),
    ("meta", [HEAD, "http_equiv", "refresh", "url"], "/next"),
    ("meta", [HEAD, "others", "meta"], [{"name": "unheard-of", "content": "x"}]),
    ("main_characters", [HEAD], 6),
    ("anchors", [HEAD], ["/p"]),
    ("images", [HEAD], [["i.png", True]]),
    ("provider_ids", ["Google Analytics", "gtag('config', 'G-ABC123'); ga('create', \"UA-12345-1\")"], ["G-ABC123", "UA-12345-1"]),
    ("provider_ids", ["Google Tag Manager", "googletagmanager.com/gtm.js?id=GTM-AB12 'GTM-AB12' 'GTM-CD34'"], ["GTM-AB12", "GTM-CD34"]),
    ("provider_ids", ["Nobody", "G-ABC123"], []),
    ("assembled_tags", [[{"name": "Hotjar", "categories": ["Analytics"], "version": "6"}, {"name": "X"}, {"categories": ["c"]}], "hjid:12345"], {"detected": {"Analytics": {"Hotjar": {"ids": ["12345"], "version": "6"}}, "Other": {"X": {"ids": []}}}, "entries": [{"provider": "Hotjar", "categories": ["Analytics"], "version": "6", "sources": [{"type": "html"}], "id": "12345"}, {"provider": "X", "categories": [], "sources": [{"type": "html"}]}]}),
    ("decode_uri", ["%E3%81%82%2F%20"], "あ%2F "),
    ("decode_uri", ["%zz"], "%zz"),
    ("decode_component", ["%E3%81%82%2F"], "あ/"),
    ("decode_component", ["%E3%81"], "%E3%81"),
    ("path_to_url", ["a/b c.txt"], "file:///a/b%20c.txt"),
    ("path_to_url", ["HTTP://X.com/a"], "http://x.com/a"),
    ("safe_file_path", ["a%20b?c:d*.txt"], "a b_c_d_.txt"),
    ("safe_file_path", ["con"], "_"),
    ("sheet_id", ["https://docs.e.com/spreadsheets/d/ID/edit"], "ID"),
    ("project_id", ["https://s.e.com/projects/KEY"], "KEY"),
    ("last_segment", ["https://n.e.com/a/b-c?x=1"], "b-c"),
    ("parse_url", ["http://u:p@Ex.com:80/a//b/Index.html?b=1&a=2&PHPSESSID=9#x", "href", "is_index", "extname", "stem"], ["http://u:p@ex.com/a/b/Index.html?a=2&b=1#x", True, ".html", "/a/b/"]),
    ("parse_url", ["no url", "href", "protocol", "paths"], ["no url", "", []]),
    ("urls_match", ["http://a.com/x/", "http://a.com/x/index.html"], True),
    ("urls_match", ["http://a.com/x", "http://a.com/y"], False),
    ("tree_diff", [{"a": 1}, {"a": 1}], [0, 0, 1.0]),
    ("text_diff", ["a b", "a c"], [0.5, ["b x1"], ["c x1"]]),
    ("shortened", ["abcdefghij", 5], "ab…ij"),
    ("layout", [_box(0, 0, 200, 100, [_box(0, 0), _box(100, 0)])], [["0", "horizontal-row"], ["0/0", "leaf"], ["0/1", "leaf"]]),
    ("layout", [_box(0, 0, 100, 200, [_box(0, 0), _box(0, 100)])], [["0", "vertical-stack"], ["0/0", "leaf"], ["0/1", "leaf"]]),
    ("layout", [_box(0, 0, 200, 200, [_box(0, 0), _box(100, 0), _box(0, 100), _box(100, 100)])], [["0", "simple-grid"], ["0/0", "leaf"], ["0/1", "leaf"], ["0/2", "leaf"], ["0/3", "leaf"]]),
    ("layout", [_box(0, 0, 200, 100, [_box(0, 0), _box(0, 0, display="none")])], [["0", "leaf"]]),
    ("viewport_spec", ["sp: 375"], ["sp", 375]),
    ("devices", [["tablet", "mobile"]], {"tablet": [768, 1], "mobile": [375, 2]}),
    ("devices", [[]], {}),
    ("retry_wait", [429], 110.0),
    ("retry_wait", [403, "Rate limit"], 60.0),
    ("retry_wait", [200], None),
]


def _text(x) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_sql(n)}, {_sql(_text(out))})" for i, (n, _, out) in enumerate(CASES)) + ") t(place, name, result)"


def function_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.plans.functions import mapped

    rows = spark.createDataFrame([(i, n, json.dumps(args)) for i, (n, args, _) in enumerate(CASES)], "place int, name string, args string")
    return mapped(rows, lambda i, n, args: [(i, n, _text(FUNCTIONS[n](*json.loads(args))))], "place int, name string, result string")
