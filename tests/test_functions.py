import random
from itertools import combinations

import pytest

from weft.functions import diffs, head, layout, sets, skeleton, sorting, urls, values


def tokens(html, **kw):
    return skeleton.tokenize(html, **kw)[0]


def test_tokenize_cases():
    assert tokens("<body><ul><li>a<li>b</ul></body>") == ["body>ul>li", "body>ul>li"]
    assert tokens("<body></body>") == ["body"]
    assert tokens("") == tokens("<p>no body</p>") == []
    assert tokens("<body><p>cut <b") == ["body>p"]
    assert tokens("<body>" + "<div>" * 50 + "x" + "</div>" * 50 + "</body>") == ["body>div"]
    assert tokens("<body><p>1</p></body><body><i>2</i></body>") == ["body>p"]
    assert tokens("<body><body><p>1</p></body></body>") == ["body>p"]
    assert skeleton.tokenize('<body class="home a1b2c3d4"><p>1</p></body>')[1] == ["home"]
    assert tokens("<body><!--x--><p>1</p></body>", comments=True)[0].startswith("body>comment[sha=")
    assert len(tokens("<body>" + "<i></i>" * 20000 + "</body>")) == 20000
    assert tokens('<body><div class="b a" role="x"><input type="text"></div></body>') == ["body>.a.b[role=x]>input[type=text]"]
    assert tokens("<body><script> </script></body>") == ["body>script[sha=e3b0c44298fc1c14]"]


def test_landmarks():
    found, rest = skeleton.landmarks("<body><header><nav>x</nav></header><main><nav>y</nav></main><form>f</form><div role=form>g</div><aside>open</body>")
    assert [len(found[k]) for k in (*skeleton.LANDMARKS, "main")] == [1, 0, 1, 0, 1, 0, 1]
    assert rest == "<body><main></main><form>f</form><aside>open</body>"
    assert skeleton.landmarks('<body role="banner">a</body>')[0]["header"][0]["html"] == '<body role="banner">a</body>'
    instances = skeleton.page_instances(found)
    assert [i["type"] for i in instances] == ["header", "nav", "form"]


def test_cuts():
    page = "<body><main><div><p>a</p></div>b</main></body>"
    assert skeleton.cap_depth(page, 0) == "<body><main>b</main></body>"
    assert skeleton.cap_depth(page, 5) == page
    assert skeleton.cap_depth("<body><div><p>a</p></div></body>", 0) == "<body><div><p>a</p></div></body>"
    with pytest.raises(ValueError):
        skeleton.cap_depth(page, -1)
    assert skeleton.remove_blocks("<body data-x><div data-x='no'>a</div><svg data-x></svg>b</body>", "data-x") == "<body data-x>b</body>"


def test_shapes_and_signatures():
    assert skeleton.shape("body>.a.b[role=x]>p.c") == "body>*[role=x]>p"
    assert skeleton.collapse_anonymous("body>div>span>p") == "body>p"
    assert skeleton.canonical(["b", "a", "b"]) == '["a","b"]'
    assert [skeleton.is_noise_class(c) for c in ("sc-bdVaJa", "css-1abc23", "button", "_a1b2c", "btn__x1y2z3")] == [True, True, False, True, True]


def brute_dendrogram(s):
    groups, out = {i: [i] for i in range(len(s))}, []
    while len(groups) > 1:
        link = lambda a, b: min(sets.jaccard(s[i], s[j]) for i in groups[a] for j in groups[b])
        a, b = max(combinations(sorted(groups), 2), key=lambda p: (link(*p), -p[0], -p[1]))
        out.append(link(a, b))
        groups[a] += groups.pop(b)
    return out


def test_clustering_against_brute_force():
    draw = random.Random(1)
    for _ in range(20):
        s = [set(draw.sample("abcdefghij", draw.randint(1, 6))) for _ in range(7)]
        heights = sorted((h for _, _, h in sets.dendrogram(s)), reverse=True)
        assert len(heights) == 6 and abs(heights[0] - max(brute_dendrogram(s))) < 1e-12
    assert sets.structural_clusters([{"a"}, {"b"}, {"a"}, set()]) == ["cluster:0", "cluster:1", "cluster:0", "cluster:2"]
    assert sets.jaccard(set(), set()) == 1.0
    assert sets.auto_cut([0.9, 0.85, 0.2], 0.8) == pytest.approx(0.525) and sets.auto_cut([1, 1], 0.8) == 0.8
    assert sets.contained({0: ({"a", "b"}, 1), 1: ({"a", "b", "c"}, 1), 2: ({"x"}, 1)}) == {0: 1, 1: 1, 2: 2}
    assert sets.edit_distance("kitten", "sitting") == 3


def test_reservoir():
    assert sets.reservoir(5, 9) == [0, 1, 2, 3, 4] and sets.reservoir(5, 0) == []
    assert sets.reservoir(1000, 10, "k") == sets.reservoir(1000, 10, "k") != sets.reservoir(1000, 10, "l")
    assert sets.fnv1a("") == 2166136261 and sets.fnv1a("a") == 0xE40C292C


def test_urls():
    p = urls.parse_url("http://u:p@Ex.com:80/a//b/Index.html?b=1&a=2&PHPSESSID=9#x")
    assert (p["href"], p["is_index"], p["extname"], p["stem"]) == ("http://u:p@ex.com/a/b/Index.html?a=2&b=1#x", True, ".html", "/a/b/")
    assert urls.urls_match("http://a.com/x/", "http://a.com/x/index.html") and not urls.urls_match("http://a.com/x", "http://a.com/y")
    assert urls.is_lower("http://a.com/x/y", "http://a.com/x/") and not urls.is_lower("http://a.com/x", "http://b.com/")
    assert [u["href"] for u in urls.sort_urls(["http://a.com/p10", "http://a.com/p9", "no url", "http://a.com/"])] == ["http://a.com", "http://a.com/p9", "http://a.com/p10"]
    assert urls.sheet_id("https://docs.x.com/spreadsheets/d/ID/edit") == "ID"


def test_sorting_and_values():
    assert sorting.natural_sorted(["a10", "a2", "a1"]) == ["a1", "a2", "a10"]
    assert sorting.natural_sorted(["1.10", None, "1.2", "1.2.1"], sorting.sc_number) == ["1.2", "1.2.1", "1.10", None]
    assert sorting.decode_uri("%E3%81%82%2F") == "あ%2F" and sorting.decode_uri("%zz") == "%zz"
    assert values.parse_interval("100-200") == (100, 200) and values.parse_interval("5") == 5
    with pytest.raises(ValueError):
        values.parse_interval("9-1")
    assert [values.column_name(n) for n in (1, 26, 27, 702)] == ["A", "Z", "AA", "ZZ"]
    assert values.inverse_weight(lambda x: 1.0, 0, 10, 0.5) == pytest.approx(5)


def test_head_and_layout_and_diffs():
    html = '<html lang=en><head><title> a  b </title><meta name=robots content="noindex, max-snippet:5"><meta property="og:image" content=1><meta property="og:image" content=2><link rel="shortcut icon" href=i.ico><script type="application/ld+json">{"a":1}</script></head><body><main><h1>T</h1>xy z<img></main><a href="mailto:a@b.c">m</a><a href="/p">go</a></body>'
    meta = head.page_meta(html)
    assert meta["title"] == "a b" and meta["robots"]["noindex"] and meta["robots"]["max_snippet"] == 5 and meta["og"]["image"] == ["1", "2"]
    assert meta["icons"] == [{"href": "i.ico"}] and meta["json_ld"][0]["parsed"] == {"a": 1}
    assert head.main_content(html)["characters"] == 4 and [a["href"] for a in head.collect(html)[1]] == ["/p"]
    box = lambda x, y, kids=(), tag="DIV": {"tagName": tag, "style": {"display": "block"}, "boundingBox": {"x": x, "y": y, "width": 100, "height": 100}, "children": list(kids)}
    assert layout.classify(box(0, 0, [box(0, 0), box(0, 100)]))[0]["layoutType"] == "unknown"
    wide = {**box(0, 0, [box(0, 0), box(100, 0)]), "boundingBox": {"x": 0, "y": 0, "width": 200, "height": 100}}
    assert layout.classify(wide)[0]["layoutType"] == "horizontal-row" and layout.parse_display("inline-flex")["inside"] == "flex"
    assert diffs.text_diff("a b", "a c")["only_a"] == ["b x1"] and diffs.tree_diff({"a": 1}, {"a": 1})["matches"] == 1
