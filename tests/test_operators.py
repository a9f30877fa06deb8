import json
import random

from pyspark.sql import functions as F

from weft.functions import sets as S
from weft.operators import blocking as B
from weft.operators import clusters as C
from weft.operators import partition as P
from weft.operators import rows as R
from weft.sources import lists as L
from weft.streaming import flows

SCHEMA = "idx long, host string, paths array<string>, stylesheetHrefs array<string>"


def test_blocks_and_orphans(spark):
    pages = spark.createDataFrame([(0, "s", ["a", "x"], ["http://s/a.css"]), (1, None, ["a", "y"], ["http://s/a.css", "http://cdn/x.css"]), (2, None, ["a", "z"], []), (3, "t", ["b"], ["http://t/b.css"]), (4, None, [""], [])], SCHEMA)
    got = {r.idx: r.block_key for r in B.resolve_blocks(pages).collect()}
    assert got[0] == got[1] == got[2] == "orphan-merge:a" and got[3] == "path:b" and got[4] == "path:"
    assert B.dominant_host(pages).first().dominant == "s"


def test_large_blocks_are_sampled(spark):
    pages = spark.range(1200).select(F.col("id").alias("idx"), F.concat(F.lit("<body><p>"), F.when(F.col("id") % 2 == 0, "<b>x</b>").otherwise("<i>x</i><table><tr><td>1</td></tr></table>"), F.lit("</p></body>")).alias("html"))
    keyed = pages.select("idx", F.lit("path:k").alias("block_key"))
    out = C.cluster_pages(C.prepared(pages), keyed).collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster_key, set()).add(r.idx % 2)
    assert len(out) == 1200 and all(len(v) == 1 for v in by.values()) and len(by) == 2


def test_partition_checks(spark):
    rows = [(i, f"c{i % 2}", ["t1", "t2"], [lang, "p", str(i // 2)], [f"http://s/{lang}/x.css"]) for i, lang in enumerate(["en", "de"] * 4)]
    pages = spark.createDataFrame(rows, "idx long, cluster_key string, tokens array<string>, paths array<string>, stylesheetHrefs array<string>")
    axis = P.mirror_axis(pages)
    assert axis == (0, ["de", "en"])
    dup = P.cross_duplicates(pages, axis)
    assert [(r.similarity, r.corroborated) for r in dup.collect()] == [(1.0, True)]
    assert P.validated_merges(dup) == {"c0": "c0", "c1": "c0"}
    assert {(r.members, r.median, r.suspicious) for r in P.cohesion(pages).collect()} == {(4, 1.0, False)}


def test_merge_across_blocks():
    units = {"a": [{"x>p", "x>q"}] * 2, "b": [{"x>p", "x>q"}] * 2, "c": [{"z"}]}
    assert C.merge_across_blocks(units) == {"a": "a", "b": "a", "c": "c"}


def test_path_tree_and_findings(spark):
    tree = R.path_tree(spark.createDataFrame([("/a/b/c",), ("/a",)], "stem string"))
    assert {(r.stem, r.parent_stem, r.depth, r.virtual) for r in tree.collect()} == {("/", None, 0, True), ("/a", "/", 1, False), ("/a/b", "/a", 2, True), ("/a/b/c", "/a/b", 3, False)}
    assert {r.stem for r in R.pruned_tree(tree, F.col("stem") == "/a/b").collect()} == {"/", "/a"}
    found = R.cleaned_findings(spark.createDataFrame([("k", "desktop-compact", 1), ("k", "desktop", 2), ("k", "mobile", 3)], "k string, env string, at int"), ["k"], "env", "at")
    assert found.first().environments == "desktop-compact\nmobile"


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"html": "<p>"}\n\n{"id": "z", "html": "<i>", "paths": ["a"]}\n')
    got = L.read_pages(spark, str(tmp_path / "p.jsonl")).orderBy("idx").collect()
    assert [(r.id, r.html, r.paths) for r in got][1] == ("z", "<i>", ["a"]) and got[0].stylesheetHrefs == []
    (tmp_path / "l.txt").write_text("# no\n  a b\n\nc")
    assert [(r.line, r.column, r.value) for r in L.read_list(spark, str(tmp_path / "l.txt")).collect()] == [(2, 3, "a b"), (4, 1, "c")]
    cells = spark.createDataFrame([(1, 1, "N"), (1, 2, "X"), (2, 1, "1"), (2, 2, "u"), (3, 1, "z"), (3, 2, "")], "row int, column int, text string")
    assert [tuple(r) for r in L.sheet_table(cells, {"n": "N", "x": "X", "gone": "?"}).collect()] == [(1.0, "u"), (None, None)]
    files = spark.createDataFrame([("a.zip", bytearray(L.zipped([("f", b"1"), ("g", b"2")])))], "path string, content binary")
    assert [(r.name, bytes(r.content)) for r in L.unzipped(files).collect()] == [("f", b"1"), ("g", b"2")]
    a = spark.createDataFrame([("same", bytearray(b"1")), ("mod", bytearray(b"1")), ("new", bytearray(b"1"))], "name string, content binary")
    b = spark.createDataFrame([("same", bytearray(b"1")), ("mod", bytearray(b"2")), ("missing", bytearray(b"1"))], "name string, content binary")
    assert {r.name: r.status for r in L.compared_files(a, b).collect()} == {"same": "same", "mod": "modified", "new": "new", "missing": "missing"}
    sent = []

    def send(batch):
        if len(batch) > 2:
            raise ValueError
        sent.append(len(batch))

    assert L.in_batches(iter(range(7)), 5, send) == 7 and sum(sent) == 7


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    flows.into(flows.windowed_counts(flows.read_stream(spark, str(tmp_path / "in"), files=10)), str(tmp_path / "cp"), lambda df, _: seen.extend(df.collect()), "complete")
    want = {(r.window_start, r.event_type): r.n for r in flows.windowed_counts(events).collect()}
    assert {(r.window_start, r.event_type): r.n for r in seen} == want
    assert json.dumps(sorted(str(k) for k in want))


def test_profiles_and_merges(spark):
    inst = lambda *t: ("nav", list(t))
    rows = [(0, "c", [inst("a", "b")], ["t"]), (1, "c", [inst("a", "b"), inst("z")], ["t"]), (2, "c", [], ["t"]), (3, "d", [], ["t"])]
    pages = spark.createDataFrame(rows, "idx long, cluster_key string, instances array<struct<type:string,tokens:array<string>>>, tokens array<string>")
    got = P.landmark_profiles(pages).collect()
    assert [(r.cluster_key, r.type, round(r.presence_rate, 3), round(r.chrome_rate, 3), r.shell_tokens, r.members_with) for r in got] == [("c", "nav", 0.667, 0.667, ["a", "b"], 2)]
    assert {r.cluster_key for r in P.merged_partition(pages).collect()} == {"c"}


def test_findings(spark):
    from weft.operators import findings

    result = {"url": "http://a", "timestamp": "2024-01-02T03:04:05Z", "testEngine": {"name": "e", "version": "1"}, "violations": [{"id": "x", "help": "H", "helpUrl": "U", "description": "D", "impact": "serious", "tags": ["wcag2aa", "wcag143"], "nodes": [{"html": "<a>"}, {"html": "<b>"}]}], "incomplete": []}
    rows = findings.finding_rows(spark.createDataFrame([(json.dumps(result), "desktop")], "result string, environment string")).collect()
    assert [(r.target, r.sc_number, r.level, r.severity, r.as_is, r.tool) for r in rows] == [(t, "1.4.3", "AA", "high", "H\n(U)\n\nD", "e (v1)") for t in ("<a>", "<b>")]
    assert findings.devices(["mobile"]) == {"mobile": (375, 2)} and findings.retry_wait(429) == 110


def test_small_corpora_are_clustered_whole(spark):
    # three pages of 1,200 have a template of their own, none of them among the 100 of the smallest hashes
    pages = spark.range(1200).withColumn("r", F.expr("row_number() over (order by xxhash64(id), id)"))
    rare = F.col("r") > 1197
    html = F.when(rare, "<body><ul><li><a>x</a></li></ul><form><input></form></body>").otherwise("<body><p><b>x</b></p><table><tr><td>1</td></tr></table></body>")
    pages = pages.select(F.col("id").alias("idx"), html.alias("html"), rare.alias("rare"))
    keyed = pages.select("idx", F.lit("path:k").alias("block_key"))
    got = C.cluster_blocks(C.prepared(pages), keyed).join(pages, "idx").groupBy("rare").agg(F.collect_set("unit_key").alias("k"), F.count("*").alias("n")).collect()
    by = {r.rare: (set(r.k), r.n) for r in got}
    assert by[True][1] == 3 and by[False][1] == 1197 and not by[True][0] & by[False][0]


def test_weighted_clustering_is_that_of_all_pages():
    draw = random.Random(5)
    for _ in range(200):
        base = [{x for x in "abcdefghijkl" if draw.random() < 0.6} for _ in range(6)]
        sets = [draw.choice(base) for _ in range(draw.randrange(2, 30))]
        whole = S.comparison_sets(sets)
        merges = S.dendrogram(whole)
        roots = S.labels_at(len(sets), merges, S.auto_cut([h for _, _, h in merges], S.SIMILARITY))
        kinds = list(dict.fromkeys(map(frozenset, sets)))
        compared = S.comparison_sets(kinds, [sets.count(k) for k in kinds])
        got = dict(zip(kinds, S.first_seen(S.auto_cut_roots(compared, [sets.count(k) for k in kinds]))))
        assert [got[frozenset(s)] for s in sets] == S.first_seen(roots)


def test_pages_outside_the_sample_have_the_blocks_depth_cap(spark, monkeypatch):
    monkeypatch.setattr(C, "CORPUS_INLINE", 100)
    words = "apple bread chair dance eagle flame grape house island jungle kettle lemon mango needle ocean piano queen river stone table".split()
    draw = random.Random(3)

    def page(i):
        deep = "".join(f'<b class="{w}">x</b>' for w in draw.sample(words, 12))
        inner = f"<div><div><div><div>{deep}</div></div></div></div>"
        return (i, f"<body><main><section>{inner}</section></main></body>" if i % 2 else f"<body><main><article><h2>t</h2><ul><li>x</li></ul>{inner}</article></main></body>")

    pages = spark.createDataFrame([page(i) for i in range(700)], "idx long, html string")
    out = C.cluster_blocks(C.prepared(pages), pages.select("idx", F.lit("path:k").alias("block_key"))).collect()
    assert len(out) == 700 and not {t for r in out for t in r.tokens if any(w in t for w in words)}
    by = {}
    for r in out:
        by.setdefault(r.unit_key, set()).add(r.idx % 2)
    assert all(len(v) == 1 for v in by.values()) and len(by) == 2


def test_merge_counts_all_members_of_a_unit(spark):
    # 10 of 12 pages of block a have block b's tokens; the two that don't are the first ones of their ids modulo 64
    rows = [(64 * i, "a", ["p>q", "p>r"] if i >= 2 else ["z>y"]) for i in range(12)] + [(7, "b", ["p>q", "p>r"])]
    inside = spark.createDataFrame(rows, "idx long, unit_key string, tokens array<string>")
    got = {r.unit_key: (r.n, {x.t: x.c for x in r.counts}) for r in C.tallied(inside).collect()}
    assert got == {"a": (12, {"p>q": 10, "p>r": 10, "z>y": 2}), "b": (1, {"p>q": 1, "p>r": 1})}


def test_merge_sees_pages_with_ids_of_one_remainder(spark, monkeypatch):
    rows = [(64 * i, "a", ["p>q", "p>r"] if i >= 2 else ["z>y"]) for i in range(12)] + [(7, "b", ["p>q", "p>r"])]
    inside = spark.createDataFrame([(i, k, k, t) for i, k, t in rows], "idx long, block_key string, unit_key string, tokens array<string>")
    monkeypatch.setattr(C, "cluster_blocks", lambda pages, keyed: inside)
    assert {r.cluster_key for r in C.cluster_pages(None, None).collect()} == {"a"}


def random_units(draw, n):
    """Units of pages from a few templates with tokens lost and added, some with equal pages."""
    heads = [[f"body>{a}.k{i}>{b}" for i in range(9) for b in "pq"] for a in ("main", "div", "ul", "div")]
    units = {}
    for u in range(n):
        base = draw.choice(heads)
        core = [t for t in base if draw.random() > draw.choice((0, 0.05, 0.3))] + [f"body>x{u % 7}"] * (draw.random() < 0.3)
        units[f"u{u:03}"] = [{t for t in core if draw.random() > draw.choice((0, 0.1))} for _ in range(draw.choice((1, 1, 2, 5)))]
    return units


def test_merge_in_spark_is_that_on_the_driver(spark):
    for seed in range(3):
        units = random_units(random.Random(seed), 40)
        rows = [(100 * n + i, k, sorted(t)) for n, (k, pages) in enumerate(units.items()) for i, t in enumerate(pages)]
        tallies = C.tallied(spark.createDataFrame(rows, "idx long, unit_key string, tokens array<string>"))
        got = {r.unit_key: r.root for r in C.merge_many(C.written(tallies, "tallies")).collect()}
        want = C.merge_across_blocks(units)
        assert got == want and 1 < len(set(want.values())) < 40


def test_more_units_than_the_driver_takes_still_merge(spark, monkeypatch):
    inside = spark.createDataFrame([(i, f"b{i}", f"b{i}", ["p>q", f"p>r{i % 2}"]) for i in range(6)], "idx long, block_key string, unit_key string, tokens array<string>")
    monkeypatch.setattr(C, "cluster_blocks", lambda pages, keyed: inside)
    assert {(r.idx % 2, r.cluster_key) for r in C.cluster_pages(None, None, max_units=2).collect()} == {(0, "b0"), (1, "b1")}


def shuffled(spark, what):
    """Rows or bytes that all stages until now have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_pairs_of_equal_clusters_are_not_shuffled(spark):
    # 300 clusters that share three token sets: 44,850 pairs
    pages = spark.range(900).select(F.col("id").alias("idx"), F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("cluster_key"), F.array(F.concat(F.lit("t"), F.floor(F.col("id") / 300).cast("string"))).alias("tokens"))
    before = shuffled(spark, "shuffleWriteRecords")
    P.cross_duplicates(pages).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, "shuffleWriteRecords") - before < 20_000
    assert P.cross_duplicates(pages).distinct().count() == P.cross_duplicates(pages).count() == 300 * 299 // 2


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIR_CHUNK", 3)
    monkeypatch.setattr(P, "PAIR_CHUNKS", 2)
    draw = random.Random(5)
    rows = [(i, f"c{draw.randrange(60)}", [f"t{draw.randrange(40)}"]) for i in range(90)] + [(90 + i, f"d{i % 20}", [f"u{i % 2}", f"u{i % 2}"]) for i in range(60)]
    rows += [(200, None, ["u0"]), (201, "e0", []), (202, "e1", []), (203, "e2", None), (204, "e3", ["u0", None]), (205, "e4", [None, "u0"]), (206, "lone", ["x"])]
    pages = spark.createDataFrame(rows, "idx long, cluster_key string, tokens array<string>")
    sets = {}
    for _, c, tokens in rows:
        if c and tokens:
            sets.setdefault(c, set()).add(frozenset(tokens))
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] & sets[b])
    got = P.cross_duplicates(pages).collect()
    assert sorted((r.cluster_key_a, r.cluster_key_b) for r in got) == want and {(r.similarity, r.corroborated) for r in got} == {(1.0, False)}
    roots = {}
    for a, b in want * len(sets):
        roots[a] = roots[b] = min(roots.get(a, a), roots.get(b, b))
    merged = P.merged_partition(pages).collect()
    assert {r.idx: r.cluster_key for r in merged} == {i: roots.get(c, c) for i, c, _ in rows} and len(merged) == len(rows)
    assert P.cross_duplicates(pages.where("idx < 0")).count() == 0


def test_siblings_are_counted_without_lists(spark):
    # clusters of one block, of several and of none, alone in a block, twice in one, without a key
    draw = random.Random(6)
    rows = [(i, f"c{draw.randrange(40)}", f"b{draw.randrange(9)}", ["t", f"u{i % 3}"]) for i in range(70)]
    rows += [(100, "lone", "z", []), (101, "none", None, ["t"]), (102, "twice", "b1", ["t"]), (103, "twice", "b1", ["t", "t"]), (104, None, "b1", ["t"]), (105, "none", None, None)]
    pages = spark.createDataFrame(rows, "idx long, cluster_key string, block_key string, tokens array<string>")
    of = lambda c: {b for _, k, b, _ in rows if k == c and b}
    want = {c: sorted({k for _, k, b, _ in rows if k and b in of(c)} - {c}) for c in {r[1] for r in rows} if c}
    listed = {r.cluster_key: r for r in P.cluster_reasons(pages).collect()}
    assert {c: r.siblings for c, r in listed.items()} == want | {None: []}
    counted = {r.cluster_key: r for r in P.cluster_reason_counts(pages).collect()}
    assert {c: r.n_siblings for c, r in counted.items()} == {c: len(r.siblings) for c, r in listed.items()}
    assert all((counted[c].pages, counted[c].core_tokens) == (r.pages, r.core_tokens) for c, r in listed.items())


def test_turn_reasons_shuffle_no_siblings(spark, tmp_path):
    # 4,000 conversations of one word: five blocks of 800 clusters, 3.2 million siblings
    from weft.plans import functions

    spark.range(4000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("w").alias("text")).write.parquet(str(tmp_path / "conversations.parquet"))
    before = shuffled(spark, "shuffleWriteBytes")
    rows = functions.turn_reasons(spark, str(tmp_path)).collect()
    assert shuffled(spark, "shuffleWriteBytes") - before < 2_000_000
    assert len(rows) == 4000 and {(r.pages, r.core, r.first_token, r.siblings) for r in rows} == {(1, 1, "w", 799)}
