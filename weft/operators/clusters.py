"""Template clusters of pages: within blocks by complete linkage, then across blocks.

In a corpus of up to CORPUS_INLINE pages every block is clustered as a whole. In a larger one blocks are up to INLINE pages; of a
larger block BLOCK_SAMPLE pages are, and the rest go to the cluster of the most similar sampled page. Samples are drawn in two levels of
salted groups, and the rest is compared in salted groups of bounded size, so a block that holds most pages is never one task's. Pages of
a block with equal token sets (at all depths) are one weighted row before its task. HTML is parsed in mapInArrow, and only token sets
travel on."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from weft.functions import sets as S
from weft.functions import skeleton as K
from weft.sources.tables import written

CORPUS_INLINE, INLINE, BLOCK_SAMPLE, SALT_ROWS = 20_000, 500, 100, 2_000
ROUNDS, FINE, QUORUM, SHAPE, SHAPE_PAGES, GUARD = 10, 0.8, 0.8, 0.9, 2, 0.5
UNASSIGNED = "cluster:unassigned"
INSTANCE = "struct<type:string,tokens:array<string>,signature:string,startOffset:int,endOffset:int,startLine:int,startColumn:int,endLine:int,endColumn:int>"


def prepared(pages: DataFrame, exclude_landmarks: bool = True, block_attribute: str | None = None, id_col: str = "idx") -> DataFrame:
    """(idx, prepared html, tokens, instances): landmarks cut out and read, content blocks removed, leaf paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("type", pa.string()), ("tokens", pa.list_(pa.string())), ("signature", pa.string()), *[(c, pa.int32()) for c in ("startOffset", "endOffset", "startLine", "startColumn", "endLine", "endColumn")]])
        for batch in batches:
            html, tokens, instances = [], [], []
            for page in batch.column(1).to_pylist():
                found, rest = K.landmarks(page or "")
                rest = rest if exclude_landmarks else page or ""
                rest = K.remove_blocks(rest, block_attribute) if block_attribute else rest
                html.append(rest)
                tokens.append(list(dict.fromkeys(K.tokenize(rest)[0])))
                instances.append(K.page_instances(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(instances, pa.list_(kind))], ["idx", "prepared", "tokens", "instances"])

    return pages.select(F.col(id_col).cast("long").alias("idx"), "html").mapInArrow(run, f"idx long, prepared string, tokens array<string>, instances array<{INSTANCE}>")


def local_chrome(pages: DataFrame) -> DataFrame:
    """(idx, local): tokens of landmark instances that several pages share but few: their signature's share of pages lies under the auto-cut."""
    seen = pages.select("idx", F.explode("instances").alias("x")).select("idx", "x.signature", "x.tokens")
    share = seen.groupBy("signature").agg(F.countDistinct("idx").alias("n")).crossJoin(F.broadcast(pages.agg(F.count("*").alias("total"))))  # one row
    share = share.withColumn("f", F.col("n") / F.col("total"))
    # the widest gap between neighbouring shares in descending order, over distinct shares: equal ones have no gap. One task orders
    # them; n instances have at most sqrt(2 n) distinct counts
    levels = share.select("f").distinct().withColumn("next", F.lead("f").over(Window.orderBy(F.desc("f"))))
    many = share.agg(F.count("*").alias("signatures"))
    cut = levels.agg(F.max(F.struct((F.col("f") - F.col("next")).alias("gap"), "f", "next")).alias("g")).crossJoin(many).select(F.when((F.col("signatures") > 1) & (F.col("g.gap") > 0), F.least((F.col("g.f") + F.col("g.next")) / 2, F.lit(S.CHROME))).otherwise(S.CHROME).alias("cut"))
    local = share.crossJoin(F.broadcast(cut)).where("n >= 2 and f < cut").select("signature")
    return seen.join(local, "signature", "left_semi").groupBy("idx").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("local"))


def at_depths(rows: DataFrame) -> DataFrame:
    """rows (idx, prepared) as (idx, capped): the tokens at each of S.DEPTHS; null without a main, where all are the page's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capped = [[sorted(set(K.tokenize(K.cap_depth(h, d))[0])) for d in S.DEPTHS] if "main" in h.lower() else None for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(capped, pa.list_(pa.list_(pa.string())))], ["idx", "capped"])

    return rows.select("idx", "prepared").mapInArrow(run, "idx long, capped array<array<string>>")


def at_learned(rows: DataFrame) -> DataFrame:
    """rows (idx, prepared, depth) as (idx, own): the tokens at the depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(K.tokenize(K.cap_depth(h, d))[0])) for h, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["idx", "own"])

    return rows.select("idx", "prepared", "depth").mapInArrow(run, "idx long, own array<string>")


def stage_a(tokens: list[set], weights: list[int], capped: list[list[set] | None], local: list[set]) -> tuple[list[str], list[set], int | None]:
    """(label, tokens) of a block's distinct pages in order, each standing for `weights` pages, and the depth cap, which blocks of one page have none of."""
    depth = S.DEPTHS[-1] if sum(weights) > 1 else None
    if depth and any(c is not None for c in capped):
        depth = S.knee_depth([[t if c is None else c[d] for t, c in zip(tokens, capped)] for d in range(len(S.DEPTHS))])
        tokens = [t if c is None else c[S.DEPTHS.index(depth)] for t, c in zip(tokens, capped)]
    tokens = [t | l for t, l in zip(tokens, local)]
    compared = S.comparison_sets(tokens, weights)
    roots = S.auto_cut_roots(compared, weights)
    if sum(weights) >= S.SPLIT_FROM:
        groups: dict[int, tuple[set, int]] = {}
        for r, t, w in zip(roots, compared, weights):
            held, n = groups.get(r, (set(), 0))
            groups[r] = (held | {K.collapse_anonymous(x) for x in t}, n + w)
        into = S.contained(groups)
        roots = [into[r] for r in roots]
    return S.first_seen(roots), tokens, depth


def unit_key(block: str, label: str) -> str:
    return json.dumps([block, label], ensure_ascii=False, separators=(",", ":"))


def sampled_blocks(keyed: DataFrame) -> DataFrame:
    """(idx, block_key, size, in_sample): whole blocks in a corpus of up to CORPUS_INLINE pages or up to INLINE pages of their own, else BLOCK_SAMPLE pages by a hash of idx."""
    inline = INLINE if keyed.count() > CORPUS_INLINE else CORPUS_INLINE
    sizes = keyed.groupBy("block_key").agg(F.count("*").alias("size"))
    rows = keyed.select("idx", "block_key").join(sizes, "block_key").withColumn("h", F.xxhash64("idx"))
    salted = rows.withColumn("salt", F.pmod("idx", F.greatest(F.lit(1), (F.col("size") / SALT_ROWS).cast("long"))))
    first = salted.where(F.col("size") > inline).withColumn("r", F.row_number().over(Window.partitionBy("block_key", "salt").orderBy("h", "idx"))).where(F.col("r") <= BLOCK_SAMPLE)
    chosen = first.withColumn("r", F.row_number().over(Window.partitionBy("block_key").orderBy("h", "idx"))).where(F.col("r") <= BLOCK_SAMPLE).select("idx", F.lit(True).alias("chosen"))
    return rows.join(chosen, "idx", "left").select("idx", "block_key", "size", ((F.col("size") <= inline) | F.coalesce("chosen", F.lit(False))).alias("in_sample"))


def cluster_blocks(pages: DataFrame, keyed: DataFrame, cap: bool = True) -> DataFrame:
    """(idx, block_key, unit_key, tokens): pages of prepared() with the blocks of keyed."""
    pages = written(pages, "pages-prepared")  # parsed once
    placed = written(sampled_blocks(written(keyed.select("idx", "block_key"), "block-keys")), "block-places")
    rows = pages.select("idx", "prepared", "tokens").join(local_chrome(pages), "idx", "left").join(placed, "idx")
    sample = rows.where("in_sample")
    if cap:
        depths = at_depths(sample.where(F.col("size") > 1))
        sample = sample.join(depths, "idx", "left")
    else:
        sample = sample.withColumn("capped", F.lit(None).cast("array<array<string>>"))
    sets = F.struct(F.array_sort("tokens").alias("t"), F.array_sort("local").alias("l"), "capped")
    sample = written(sample.select("idx", "block_key", "tokens", "local", "capped", F.sha2(F.to_json(sets), 256).alias("sig")), "block-samples")
    distinct = sample.groupBy("block_key", "sig").agg(F.min("idx").alias("first"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("tokens", "local", "capped")])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        local = [set(x) if x is not None else set() for x in group["local"]]
        capped = [[set(t) for t in c] if c is not None else None for c in group["capped"]]
        labels, tokens, depth = stage_a([set(t) for t in group["tokens"]], group["weight"].tolist(), capped, local)
        block = group["block_key"].iloc[0]
        return pd.DataFrame({"block_key": block, "sig": group["sig"], "first": group["first"], "unit_key": [unit_key(block, x) for x in labels], "tokens": [sorted(t) for t in tokens], "depth": pd.array([depth] * len(group), "Int32")})

    schema = "idx long, block_key string, unit_key string, tokens array<string>"
    kinds = written(distinct.groupBy("block_key").applyInPandas(run, "block_key string, sig string, first long, unit_key string, tokens array<string>, depth int"), "block-clusters")
    done = sample.select("idx", "block_key", "sig").join(kinds, ["block_key", "sig"]).select("idx", "block_key", "unit_key", "tokens")
    rest = rows.where("not in_sample")
    if cap:
        learned = kinds.groupBy("block_key").agg(F.max("depth").alias("depth"))
        own = at_learned(rest.where(F.lower("prepared").contains("main")).join(learned, "block_key").where("depth is not null"))
        rest = rest.join(own, "idx", "left").withColumn("tokens", F.coalesce("own", "tokens")).drop("own")
    rest = rest.drop("prepared").withColumn("salt", F.pmod("idx", F.greatest(F.lit(1), (F.col("size") / SALT_ROWS).cast("long"))))
    large = placed.where("not in_sample").groupBy(F.col("block_key").alias("large_key")).agg(F.max("size").alias("rows"))
    salts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), (F.col("rows") / SALT_ROWS).cast("long")) - 1)
    models = kinds.join(large, F.col("block_key") == F.col("large_key")).select(F.col("block_key").alias("model_key"), F.explode(salts).alias("model_salt"), "unit_key", F.col("first").alias("member"), F.col("tokens").alias("member_tokens"))

    def nearest(key: tuple, group: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        members = [(k, frozenset(t)) for k, t in model.sort_values("member")[["unit_key", "member_tokens"]].itertuples(index=False)]
        out = []
        for i, tokens, local in group[["idx", "tokens", "local"]].itertuples(index=False):
            own = set(tokens) | (set(local) if local is not None else set())
            best = max(((S.jaccard(own, t), -n) for n, (_, t) in enumerate(members)), default=None)
            out.append((i, key[0], members[-best[1]][0] if best else unit_key(key[0], UNASSIGNED), sorted(own)))
        return pd.DataFrame(out, columns=["idx", "block_key", "unit_key", "tokens"])

    others = rest.groupBy("block_key", "salt").cogroup(models.groupBy("model_key", "model_salt")).applyInPandas(nearest, schema)
    return done.unionByName(others)


def quorum_core(count: Counter, members: int, share: float = QUORUM) -> set:
    """The tokens that so many of the members have."""
    return {t for t, n in count.items() if n >= share * members - S.EPSILON}


def merge_across_blocks(units: dict[str, list[set]]) -> dict[str, str]:
    """merge_counted() of units given by their members' tokens."""
    return merge_counted({k: (Counter(t for m in members for t in m), len(members)) for k, members in units.items()})


def merge_counted(units: dict[str, tuple[Counter, int]]) -> dict[str, str]:
    """Unit to the unit that stands for it. units: in first-seen order, each with its tokens' counts of members and its members.

    Rounds until nothing changes: complete linkage of the quorum cores, containment, and shape similarity of units with several pages;
    a merge needs class-stripped cores that agree by GUARD. The lower unit survives, and counts add up, so no member is left out."""
    keys = list(units)
    root = {k: k for k in keys}
    place = {k: i for i, k in enumerate(keys)}
    counts, members = {k: c for k, (c, _) in units.items()}, {k: n for k, (_, n) in units.items()}
    for _ in range(ROUNDS):
        live = [k for k in keys if root[k] == k]
        cores = [quorum_core(counts[k], members[k]) for k in live]
        shapes = [{K.shape(t) for t in c} for c in cores]
        proposals = [(a, b) for a, b, h in S.dendrogram(cores) if h >= FINE - S.EPSILON]
        into = S.contained({i: (c, members[k]) for i, (k, c) in enumerate(zip(live, cores))})
        proposals += [(i, j) for i, j in into.items() if i != j]
        several = [i for i, k in enumerate(live) if members[k] >= SHAPE_PAGES]
        proposals += [(i, j) for n, i in enumerate(several) for j in several[n + 1 :] if S.jaccard(shapes[i], shapes[j]) >= SHAPE]
        changed = False
        for i, j in proposals:
            a, b = S.root_of(root, live[i]), S.root_of(root, live[j])
            if a != b and S.jaccard(shapes[i], shapes[j]) >= GUARD:
                a, b = sorted((a, b), key=place.__getitem__)
                root[b] = a
                counts[a], members[a] = counts[a] + counts[b], members[a] + members[b]
                changed = True
        if not changed:
            break
    return {k: S.root_of(root, k) for k in keys}


def tallied(inside: DataFrame) -> DataFrame:
    """(unit_key, n, first, counts): each unit's members, its first, and how many of them have each token, over all members."""
    sizes = inside.groupBy("unit_key").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    counts = inside.select("unit_key", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("unit_key", "t").agg(F.count("*").alias("c"))
    return sizes.join(counts.groupBy("unit_key").agg(F.collect_list(F.struct("t", "c")).alias("counts")), "unit_key", "left")


def with_shapes(groups: DataFrame) -> DataFrame:
    """groups (…, core) with their cores' shapes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [sorted({K.shape(t) for t in c}) for c in batch.column("core").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.list_(pa.string()))], [*batch.schema.names, "shapes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
    return groups.mapInArrow(run, f"{schema}, shapes array<string>")


def likely_pairs(sets: DataFrame, share: float) -> DataFrame:
    """(x, y) of sets (id, items): all pairs where y holds at least `share` of x's items. y then has one of x's rarest 1 - share and one more."""
    items = sets.select("id", F.size("items").alias("size"), F.explode("items").alias("t"))
    df = items.groupBy("t").agg(F.count("*").alias("df"))
    ranked = items.join(df, "t").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "t")))
    prefix = ranked.where(F.col("r") <= F.col("size") - F.ceil(share * F.col("size") - S.EPSILON) + 1).select(F.col("id").alias("x"), "t", F.col("size").alias("size_x"))
    others = items.select(F.col("id").alias("y"), "t", F.col("size").alias("size_y"))
    return prefix.join(others, "t").where(f"x != y and size_y >= {share} * size_x - {S.EPSILON}").select("x", "y").distinct()


def compared_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(x, y, core_both, shape_both) of pairs of groups."""
    x, y = (groups.select(F.col("id").alias(k), F.col("core").alias(f"core_{k}"), F.col("shapes").alias(f"shapes_{k}")) for k in "xy")
    both = [F.size(F.array_intersect(f"{c}_x", f"{c}_y")).alias(f"{c}_both") for c in ("core", "shapes")]
    return pairs.join(x, "x").join(y, "y").select("x", "y", *both)


def proposals_of(groups: dict[int, Row], edges: dict[tuple[int, int], Row]) -> set[tuple[int, int]]:
    """A round's pairs of groups of equal cores by complete linkage and containment. Similarities under FINE matter to neither, so linkage is done by connected parts."""
    parent = {g: g for g in groups}
    close, best = {}, {}
    for (x, y), e in edges.items():
        a, b = groups[x], groups[y]
        h = e.core_both / (a.size + b.size - e.core_both)
        if h >= FINE - S.EPSILON:
            close[min(x, y), max(x, y)] = h
            parent[max(S.root_of(parent, x), S.root_of(parent, y))] = min(S.root_of(parent, x), S.root_of(parent, y))
        # of several equal cores each is the others' best unless a larger core holds them whole
        ratio = e.core_both / a.size
        if ratio >= (1 if a.units > 1 else S.CONTAINMENT):
            rank = (ratio, a.size + b.size - e.core_both, b.most, -b.most_first)
            if x not in best or rank > best[x][0]:
                best[x] = (rank, y)
    parts: dict[int, list[int]] = {}
    for g in sorted({i for pair in close for i in pair}):
        parts.setdefault(S.root_of(parent, g), []).append(g)
    of = {g: (p, i) for p, part in parts.items() for i, g in enumerate(part)}
    links: dict[int, list] = {}
    for (x, y), h in close.items():
        links.setdefault(of[x][0], []).append((of[x][1], of[y][1], h))
    out = set()
    for p, part in parts.items():
        s = np.zeros((len(part), len(part)))
        for i, j, h in links[p]:
            s[i, j] = s[j, i] = h
        out |= {(part[i], part[j]) for i, j, h in S.linkage(s) if h >= FINE - S.EPSILON}
    into = S.followed({x: y for x, (_, y) in best.items()}, {g: (r.size, r.most) for g, r in groups.items()})
    return out | {(i, j) for i, j in into.items() if i != j}


def merge_many(tallies: DataFrame) -> DataFrame:
    """(unit_key, root) as merge_counted() has them, of tallied(): token sets stay in Spark, which joins equal cores and finds the pairs
    that may merge by their rarest tokens; the driver sees numbers of distinct cores and of these pairs alone."""
    spark = tallies.sparkSession
    units = tallies.select("unit_key", F.col("first").alias("id"), "n", "counts")
    roots = written(units.select("unit_key", F.col("id").alias("root")), "unit-roots")
    for _ in range(ROUNDS):
        core = F.array_sort(F.transform(F.filter(F.coalesce("counts", F.array().cast("array<struct<t:string,c:bigint>>")), lambda x: x.c >= QUORUM * F.col("n") - S.EPSILON), lambda x: x.t))
        cores = written(units.select("id", "n", core.alias("core")).withColumn("sig", F.sha2(F.to_json("core"), 256)), "unit-cores")
        most = F.max(F.struct("n", (-F.col("id")).alias("first")))
        groups = cores.groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("units"), most.alias("m"), F.first("core").alias("core"))
        groups = written(with_shapes(groups.select("id", "units", F.col("m.n").alias("most"), (-F.col("m.first")).alias("most_first"), "sig", "core")), "core-groups")
        numbers = {r.id: r for r in groups.select("id", "units", "most", "most_first", F.size("core").alias("size")).orderBy("id").toLocalIterator()}
        pairs = compared_pairs(likely_pairs(groups.select("id", F.col("core").alias("items")), FINE), groups)
        edges = {(r.x, r.y): r for r in pairs.toLocalIterator()}
        wanted = proposals_of(numbers, edges)
        # the guard: shapes of the proposed pairs
        sizes = groups.select(F.col("id"), F.size("shapes").alias("n"))
        asked = spark.createDataFrame(sorted(wanted), "x long, y long")
        guarded = compared_pairs(asked, groups).join(sizes.toDF("x", "n_x"), "x").join(sizes.toDF("y", "n_y"), "y")
        union = F.col("n_x") + F.col("n_y") - F.col("shapes_both")
        kept = guarded.where((union == 0) | (F.col("shapes_both") >= GUARD * union)).select("x", "y")
        # shapes of groups with several pages: equal ones are a star, others meet by their rarest
        shaped = groups.where(F.col("most") >= SHAPE_PAGES).groupBy("shapes").agg(F.collect_list("id").alias("ids"), F.min("id").alias("id"))
        shaped = written(shaped, "shape-groups")
        stars = shaped.select(F.col("id").alias("x"), F.explode("ids").alias("y")).where("x != y")
        like = likely_pairs(shaped.select("id", F.col("shapes").alias("items")), SHAPE).join(shaped.select(F.col("id").alias("x"), F.col("shapes").alias("a")), "x").join(shaped.select(F.col("id").alias("y"), F.col("shapes").alias("b")), "y")
        like = like.where(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")) >= SHAPE).select("x", "y")
        parent = {g: g for g in numbers}
        for r in kept.unionByName(stars).unionByName(like).toLocalIterator():
            a, b = sorted((S.root_of(parent, r.x), S.root_of(parent, r.y)))
            parent[b] = a
        moves = [(g, S.root_of(parent, g)) for g in numbers]
        if all(a == b for a, b in moves) and all(r.units == 1 for r in numbers.values()):
            break
        to = spark.createDataFrame(moves, "group long, into long")
        step = written(cores.select(F.col("id").alias("was"), "sig").join(groups.select("sig", F.col("id").alias("group")), "sig").join(to, "group").select("was", "into"), "unit-moves")
        roots = written(roots.join(step, F.col("root") == F.col("was")).select("unit_key", F.col("into").alias("root")), "unit-roots")
        moved = units.join(step, F.col("id") == F.col("was"))
        counts = moved.select("into", F.explode("counts").alias("x")).groupBy("into", F.col("x.t").alias("t")).agg(F.sum("x.c").alias("c")).groupBy("into").agg(F.collect_list(F.struct("t", "c")).alias("counts"))
        units = written(moved.groupBy("into").agg(F.sum("n").alias("n")).join(counts, "into", "left").select(F.col("into").alias("id"), "n", "counts"), "unit-tallies")
    names = tallies.select(F.col("first").alias("root"), F.col("unit_key").alias("root_key"))
    return roots.join(names, "root").select("unit_key", F.col("root_key").alias("root"))


def cluster_pages(pages: DataFrame, keyed: DataFrame, max_units: int = 2_000) -> DataFrame:
    """(idx, block_key, cluster_key, tokens). The cross-block step runs on the driver over the units' token counts up to max_units units, and with the same result in Spark beyond."""
    inside = written(cluster_blocks(pages, keyed), "page-units")
    tallies = written(tallied(inside), "unit-tallies")
    if tallies.count() > max_units:
        return inside.join(merge_many(tallies), "unit_key").select("idx", "block_key", F.col("root").alias("cluster_key"), "tokens")
    units = {r.unit_key: (Counter({x.t: x.c for x in r.counts or []}), r.n) for r in tallies.orderBy("first").toLocalIterator()}
    mapping = {k: v for k, v in merge_counted(units).items() if k != v}
    key = F.col("unit_key")
    if mapping:
        key = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("unit_key")], key)
    return inside.select("idx", "block_key", key.alias("cluster_key"), "tokens")
