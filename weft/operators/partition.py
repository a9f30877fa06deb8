"""Checks of a page partition: mirror axis, cohesion, duplicates across clusters, the merges they justify, and reasons.

Input: clustered pages (idx, cluster_key, tokens, paths, stylesheetHrefs)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import sets as S
from weft.sources.tables import written

COHESION_SAMPLE, SUSPICIOUS, CORROBORATED, MIN_SKELETONS, MAX_POSITION = 40, 0.75, 0.8, 3, 3
#: Clusters of a class that are paired at once, at least; chunks into which a class goes, at most; pairs for which there is a task of their own.
PAIR_CHUNK, PAIR_CHUNKS, PAIRS_A_TASK = 1024, 64, 2_000_000


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; two empty ones are alike."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def mirror_axis(pages: DataFrame, max_position: int = MAX_POSITION, min_skeletons: int = MIN_SKELETONS) -> tuple[int, list[str]] | None:
    """(position, values): the set of two or more values of one path segment that recurs in most path skeletons."""
    paths = pages.select(F.filter("paths", lambda p: p != "").alias("p")).distinct()
    found = None
    for at in range(max_position):
        rows = paths.where(F.size("p") > at).select(F.col("p")[at].alias("v"), F.transform("p", lambda x, i: F.when(i == at, F.lit("*")).otherwise(x)).alias("skeleton"))
        values = rows.groupBy("skeleton").agg(F.array_sort(F.collect_set("v")).alias("values")).where(F.size("values") > 1)
        best = values.groupBy("values").count().where(F.col("count") >= min_skeletons).orderBy(F.desc("count"), "values").limit(1).collect()
        if best and (found is None or best[0]["count"] > found[0]):
            found = (best[0]["count"], at, list(best[0]["values"]))
    return found and found[1:]


def normalized_path(paths: Column, axis: tuple[int, list[str]]) -> Column:
    at, values = axis
    return F.array_join(F.transform(paths, lambda s, i: F.when((i == at) & s.isin(values), F.lit("{axis}")).otherwise(s)), "/")


def normalized_href(href: Column, axis: tuple[int, list[str]]) -> Column:
    for v in axis[1]:
        href = F.replace(href, F.lit(f"/{v}/"), F.lit("/{axis}/"))
    return href


def cohesion(pages: DataFrame) -> DataFrame:
    """(cluster_key, members, median, p10, min, suspicious) from the pairs of a sample of COHESION_SAMPLE members; nulls for single pages."""
    counts = pages.groupBy("cluster_key").agg(F.count("*").alias("members"))
    salted = pages.select("cluster_key", "idx", "tokens", F.xxhash64("idx").alias("h"))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("cluster_key", F.pmod("idx", F.lit(256))).orderBy("h", "idx"))).where(F.col("r") <= COHESION_SAMPLE)
    sample = first.withColumn("r", F.row_number().over(Window.partitionBy("cluster_key").orderBy("h", "idx"))).where(F.col("r") <= COHESION_SAMPLE).select("cluster_key", "idx", "tokens")
    a, b = sample.alias("a"), sample.alias("b")
    pairs = a.join(b, (F.col("a.cluster_key") == F.col("b.cluster_key")) & (F.col("a.idx") < F.col("b.idx")))  # bounded by the sample
    pairs = pairs.select(F.col("a.cluster_key").alias("cluster_key"), set_similarity(F.col("a.tokens"), F.col("b.tokens")).alias("s"))
    stats = pairs.groupBy("cluster_key").agg(F.expr("percentile(s, 0.5)").alias("median"), F.expr("percentile_disc(0.1) within group (order by s)").alias("p10"), F.min("s").alias("min"))
    return counts.join(stats, "cluster_key", "left").withColumn("suspicious", F.coalesce(F.col("median") < SUSPICIOUS, F.lit(False)))


def cross_duplicates(pages: DataFrame, axis: tuple[int, list[str]] | None = None, threshold: float = CORROBORATED) -> DataFrame:
    """(cluster_key_a, cluster_key_b, similarity, corroborated): clusters that share a token set, or mirror pages under the axis.

    Equal sets are paired by same_pairs(); of mirror pages, which meet on their normalised path and hrefs, a cluster has one row for
    each token set."""
    same = same_pairs(_signed(pages)).select("cluster_key_a", "cluster_key_b", F.lit(1.0).alias("similarity"), F.lit(False).alias("corroborated"))
    if not axis:
        return same
    out = same.unionByName(_mirror_pairs(pages, axis, threshold))
    return out.groupBy("cluster_key_a", "cluster_key_b").agg(F.max(F.struct("similarity", "corroborated")).alias("m")).select("cluster_key_a", "cluster_key_b", "m.similarity", "m.corroborated")


def _signature() -> Column:
    return F.sha2(F.to_json(F.array_sort(F.array_distinct("tokens"))), 256)


def _signed(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("tokens") > 0).select("cluster_key", _signature().alias("mark"))


def _mirror_pairs(pages: DataFrame, axis: tuple[int, list[str]], threshold: float) -> DataFrame:
    hrefs = F.sha2(F.to_json(F.array_sort(F.array_distinct(F.transform("stylesheetHrefs", lambda h: normalized_href(h, axis))))), 256)
    m = pages.select("cluster_key", "tokens", normalized_path(F.col("paths"), axis).alias("path"), hrefs.alias("hrefs"), _signature().alias("sig"))
    m = m.groupBy("cluster_key", "path", "hrefs", "sig").agg(F.first("tokens").alias("tokens"))
    pair = m.alias("a").join(m.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.hrefs") == F.col("b.hrefs")) & (F.col("a.cluster_key") < F.col("b.cluster_key")))
    close = pair.select(F.col("a.cluster_key").alias("cluster_key_a"), F.col("b.cluster_key").alias("cluster_key_b"), set_similarity(F.col("a.tokens"), F.col("b.tokens")).alias("similarity"), F.lit(True).alias("corroborated"))
    return close.where(F.col("similarity") >= threshold)


def linked_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: (cluster_key, mark). Gives members (cluster_key, class) and links (class, other): clusters are of one class if they have the
    same marks, and classes are linked, both ways and each with itself, if they share a mark.

    Marks of one cluster alone link nothing and are left out, as are clusters without others. A class is known by the number and 120 bits of the
    sums modulo 2 of its marks' SHA-256, so that no cluster's marks are collected, and is named by its smallest cluster."""
    rows = rows.where(F.col("cluster_key").isNotNull() & F.col("mark").isNotNull()).select("cluster_key", "mark").distinct()
    shared = rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    rows = written(rows.join(shared, "mark", "left_semi"), "shared-marks")
    word = lambda at: F.bit_xor(F.conv(F.substring(F.sha2("mark", 256), at, 15), 16, 10).cast("long"))
    prints = rows.groupBy("cluster_key").agg(F.count("*").alias("n"), word(1).alias("x"), word(16).alias("y"))
    names = prints.groupBy("n", "x", "y").agg(F.min("cluster_key").alias("class"))
    members = written(prints.join(names, ["n", "x", "y"]).select("cluster_key", "class"), "class-members")
    marks = rows.join(members.where("cluster_key = class"), "cluster_key").select("class", "mark")
    links = marks.join(marks.withColumnRenamed("class", "other"), "mark").select("class", "other").distinct()
    return members, links


def same_pairs(rows: DataFrame) -> DataFrame:
    """(cluster_key_a, cluster_key_b): the pairs, once each, of clusters that share a mark; rows: (cluster_key, mark).

    Pairs are as many as there are; they come from pairs of linked classes, so none comes twice and none is shuffled. Classes are cut
    into chunks, and a pair of chunks is what a task takes: its two lists of clusters are shuffled, at most PAIR_CHUNKS times for a cluster
    and once more for each class linked to its own."""
    spark = rows.sparkSession
    members, links = linked_classes(rows)
    chunk = max(PAIR_CHUNK, -(-members.count() // PAIR_CHUNKS))
    sizes = members.groupBy("class").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
    parts = members.join(sizes, "class").select("class", F.pmod(F.xxhash64("cluster_key"), F.col("k")).cast("int").alias("i"), "cluster_key")
    others = sizes.select(F.col("class").alias("other"), F.col("n").alias("m"), F.col("k").alias("l"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    units = links.where("class <= other").join(sizes, "class").join(others, "other").withColumn("i", upto("k")).withColumn("j", upto("l"))
    units = units.where("class < other or i <= j").withColumns({"unit": F.monotonically_increasing_id(), "pairs": F.col("n") * F.col("m") / (F.col("k") * F.col("l"))})
    units = written(units.select("unit", "class", "i", "other", "j", "pairs"), "pair-units")
    total = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()
    tasks = max(1, min(total["units"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total["pairs"] // PAIRS_A_TASK))))
    within = ((F.col("class") == F.col("other")) & (F.col("i") == F.col("j"))).alias("within")
    a = units.join(parts, ["class", "i"]).select("unit", within, F.col("cluster_key").alias("a")).repartition(tasks, "unit")
    b = units.select("unit", F.col("other").alias("class"), F.col("j").alias("i")).join(parts, ["class", "i"]).select("unit", F.col("cluster_key").alias("b")).repartition(tasks, "unit")
    return a.join(b, "unit").where("not within or a < b").select(F.least("a", "b").alias("cluster_key_a"), F.greatest("a", "b").alias("cluster_key_b"))


def validated_merges(duplicates: DataFrame) -> dict[str, str]:
    """merged_keys() as a dictionary, for few clusters."""
    return {r.cluster_key: r.root for r in merged_keys(duplicates).toLocalIterator()}


def merged_keys(duplicates: DataFrame) -> DataFrame:
    """(cluster_key, root): clusters that merge with others, by pairs that are equal or corroborated, and the smallest key of their group.

    Labels spread along the pairs, both ways, until they stay: a round is a join and a minimum over pairs of clusters."""
    pairs = duplicates.where("similarity = 1 or corroborated").select(F.col("cluster_key_a").alias("a"), F.col("cluster_key_b").alias("b"))
    pairs = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "merging-pairs")
    roots = written(pairs.groupBy(F.col("a").alias("cluster_key")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "merged-keys")
    while True:
        # a neighbour's root, and the root's own root: paths halve
        near = pairs.join(roots.withColumnRenamed("cluster_key", "b"), "b").groupBy(F.col("a").alias("cluster_key")).agg(F.min("root").alias("near"))
        up = roots.select(F.col("cluster_key").alias("root"), F.col("root").alias("up"))
        stepped = roots.join(near, "cluster_key").join(up, "root", "left").select("cluster_key", F.least("root", "near", "up").alias("to"), "root")
        stepped = written(stepped, "merged-keys")
        moved = bool(stepped.where("to != root").take(1))
        roots = stepped.select("cluster_key", F.col("to").alias("root"))
        if not moved:
            return roots


def cluster_cores(pages: DataFrame) -> DataFrame:
    """(cluster_key, pages, core_tokens): tokens in at least 80 % of the members."""
    sizes = pages.groupBy("cluster_key").agg(F.count("*").alias("pages"))
    counts = pages.select("cluster_key", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("cluster_key", "t").count()
    core = counts.join(sizes, "cluster_key").where(F.col("count") >= 0.8 * F.col("pages") - S.EPSILON).groupBy("cluster_key").agg(F.array_sort(F.collect_list("t")).alias("core_tokens"))
    return sizes.join(core, "cluster_key", "left").withColumn("core_tokens", F.coalesce("core_tokens", F.array().cast("array<string>")))


def _block_classes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """linked_classes() by blocks: the clusters of a class, and of those linked to it, are siblings."""
    return linked_classes(pages.select("cluster_key", F.col("block_key").alias("mark")))


def cluster_reason_counts(pages: DataFrame) -> DataFrame:
    """(cluster_key, pages, core_tokens, n_siblings): cluster_reasons() with the number of siblings. Classes of clusters with the same blocks
    are counted, so that no cluster's siblings, which may be most of the clusters, are listed."""
    members, links = _block_classes(pages)
    sizes = members.groupBy(F.col("class").alias("other")).agg(F.count("*").alias("n"))
    near = links.join(sizes, "other").groupBy("class").agg((F.sum("n") - 1).alias("n_siblings"))
    counts = members.join(near, "class").select("cluster_key", "n_siblings")
    return cluster_cores(pages).join(counts, "cluster_key", "left").withColumn("n_siblings", F.coalesce("n_siblings", F.lit(0).cast("long")))


def _sibling_lists(members: DataFrame, links: DataFrame) -> DataFrame:
    """(class, all): the clusters of a class and of the classes linked to it, sorted, once a class."""
    return links.join(members.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.array_sort(F.collect_list("cluster_key")).alias("all"))


def cluster_reasons(pages: DataFrame) -> DataFrame:
    """(cluster_key, pages, core_tokens, siblings): tokens in at least 80 % of the members, and the other clusters of its blocks.

    Siblings are in all as many as the pairs of clusters of a block; they are joined last, from one list a class, and aren't shuffled.
    cluster_reason_counts() has their number."""
    members, links = _block_classes(pages)
    found = cluster_cores(pages).join(members, "cluster_key", "left").join(_sibling_lists(members, links), "class", "left")
    siblings = F.coalesce(F.array_remove("all", F.col("cluster_key")), F.array().cast("array<string>"))
    return found.select("cluster_key", "pages", "core_tokens", siblings.alias("siblings"))


def landmark_variants(pages: DataFrame, kind: str) -> DataFrame:
    """(idx, variant): clusters of the most common instance signature of one landmark type; pages without one are a group of their own."""
    seen = pages.select("idx", F.explode("instances").alias("x")).where(F.col("x.type") == kind).select("idx", "x.signature", "x.tokens", "x.startOffset")
    counts = seen.groupBy("signature").agg(F.count("*").alias("n"))
    pick = seen.join(counts, "signature").groupBy("idx").agg(F.max(F.struct("n", (-F.col("startOffset")).alias("first"), "signature", "tokens")).alias("m")).select("idx", "m.signature", "m.tokens")
    kinds = pick.groupBy("signature").agg(F.first("tokens").alias("tokens"), F.min("idx").alias("first"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        return pd.DataFrame({"signature": group["signature"], "variant": S.structural_clusters([set(t) for t in group["tokens"]])})

    named = kinds.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "signature string, variant string")  # distinct variants, not pages
    return pages.select("idx").join(pick.select("idx", "signature"), "idx", "left").join(named, "signature", "left").select("idx", F.coalesce("variant", F.lit("none")).alias("variant"))


def landmark_profiles(pages: DataFrame) -> DataFrame:
    """(cluster_key, type, presence_rate, chrome_rate, shell_tokens, members_with): of clustered pages with their landmark instances.

    A type's shell is the tokens whose share of member pages reaches the auto-cut; an instance is chrome if 80 % of its tokens lie in it."""
    members = pages.groupBy("cluster_key").agg(F.count("*").alias("members"))
    seen = pages.select("cluster_key", "idx", F.posexplode("instances").alias("n", "x")).select("cluster_key", "idx", "n", "x.type", "x.tokens")
    tokens = seen.select("cluster_key", "type", "idx", F.explode("tokens").alias("t")).distinct().groupBy("cluster_key", "type", "t").agg(F.count("*").alias("c")).join(members, "cluster_key").withColumn("f", F.col("c") / F.col("members"))
    of = ["cluster_key", "type"]
    levels = tokens.select(*of, "f").distinct().withColumn("below", F.lead("f").over(Window.partitionBy(*of).orderBy(F.desc("f"))))
    gap = F.struct((F.col("f") - F.col("below")).alias("gap"), "f", "below")
    cut = levels.groupBy(*of).agg(F.max(F.when(F.col("below").isNotNull(), gap)).alias("g")).select(*of, F.coalesce(F.least((F.col("g.f") + F.col("g.below")) / 2, F.lit(S.CHROME)), F.lit(S.CHROME)).alias("cut"))
    shell = tokens.join(cut, of).where(F.col("f") >= F.col("cut")).select(*of, "t")
    within = seen.select(*of, "idx", "n", F.explode("tokens").alias("t")).join(shell.withColumn("hit", F.lit(1)), [*of, "t"], "left").groupBy(*of, "idx", "n").agg((F.count("hit") / F.count("*")).alias("share"))
    rates = within.groupBy(*of).agg(F.avg((F.col("share") >= S.CHROME).cast("double")).alias("chrome_rate"), F.countDistinct("idx").alias("members_with"))
    named = shell.groupBy(*of).agg(F.array_sort(F.collect_list("t")).alias("shell_tokens"))
    out = rates.join(members, "cluster_key").join(named, of, "left")
    return out.select(*of, (F.col("members_with") / F.col("members")).alias("presence_rate"), "chrome_rate", F.coalesce("shell_tokens", F.array().cast("array<string>")).alias("shell_tokens"), "members_with")


def merged_partition(pages: DataFrame, axis: tuple[int, list[str]] | None = None, threshold: float = CORROBORATED) -> DataFrame:
    """pages with cluster keys merged where clusters share token sets or mirror each other under the axis.

    Clusters of one token set are linked to the smallest of them, which groups them as all their pairs would."""
    signed = _signed(pages).where(F.col("cluster_key").isNotNull()).distinct()
    links = signed.join(signed.groupBy("mark").agg(F.min("cluster_key").alias("first")), "mark").where("first < cluster_key")
    links = links.select(F.col("first").alias("cluster_key_a"), F.col("cluster_key").alias("cluster_key_b"), F.lit(1.0).alias("similarity"), F.lit(False).alias("corroborated")).distinct()
    roots = merged_keys(links.unionByName(_mirror_pairs(pages, axis, threshold)) if axis else links)
    return pages.join(roots, "cluster_key", "left").withColumn("cluster_key", F.coalesce("root", "cluster_key")).select(*pages.columns)


def report(pages: DataFrame, axis: tuple[int, list[str]] | None) -> dict:
    """The checks of a partition as one record: clusters and pairs of clusters, no pages."""
    cohesion_rows = cohesion(pages).orderBy("cluster_key").toLocalIterator()
    duplicates = cross_duplicates(pages, axis).orderBy("cluster_key_a", "cluster_key_b").toLocalIterator()
    return {
        "mirrorAxis": axis and {"position": axis[0], "values": axis[1]},
        "cohesion": [{"clusterKey": r.cluster_key, "memberCount": r.members, "sampledMemberCount": min(r.members, COHESION_SAMPLE), "medianPairSimilarity": r.median, "p10PairSimilarity": r.p10, "minPairSimilarity": r.min, "suspicious": r.suspicious} for r in cohesion_rows],
        "crossClusterDuplicates": [{"clusterKeyA": r.cluster_key_a, "clusterKeyB": r.cluster_key_b, "similarity": r.similarity, "corroboratedByMirrorAxis": r.corroborated} for r in duplicates],
    }


def reasons_report(pages: DataFrame) -> dict:
    """Why each cluster is one: its blocks' reasons, core tokens, landmarks and siblings. pages: clustered, with reason and instances."""
    blocks = pages.groupBy("cluster_key").agg(F.array_sort(F.collect_set(F.struct("block_key", "reason"))).alias("blocks"))
    marks = landmark_profiles(pages).groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("type", "presence_rate", "chrome_rate", "shell_tokens", "members_with"))).alias("marks"))
    out = {}
    members, links = _block_classes(pages)
    mates = {r["class"]: r["all"] for r in _sibling_lists(members, links).toLocalIterator()}
    for r in cluster_cores(pages).join(members, "cluster_key", "left").join(blocks, "cluster_key").join(marks, "cluster_key", "left").orderBy("cluster_key").toLocalIterator():
        landmarks = {m.type: {"presenceRate": m.presence_rate, "chromeRate": m.chrome_rate, "shellTokens": m.shell_tokens, "memberCountWithInstance": m.members_with} for m in r.marks or []}
        blocking = [{"blockKey": b.block_key, "reason": {k: v for k, v in b.reason.asDict().items() if v is not None}} for b in r.blocks]
        out[r.cluster_key] = {"memberCount": r.pages, "blocking": blocking, "structuralCoreTokens": r.core_tokens, "landmarks": landmarks, "siblingClusterKeys": [k for k in mates.get(r["class"], ()) if k != r.cluster_key]}
    return out
