"""Row operators beside the page clusters: cleaning of findings, path trees, chunks, frequencies, auto-cuts, task calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cleaned_findings(rows: DataFrame, keys: list[str], environment: str, order: str) -> DataFrame:
    """One row for each key with its environments in order of arrival, each once, line by line; one that is part of the text so far is left out, as a test by substring has it."""
    arrived = F.array_sort(F.collect_list(F.struct(order, environment)))
    folded = F.aggregate(arrived, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x[environment]).when(F.contains(acc, x[environment]), acc).otherwise(F.concat(acc, F.lit("\n"), x[environment])))
    return rows.groupBy(*keys).agg(F.min(order).alias("first"), folded.alias("environments"))


def version_key(number: Column) -> Column:
    """Dotted numbers as arrays of integers; nulls sort last with asc_nulls_last."""
    return F.transform(F.split(number, "[.]"), lambda p: p.cast("int"))


def path_tree(paths: DataFrame, column: str = "stem") -> DataFrame:
    """(stem, parent_stem, depth, virtual): every path and its ancestors; virtual ones have no row of their own."""
    stems = paths.select(F.regexp_replace(F.when(F.col(column).startswith("/"), F.col(column)).otherwise(F.concat(F.lit("/"), column)), "(.)/$", "$1").alias("stem")).distinct()
    parts = F.filter(F.split("stem", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts), F.lit(0))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    nodes = stems.select(F.explode(above).alias("stem"), F.col("stem").alias("own"))
    out = nodes.groupBy("stem").agg((~F.bool_or(F.col("stem") == F.col("own"))).alias("virtual"))
    mine = F.filter(F.split("stem", "/"), lambda p: p != "")
    parent = F.when(F.size(mine) > 0, F.concat(F.lit("/"), F.array_join(F.slice(mine, 1, F.size(mine) - 1), "/")))
    return out.select("stem", parent.alias("parent_stem"), F.size(mine).alias("depth"), "virtual")


def pruned_tree(tree: DataFrame, drop: Column) -> DataFrame:
    """Without the nodes for which drop holds and all below them."""
    gone = tree.where(drop).select(F.col("stem").alias("gone"))
    ancestors = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split("stem", "/"), lambda p: p != ""), 1, n), "/")))
    hit = tree.select("stem", F.explode(ancestors).alias("gone")).join(gone, "gone", "left_semi").select("stem").distinct()
    return tree.join(hit, "stem", "left_anti")


def chunks(rows: DataFrame, size: int, by: list[str], order: str) -> DataFrame:
    """rows with chunk: numbers from 0 of runs of `size` in order within each group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("long"))


def document_frequency(rows: DataFrame, tokens: Column, token: str = "token") -> DataFrame:
    return rows.select(F.explode(F.array_distinct(tokens)).alias(token)).groupBy(token).agg(F.count("*").alias("df"))


def split_by_frequency(rows: DataFrame, key: str, tokens: Column, threshold: float = 0.9) -> DataFrame:
    """(key, template, content): how many of a row's distinct tokens are in at least `threshold` of all rows, and how many aren't.

    Only template tokens are looked up, and there are at most (tokens a row / threshold) of those, so their list is small; with none, nothing is joined to much."""
    total = rows.agg(F.count("*").alias("total"))
    exploded = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    common = exploded.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).where(F.col("df") >= threshold * F.col("total") - 1e-9).select("token", F.lit(1).alias("common"))
    return exploded.join(common, "token", "left").groupBy(key).agg(F.count("common").alias("template"), (F.count("*") - F.count("common")).alias("content"))


def auto_cut(values: DataFrame, value: str, upper: float) -> DataFrame:
    """One row: the middle of the widest gap between neighbouring values, at most `upper`; `upper` if there is no gap.

    Equal values leave no gap, so neighbours are found among distinct ones. One task orders these: shares of a total of n have counts that
    add up to n, so there are at most sqrt(2 n) distinct ones."""
    levels = values.select(F.col(value).cast("double").alias("v")).distinct()
    gaps = levels.withColumn("next", F.lead("v").over(Window.orderBy(F.desc("v")))).where("next is not null")
    best = gaps.agg(F.max(F.struct((F.col("v") - F.col("next")).alias("gap"), "v", "next")).alias("b"))
    return best.select(F.coalesce(F.least((F.col("b.v") + F.col("b.next")) / 2, F.lit(upper)), F.lit(upper)).alias("cut"))


def token_signature(tokens: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), "\u0001"), 256)


def equal_sets(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(signature, members, first): groups of rows with the same token set, of two or more."""
    return rows.select(F.col(key), token_signature(tokens).alias("signature")).groupBy("signature").agg(F.count("*").alias("members"), F.min(key).alias("first")).where("members > 1")
