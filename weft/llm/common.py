"""What the operators share: tables in the shared folder, bounded labelled samples, joins on hot keys, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import forget, shared_folder, written  # noqa: F401

#: At most so many labelled rows are used to fit a classifier.
SAMPLE_ROWS = 20_000
#: A key is hot if it holds over one in so many rows; there are fewer hot keys than this.
HOT_SHARE = 1_000
#: Sub-keys into which a hot key's rows go.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_remainder(id_col: str, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id's decimal text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def few(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows (exactly so many, unless there are fewer or keys repeat much), in the order of a hash of `key`.

    A bound on the hash is set by the row count first, so that no task hands the driver `most` rows of its own."""
    n = rows.count()
    h = F.xxhash64(key)
    if n > 2 * most:
        rows = rows.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.3 * most / n)) + 1)
    return rows.orderBy(h, key).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: F.Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y): at most `rows` labelled documents for which `usable` (over doc_id) holds, in an order by a hash of doc_id.

    The chosen ids are bounded by `rows`, so they are broadcast and texts without them aren't shuffled; of documents with one id the one
    with the least hash counts, so the result is bounded too. Null labels and null ids are left out."""
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    ids = [(r.doc_id, r.y) for r in few(chosen, "doc_id", rows).collect()]
    chosen = spark.createDataFrame(ids, "doc_id long, y int")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("x")).select("x.text", "x.y")


def join_hot(rows: DataFrame, unique: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined to `unique`, which has one row a key. Keys that hold over a HOT_SHARE-th of the rows (so fewer than HOT_SHARE keys) are salted; their list is broadcast."""
    total = rows.count()
    hot = [r[0] for r in rows.groupBy(key).count().where((F.col("count") * HOT_SHARE > total) & (F.col("count") > SALTS) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(unique, key, how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, (F.rand(7) * SALTS).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_salt", salt)
    right = unique.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of an edge, the smallest node that can be reached.

    Alternating large-star and small-star rounds; every round is two equi-joins and min aggregations with map-side combine,
    and is written to the shared folder. Rounds grow as the logarithm of the component sizes."""
    spark = edges.sparkSession
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        nxt = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = written(nxt, "edges")
        forget(e)
        e = nxt
        mark = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


#: What Python workers keep from task to task, by operator: how to let go of it.
_HELD: dict[str, Callable[[], None]] = {}


def entering(operator: str, release: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins in a Python worker: a worker holds one operator's caches at a time, and memory that the last one freed goes back to the system."""
    others = [k for k in _HELD if k != operator]
    for k in others:
        _HELD.pop(k)()
    if release:
        _HELD[operator] = release
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def local_env() -> None:
    """For Python workers: one thread a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
