"""Readers for JSON-lines pages, commented lists, key-value lists, grids, typed sheets, archives; writers for results."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.values import cell_value, column_name

PAGE = T.StructType([T.StructField("id", T.StringType()), T.StructField("html", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("stylesheetHrefs", T.ArrayType(T.StringType())), T.StructField("host", T.StringType())])


def read_pages(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Pages of JSON lines with idx in file order; absent arrays become empty, empty lines are skipped. strict: a line without a text `html` fails the read, naming the line."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("idx", F.monotonically_increasing_id())
    rows = lines.withColumn("page", F.from_json("value", PAGE))
    html = F.col("page.html")
    if strict:
        html = F.coalesce(html, F.raise_error(F.concat(F.lit("no text html in line "), F.col("idx") + 1)).cast("string"))
    empty = F.array().cast("array<string>")
    return rows.select("idx", F.coalesce("page.id", F.col("idx").cast("string")).alias("id"), html.alias("html"), F.coalesce("page.paths", empty).alias("paths"), F.coalesce("page.stylesheetHrefs", empty).alias("stylesheetHrefs"), "page.host").where("html is not null")


def write_keys(clusters: DataFrame, path: str) -> None:
    """{id, clusterKey} as JSON lines in input order."""
    clusters.orderBy("idx").select("id", F.col("cluster_key").alias("clusterKey")).write.mode("overwrite").json(path)


def list_lines(text: Column) -> Column:
    """array<struct(line, column, value)>: the lines of a text that aren't blank nor begin with #, trimmed, with 1-based places."""
    lines = F.transform(F.split(text, "\n"), lambda t, i: F.struct((i + 1).alias("line"), (F.length(t) - F.length(F.ltrim(t)) + 1).alias("column"), F.trim(t).alias("value")))
    return F.filter(lines, lambda x: (x["value"] != "") & ~x["value"].startswith("#"))


def list_values(text: Column) -> Column:
    return F.transform(list_lines(text), lambda x: x["value"])


def key_values(text: Column, separator: str = r"\s+") -> Column:
    """array<struct(key, value)> of a list's lines, split at the first separator; without one the value is empty."""
    return F.transform(list_values(text), lambda v: F.struct(F.split(v, separator, 2)[0].alias("key"), F.coalesce(F.get(F.split(v, separator, 2), F.lit(1)), F.lit("")).alias("value")))


def grid(text: Column, separator: str = "\t") -> Column:
    return F.transform(list_values(text), lambda v: F.transform(F.split(v, separator), lambda c: F.trim(c)))


def comma_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda c: F.trim(c))


def url_list(text: Column) -> Column:
    """A JSON array of texts, else a commented list."""
    return F.coalesce(F.from_json(text, "array<string>"), list_values(text))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, column, value) of a list file."""
    return spark.read.text(path, wholetext=True).select(F.explode(list_lines(F.col("value"))).alias("x")).select("x.*")


def front_matter(path: str) -> dict:
    """{content, attributes, base_dir} of a file that may begin with a block of `key: value` lines between --- marks."""
    text = Path(path).read_text(encoding="utf-8")
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    pairs = (line.partition(":") for line in (m[1].split("\n") if m else []) if ":" in line and not line.lstrip().startswith("#"))
    return {"attributes": {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}, "content": text[m.end() :] if m else text, "base_dir": str(Path(path).resolve().parent)}


def inferred_kind(value: str | None) -> str:
    """A column's kind from its first cell."""
    v = (value or "").strip()
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", v):
        return "number"
    return "boolean" if v.lower() in ("true", "false", "yes", "no") else "text"


def sheet_table(rows: DataFrame, headers: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """A table from cells (row, column from 1, text): headers maps names to labels of the first row; kinds not given come from the first body row alone; labels not found are left out."""
    first = {(r.row, r.column): r.text for r in rows.where("row in (1, 2)").collect()}  # two rows of a sheet
    place = {text: c for (row, c), text in first.items() if row == 1}
    found = sorted(((place[label], name) for name, label in headers.items() if label in place))
    body = rows.where("row > 1").groupBy("row").agg(*[F.max(F.when(F.col("column") == c, F.col("text"))).alias(name) for c, name in found])
    kind = lambda c, name: (kinds or {}).get(name) or inferred_kind(first.get((2, c)))
    return body.orderBy("row").select(*[cell_value(F.col(name), kind(c, name)).alias(name) for c, name in found])


def sheet_cells(table: DataFrame, order: list[str], if_null: str = "") -> Column:
    """A row's cells in order: nulls replaced, dates as serial days, = kept for formulas, at most 49,999 characters."""
    types = dict(table.dtypes)

    def cell(c: str) -> Column:
        x = F.col(c)
        if types[c].startswith(("timestamp", "date")):
            x = F.unix_millis(x.cast("timestamp")) / 86400000 + 25569
        return F.substring(F.coalesce(x.cast("string"), F.lit(if_null)), 1, 49_999)

    return F.array(*map(cell, order))


def in_batches(rows: Iterator, size: int, send) -> int:
    """Sends rows in batches; a batch that is too large (ValueError) is halved until it fits."""
    sent, held = 0, []

    def deliver(batch: list) -> None:
        try:
            send(batch)
        except ValueError:
            if len(batch) < 2:
                raise
            deliver(batch[: len(batch) // 2])
            deliver(batch[len(batch) // 2 :])

    for row in rows:
        held.append(row)
        if len(held) == size:
            deliver(held)
            sent, held = sent + size, []
    if held:
        deliver(held)
    return sent + len(held)


def column_range(n: int) -> str:
    return f"A:{column_name(n)}"


def property_text(prop: Column) -> Column:
    """The text of a page property's JSON: titles and rich texts joined, numbers, selected names; null for other kinds."""
    kind = F.get_json_object(prop, "$.type")
    parts = lambda k: F.array_join(F.transform(F.from_json(F.get_json_object(prop, f"$.{k}"), "array<struct<plain_text:string>>"), lambda p: p["plain_text"]), "")
    return F.when(kind == "title", parts("title")).when(kind == "rich_text", parts("rich_text")).when(kind == "number", F.get_json_object(prop, "$.number")).when(kind == "select", F.get_json_object(prop, "$.select.name"))


def unzipped(archives: DataFrame) -> DataFrame:
    """(path, name, content) of the files in archives (path, content as of the binaryFile source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], ["path", "name", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def zipped(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def compared_files(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(name, status): new, missing, same or modified, from (name, content). Sizes differ first, then digests."""
    mark = lambda df, c: df.select("name", F.length("content").alias(f"{c}_size"), F.sha2("content", 256).alias(f"{c}_sha"))
    both = mark(local, "l").join(mark(remote, "r"), "name", "full_outer")
    status = F.when(F.col("r_size").isNull(), "new").when(F.col("l_size").isNull(), "missing").when((F.col("l_size") == F.col("r_size")) & (F.col("l_sha") == F.col("r_sha")), "same").otherwise("modified")
    return both.select("name", status.alias("status"))


def one_copy(resources: DataFrame, by: str = "localPath") -> DataFrame:
    return resources.dropDuplicates([by])


def report_json(rows: DataFrame, path: str, key: str) -> None:
    """A small report as one JSON object by key, sets as sorted arrays."""
    names = [c for c in rows.columns if c != key]
    body = {r[key]: {c: sorted(r[c]) if isinstance(r[c], (set, frozenset)) else r[c] for c in names} for r in rows.toLocalIterator()}
    Path(path).write_text(json.dumps(body, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
