"""Template clusters of JSON-lines pages from the command line: python -m weft.cli [options] < pages.jsonl > clusters.jsonl."""

from __future__ import annotations

import json
import shutil
import sys
import tempfile
import time
from collections.abc import Sequence
from pathlib import Path
from typing import TextIO

VERSION = "0.2.0"
VALUED = {"--content-block-attribute": "block_attribute", "--cluster-reasons-file": "reasons_file", "--validation-file": "validation_file"}
HELP = """weft.cli [--content-block-attribute NAME] [--cluster-reasons-file FILE] [--validation-file FILE] < pages.jsonl > clusters.jsonl

A line in: {"id", "html", "paths", "stylesheetHrefs", "host"}, all but html optional. A line out, in the same order: {"id", "clusterKey"}.
The reasons are one JSON object by cluster, the validation one object (mirrorAxis, cohesion, crossClusterDuplicates); with a validation
file clusters that the checks find equal are merged. Progress goes to the error stream.
"""


def parse_args(argv: Sequence[str]) -> dict:
    """{help, version, block_attribute, reasons_file, validation_file, error}: the first unknown flag, or one without its value, is the error."""
    out: dict = {}
    todo = list(argv)
    while todo:
        flag = todo.pop(0)
        if flag in ("-h", "--help"):
            out["help"] = True
        elif flag in ("-v", "--version"):
            out["version"] = True
        elif flag in VALUED:
            if not todo:
                return {**out, "error": f"{flag} requires a value"}
            out[VALUED[flag]] = todo.pop(0)
        else:
            return {**out, "error": f"unknown option {flag}"}
    return out


def run(argv: Sequence[str], source: TextIO, sink: TextIO, log: TextIO, spark=None) -> int:
    """The exit code: 0, 1 where the pages fail, 2 where the options do."""
    args = parse_args(argv)
    if "error" in args:
        log.write(f"weft: {args['error']}\n{HELP}")
        return 2
    if args.get("help") or args.get("version"):
        sink.write(HELP if args.get("help") else VERSION + "\n")
        return 0
    began, folder = time.monotonic(), tempfile.mkdtemp(prefix="weft-cli-")
    try:
        pages = Path(folder) / "pages.jsonl"
        with pages.open("w", encoding="utf-8") as f:
            shutil.copyfileobj(source, f)
        log.write("[weft] reading input pages...\n")
        count, clusters = clustered(spark or session(), str(pages), args, sink, log)
        log.write(f"[weft] done: {count} pages in {clusters} clusters (elapsed {time.monotonic() - began:.0f}s)\n")
        return 0
    except Exception as e:  # the command line's boundary: one line for whatever the pages caused
        log.write(f"[weft] error: {str(e).splitlines()[0] if str(e) else type(e).__name__}\n")
        return 1
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("weft").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def clustered(spark, path: str, args: dict, sink: TextIO, log: TextIO) -> tuple[int, int]:
    from pyspark.sql import functions as F

    from weft.operators import blocking as B
    from weft.operators import clusters as C
    from weft.operators import partition as P
    from weft.sources.lists import read_pages
    from weft.sources.tables import written

    pages = written(read_pages(spark, path), "cli-pages")
    n = pages.count()
    log.write(f"[weft] read {n} pages, clustering...\n")
    keyed = B.resolve_blocks(pages.select("idx", "host", "paths", "stylesheetHrefs"))
    blocks = written(keyed.select("idx", "block_key", "reason"), "cli-blocks")
    prepared = written(C.prepared(pages, block_attribute=args.get("block_attribute")), "cli-prepared")
    found = written(C.cluster_pages(prepared, blocks).join(pages.select("idx", "id", "paths", "stylesheetHrefs"), "idx"), "cli-clusters")
    if "validation_file" in args:
        axis = P.mirror_axis(pages)
        Path(args["validation_file"]).write_text(json.dumps(P.report(found, axis), ensure_ascii=False, indent=1), encoding="utf-8")
        found = written(P.merged_partition(found, axis), "cli-merged")
    if "reasons_file" in args:
        whole = found.join(blocks.select("idx", "reason"), "idx").join(prepared.select("idx", "instances"), "idx")
        Path(args["reasons_file"]).write_text(json.dumps(P.reasons_report(whole), ensure_ascii=False, indent=1), encoding="utf-8")
    seen = set()
    for r in found.orderBy("idx").select("id", F.col("cluster_key").alias("k")).toLocalIterator():
        seen.add(r.k)
        sink.write(json.dumps({"id": r.id, "clusterKey": r.k}, ensure_ascii=False) + "\n")
    return n, len(seen)


def main() -> None:
    sys.exit(run(sys.argv[1:], sys.stdin, sys.stdout, sys.stderr))


if __name__ == "__main__":
    main()
