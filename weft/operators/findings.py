"""Accessibility findings: rule results to one row for each element, devices, and the policy for retries of service sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import values as V

NODES = "array<struct<html:string,failureSummary:string,landmark:string>>"
RULES = f"array<struct<id:string,help:string,helpUrl:string,description:string,impact:string,tags:array<string>,nodes:{NODES}>>"
RESULT = f"struct<url:string,timestamp:string,testEngine:struct<name:string,version:string>,violations:{RULES},incomplete:{RULES}>"
DEVICES = {"desktop": (1400, 1), "tablet": (768, 1), "mobile": (375, 2), "desktop-hd": (1920, 1), "desktop-compact": (1280, 1), "mobile-large": (414, 3), "mobile-small": (320, 2)}


def devices(names: list[str] | None) -> dict[str, tuple[int, int]] | None:
    """(width, resolution) of the named presets; None for none named."""
    unknown = set(names or ()) - DEVICES.keys()
    if unknown:
        raise ValueError(f"unknown devices {sorted(unknown)}; there are {', '.join(DEVICES)}")
    return {n: DEVICES[n] for n in names} if names else None


def finding_rows(results: DataFrame, json: str = "result", environment: str = "environment") -> DataFrame:
    """One row for each element of each rule that failed or needs a look."""
    r = F.from_json(json, RESULT)
    rules = results.select(environment, r.alias("r")).select(environment, "r.url", "r.timestamp", "r.testEngine", F.explode(F.concat(F.coalesce("r.incomplete", F.array().cast(RULES)), F.coalesce("r.violations", F.array().cast(RULES)))).alias("rule"))
    rows = rules.select("*", F.explode("rule.nodes").alias("node"))
    tags = F.col("rule.tags")
    return rows.select(
        "url",
        F.concat("testEngine.name", F.lit(" (v"), "testEngine.version", F.lit(")")).alias("tool"),
        F.to_timestamp("timestamp").alias("timestamp"),
        F.col("node.landmark").alias("component"),
        F.col(environment).alias("environment"),
        F.col("node.html").alias("target"),
        V.paragraphs(F.concat("rule.help", F.lit("\n("), "rule.helpUrl", F.lit(")")), F.col("rule.description"), F.col("node.failureSummary")).alias("as_is"),
        F.when(F.array_contains(tags, "wcag2a"), "WCAG2.0").otherwise("WCAG2.1").alias("wcag_version"),
        F.array_join(V.success_criteria(tags), ",").alias("sc_number"),
        V.conformance_level(tags).alias("level"),
        V.severity(F.col("rule.impact")).alias("severity"),
    )


def retry_wait(status: int | None, message: str = "", code: str = "") -> float | None:
    """Seconds to wait before a service call is tried again; None if it shouldn't be."""
    if status == 429:
        return 110.0
    if status == 403 and "rate" in message.lower():
        return 60.0
    if status is not None and 500 <= status < 600:
        return 30.0
    return 5.0 if code == "ECONNRESET" else None


def is_html_page(content_type: Column, status: Column) -> Column:
    return V.is_html_type(content_type) & ~V.is_error(status)
