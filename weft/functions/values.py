"""Scalar functions over columns: text, colours, numbers, dates, cells, headers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NETWORK_FAILURES = ("net::ERR_INTERNET_DISCONNECTED", "net::ERR_NETWORK_CHANGED", "net::ERR_CONNECTION_RESET", "net::ERR_NAME_NOT_RESOLVED", "net::ERR_CONNECTION_CLOSED")


def normalized_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the text with its white space collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256), 1, 16)


def document_lines(text: Column) -> Column:
    """White space as line breaks, and one after each ideographic full stop."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(?U)\s+", "\n"), "。(?!\n)", "。\n")


def keyword_check(html: Column, keywords: list[str]) -> Column:
    """The first keyword (text, or /pattern/flags) found in html; null if none is."""
    found = F.lit(None).cast("string")
    for k in reversed(keywords):
        m = re.fullmatch(r"/(.+)/([gim]*)", k, re.S)
        hit = html.rlike(f"(?{m[2].replace('g', '')}){m[1]}" if m and m[2].replace("g", "") else m[1]) if m else F.contains(html, F.lit(k))
        found = F.when(hit, F.lit(k)).otherwise(found)
    return found


def is_html_type(content_type: Column) -> Column:
    return F.lower(F.trim(content_type)) == "text/html"


def is_error(status: Column) -> Column:
    return ~F.coalesce((status >= 200) & (status < 400), F.lit(False))


def is_disconnection(error: Column) -> Column:
    return error.isin(*NETWORK_FAILURES)


def size_text(n: Column) -> Column:
    kb = F.round(n / 1024)
    return F.when(kb < 1024, F.concat(F.format_string("%d", kb.cast("long")), F.lit("KB"))).otherwise(F.concat(F.format_string("%d", F.round(n / 1024 / 1024).cast("long")), F.lit("MB")))


def score_text(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))


def detect_cdn(headers: Column) -> Column:
    """From a map of lower-case header names."""
    has = lambda p: F.exists(F.map_keys(headers), lambda k: k.rlike(p))
    server = F.lower(F.coalesce(headers["server"], F.lit("")))
    return F.when(has("akamai"), "Akamai").when(has("^x-amz-cf"), "Amazon CloudFront").when(has("^x-iij"), "IIJ").when(server.rlike("cloudflare"), "Cloudflare").when(server.rlike("amazons3"), "Amazon S3")


def detect_compression(headers: Column) -> Column:
    value = F.lower(F.coalesce(headers["content-encoding"], F.lit("")))
    out = F.lit(None).cast("string")
    for name, pattern in reversed((("gzip", "gzip"), ("br", r"\bbr\b"), ("compress", "compress"), ("deflate", "deflate"), ("sdch", "sdch"), ("vcdiff", "vcdiff"), ("xdelta", "xdelta"))):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def column_letters(n: Column) -> Column:
    """1 is A, 27 is AA, up to ZZ."""
    letter = lambda x: F.char(65 + x)
    return F.when(n <= 26, letter(n - 1)).otherwise(F.concat(letter(F.floor((n - 27) / 26)), letter((n - 27) % 26)))


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_value(text: Column, kind: str) -> Column:
    """A sheet's cell by the column's kind: number, boolean, date (days since 1899-12-30), else text; empty and failing ones are null."""
    value = F.nullif(text, F.lit(""))
    if kind == "number":
        return value.try_cast("double")
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    if kind == "date":
        return F.timestamp_millis(((value.try_cast("double") - 25569) * 86400000).cast("long"))
    return value


def rgb_hex(color: Column) -> Column:
    """struct(hex, a) of rgb() or rgba(); null for other texts and for alpha 0."""
    part = lambda i: F.regexp_extract(color, r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*(?:,\s*([0-9.]+)\s*)?\)$", i)
    alpha = F.when(part(4) == "", 1.0).otherwise(part(4).try_cast("double"))
    hex_ = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(part(i).cast("int"))), 2, "0") for i in (1, 2, 3)])
    return F.when((part(1) != "") & (alpha > 0), F.struct(hex_.alias("hex"), alpha.alias("a")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    line = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))
    return 0.2126 * line(r) + 0.7152 * line(g) + 0.0722 * line(b)


def contrast(x: Column, y: Column) -> Column:
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def contrast_level(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").otherwise("fail")


def weekend_days(a: Column, b: Column) -> Column:
    """Saturdays and Sundays from the earlier to the later date, both included."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.size(F.filter(F.sequence(lo, hi), lambda d: F.dayofweek(d).isin(1, 7)))


def skip_holidays(day: Column, holidays: list[str] | None = None) -> Column:
    """A Sunday moves by one day, a Saturday by two; then one more, once, if that is a holiday."""
    moved = F.when(F.dayofweek(day) == 1, F.date_add(day, 1)).when(F.dayofweek(day) == 7, F.date_add(day, 2)).otherwise(day)
    return F.when(moved.isin([F.lit(h).cast("date") for h in holidays]), F.date_add(moved, 1)).otherwise(moved) if holidays else moved


def holiday_period(start: Column, days: int, holidays: list[str] | None = None) -> tuple[Column, Column]:
    """(start, due): the start moved off weekends and holidays, the due date put off by the weekend days between and then off weekends itself."""
    begin = skip_holidays(start, holidays)
    due = F.date_add(begin, days)
    due = F.date_add(due, weekend_days(begin, due))
    return begin, skip_holidays(due, holidays)


def parse_interval(text: str | int | float) -> int | tuple[int, int]:
    """Milliseconds, or a range `min-max` of them."""
    if isinstance(text, (int, float)):
        if text < 0 or not math.isfinite(text):
            raise ValueError(f"not an interval: {text}")
        return int(text)
    parts = text.strip().split("-")
    if not all(re.fullmatch(r"\s*\d+\s*", p) for p in parts) or len(parts) > 2:
        raise ValueError(f"not an interval: {text}")
    if len(parts) == 1:
        return int(parts[0])
    lo, hi = map(int, parts)
    if lo > hi:
        raise ValueError(f"not an interval: {text}")
    return lo, hi


def random_int(lo: Column | int, hi: Column | int, seed: int | None = None) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.greatest(lo, F.floor(F.rand(seed) * (hi - lo) + lo))


def sampled_value(kind: str, lo: float = 0.0, hi: float = 1.0, seed: int | None = None) -> Column:
    """A draw from [lo, hi]: uniform, normal (the middle, a sixth of the width as deviation), triangular, right- or left-skewed, bimodal."""
    u, width = F.rand(seed), hi - lo
    if kind == "uniform":
        x = u
    elif kind == "normal":
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.randn(seed) / 6))
    elif kind == "triangular":
        x = F.when(u < 0.5, F.sqrt(u / 2)).otherwise(1 - F.sqrt((1 - u) / 2))
    elif kind == "right-skewed":
        x = u * u
    elif kind == "left-skewed":
        x = 1 - u * u
    elif kind == "bimodal":
        side = F.when(F.rand(None if seed is None else seed + 1) < 0.5, 0.25).otherwise(0.75)
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), side + F.randn(seed) / 12))
    else:
        raise ValueError(f"unknown distribution: {kind}")
    return lo + x * width


def inverse_weight(weight, lo: float, hi: float, u: float, steps: int = 256) -> float:
    """The value at share u of the area under a weight function, by trapezoids."""
    xs = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
    ws = [max(0.0, weight(x)) for x in xs]
    areas = [(a + b) / 2 for a, b in zip(ws, ws[1:])]
    target = u * sum(areas)
    for i, a in enumerate(areas):
        if target <= a:
            return xs[i] + (xs[i + 1] - xs[i]) * (target / a if a else 0)
        target -= a
    return hi


def updated_ratio(state: dict, name: str, value: float) -> dict:
    out = {**state, name: value}
    if name == "abs":
        out["rel"] = out["abs"] / out["max"]
    else:
        out["abs"] = out["rel"] * out["max"]
    return out


def severity(impact: Column) -> Column:
    return F.when(impact.isin("critical", "serious"), "high").when(impact == "minor", "medium").when(impact == "moderate", "low")


def conformance_level(tags: Column) -> Column:
    has = lambda p: F.exists(tags, lambda t: t.rlike(p))
    return F.when(has("^wcag[0-9]*aaa$"), "AAA").when(has("^wcag[0-9]*aa$"), "AA").when(has("^wcag[0-9]*a$"), "A")


def success_criteria(tags: Column) -> Column:
    """wcag143 becomes 1.4.3, wcag1410 1.4.10."""
    found = F.filter(tags, lambda t: t.rlike("^wcag[0-9]{3,4}$"))
    return F.transform(found, lambda t: F.regexp_replace(t, r"^wcag([0-9])([0-9])([0-9]{1,2})$", "$1.$2.$3"))


def paragraphs(*parts: Column, by: str = "\n\n") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), by)


def readable(text: Column) -> Column:
    """Trimmed, white space collapsed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def provided_cell(value: Column, kind: str, *, image: bool = False, link: Column | None = None, if_null: str | None = None, note: Column | None = None, note_most: int = 5_000) -> Column:
    """struct(formula, text, number, flag, hyperlink, note): a value as a sheet's cell takes it. kind: text, number, boolean, timestamp."""
    none = lambda t: F.lit(None).cast(t)
    formula, text, number, flag, hyper = none("string"), none("string"), none("double"), none("boolean"), none("string")
    if kind == "text":
        v = F.trim(F.coalesce(value, F.lit(if_null)) if if_null is not None else value)
        if image:
            formula = F.concat(F.lit('=IMAGE("'), F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v), F.lit('", 1)'))
        else:
            is_formula = v.startswith("=")
            hyper = F.when(~is_formula & (F.trim(link) != ""), F.trim(link)) if link is not None else hyper
            linked = F.concat(F.lit('=HYPERLINK("'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('", "'), hyper, F.lit('")'))
            formula = F.when(is_formula, v).when(hyper.isNotNull(), linked)
            text = F.when(v.isNull(), "").when(formula.isNull(), F.substring(v, 1, 49_999))
    elif kind == "number":
        number = value.cast("double")
    elif kind == "boolean":
        flag = value
    else:
        number = F.unix_millis(value.cast("timestamp")) / 86_400_000 + 25_569
    said = note if note is not None else none("string")
    cut = F.when(F.length(said) > note_most, F.concat(F.substring(said, 1, note_most), F.lit("\n\n...\nToo Large Text"))).otherwise(said)
    return F.struct(formula.alias("formula"), text.alias("text"), number.alias("number"), flag.alias("flag"), hyper.alias("hyperlink"), cut.alias("note"))


def console_entry(page: Column, event: Column) -> Column:
    """struct(page_url, type, text, args, location, stack, ts) of a captured console message or page error (a struct with type, text, args, url, message, stack, ts)."""
    error = event["type"] == "pageerror"
    return F.struct(page.alias("page_url"), event["type"].alias("type"), F.when(error, F.coalesce(event["message"], event["text"])).otherwise(event["text"]).alias("text"), F.when(error, F.array().cast("array<string>")).otherwise(event["args"]).alias("args"), F.when(~error, event["url"]).alias("location"), F.when(error, event["stack"]).alias("stack"), event["ts"].alias("ts"))


def stamp(ts: Column, pattern: str | None = None) -> Column:
    """Seconds since 1970 as text, or the time in a pattern."""
    return F.date_format(ts, pattern) if pattern else F.unix_seconds(ts.cast("timestamp")).cast("string")
