"""URL algebra: Catalyst columns where built-ins express it, Python for the rest."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.sorting import decode_uri, numerical

SEPARATOR = ":::"
EXTENSIONS = {
    "text/html": ".html", "text/css": ".css", "text/javascript": ".js", "application/javascript": ".js", "application/json": ".json", "application/xml": ".xml", "text/xml": ".xml", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
    "image/svg+xml": ".svg", "image/x-icon": ".ico", "font/woff": ".woff", "font/woff2": ".woff2", "font/ttf": ".ttf", "font/otf": ".otf", "application/font-woff": ".woff", "application/x-font-ttf": ".ttf", "application/x-font-otf": ".otf",
}

# --- columns -----------------------------------------------------------------------------------------------------------------


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1))


def pathname(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(raw == "", "/").otherwise(F.regexp_replace(raw, "/+", "/"))


def path_segments(url: Column) -> Column:
    return F.split(F.regexp_replace(pathname(url), "^/", ""), "/")


def extension(url: Column) -> Column:
    name = F.element_at(path_segments(url), -1)
    return F.nullif(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1), F.lit(""))


def base_name(url: Column) -> Column:
    name = F.element_at(path_segments(url), -1)
    return F.nullif(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), F.lit(""))


def is_index(url: Column) -> Column:
    return F.coalesce(base_name(url).isNull() | (F.lower(base_name(url)) == "index"), F.lit(True))


def query_string(url: Column) -> Column:
    """Without PHPSESSID, parameters in order of their names."""
    raw = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(raw, "&"), lambda p: (p != "") & ~p.startswith("PHPSESSID=") & (p != "PHPSESSID"))
    by_name = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))
    return F.nullif(F.array_join(F.transform(F.array_sort(by_name), lambda s: s["p"]), "&"), F.lit(""))


def without_auth(url: Column) -> Column:
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")


def file_name(url: Column) -> Column:
    """Without login and scheme, the first white space gone, ? as +, runs of / as _."""
    bare = F.regexp_replace(without_auth(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    once = F.regexp_replace(bare, r"^(\S*)\s+", "$1")
    return F.regexp_replace(F.replace(once, F.lit("?"), F.lit("+")), "/+", "_")


def encode_resource(url: Column, mime: Column, separator: str = SEPARATOR) -> Column:
    path = pathname(url)
    return F.when(F.contains(F.element_at(F.split(path, "/"), -1), F.lit(".")) | mime.isNull() | (mime == ""), path).otherwise(F.concat(path, F.lit(separator), mime))


def decode_resource(encoded: Column, separator: str = SEPARATOR) -> Column:
    """struct(pathname, mimeType): split at the last separator, if something follows it."""
    mime = F.substring_index(encoded, separator, -1)
    has = F.contains(encoded, F.lit(separator)) & (mime != "")
    path = F.substring(encoded, F.lit(1), F.length(encoded) - F.length(mime) - len(separator))
    return F.struct(F.when(has, path).otherwise(encoded).alias("pathname"), F.when(has, mime).alias("mimeType"))


def mime_extension(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(F.substring_index(mime, ";", 1)))], F.lit(""))


def local_path(url: Column, ext: Column) -> Column:
    path = F.regexp_replace(pathname(url), "^/", "")
    return F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index"), ext)).when(~F.contains(F.element_at(F.split(path, "/"), -1), F.lit(".")), F.concat(path, ext)).otherwise(path)


def under(url: Column, host: str, path: str) -> Column:
    """The same host and the same path or one below it."""
    from weft.operators.blocking import url_host

    stem = path.rstrip("/")
    return (url_host(url) == host.lower()) & ((pathname(url) == path) | (pathname(url) == stem) | pathname(url).startswith(f"{stem}/"))


def glob_pattern(glob: str) -> str:
    """A path glob (*, **, ?, {a,b}, [..]) as a regular expression for the whole path."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]")
            i = end + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return f"^{''.join(out)}$"


def path_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


# --- Python ------------------------------------------------------------------------------------------------------------------


def parse_url(url: str, base: str | None = None, drop_query: bool = False, index_as_parent: bool = False) -> dict:
    """The parts of a URL; for what isn't one, its text with empty parts."""
    empty = dict(protocol="", is_http=False, is_secure=False, username=None, password=None, hostname="", port=None, pathname=None, paths=[], depth=0, dirname=None, basename=None, is_index=False, extname=None, query=None, hash=None, stem="")
    try:
        s = urlsplit(urljoin(base, url) if base else url.strip())
        port = s.port
    except ValueError:
        return {"href": url, "without_hash": url, "without_hash_and_auth": url, **empty}
    scheme = f"{s.scheme.lower()}:"
    if not s.scheme or (s.scheme.lower() in ("http", "https") and not s.hostname):
        return {"href": url, "without_hash": url, "without_hash_and_auth": url, **empty}
    if s.scheme.lower() not in ("http", "https"):
        href = scheme + (s.path or s.netloc)
        return {"href": href, "without_hash": href, "without_hash_and_auth": href, **empty, "protocol": scheme, "pathname": s.path}
    path = re.sub("/+", "/", quote(posixpath.normpath(s.path) + ("/" if s.path.endswith(("/", "/.", "/..")) and s.path != "/" else "") if s.path else "/", safe="/%:@!$&'()*+,;=~-._") or "/")
    path = re.sub("/+", "/", path)
    paths, unnamed = path.removeprefix("/").split("/"), path.endswith("/")
    stem_name, ext = posixpath.splitext(paths[-1])
    dirname = None if path == "/" else posixpath.dirname(path + ("index" if unnamed else ""))
    query = None if drop_query or not s.query else urlencode(sorted(((k, v) for k, v in parse_qsl(s.query, keep_blank_values=True) if k != "PHPSESSID"), key=lambda p: p[0])) or None
    default = {"http": 80, "https": 443}[s.scheme.lower()]
    shown_port = str(port) if port and port != default else None
    host = (s.hostname or "").lower() + (f":{shown_port}" if shown_port else "")
    auth = f"{s.username}:{s.password}@" if s.username and s.password else ""
    body = path + (f"?{query}" if query else "") if dirname else f"/?{query}" if query else ""
    bare, fragment = f"{scheme}//{auth}{host}{body}", f"#{s.fragment}" if s.fragment else ""
    index = unnamed or stem_name.lower() == "index"
    return {
        "href": bare + (f"/{fragment}" if fragment and not body and not bare.endswith("/") else fragment), "without_hash": bare, "without_hash_and_auth": f"{scheme}//{host}{body}", "protocol": scheme, "is_http": True, "is_secure": scheme == "https:",
        "username": s.username or None, "password": s.password or None, "hostname": (s.hostname or "").lower(), "port": shown_port, "pathname": path, "paths": paths, "depth": len(paths) - (index_as_parent and index), "dirname": dirname, "basename": None if unnamed else stem_name, "is_index": index,
        "extname": None if unnamed else ext or None, "query": query, "hash": fragment or None, "stem": re.sub("/+", "/", f"{dirname or ''}/{'' if index else stem_name}"),
    }


def normalize_url(url: str, ignorable: tuple[str, ...] = ()) -> str:
    """Decoded and encoded alike, host in lower case, index names and ignorable extensions gone."""
    p = parse_url(decode_uri(url))
    ext = p["extname"] if p["extname"] and p["extname"].lower() not in ignorable else ""
    if p["is_index"]:
        stem = p["stem"]
        named = ext and (p["basename"] is not None)
        path = stem + (f"index{ext}" if named and stem.endswith("/") else ext if named else "")
    else:
        path = "/" if p["stem"] == "/" else p["stem"].rstrip("/") + (p["extname"] or "")
    auth = f"{p['username']}:{p['password']}@" if p["username"] and p["password"] else ""
    host = p["hostname"] + (f":{p['port']}" if p["port"] else "")
    coded = "/".join(quote(unquote(x), safe="!'()*~-._") for x in path.split("/"))
    return f"{p['protocol']}//{auth}{host}{coded}" + (f"?{p['query']}" if p["query"] else "")


def urls_match(a: str, b: str, ignorable: tuple[str, ...] = (".html", ".htm")) -> bool:
    x, y = parse_url(decode_uri(a)), parse_url(decode_uri(b))
    if x["is_index"] and y["is_index"]:
        e, f = (x["extname"] or "").lower(), (y["extname"] or "").lower()
        if e and f and e != f or bool(e) != bool(f) and (e or f) not in ignorable:
            return False
    return normalize_url(x["without_hash_and_auth"], ignorable) == normalize_url(y["without_hash_and_auth"], ignorable)


def is_lower(target: str, base: str) -> bool:
    """Whether target lies below base (or is it)."""
    a, b = parse_url(target), parse_url(base)
    if not (a["protocol"] and b["protocol"]):
        return False
    if a["href"] == b["href"]:
        return True
    if a["hostname"] != b["hostname"] or len(a["paths"]) < len(b["paths"]):
        return False
    if a["paths"] == b["paths"] == [""]:
        return True
    for i, x in enumerate(a["paths"]):
        y = b["paths"][i] if i < len(b["paths"]) else ""
        if x and not y:
            return True
        if x != y:
            return False
    return False


def compare_urls(a: str, b: str) -> int:
    """Host, then path segments with index files first, extension, query, fragment, text."""
    x, y = parse_url(a), parse_url(b)
    if (c := numerical(x["hostname"], y["hostname"])) != 0:
        return c
    for p, q in zip(x["paths"][:-1], y["paths"][:-1]):
        if (c := numerical(p, q)) != 0:
            return c
    if len(x["paths"]) != len(y["paths"]):
        return -1 if len(x["paths"]) < len(y["paths"]) else 1
    if x["is_index"] != y["is_index"]:
        return -1 if x["is_index"] else 1
    for k in ("basename", "extname", "query", "hash", "protocol", "href"):
        if (c := numerical(x[k], y[k])) != 0:
            return c
    return 0


def sort_urls(urls: list[str]) -> list[dict]:
    """Parsed, one for each normal form (the last of equals), what isn't a URL dropped, in natural order."""
    from functools import cmp_to_key

    seen = {p["href"]: p for p in map(parse_url, urls) if p["protocol"]}
    return sorted(seen.values(), key=cmp_to_key(lambda a, b: compare_urls(a["href"], b["href"])))


def same_host(urls: list[str]) -> str:
    hosts = {parse_url(u)["hostname"] for u in urls}
    if len(hosts) != 1:
        raise ValueError(f"one host is expected, not {sorted(hosts)}")
    return hosts.pop()


def last_segment(url: str) -> str:
    return parse_url(url)["paths"][-1] if parse_url(url)["paths"] else ""


def sheet_id(url: str) -> str | None:
    parts = (parse_url(url)["pathname"] or "").split("/")
    return parts[3] if len(parts) > 3 else None


def project_id(url: str) -> str:
    p = parse_url(url)
    if not p["protocol"]:
        return url
    return p["paths"][1] if len(p["paths"]) > 1 and p["paths"][1] else dict(parse_qsl(p["query"] or "")).get("project.id", url)


def path_to_url(path: str) -> str:
    """A URL as it is (normalised), anything else as a file's."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return parse_url(path)["href"]
    return "file:///" + quote(posixpath.normpath("/" + path.lstrip("/")).lstrip("/"), safe="/%:@!$&'()*+,;=~-._") + ("/" if path.endswith("/") and path.strip("/") else "")


def safe_file_path(path: str) -> str:
    """Decoded, with _ for characters and names that file systems refuse. Raises on a malformed escape."""
    if re.search(r"%(?![0-9a-fA-F]{2})", path):
        raise ValueError(f"malformed escape in {path!r}")
    name = re.sub(r'[/?<>\\:*|"\x00-\x1f\x80-\x9f]', "_", decode_uri(path))
    name = "_" if re.fullmatch(r"\.+|(?i:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\..*)?", name) else name
    return re.sub(r"[. ]+$", "_", name).encode()[:255].decode("utf-8", "ignore")


def analyzed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """One row (has_auth, has_no_ssl) of a column of URLs, or of arrays of them."""
    kind = dict(urls.dtypes)[column]
    u = urls.select(F.explode(column).alias("u")) if kind.startswith("array") else urls.select(F.col(column).alias("u"))
    login = F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*)@", 1)
    return u.agg(F.coalesce(F.bool_or(F.regexp_replace(login, ":$", "") != ""), F.lit(False)).alias("has_auth"), F.coalesce(F.bool_or(protocol(F.col("u")) == "http:"), F.lit(False)).alias("has_no_ssl"))


def compared_with(urls: DataFrame, host: str, column: str = "url") -> DataFrame:
    """(url_a, url_b): each URL and the same path and query on the host to compare with."""
    rest = F.regexp_replace(F.regexp_replace(column, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return urls.select(F.col(column).alias("url_a"), F.concat(F.lit(host), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))).alias("url_b"))


def environment_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame, sizes: str = "size") -> DataFrame:
    """Captures of both sides: by the pair's URLs, then by size. A size of the first that the second lacks fails the query."""
    left = pairs.join(a, F.col("url_a") == F.col("url")).drop("url")
    right = b.select(F.col("url").alias("url_b"), F.col(sizes), *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in ("url", sizes)], F.lit(True).alias("there"))
    both = left.join(right, ["url_b", sizes], "left")
    checked = F.when(F.col("there"), F.col(sizes)).otherwise(F.raise_error(F.concat(F.lit("no capture of "), "url_b", F.lit(" at "), F.col(sizes))))
    return both.withColumn(sizes, checked).drop("there")
