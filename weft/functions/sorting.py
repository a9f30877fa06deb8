"""Orders for names, numbers, directories and URLs, as keys or comparators."""

from __future__ import annotations

import re
from functools import cmp_to_key
from urllib.parse import unquote

#: decodeURI leaves the escapes of these characters.
_RESERVED = {f"%{ord(c):02X}" for c in ";/?:@&=+$,#"}


def decode_uri(text: str) -> str:
    """Decodes all escapes but those of reserved characters; the text itself where an escape is malformed."""
    if re.search(r"%(?![0-9a-fA-F]{2})", text):
        return text
    try:
        return re.sub(r"(?:%[0-9a-fA-F]{2})+", lambda m: "".join(p if p.upper() in _RESERVED else unquote(p, errors="strict") for p in re.findall(r"%(?:2[46BCF]|3[ABDF]|40|3b|2c|23|24|26|2b|2f|3a|3d|3f)|(?:%(?!2[46BCF3]|3[ABDF]|40)[0-9a-fA-F]{2})+", m[0], re.I)), text)
    except UnicodeDecodeError:
        return text


def decode_component(text: str) -> str:
    """Decodes all escapes; the text itself where one is malformed."""
    if re.search(r"%(?![0-9a-fA-F]{2})", text):
        return text
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return text


def _units(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def alphabetical_key(text: str) -> bytes:
    """Lower case first, then decoded; by code units."""
    return _units(decode_uri(text.lower()))


def compare(a, b) -> int:
    return (a > b) - (a < b)


def alphabetical(a: str, b: str) -> int:
    return compare(alphabetical_key(a), alphabetical_key(b))


def without_common_start(a: str, b: str) -> tuple[str, str]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n] and not a[n].isdigit():
        n += 1
    return a[n:], b[n:]


_LEADING = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)")


def leading_number(text: str) -> float | None:
    m = _LEADING.match(text)
    return float(m[0]) if m else None


def numerical(a: str | None, b: str | None) -> int:
    """Nulls first, then by the number after the common start, else by letters."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    x, y = map(leading_number, without_common_start(a, b))
    if x is None or y is None or x == y:
        return alphabetical(a, b)
    return compare(x, y)


def is_index(name: str) -> bool:
    return re.fullmatch(r"index(?:\.[^.]*)?", name) is not None


def directory(a: str, b: str) -> int:
    """Segment by segment, an index file before its siblings, a directory before what is in it."""
    x, y = a.split("/"), b.split("/")
    for p, q in zip(x, y):
        if p == q:
            continue
        if is_index(p) != is_index(q):
            return -1 if is_index(p) else 1
        if not p or not q:
            return -1 if not p else 1
        if (c := numerical(p, q)) != 0:
            return c
    return compare(len(x), len(y))


def sc_number(a: str | None, b: str | None) -> int:
    """Dotted numbers part by part; nulls last."""
    if not a or not b:
        return (not a) - (not b)
    parts = lambda t: [int(p) if p.isdigit() else -1 for p in t.split(".")]
    return compare(parts(a), parts(b))


def natural_sorted(items, by=numerical) -> list:
    return sorted(items, key=cmp_to_key(by))
