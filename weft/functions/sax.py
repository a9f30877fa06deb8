"""An event parser for HTML as crawlers meet it: void elements, implied and forced ends, raw text, offsets of every tag."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr".split())
RAW = frozenset(("script", "style", "title", "textarea"))
FOREIGN = frozenset(("svg", "math"))
_FORM = frozenset("input option optgroup select button datalist textarea".split())
#: A start tag ends open elements of these names at the top of the stack.
ENDS = {
    "tr": {"tr", "th", "td"}, "th": {"th"}, "td": {"thead", "th", "td"}, "body": {"head", "link", "script"}, "li": {"li"},
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 address article aside blockquote details div dl fieldset figcaption figure footer form header hr main nav ol pre section table ul".split(), {"p"}),
    **dict.fromkeys("select input output button datalist textarea".split(), _FORM),
    "option": {"option"}, "optgroup": {"optgroup", "option"}, "dd": {"dt", "dd"}, "dt": {"dt", "dd"},
    "rt": {"rt", "rp"}, "rp": {"rt", "rp"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"},
}
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TO_END = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")


class Handler:
    """Override what is needed; start and end are the offsets of the tag that caused the event."""

    def opened(self, name: str, attrs: dict[str, str], start: int, end: int) -> None: ...

    def closed(self, name: str, start: int, end: int) -> None: ...

    def comment(self, data: str) -> None: ...

    def text(self, data: str) -> None: ...


def attributes(source: str, decode: bool) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        name = m[1].lower()
        if name not in found:
            value = next((g for g in m.groups()[1:] if g is not None), "")
            found[name] = unescape(value) if decode else value
    return found


def parse(html: str, handler: Handler, decode: bool = True) -> None:
    stack: list[str] = []
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            break
        if m.start() > at:
            handler.text(html[at : m.start()])
        start = m.start()
        if m[1]:
            stop = html.find("-->", m.end())
            handler.comment(html[m.end() : stop if stop >= 0 else n])
            at = stop + 3 if stop >= 0 else n
            continue
        if m[2]:
            stop = html.find(">", m.end())
            at = stop + 1 if stop >= 0 else n
            continue
        whole = _TO_END.match(html, m.end())
        if not whole:  # cut off within a tag
            at = n
            break
        end, name = whole.end(), m[4].lower()
        at = end
        if m[3]:
            _close(name, stack, handler, start, end)
            continue
        while stack and stack[-1] in ENDS.get(name, ()):
            handler.closed(stack.pop(), start, end)
        body = html[m.end() : end - 1]
        handler.opened(name, attributes(body, decode), start, end)
        if name in VOID:
            handler.closed(name, start, end)
            continue
        if body.endswith("/") and (name in FOREIGN or any(x in FOREIGN for x in stack)):
            handler.closed(name, start, end)
            continue
        stack.append(name)
        if name in RAW and not any(x in FOREIGN for x in stack):
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if stop:
                if stop.start() > at:
                    handler.text(html[at : stop.start()])
                at = stop.start()
            else:
                handler.text(html[at:])
                at = n
    if at < n:
        handler.text(html[at:])
    while stack:
        handler.closed(stack.pop(), n, n)


def _close(name: str, stack: list[str], handler: Handler, start: int, end: int) -> None:
    if name in VOID:
        if name == "br":
            handler.opened("br", {}, start, end)
            handler.closed("br", start, end)
        return
    if name in stack:
        while (top := stack.pop()) != name:
            handler.closed(top, start, end)
        handler.closed(name, start, end)
    elif name == "p":
        handler.opened("p", {}, start, end)
        handler.closed("p", start, end)
