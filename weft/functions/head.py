"""Metadata and main content of static HTML: head entries, their classification, anchors, images, counts."""

from __future__ import annotations

import json
import re

from weft.functions import keys as K
from weft.functions.sax import VOID, Handler, parse

LD_ENTRY, LD_TOTAL = 200_000, 1_000_000
STRUCTURED = frozenset(("application/ld+json", "speculationrules", "application/json+oembed", "application/xml+oembed"))
ROBOTS = frozenset("index noindex follow nofollow none all noarchive nosnippet noimageindex nocache notranslate noodp noydir indexifembedded".split())
MAIN = ("main", "[role=main]", "#main", ".main", "#content", ".content", "#contents", ".contents", "#main-content", ".main-content", "#main_content", ".main_content", "#mainContent", ".mainContent")
PARTS = (("id", "main"), ("class", "main"), ("id", "content"), ("class", "content"))
#: Names with a parser of their own stand at the top of the record.
NAMES = {k: k.replace("-", "_") for k in ("viewport", "robots", "referrer", "format-detection")} | K.NAMES
TWITTER = {k: v for k, v in K.NAMES.items() if k.startswith("twitter:")}
FLAGS = frozenset(("pinterest.rich_pin", "pinterest.nopin"))
SINGLE_REL = {"canonical": "canonical", "amphtml": "amphtml", "manifest": "manifest", "shortlink": "shortlink", "next": "next", "prev": "prev", "license": "license", "author": "author_link", "search": "search", "pingback": "pingback"}
MANY_REL = {"icon": "icons", "shortcut": "icons", "apple-touch-icon": "apple_icons", "alternate": "alternates", "stylesheet": "stylesheets", "preload": "preload", "prefetch": "prefetch", "preconnect": "preconnect", "dns-prefetch": "dns_prefetch", "modulepreload": "modulepreload", "me": "me"}


class _Collect(Handler):
    def __init__(self) -> None:
        self.entries: list[dict] = []
        self.html: dict = {}
        self.anchors: list[dict] = []
        self.images: list[dict] = []
        self.open: list[tuple[str, dict]] = []
        self.title: list[str] | None = None
        self.title_done = False
        self.text_of: dict | None = None

    def opened(self, name: str, attrs: dict, start: int, end: int) -> None:
        get = attrs.get
        place = "head" if any(n == "head" for n, _ in self.open) else "noscript" if any(n == "noscript" for n, _ in self.open) else "body"
        if name == "html" and not self.html:
            self.html = {"kind": "html", **{k: v for k, v in attrs.items() if k in ("lang", "dir", "xmlns", "prefix", "vocab", "typeof", "itemtype") and v}, **{k: True for k in ("itemscope", "amp") if k in attrs}}
        elif name == "title" and not self.title_done and not any(n == "svg" for n, _ in self.open):
            self.title = []
        elif name == "base":
            self.entries.append({"kind": "base", "href": get("href"), "target": get("target")})
        elif name == "meta":
            low = lambda k: get(k).lower() if get(k) else None
            self.entries.append({"kind": "meta", "name": low("name"), "property": low("property"), "http_equiv": low("http-equiv"), "itemprop": get("itemprop"), "charset": get("charset"), "content": get("content"), "media": get("media")})
        elif name == "link" and "href" in attrs:
            self.entries.append({"kind": "link", "rel": (get("rel") or "").lower().split(), **{k: get(k) for k in ("href", "type", "media", "sizes", "title", "hreflang", "as")}})
        elif name == "script" and (get("type") or "").lower() in STRUCTURED:
            self.entries.append({"kind": "script", "type": get("type").lower(), "src": get("src"), "content": "", "location": place})
            self.text_of = self.entries[-1]
        elif name == "iframe" and get("src"):
            self.entries.append({"kind": "iframe", "src": get("src"), "location": place})
        elif name == "a" and "href" in attrs:
            self.anchors.append({"href": get("href"), "title": get("title"), "text": ""})
        elif name == "img":
            self.images.append({"src": get("src") or "", "alt": get("alt") or "", "lazy": (get("loading") or "").strip().lower() == "lazy"})
        if name not in VOID:
            self.open.append((name, attrs))

    def closed(self, name: str, start: int, end: int) -> None:
        if name == "title" and self.title is not None:
            self.entries.append({"kind": "title", "content": " ".join("".join(self.title).split())})
            self.title, self.title_done = None, True
        if name == "script":
            self.text_of = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i]
                break

    def text(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif self.text_of is not None:
            self.text_of["content"] += data
        elif self.anchors and any(n == "a" for n, _ in self.open):
            self.anchors[-1]["text"] += data


def collect(html: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(head entries, anchors, images) in document order."""
    walk = _Collect()
    parse(html, walk)
    anchors = [{**a, "text": " ".join(a["text"].split())} for a in walk.anchors if not re.match(r"(?!https?:)[a-z][a-z0-9+.-]*:", a["href"].strip(), re.I)]
    return [walk.html or {"kind": "html"}, *walk.entries], anchors, walk.images


def number(text: str) -> float | None:
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)", text)
    return float(m[0]) if m else None


def viewport(raw: str) -> dict:
    out: dict = {"raw": raw}
    for part in raw.split(","):
        k, _, v = (x.strip() for x in part.partition("="))
        k = k.lower()
        if k in ("width", "height", "viewport-fit", "interactive-widget"):
            out[k.replace("-", "_")] = v
        elif k in ("initial-scale", "minimum-scale", "maximum-scale") and number(v) is not None:
            out[k.replace("-", "_")] = number(v)
        elif k == "user-scalable":
            out["user_scalable"] = {"no": False, "0": False, "yes": True, "1": True}.get(v.lower(), v)
    return out


def robots(raw: str) -> dict:
    out: dict = {"raw": raw}
    for part in raw.split(","):
        k, mark, v = part.strip().partition(":")
        k, v = k.strip().lower(), v.strip()
        if not mark and k in ROBOTS:
            out[k] = True
        elif mark and k in ("max-snippet", "max-video-preview") and number(v) is not None:
            out[k.replace("-", "_")] = int(number(v))
        elif mark and k in ("max-image-preview", "unavailable_after", "unavailable-after"):
            out[k.replace("-", "_")] = v
    return out


def format_detection(raw: str) -> dict:
    pairs = (p.partition("=") for p in re.split("[,;]", raw))
    return {"raw": raw, **{k.strip().lower(): v.strip().lower() not in ("no", "false", "0") for k, _, v in pairs if k.strip().lower() in ("telephone", "email", "address", "date")}}


def referrer(raw: str) -> dict:
    policies = "no-referrer origin origin-when-cross-origin strict-origin strict-origin-when-cross-origin unsafe-url same-origin no-referrer-when-downgrade".split()
    name = raw.strip().lower()
    return {"raw": raw, **({name.replace("-", "_"): True} if name in policies else {})}


def refresh(raw: str) -> dict:
    seconds, _, rest = raw.partition(";")
    out: dict = {"raw": raw}
    if number(seconds) is not None:
        out["seconds"] = number(seconds)
    if m := re.search(r"url\s*=\s*(.+)", rest, re.I):
        out["url"] = m[1].strip().strip("'\"")
    return out


def json_ld(content: str) -> dict:
    try:
        return {"raw": content, "parsed": json.loads(content)}
    except ValueError as e:
        return {"raw": content, "error": str(e)}


def coerced(value: str, kind: str | None):
    low = value.strip().lower()
    table = {"yes": {"yes": True, "no": False}, "on": {"on": True, "true": True, "1": True, "off": False, "false": False, "0": False}, "true": {"true": True, "false": False}}
    if kind == "number":
        return value if number(value) is None else number(value)
    return table.get(kind or "", {}).get(low, value)


def put(tree: dict, path: str, value) -> None:
    """Writes at dotted paths, parted by |: a starred path appends, others keep their first value; a flag's value is true."""
    if "|" in path:
        for p in path.split("|"):
            put(tree, p, value)
        return
    value = True if path in FLAGS else value
    *ways, last = path.rstrip("*").split(".")
    for w in ways:
        tree = tree.setdefault(w, {})
    if path.endswith("*"):
        tree.setdefault(last, []).append(value)
    else:
        tree.setdefault(last, value)


PARSERS = {"viewport": viewport, "robots": robots, "referrer": referrer, "format_detection": format_detection}


def classify(entries: list[dict]) -> dict:
    """Head entries as one nested record; what has no place of its own goes to `others`."""
    meta: dict = {}
    budget = LD_TOTAL
    for e in entries:
        kind = e["kind"]
        if kind == "html":
            meta["html"] = {k: v for k, v in e.items() if k != "kind"}
        elif kind == "title":
            put(meta, "title", e["content"])
        elif kind == "base":
            put(meta, "base", {k: e[k] for k in ("href", "target") if e[k]})
        elif kind == "meta":
            value = e["content"]
            if e["charset"]:
                put(meta, "charset", e["charset"])
            key, table = next(((e[k], t) for k, t in (("name", NAMES | K.PROPERTIES), ("property", K.PROPERTIES | TWITTER), ("http_equiv", K.EQUIV), ("itemprop", K.ITEMPROPS)) if e[k]), (None, {}))
            if key is None or value is None:
                if not e["charset"]:
                    put(meta, "others.meta*", {k: v for k, v in e.items() if v and k != "kind"})
            elif key in table:
                path = table[key]
                put(meta, path, refresh(value) if path == "http_equiv.refresh" else PARSERS.get(path, lambda v: v)(value))
            else:
                put(meta, "others.meta*", {k: v for k, v in e.items() if v and k != "kind"})
        elif kind == "link":
            item = {k: v for k, v in e.items() if v and k not in ("kind", "rel")}
            known = False
            for rel in e["rel"]:
                if rel in SINGLE_REL:
                    put(meta, SINGLE_REL[rel], e["href"])
                    known = True
                elif rel in MANY_REL and not (rel == "shortcut" and "icon" in e["rel"]):
                    target = "feeds" if rel == "alternate" and re.search("rss|atom|feed", e.get("type") or "") else MANY_REL[rel]
                    put(meta, target + "*", item)
                    known = True
                elif rel in K.RELATIONS and not (rel == "shortcut" and "icon" in e["rel"]):
                    path, kind_of = K.RELATIONS[rel]
                    put(meta, f"link.{path}" + "*" * (kind_of in "*#"), e["href"] if kind_of == "=" else item)
                    known = True
            if not known:
                put(meta, "others.link*", {**item, "rel": e["rel"]})
        elif kind == "script" and e["type"] == "application/ld+json":
            text = e["content"][: min(LD_ENTRY, budget)]
            budget -= len(text)
            put(meta, "json_ld*", json_ld(text))
        else:
            put(meta, f"others.{kind}*", {k: v for k, v in e.items() if v and k != "kind"})
    return meta


def page_meta(html: str) -> dict:
    return {**empty_meta(), **classify(collect(html)[0])}


def _called(f: str, *words: str) -> str:
    """A call of f: words as quoted arguments, the last one the id."""
    quoted = [f"['\"]{w}['\"]" for w in words[:-1]] + [f"['\"]({words[-1]})['\"]"]
    return f + r"\(\s*" + r"\s*,\s*".join(quoted)


def _quoted(pattern: str) -> str:
    return f"['\"]({pattern})['\"]"


_UA, _GA, _GTM, _PIXEL = r"UA-\d{4,10}-\d{1,4}", "G-[A-Z0-9]{4,20}", "GTM-[A-Z0-9]{4,12}", r"\d{6,20}"
#: Patterns of measurement and service ids by provider; the first group, or the whole match, is the id.
TAG_IDS: dict[str, list[str]] = {
    "Adobe Analytics": [rf"(?i)s{dot}account\s*=\s*{_quoted('[a-z0-9,]{3,50}')}" for dot in ("_", r"\.")],
    "Amplitude": [_called(f, "[a-f0-9]{16,40}") for f in (r"amplitude\.init", r"getInstance\(\)\.init")],
    "Bing Universal Event Tracking": [_called("setAttribute", "data-tag", _PIXEL), r"UET\(\{\s*ti:\s*" + _quoted(_PIXEL)],
    "Cookiebot": [r"consent\.cookiebot\.com/uc\.js[^\"']*?cbid=([a-f0-9-]{16,40})"],
    "Drift": [_called(r"drift\.load", "[a-z0-9]{6,30}")],
    "Facebook Pixel": [_called("fbq", "init", _PIXEL), rf"connect\.facebook\.net/[^\"']+/fbevents\.js\D*({_PIXEL})"],
    "Facebook for WordPress": [_called("fbq", "init", _PIXEL)],
    "Google Ads": [_quoted(r"AW-\d{4,12}")],
    "Google Analytics": [_called("gtag", "config", _GA), rf"googletagmanager\.com/gtag/js\?id=({_GA})", _called(r"\bga", "create", _UA), _quoted(_UA)],
    "Google Tag Manager": [rf"googletagmanager\.com/(?:gtm|ns)\.[a-z]+\?id=({_GTM})", _quoted(_GTM)],
    "Google reCAPTCHA": [r"google\.com/recaptcha/api\.js[^\"']*?(?:render=)?([\w-]{20,60})"],
    "Heap": [_called(r"heap\.load", _PIXEL), r"heap\.appid\s*=\s*" + _quoted(_PIXEL)],
    "Hotjar": [r"hjid\s*[:=]\s*(\d{4,10})", r"static\.hotjar\.com/c/hotjar-(\d{4,10})\.js"],
    "HubSpot": [r"js\.hs-?scripts\.com/(\d{4,12})\.js", r"js\.hubspot\.com/web-interactives/v1/embeds/(\d{4,12})"],
    "Intercom": [f"{start}[^}}]*?app_id:\\s*{_quoted('[a-z0-9]{4,10}')}" for start in (r"intercomSettings\s*=\s*\{", r"Intercom\(\s*['\"]boot['\"]\s*,\s*\{")],
    "LinkedIn Insight Tag": [r"_linkedin_partner_id\s*=\s*" + _quoted(r"\d{4,10}")],
    "Matomo": [r"_paq\.push\(\s*\[\s*['\"]setSiteId['\"]\s*,\s*['\"]?(\d{1,6})['\"]?\s*\]", r"matomo\.php\?siteId=(\d{1,6})"],
    "Microsoft Clarity": [r"clarity\.ms/tag/([a-z0-9]{6,20})", "(?i)" + _called("clarity", "start", "[a-z0-9]{6,20}")],
    "Mixpanel": [_called(r"mixpanel\.init", "[a-f0-9]{16,40}")],
    "OneTrust": [r"(?i)dataDomain['\"=]\s*['\"]?([a-z0-9-]{16,80})['\"]?"],
    "Optimizely": [rf"cdn\.optimizely\.com/js/({_PIXEL})\.js"],
    "Pinterest Tag": [_called("pintrk", "load", r"\d{12,20}")],
    "Plausible": [r"plausible\.io/js/script\.js[?&]domain=([a-zA-Z0-9.,-]+)"],
    "PostHog": [_called(r"posthog\.init", r"[\w-]{16,80}")],
    "Segment": [_called(r"analytics\.load", "[a-zA-Z0-9]{8,40}"), r"cdn\.segment\.com/analytics\.js/v1/([a-zA-Z0-9]{8,40})"],
    "Sentry": [rf"(https://[a-f0-9]+@[a-zA-Z0-9.-]+{host}\.io/\d+)" for host in (r"\.ingest\.sentry", r"\.sentry")],
    "Stripe": [r"js\.stripe\.com/v\d+/"],
    "Tawk.to": [r"embed\.tawk\.to/([a-f0-9]{16,40})"],
    "TikTok Pixel": [_called(r"ttq\.load", "[A-Z0-9]{12,30}"), r"tiktok\.com/i18n/pixel/events\.js\?sdkid=([A-Z0-9]{12,30})"],
    "Twitter Ads": [_called("twq", "config", "[a-z0-9]{4,12}")],
    "Yandex Metrica": [r"ym\(\s*(\d{6,12})\s*,\s*['\"]init['\"]"],
    "Zendesk Chat": [r"static\.zdassets\.com/ekr/snippet\.js\?key=([a-f0-9-]{16,40})"],
}


def provider_ids(provider: str, html: str) -> list[str]:
    """Distinct ids of one provider, pattern by pattern in the order they appear."""
    return list(dict.fromkeys(m[1] if m.re.groups else m[0] for p in TAG_IDS.get(provider, []) for m in re.finditer(p, html)))


def tag_ids(html: str) -> dict[str, list[str]]:
    """All providers that have ids in the page."""
    found = {k: provider_ids(k, html) for k in TAG_IDS}
    return {k: v for k, v in found.items() if v}


def assembled_tags(detections: list[dict], html: str) -> dict:
    """Detected technologies (name, categories, version, confidence) as a map by category and as entries, one for each id. Without a category they are Other; the detection itself needs a fingerprint base that isn't supplied."""
    detected: dict[str, dict] = {}
    entries = []
    for d in detections:
        if not d.get("name"):
            continue
        ids = provider_ids(d["name"], html)
        more = {k: d[k] for k in ("version", "confidence") if d.get(k) is not None}
        categories = [c for c in d.get("categories") or [] if isinstance(c, str)]
        for c in categories or ["Other"]:
            detected.setdefault(c, {})[d["name"]] = {"ids": ids, **more}
        entries += [{"provider": d["name"], "categories": categories, **more, "sources": [{"type": "html"}], **({"id": i} if i else {})} for i in ids or [None]]
    return {"detected": detected, "entries": entries}


def empty_meta() -> dict:
    """What every page's record has."""
    return {"title": "", "origin_trial": [], "json_ld": [], "speculation_rules": [], "tags": {"detected": {}, "entries": []}, "others": {}}


class _Main(Handler):
    """Counts within one element, chosen by its start offset."""

    def __init__(self, start: int) -> None:
        self.start, self.depth, self.silent = start, 0, 0
        self.done = False
        self.counts = dict.fromkeys(("headings", "images", "tables", "buttons", "iframes", "media", "characters"), 0)
        self.headings: list[tuple[int, str]] = []
        self.heading: list[str] | None = None

    def opened(self, name: str, attrs: dict, start: int, end: int) -> None:
        if self.done or not self.depth and start != self.start:
            return
        self.depth += 1
        self.silent += name in ("script", "style")
        for key, tags in (("images", ("img",)), ("tables", ("table",)), ("buttons", ("button",)), ("iframes", ("iframe",)), ("media", ("video", "audio"))):
            self.counts[key] += name in tags
        if re.fullmatch("h[1-6]", name):
            self.counts["headings"] += 1
            self.headings.append((int(name[1]), ""))
            self.heading = []

    def closed(self, name: str, start: int, end: int) -> None:
        if not self.depth:
            return
        self.depth -= 1
        self.silent -= name in ("script", "style")
        if re.fullmatch("h[1-6]", name) and self.heading is not None:
            self.headings[-1] = (self.headings[-1][0], " ".join("".join(self.heading).split()))
            self.heading = None
        self.done = not self.depth

    def text(self, data: str) -> None:
        if self.depth and not self.silent:
            self.counts["characters"] += len(re.sub(r"\s+", "", data))
            if self.heading is not None:
                self.heading.append(data)


class _Elements(Handler):
    def __init__(self) -> None:
        self.found: list[tuple[str, dict, int]] = []

    def opened(self, name: str, attrs: dict, start: int, end: int) -> None:
        self.found.append((name, attrs, start))


def main_content(html: str) -> dict | None:
    """Which element holds the main content, and what it holds; null where nothing qualifies."""
    walk = _Elements()
    parse(html, walk)

    def fits(rule: str, name: str, attrs: dict) -> bool:
        if rule[0] == "#":
            return attrs.get("id") == rule[1:]
        if rule[0] == ".":
            return rule[1:] in (attrs.get("class") or "").split()
        return attrs.get("role") == "main" if rule[0] == "[" else name == rule

    for rule in MAIN:
        hit = next((x for x in walk.found if fits(rule, x[0], x[1])), None)
        if hit:
            break
    else:
        rule, hit = next(((f"{k}*={v}", x) for k, v in PARTS for x in walk.found if x[0] not in ("html", "head", "meta", "link", "script") and v in (x[1].get(k) or "").lower()), (None, None))
    if not hit:
        return None
    count = _Main(hit[2])
    parse(html, count)
    return {"rule": rule, "tag": hit[0], **count.counts, "outline": count.headings}
