"""Main text of HTML pages by line-block distribution.

The markup is stripped to blocks, one line each, with every line's weight: nothing inside navigation, headers, footers,
asides, forms, adverts, notices and comments, told by element or by a class, id or role that says nothing else; for the
others the length of the text outside links, or in an article or main element of all text. Sums of the weights over
sliding windows of lines show where text surges and where it dives; the lines from a surge to the dive after it are kept,
links too, unless they are boilerplate. Where an article or main element holds a third of the page's dense text or more,
its lines alone count and less text makes a surge; with less it is a teaser like any other element. A class that names boilerplate among other things ("legal-history") decides only for
lines that stand in thin text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Element names of the HTML standard by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "object", "canvas", "audio", "video", "map", "datalist", "input", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Words of class, id, role and aria-label that mark what is not the article.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "recommended",
    "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "modal", "alert",
    "overlay", "paywall", "skip", "copyright", "legal", "disclaimer", "adsense", "adslot", "adbox", "adcontainer",
}
#: Words beside the marks that do not make a class say something else.
NEUTRAL = {
    "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "content", "desktop", "feed", "footer", "form", "global", "group", "header", "holder", "icon", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "primary", "right", "section", "site", "slot", "text", "title", "top",
    "unit", "wrap", "wrapper", "zone",
}
#: Words that make a "header" one of the article and not of the page.
OWN = {"article", "entry", "post", "content", "story"}
WINDOW = 3
#: A window of lines needs so many characters to count as text, outside links; in an article, where links are text too and
#: short paragraphs stand together, so many.
DENSE, DENSE_INSIDE = 60, 10
#: An article element with less than this share of the page's dense text is not the page's article.
SHARE = 1 / 3

#: Elements nested deeper than this are read as if they were not there; browsers have such a limit as well.
DEEPEST = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=<][^\s/>=<]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s><]*")
_SPEAKING = ("class", "id", "role", "aria-label")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTENT = {"article", "main"}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


#: What an element says of its lines: text, text unless it is thin, or no text.
_TEXT, _DOUBTFUL, _BOILERPLATE = 0, 1, 2


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag from a place behind its name, whether it closes itself, and the place behind the tag.

    A value is quoted only if a quote follows the equals sign; a quote elsewhere is a character like any other, and one
    that is never closed is too. A tag that another one interrupts ends there, so no character is looked at twice.
    """
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            break
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[1].lower(), value)
    while at < len(page) and page[at] not in "<>":
        at += 1
    return found, page[at - 1 : at] == "/", at + (page[at : at + 1] == ">")


def tags(page: str):
    """(start, end, '' or '/' or '!', name, attributes, closes itself) of each tag, comment and declaration of a page."""
    at = 0
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "!", "", {}, False
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, "!", "", {}, False
        else:
            slash = page[start + 1 : start + 2] == "/"
            name = _NAME.match(page, start + 1 + slash)
            if name is None:  # a character of the text
                at = start + 1
                continue
            given, closed, at = _attributes(page, name.end())
            jump = yield start, at, "/" if slash else "", name[0].lower(), given, closed
            if jump is not None:
                at = jump


#: Marks that inside an article may head a part of it.
PARTS = {"legal"}


def _standing(name: str, given: dict[str, str], inside: bool) -> int:
    """Whether an element is boilerplate; inside: whether it stands in an article or main element."""
    if name in HIDDEN or (name == "header" and not inside):
        return _BOILERPLATE
    if not given:
        return _TEXT
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(given.get("style", "")):
        return _BOILERPLATE
    if name in ("main", "body", "html"):
        return _TEXT
    standing = _TEXT
    for key in _SPEAKING:
        for token in given.get(key, "").split():
            words = {w.lower() for w in _WORD.findall(token)}
            header = "header" in words and not inside and not words & OWN
            if inside and words & MARKS and words & MARKS <= PARTS:
                continue
            if header or (words & MARKS and words <= MARKS | NEUTRAL):
                return _BOILERPLATE
            if words & MARKS and name not in _CONTENT:
                standing = _DOUBTFUL
    return standing


def _plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, length outside links, whether inside article or main, standing) of each block that has text, in page order.

    Text and link text have their character references decoded and white space turned into single spaces. Markup need not be
    well formed: an unclosed element ends with the one around it, an end tag without a start is ignored.
    """
    out: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, standing, article or main
    opened: Counter[str] = Counter()
    flat: Counter[str] = Counter()
    dead, doubtful, content, links, at = 0, 0, 0, 0, 0

    def flush() -> None:
        if parts:
            text = _plain(parts)
            if text:
                out.append((text, 0 if dead else max(0, len(text) - len(_plain(linked))), content > 0, _BOILERPLATE if dead else _DOUBTFUL if doubtful else _TEXT))
            parts.clear()
        linked.clear()

    def pop(i: int) -> None:
        """Closes the elements from number i of the stack on."""
        nonlocal dead, doubtful, content, links
        while len(stack) > i:
            name, standing, main = stack.pop()
            opened[name] -= 1
            dead -= standing == _BOILERPLATE
            doubtful -= standing == _DOUBTFUL
            content -= main
            links -= name == "a"

    reader, jump = tags(page), None
    while True:
        try:
            start, end, kind, name, given, closed = reader.send(jump)
        except StopIteration:
            break
        jump = None
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if links:
                linked.append(piece)
        at = end
        if kind == "!":
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS or name in HIDDEN:
            flush()
        if kind == "/":
            if flat[name]:
                flat[name] -= 1
                continue
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    pop(i)
                    break
                if name not in _CONTENT and stack[i][2] and name in ("p", "b", "i", "span", "a", "em", "strong"):
                    break
            continue
        if name in RAW:
            closing = _RAW_END[name].search(page, at)
            at = jump = closing.end() if closing else len(page)  # what looks like markup inside is none
            continue
        if name in VOID:
            continue
        if name in _CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES[name]:
                    pop(i)
                    break
                if stack[i][0] in BLOCKS and stack[i][0] not in ("p",):
                    break
        elif name in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name == "body":
            for i, x in enumerate(stack):
                if x[0] == "head":
                    pop(i)
                    break
        if closed and name not in BLOCKS:
            continue
        if len(stack) >= DEEPEST:
            flat[name] += 1
            continue
        standing = _standing(name, given, content > 0)
        opened[name] += 1
        stack.append((name, standing, name in _CONTENT and not dead and standing != _BOILERPLATE))
        dead += standing == _BOILERPLATE
        doubtful += standing == _DOUBTFUL
        content += stack[-1][2]
        links += name == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def spans(weights: list[int], window: int = WINDOW, dense: int = DENSE) -> list[tuple[int, int]]:
    """(surge, dive) pairs of line numbers: the text lies in [surge, dive).

    A line is in dense ground if one of the windows that hold it sums to `dense` or more; the surge is the first line
    with weight of a run of such lines, the dive stands behind its last one.
    """
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(max(1, n - window + 1))]
    out, i = [], 0
    ground = [any(sums[j] >= dense for j in range(max(0, i - window + 1), min(i, len(sums) - 1) + 1)) for i in range(n)]
    while i < n:
        if not ground[i] or not weights[i]:
            i += 1
            continue
        j = last = i
        while j < n and ground[j]:
            if weights[j]:
                last = j
            j += 1
        out.append((i, last + 1))
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW, dense: int = DENSE) -> str:
    """The page's main text: kept blocks joined by line feeds; empty for an empty or missing page."""
    if not page:
        return ""
    lines = blocks(page)
    plain = [weight for _, weight, _, _ in lines]
    thick = [x for surge, dive in spans(plain, window, dense) for x in range(surge, dive)]
    own = sum(plain[x] for x in thick if lines[x][2])
    inside = any(main for _, _, main, _ in lines) and own >= SHARE * sum(plain[x] for x in thick)
    # Thin text behind a doubtful class weighs nothing and is dropped; in thick text the class says nothing.
    solid = set(thick)
    weights = []
    for i, (text, weight, main, standing) in enumerate(lines):
        out = standing == _BOILERPLATE or (standing == _DOUBTFUL and (i not in solid or weight < dense // window)) or (inside and not main)
        weights.append(-1 if out else len(text) if inside else weight)
    runs = spans([max(w, 0) for w in weights], window, min(dense, DENSE_INSIDE) if inside else dense)
    keep = [lines[x][0] for surge, dive in runs for x in range(surge, dive) if weights[x] >= 0]
    if not keep:  # a page of a few short lines has no dense ground
        keep = [lines[x][0] for x, w in enumerate(weights) if w > 0]
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, a row for each row of pages; other columns are ignored.

    A null or empty html gives an empty text; ids and urls may be null or repeated. Nothing is shuffled.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for rb in batches:
            texts = [main_text(x) for x in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
