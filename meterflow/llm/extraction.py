"""Main-text extraction from HTML by the line-block distribution.

Markup is stripped into lines, one per text block; the length of a line is its text outside links.  Elements that
never hold article text (navigation, page header and footer, sidebars, notices, adverts, forms, scripts, styles,
reader comments) leave a gap of empty lines; wrappers that hold the page's article or main element, headings and
outermost articles are not judged by their class or id, sections inside an article not by their id.  With window sums over ``window`` lines, a surge is a window above
``threshold`` after a gap and the dive is the next window without text; what stands between is kept, short lines
included.  What is dropped between two paragraphs, headings, list items or quotations leaves no gap, so that a short one
beside it is not cut off.  Inside a marked article or main element no gap ends the text; where such an element holds text, the
runs of lines outside it are none of the article.

Edge cases: null or empty html gives ""; a page without a surge gives its block of lines with the longest text;
unclosed tags, comments and quotes end with the page, an unclosed boilerplate element also before an article or main element;
a CDATA section is a comment, as browsers take it; very long pages are read whole in one pass; repeated rows
give repeated results; nulls in other columns and extra columns are left alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\s(hidden)(?=[\s>/])", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head"}
BLOCK = set(
    "address article aside blockquote body br center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AUTO_CLOSED = {"p", "li", "dt", "dd", "option", "tr", "td", "th", "thead", "tbody", "tfoot"}
#: A class or id name is boilerplate if its parts are such words, or such words and parts of ``FURNITURE`` alone.
ASIDE_WORD = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|disclaimer|sidebar|side|aside|"
    r"comments?|commentlist|respond|replies|reply|disqus|discussion|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|"
    r"topbar|toolbar|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|popup|modal|overlay|login|signup|search|pagination|pager|widget|skip|hidden)\d*"
)
FURNITURE = re.compile(
    r"(?:site|page|main|global|primary|secondary|left|right|top|bottom|box|bar|block|wrap|wrapper|container|inner|outer|holder|row|col|column|area|panel|section|group|"
    r"list|lists|items?|links?|buttons?|btns?|icons?|forms?|fields?|posts?|articles?|stories|story|news|media|slots?|units?|threads?|users?|reader|header|title|text|"
    r"label|message|policy|sticky|fixed|mobile|desktop|js|id|the|to|and|us|in|on|up|email|rail|region|module|component|content|d?fp|google)?\d*"
)
#: Blocks of running text.
PROSE = {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED = {"article", "main"}
ASIDE_NAMES = {"nav", "footer", "aside", "head", "header", "menu"}
UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)", re.I | re.S)
MARK = re.compile(r"<(/?)(article|main)\b[^>]*>", re.I)
TAG = re.compile(r"<[^>]*>")
ASIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
SPACE = re.compile(r"\s+")


def _aside_name(value: str, inside: bool) -> bool:
    """Whether one of the names in a class or id is that of boilerplate."""
    for word in value.lower().split():
        parts = re.split(r"[_-]+", word)
        if len(parts) > 1 and (parts[0] in ("has", "no", "with") or parts[-1] in ("open", "content")):
            continue
        known = [bool(ASIDE_WORD.fullmatch(p)) or p == "header" and not inside for p in parts]
        if any(known) and all(k or FURNITURE.fullmatch(p) for k, p in zip(known, parts, strict=True)):
            return True
    return False


def _boilerplate(name: str, tag: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if name in ("html", "body", "main") or "=" not in tag and "hidden" not in tag:
        return False
    for kind, a, b, c, hidden in ATTRIBUTE.findall(tag):
        value, kind = a or b or c, kind.lower()
        if hidden or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if kind == "role" and value.lower() in ASIDE_ROLE:
            return True
        if kind not in ("class", "id") or name in HEADINGS or name == "article" and not inside or name == "section" and inside and kind == "id":
            continue
        if _aside_name(value, inside):
            return True
    return False


def _hidden(tag: str) -> bool:
    return any(h or k.lower() == "aria-hidden" and (a or b or c) == "true" or k.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I) for k, a, b, c, h in ATTRIBUTE.findall(tag))


class _Principal:
    """The page's longest outermost article or main element; one article that holds little of the page's text is none."""

    def __init__(self, page: str):
        self.page = UNSEEN.sub(lambda m: " " * len(m.group()), page)
        self.start: int | None = None

    def _find(self) -> int:
        spans, depth, begin = [], 0, 0
        for m in MARK.finditer(self.page):
            if m[1]:
                depth = max(0, depth - 1)
                if not depth:
                    spans.append((begin, m.start()))
            else:
                begin = begin if depth else m.start()
                depth += 1
        if depth:
            spans.append((begin, len(self.page)))
        size = lambda a, b: len(SPACE.sub("", TAG.sub("", self.page[a:b])))
        most, start = max(((size(a, b), a) for a, b in spans), default=(0, -1))
        return start if self.page[start : start + 5].lower() == "<main" or 4 * most >= size(0, len(self.page)) else -1

    def within(self, name: str, at: int) -> bool:
        """Whether an element whose opening tag ends at ``at`` holds it."""
        depth, end = 1, len(self.page)
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
            depth += -1 if m[1] else (0 if m.group().endswith("/>") or name in AUTO_CLOSED else 1)
            if not depth:
                end = m.start()
                break
        if not MARK.search(self.page, at, end):
            return False
        if self.start is None:
            self.start = self._find()
        return at <= self.start < end


def lines_of(page: str, gap: int) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, length outside links, inside an article) of each line, gaps as empty lines; whether the page marks an article."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    prose: list[bool | None] = []  # of each line whether it is one of ``PROSE``; None for the gap of what is dropped
    block = ""
    linked = drop = article = 0
    drop_name, marked, in_link, at = "", False, False, 0
    principal: _Principal | None = None
    last: dict[str, int] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                lines.append((text, max(0, len(text) - linked), article > 0))
                prose.append(block in PROSE)
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not drop:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def closed(name: str) -> int:
        """Where the last closing tag of a name stands, -1 without one."""
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}\b", page, re.I)), default=-1)
        return last[name]

    def leave(dropped: bool = True) -> None:
        close()
        lines.extend([("", 0, False)] * gap)
        prose.extend([None if dropped else False] * gap)

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        tag, at = m.group(), m.end()
        if tag[1] in "!?":  # a comment, as a CDATA section is one in a page
            continue
        name, closing = NAME.match(tag)[1].lower(), tag[1] == "/"
        if name in RAW and not closing:
            if tag.endswith("/>"):
                continue
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if drop:
            if name == drop_name:
                drop += -1 if closing else (0 if tag.endswith("/>") or name in AUTO_CLOSED else 1)
                if not drop:
                    leave()
            elif not closing and (drop_name == "head" and name in ("body", *MARKED) or name in MARKED and at > closed(drop_name)):
                drop = 0
                leave()
            if drop:
                continue
            if closing:
                continue
        if name == "a":
            in_link = not closing
        if not closing and name not in VOID and not tag.endswith("/>") and _boilerplate(name, tag, article > 0):
            holds = False
            if not article and name not in ASIDE_NAMES and not _hidden(tag):
                principal = principal or _Principal(page)
                holds = principal.within(name, at)
            if not holds:
                leave()
                drop, drop_name = 1, name
                continue
        if name in ("article", "main"):
            leave(dropped=False) if not article else close()
            block = ""
            article = max(0, article + (-1 if closing else 1))
            marked = True
        elif name in BLOCK:
            close()
            block = "" if closing else name
    close()
    return [x for x, keep in zip(lines, _gaps(prose), strict=True) if keep], marked


def _gaps(prose: list[bool | None]) -> list[bool]:
    """Which lines stay: all but the gaps that what is dropped leaves between two lines of prose."""
    keep, i = [True] * len(prose), 0
    while i < len(prose):
        j = i
        while j < len(prose) and prose[j] is None:
            j += 1
        if j > i and i and j < len(prose) and prose[i - 1] and prose[j]:
            keep[i:j] = [False] * (j - i)
        i = max(j, i + 1)
    return keep


def _runs(lines: list[tuple[str, int, bool]], window: int) -> Iterator[tuple[int, int, int, bool]]:
    """Runs of lines from a surge to the dive, the next window without text: first and stop line, the most text of a window, and
    whether they are an article's, inside which nothing is a gap."""
    n, total = len(lines), [0]
    for _, size, _ in lines:
        total.append(total[-1] + size)
    block = [total[min(i + window, n)] - total[i] for i in range(n)]
    i = 0
    while i < n:
        start, inside = i, lines[i][2]
        if inside:
            while i < n and (lines[i][2] or not lines[i][0] and any(x[2] for x in lines[i : i + window + 1])):
                i += 1
        elif block[i]:
            while i < n and block[i] and not lines[i][2]:
                i += 1
        else:
            i += 1
            continue
        yield start, i, max(block[start:i]), inside


def main_text(page: str | None, window: int = 3, threshold: int = 80) -> str:
    """The text between surge and dive points of the line-block distribution."""
    if not page:
        return ""
    lines, _ = lines_of(page, window)
    runs = list(_runs(lines, window))
    size = lambda run: sum(x[1] for x in lines[run[0] : run[1]])
    article = [r for r in runs if r[3] and size(r)]
    kept = article or [r for r in runs if r[2] > threshold] or sorted(runs, key=lambda r: (-size(r), r[0]))[:1]
    return "\n".join(text for start, stop, _, _ in kept for text, _, _ in lines[start:stop] if text)


def extract(pages: DataFrame, html: str = "html", window: int = 3, threshold: int = 80) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) added, input columns of these names replaced, ``html`` left out."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda page: main_text(page, window, threshold))

    return pages.withColumn("text", run(F.col(html))).withColumn("n_chars", F.length("text").cast("long")).drop(html)


def op3_extract_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
