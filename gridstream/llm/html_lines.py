"""HTML extraction by line-block distribution.

A page becomes a list of lines, one per block element. Lines of elements that
never hold article text (menus, forms, scripts, ...) count as blank. The text
lengths are summed over a sliding window of lines; where the sum surges, text
begins, and where it dives to nothing, text ends; lines between are kept.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, ship

WINDOW = 3
SURGE = 86
LINK_SHARE = 0.6
WEIGHT = 4  # by which a named article lowers the threshold of its lines and raises that of the others
HELD = 1 / 3  # share of the text that a named article must hold to count
PAGE_FORM = 1 / 2  # a form that holds more of the page's text is no form, but wraps the page

# Element names of HTML with a meaning for the layout.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select", "xmp")
BOILER = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "audio", "video"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
HOLDERS = {"article", "main", "body"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in class, id or role that name parts around the article,
# and words that only say what kind of box it is ("ad-box", "site-header").
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "byline",
    "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr",
    "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay",
    "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "tags", "teaser", "toolbar", "topbar", "widget", "widgets",
}
BOXES = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "col", "container", "content", "form",
    "global", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel",
    "post", "posts", "primary", "reader", "right", "row", "section", "secondary", "site", "slot", "stories", "thread", "title", "top", "unit", "user", "wrap", "wrapper",
}
# What an article has itself, and words that say that such a part is an article's.
OWN = {"header", "teaser", "byline", "tags"}
ARTICLES = {"article", "content", "entry", "post", "story"}
# How a copyright line and the title of reader comments begin.
_rights = re.compile(r"(?:©|\(c\)|copyright\b(?=[\W\d]*(?:©|\(c\)|\d{4})))", re.I)
_comments = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|kommentare|commentaires|comentarios)(?: ?\(\d+\)|:)?", re.I)

# No unquoted part of a tag goes beyond the next "<", so that broken tags are not read twice.
_inside = r"(?:[^<>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
_raw = "|".join(RAW)
_token = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_raw})\b{_inside}(?<!/)>.*?(?:</(?P=raw)\b[^<>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>{_inside})>|<[!?][^<>]*>",
    re.S | re.I,
)
_attribute = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_part = re.compile(r"[-_]+")


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"' ").lower() for name, value in reversed(_attribute.findall(raw))} if raw else {}


def _named(attributes: dict[str, str], inside: bool) -> bool:
    """Whether a whole word of class, id or role names such a part, alone or with
    words for boxes and other such parts. An article's own header, teaser, byline
    and tags are none, inside it or where the other words name it."""
    for name in ("class", "id", "role"):
        for word in attributes.get(name, "").split():
            parts = [word] if word in NAMES else _part.split(word)
            own = inside or not ARTICLES.isdisjoint(parts)
            found = [p for p in parts if p in NAMES and not (own and p in OWN)]
            if found and all(p in NAMES or p in BOXES or p in ARTICLES or p.isdigit() for p in parts):
                return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None


def page_lines(page: str) -> tuple[list[tuple[str, int, int, bool]], bool]:
    """(text, its length, length inside links, inside an article) per line, and
    whether the page names its article. A line is a block's text; a skipped part
    is one blank line. A form is skipped unless it holds most of the page's text."""
    lines, named, sizes = _parsed(page, -1)
    if sizes and max(sizes) > PAGE_FORM * (sum(sizes) + sum(n for _, n, _, _ in lines)):
        lines, named, _ = _parsed(page, sizes.index(max(sizes)))
    return lines, named


def _parsed(page: str, wrapper: int) -> tuple[list[tuple[str, int, int, bool]], bool, list[int]]:
    """The lines, whether an article is named, and the length of each skipped
    form's text; the form of the number ``wrapper`` is not skipped."""
    lines: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, article
    places: dict[str, list[int]] = {}  # of each name in the stack
    holders: list[int] = []  # places of what no stray end tag leaves
    skipped = article = anchor = 0
    named = False
    sizes: list[int] = []  # of forms, by their order
    forms: list[tuple[int, int]] = []  # places and numbers of open forms

    def close_line() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            lines.append((text, len(text), min(linked, len(text)), article > 0))
        parts.clear()
        linked = 0

    def pop(upto: int) -> None:
        nonlocal skipped, article, anchor
        while len(stack) > upto:
            name, was_skipped, was_article = stack.pop()
            places[name].pop()
            if name in HOLDERS:
                holders.pop()
            if name == "form":
                forms.pop()
            skipped -= was_skipped
            article -= was_article
            anchor -= name == "a"

    at = 0
    for m in _token.finditer(page):
        if m.start() > at and not skipped:
            text = html_lib.unescape(page[at : m.start()])
            parts.append(text)
            if anchor:
                linked += len(text.strip())
        elif m.start() > at and skipped == 1 and forms and stack[forms[-1][0]][1]:
            sizes[forms[-1][1]] += len(page[at : m.start()].strip())
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close_line()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            if (own := places.get(tag)) and (tag in HOLDERS or tag == "html" or not holders or own[-1] >= holders[-1]):
                pop(own[-1])
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if tag in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and stack and stack[-1][0] == tag:
                pop(len(stack) - 1)
            attributes = _attributes(m["attrs"])
            main = tag in ("article", "main") or not {"main", "article"}.isdisjoint(attributes.get("role", "").split())
            named_so = bool(attributes) and tag not in ("body", "html", "main") and (_named(attributes, article > 0 or main) or _hidden(attributes))
            if tag == "form":
                sizes.append(0)
                forms.append((len(stack), len(sizes) - 1))
            skip = (tag in BOILER and not (tag == "form" and len(sizes) - 1 == wrapper)) or (tag == "header" and not article) or named_so
            main = main and not skipped and not skip
            if skip and not skipped:
                close_line()
                lines.append(("", 0, 0, False))
            named = named or main
            places.setdefault(tag, []).append(len(stack))
            if tag in HOLDERS:
                holders.append(len(stack))
            stack.append((tag, skip, main))
            skipped += skip
            article += main
            anchor += tag == "a"
    if at < len(page) and not skipped:
        parts.append(html_lib.unescape(page[at:]))
    close_line()
    return lines, named, sizes


def surges(lengths: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Half-open line ranges between each surge and the dive after it. A surge
    is a line with text whose window sums to more than the threshold; a dive is
    a line from which a whole window is blank."""
    n, found, i = len(lengths), [], 0
    sums = [0] * (n + 1)
    total = 0
    for k in range(n - 1, -1, -1):
        total += lengths[k] - (lengths[k + window] if k + window < n else 0)
        sums[k] = total
    while i < n:
        if lengths[i] and sums[i] > threshold:
            j = i
            while j < n and sums[j]:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    return found


def _fullest(lengths: list[int]) -> int:
    return max((sum(lengths[k : k + WINDOW]) for k in range(len(lengths))), default=0)


def _article_lengths(lines: list[tuple[str, int, int, bool]]) -> list[int]:
    """Lengths of the article's lines. A linked title is text, and so are linked
    references; only a whole window of lines made of links that is no surge is blank."""
    linked = [inside and n > 0 and links > LINK_SHARE * n for _, n, links, inside in lines]
    menu = [False] * len(lines)
    for k in range(len(lines) - WINDOW + 1):
        if all(linked[k : k + WINDOW]) and sum(n for _, n, _, _ in lines[k : k + WINDOW]) <= SURGE:
            menu[k : k + WINDOW] = [True] * WINDOW
    return [n if inside and not listed else 0 for (_, n, _, inside), listed in zip(lines, menu, strict=True)]


def _outer_lengths(lines: list[tuple[str, int, int, bool]]) -> list[int]:
    """Lengths of the lines outside the article; lines of links, copyright lines
    and whatever follows the title of reader comments are blank."""
    out, comments = [], False
    for text, n, links, inside in lines:
        comments = comments or (not inside and n < SURGE // 2 and _comments.fullmatch(text) is not None)
        out.append(0 if inside or comments or links > LINK_SHARE * n or (n < 2 * SURGE and _rights.match(text)) else n)
    return out


def main_text(page: str | None) -> str:
    """The article of one page; blocks in page order, one per line.

    Null or empty pages give an empty text. Lines made of links count as blank,
    and the threshold is SURGE, or half the fullest window of a short page. Short
    lines between a surge and the last blank line before it belong to it.
    Where the page names its article (``article``, ``main`` or such a role) and
    that holds at least HELD of its text, the name weights the threshold: lines
    inside need SURGE / WEIGHT, and a surge there reaches back to the blank
    window before it; lines outside need SURGE * WEIGHT. An article that holds
    less (a teaser card) means nothing.
    """
    if not page:
        return ""
    lines, named = page_lines(page)
    inner = _article_lengths(lines) if named else []
    outer = _outer_lengths(lines)
    if sum(inner) and sum(inner) >= HELD * (sum(inner) + sum(outer)):
        kept = set()
        least = 0
        for a, b in surges(inner, min(SURGE // WEIGHT, _fullest(inner) // 2)):
            while a > least and any(inner[max(least, a - WINDOW) : a]):
                a -= 1
            kept.update(k for k in range(a, b) if inner[k])
            least = b
        kept.update(k for a, b in surges(outer, SURGE * WEIGHT) for k in range(a, b) if outer[k])
    else:
        lengths = _outer_lengths([(text, n, links, False) for text, n, links, _ in lines])
        kept = set()
        for a, b in surges(lengths, min(SURGE, _fullest(lengths) // 2)):
            while a > 0 and lengths[a - 1]:
                a -= 1
            kept.update(k for k in range(a, b) if lengths[k])
    return "\n".join(lines[k][0] for k in sorted(kept))


@clash_free
def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Replace the html column by the main text and its length ``n_chars``.

    Every row stays, repeated ones too; other columns pass unchanged, except
    that input columns named like the two results are replaced. A null page has
    an empty text. Each row is handled alone, so nothing is shuffled.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    keep = [F.col(c) for c in pages.columns if c not in (html, text, "n_chars")]
    return pages.select(*keep, text_of(F.col(html)).alias(text)).withColumn("n_chars", F.char_length(F.col(text)).cast("long"))
