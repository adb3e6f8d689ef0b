"""Operator 5: main text of web pages by tree scoring.

Markup becomes a tree.  Every paragraph-like block gives points for its length and
commas, less its share of link text, to its parent, half to the grandparent and less to
ancestors further up.  The container with the most points, discounted by its own link
density, is kept together with those siblings that score well or are headings.  An
enclosing article element wins over a container inside it, and articles beside it that
score well are kept too; one that is mostly links is a teaser.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are cut out first: by element, by role, and containers by
class and id as well.  Inside an article fewer names count, paragraphs are only cut as
adverts, and words in mid-sentence never are.

Defined results: null, empty and textless pages give an empty text; an unclosed script
or comment hides the rest of the page, as in browsers; repeated rows get equal results;
other columns are ignored; an empty table gives an empty one.  A page is worked on whole, one page at a time, without
recursion, so nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmart.llm.frames import input_columns

# Element names of the HTML standard and what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object noembed noframes xmp".split())
CUT = RAW | frozenset("head title nav aside footer form button select textarea input dialog menu audio video map datalist fieldset".split())
BLOCK = frozenset(
    "html body div article main section header hgroup p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr center nav aside footer form fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP = frozenset("html body article main".split())
CLOSED_BY = {
    "p": BLOCK - frozenset(("html", "body")),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "thead": frozenset(("tbody", "tfoot")), "tbody": frozenset(("tbody", "tfoot")), "option": frozenset(("option",)), "head": frozenset(("body",)),
}
#: What an implied end may not pass.
SCOPE = frozenset("html body table td th div article section main blockquote".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements that hold other blocks; only these are cut by a name, never words in mid-sentence.
CONTAINERS = frozenset("div section header ul ol dl table details center address".split())
_EVERYWHERE = (
    r"ads?|adv|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|sidebar\w*|menus?|navbar|nav|navigation|breadcrumbs?|footer|"
    r"cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|disqus|repl(?:y|ies)|respond|widgets?|pagination|pager|toolbar|login|signup"
)
#: Names of page furniture that mean something else inside an article (its own header, a
#: section on search or on legal questions).
_OUTSIDE = r"(?<!post[_-])(?<!entry[_-])(?<!article[_-])header|masthead|search|skip|copyright|legal|disclaimer"


def _names(alternatives: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{alternatives})(?=$|[\s_-])", re.IGNORECASE)


BAD_NAME = _names(rf"{_EVERYWHERE}|{_OUTSIDE}|side(?=$|\s)")
BAD_INSIDE = _names(_EVERYWHERE)
ADVERT = _names(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*")
COMMENTS = _names(r"comments?|disqus|repl(?:y|ies)")
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(rest)}


class Page:
    """Elements of a page as flat lists, and its blocks of text in page order."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters of links)
        self._run: list[str] = []
        self._links = 0
        self._open = [0]
        self._anchors = 0
        at, end = 0, len(markup)
        while at < end:
            token = _TOKEN.search(markup, at)
            if token is None:
                self._text(markup[at:])
                break
            self._text(markup[at : token.start()])
            at = token.end()
            name = (token["name"] or "").lower()
            if not name:
                continue
            if token["end"]:
                self._close(name)
                continue
            self._start(name, token["rest"])
            if name in RAW and not token["rest"].endswith("/>") or name in ("textarea", "title"):
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(markup, at)
                at = close.end() if close else end
                self._close(name)
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self.cut[self._open[-1]]:
            self._run.append(raw)
            if self._anchors:
                self._links += len(raw)

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._run)).split()) if self._run else ""
        if text:
            owner = next((e for e in reversed(self._open) if self.tag[e] in BLOCK or e == 0), 0)
            self.blocks.append((owner, text, min(self._links, len(text))))
        self._run.clear()
        self._links = 0

    def _pop(self, depth: int) -> None:
        for e in self._open[depth:]:
            self._anchors -= self.tag[e] == "a"
        del self._open[depth:]

    def _start(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self._flush()
        elif name == "br":
            self._run.append(" ")
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if name in CLOSED_BY.get(tag, ()):
                self._flush()
                self._pop(depth)
                break
            if tag in SCOPE or tag in LISTS:
                break
        parent = self._open[-1]
        element = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.cut.append(self.cut[parent] or self._unwanted(name, rest))
        if self.cut[element] and not self.cut[parent]:
            self._flush()
        if name not in VOID and not rest.endswith("/>"):
            self._open.append(element)
            self._anchors += name == "a"

    def _unwanted(self, name: str, rest: str) -> bool:
        if name in CUT:
            return True
        inside = any(self.tag[e] in ("article", "main") for e in self._open)
        if name == "header" and not inside:
            return True
        if len(rest) < 3 or name in ("html", "body"):
            return False
        attributes = _attributes(rest)
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
            return True
        if attributes.get("role", "").lower() in BAD_ROLE:
            return True
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        if name in KEEP or name == "header":
            return bool(COMMENTS.search(names))
        if name in CONTAINERS:
            return bool((BAD_INSIDE if inside else BAD_NAME).search(names))
        return name in BLOCK and bool(ADVERT.search(names))

    def _close(self, name: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == name:
                if name in BLOCK or self.cut[self._open[depth]]:
                    self._flush()
                self._pop(depth)
                return
            if name not in BLOCK and self.tag[self._open[depth]] in SCOPE:
                return
        if name == "p":
            self._flush()


def main_blocks(markup: str | None) -> list[str]:
    """The blocks of text of a page's article, in page order."""
    if not markup:
        return []
    page = Page(markup)
    if not page.blocks:
        return []
    parent, tag = page.parent, page.tag
    score, chars, links = ([0.0] * len(tag) for _ in range(3))
    for element, text, linked in page.blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        if len(text) < 25:
            points *= len(text) / 50
        # A block's own element takes the points for its parent; text that stands right
        # in a container counts for the container itself.
        e = parent[element] if tag[element] in BLOCK - LISTS - {"div", "section", "article", "main", "td", "body"} else element
        level = 0
        while e > 0:
            score[e] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e, level = parent[e], level + 1
            if level > 5:
                break
    for element, text, linked in page.blocks:
        chars[element] += len(text)
        links[element] += linked
    for e in range(len(tag) - 1, 0, -1):
        chars[parent[e]] += chars[e]
        links[parent[e]] += links[e]
    final = [s * (1 - links[e] / chars[e]) if chars[e] else 0.0 for e, s in enumerate(score)]
    best = max(range(len(tag)), key=lambda e: (final[e], -e))
    if final[best] <= 0:
        best = 0
    e = best
    while e > 0:
        if tag[e] == "article":
            best = e
        e = parent[e]
    kept = {best}
    if tag[best] == "article":  # a text in several articles side by side
        for e in range(1, len(tag)):
            if tag[e] == "article" and parent[e] == parent[best] and not page.cut[e] and chars[e]:
                if final[e] >= max(2.0, 0.2 * final[best]) and links[e] / chars[e] < 0.5:
                    kept.add(e)
    elif tag[best] not in ("body", "html", "#root"):
        for e in range(1, len(tag)):
            if e != best and parent[e] == parent[best] and not page.cut[e] and chars[e]:
                density = links[e] / chars[e]
                good = final[e] >= max(2.0, 0.2 * final[best]) or tag[e] in HEADINGS
                good = good or (tag[e] in ("p", "pre", "blockquote") and density < 0.25)
                if good and density < 0.5:
                    kept.add(e)
    inside = [False] * len(tag)
    for e in range(len(tag)):
        teaser = tag[e] == "article" and links[e] >= 0.5 * chars[e]
        inside[e] = e in kept or (e > 0 and inside[parent[e]] and not teaser)
    return [text for element, text, _ in page.blocks if inside[element]]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            texts = ["\n".join(main_blocks(page)) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = input_columns(pages, "page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
