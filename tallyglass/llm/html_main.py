"""Main text of web pages by tree scoring.

Each block of text (a paragraph) earns points for its length and commas and
passes them to its ancestors: all to the parent, half to the grandparent, less
further up. A container's points are discounted by the share of its text that
stands in links. The best container (within an ``article`` or ``main``, if one has text) is kept, or the outermost ``article`` or ``main``
around it, with what stands directly beside it and those of its siblings that hold an article, a
main heading, or, where the page marks no article, ``SIBLING`` of its points or a paragraph of ``LONG`` characters.
Lists of links beside it go.

Page furniture is left out wherever it stands. Elements that are furniture by name,
role or style (menus, footers, sidebars, scripts, hidden ones) go outright. Forms,
page headers and elements whose class or id holds a word of furniture (adverts,
notices, comments) are suspects. They go where anything outside them holds an ``h1``, ``main`` or ``article``, unless they
hold one themselves and nothing outside does. On a page without any, adverts, forms, notices and comments go if there is other text,
and a weaker word only loses to over ``OUTWEIGHS`` times its points, so that a word alone
empties no page. Readers' comments stay only where they hold the page's heading.
Within a line class words say nothing, but for those of adverts.

Cases: null, empty or tagless html: what text there is counts as one block of
the body, none gives an empty string. Tags may be unclosed or crossed; an end
tag without a start is ignored, but for </p> and </br>, which end a block. Furniture that only the page's end closes
doesn't hide the rest of the page. Of equal
scores the container that begins first stays. Repeated rows each get their text;
columns that aren't named are ignored, whatever their names; an empty table
gives no rows. Pages may be of any length; memory follows the longest page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Elements of HTML by their part in the page.
DROPPED = frozenset("nav footer aside script style noscript template iframe svg canvas button select textarea input option datalist dialog menu object embed audio video map head title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption tr summary address".split())
HOLDERS = frozenset("html body div section article main header form ul ol dl table tbody thead tfoot figure details center fieldset hgroup td th".split())
CLOSES_P = BLOCKS | HOLDERS | {"hr", "nav", "footer", "aside", "form"}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side|comments?|commentlist|discussions?|talkback|reactions|disqus\w*|replies|respond|cookies?|consent|gdpr|notices?|alert|"
    r"popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer\w*|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|search|widget\w*|toc|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|$)", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|discussions?|talkback|reactions|disqus\w*|replies|respond)(?:$|[\s_-])", re.I)
#: Of the words above those that hardly name a part of an article, and of these the adverts.
CLEAR = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|subscribe|newsletter|signup|login)(?:$|[\s_-])", re.I)
ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*)(?:$|[\s_-])", re.I)
LINK_SHARE = 0.5
OUTWEIGHS = 2
SIBLING = 0.2
LONG = 80

PLAIN, SUSPECT, UNWANTED, REMARKS, GONE = range(5)
MARKS = ("h1", "main", "article")


def standing(name: str, attrs: str, inside_article: bool) -> int:
    """PLAIN; SUSPECT, UNWANTED or REMARKS (readers' comments), which need a second look; or GONE."""
    if name in DROPPED:
        return GONE
    found = UNWANTED if name == "form" else SUSPECT if name == "header" and not inside_article else PLAIN
    if not attrs or name in ("html", "body", "article", "main"):
        return found
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GONE
        if key in ("class", "id") and FURNITURE.search(value):
            if name not in BLOCKS and name not in HOLDERS:
                found = max(found, GONE if ADVERT.search(value) else PLAIN)
            else:
                found = max(found, REMARKS if COMMENTS.search(value) else UNWANTED if CLEAR.search(value) else SUSPECT)
    return found


def points(text: str) -> float:
    """What a paragraph earns: for being one, for commas, and for its length."""
    size = len(text)
    return (1.0 if size >= 25 else size / 25) + text.count(",") + text.count("，") + min(size / 100, 3.0)


class Page:
    """Containers (parent, depth, first block), suspects, and the blocks of text that stand in them."""

    def __init__(self, source: str, plain: frozenset[int] = frozenset()):
        self.parents, self.marked = [-1], [False]  # marked: an article or main
        self.suspects: list[list] = []  # [suspect around it or -1, kind, holds an h1, main or article]
        self.marks = 0  # of those outside suspects
        self.plain, self.unclosed = plain, set()  # starts of furniture that is read as any container; of furniture that only the page's end closes
        self.blocks: list[tuple[int, str, int, bool, int]] = []  # (container, text, characters in links, heading, suspect or -1)
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, int, int, int, int]] = []  # open elements that matter: name, container, whether gone, suspect, start
        self.open: Counter[str] = Counter()
        self.hidden = 0
        self._read(source)

    def _flush(self) -> None:
        if self.parts and not self.hidden:
            text = SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                name, holder, _, suspect, _ = self.stack[-1] if self.stack else ("", 0, 0, -1, 0)
                self.blocks.append((holder, text, len(SPACES.sub(" ", "".join(self.linked)).strip()), name in HEADINGS, suspect))
            self.parts, self.linked = [], []

    def _pop(self, last: bool = False) -> str:
        name, _, gone, _, start = self.stack.pop()
        self.hidden -= gone
        if last and gone:
            self.unclosed.add(start)
        self.open[name] -= 1
        return name

    def _read(self, source: str) -> None:
        stack, at, size, links = self.stack, 0, len(source), 0
        # Inline elements need no entry unless they are gone; links are counted.
        while at < size:
            m = TOKEN.search(source, at)
            if not self.hidden and (m is None or m.start() > at):
                piece = html.unescape(source[at : m.start() if m else size])
                self.parts.append(piece)
                if links:
                    self.linked.append(piece)
            if m is None:
                break
            start, at = m.start(), m.end()
            name = m["name"]
            if name is None:
                if m["cdata"] and not self.hidden:
                    self.parts.append(m["cdata"])
                continue
            name = name.lower()
            if m["end"]:
                if name == "a":
                    links = max(0, links - 1)
                elif self.open[name]:
                    if name in BLOCKS or name in HOLDERS:
                        self._flush()
                        links = 0
                    while self._pop(name in ("body", "html")) != name:
                        pass
                elif name in ("p", "br"):
                    self._flush()
                continue
            if name == "a":
                links = 1
                continue
            if name in ("br", "hr"):
                self._flush()
                continue
            if name in RAW:
                ends = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                if ends:
                    at = ends.end()
                    continue
                if name in ("script", "style", "textarea"):
                    break
            known = name in BLOCKS or name in HOLDERS
            kind = PLAIN if start in self.plain else standing(name, m["attrs"], self.open["article"] + self.open["main"] > 0)
            if not known and kind == PLAIN and start not in self.plain:
                continue
            cell = name in ("td", "th")
            if cell and not self.hidden:
                self.parts.append(" ")
            elif known or name in CLOSES_P:
                self._flush()
            if name in CLOSES_P and stack and stack[-1][0] == "p" or name in ("li", "tr", "dt", "dd") and stack and stack[-1][0] == name:
                self._pop()
            if m["attrs"].endswith("/") or name in VOID:
                continue
            _, holder, _, suspect, _ = stack[-1] if stack else ("", 0, 0, -1, 0)
            gone = kind == GONE
            if kind != PLAIN and not gone:
                self.suspects.append([suspect, kind, False])
                suspect = len(self.suspects) - 1
            if name in MARKS and not self.hidden:
                outer = suspect
                self.marks += outer < 0
                while outer >= 0 and not self.suspects[outer][2]:
                    self.suspects[outer][2] = True
                    outer = self.suspects[outer][0]
            if (name in HOLDERS or not known) and not cell and not gone:
                self.parents.append(holder)
                self.marked.append(name in ("article", "main"))
                holder = len(self.parents) - 1
            self.hidden += gone
            self.open[name] += 1
            stack.append((name, holder, int(gone), suspect, start))
        self._flush()
        while stack:
            self._pop(True)

    def _cleared(self) -> list[tuple[int, str, int, bool]]:
        """The blocks without those of suspects that go."""
        n = len(self.suspects)
        worth, chars, linked = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # of a suspect's own blocks; the last: outside
        for _, text, links, heading, suspect in self.blocks:
            if not heading:
                worth[suspect] += points(text)
                chars[suspect] += len(text)
                linked[suspect] += links
        value = [w * (1 - min(1.0, k / max(1, c))) for w, k, c in zip(worth, linked, chars, strict=True)]
        stays = [False] * n + [True]
        for i, (outer, _, marked) in enumerate(self.suspects):  # suspects stand after those around them
            stays[i] = marked and not self.marks and stays[outer]
        if self.marks or any(stays[:n]):
            return [b[:4] for b in self.blocks if stays[b[4]]]
        while True:
            clear = sum(v for v, s in zip(value, stays, strict=True) if s)
            words = [kind == SUSPECT or kind == UNWANTED and not clear for _, kind, _ in self.suspects]
            able = [i for i in range(n) if not stays[i] and stays[self.suspects[i][0]] and words[i] and linked[i] <= LINK_SHARE * chars[i]]
            inner = [0.0] * n  # the most that a suspect or one within it holds
            for i in range(n - 1, -1, -1):
                inner[i] = max(inner[i], value[i])
                outer = self.suspects[i][0]
                if outer >= 0 and words[i]:
                    inner[outer] = max(inner[outer], inner[i])
            best = max(able, key=lambda i: (inner[i], -i), default=-1)
            if best < 0 or inner[best] <= OUTWEIGHS * clear:
                return [b[:4] for b in self.blocks if stays[b[4]]]
            stays[best] = True

    def text(self) -> str:
        """The blocks of the best container, of what stands beside it and of its siblings that belong to it, in page order."""
        blocks = self._cleared()
        if not blocks:
            return ""
        n = len(self.parents)
        score, size, linked, good = [0.0] * n, [0] * n, [0] * n, [0.0] * n
        own, own_linked = [0] * n, [0] * n
        headed, long = [False] * n, [False] * n
        for holder, text, links, heading in blocks:
            if not heading:
                own[holder] += len(text)
                own_linked[holder] += links
            got, level, node = points(text), 0, holder
            while node >= 0:
                score[node] += got if level == 0 else got / (2 * level)
                size[node] += len(text)
                linked[node] += links
                headed[node] = headed[node] or heading
                long[node] = long[node] or not heading and len(text) >= LONG and links <= LINK_SHARE * len(text)
                level, node = level + 1, self.parents[node]
        for i in range(n):
            good[i] = score[i] * (1 - min(1.0, linked[i] / max(1, size[i])))
        within = self.marked[:]
        for i in range(1, n):
            within[i] = within[i] or within[self.parents[i]]
        # where the page marks an article with any text, the best container is sought there
        best = max([i for i in range(n) if within[i] and good[i] > 0] or range(n), key=lambda i: (good[i], -i))
        root = node = best
        while node >= 0:
            if self.marked[node]:
                root = node
            node = self.parents[node]
        around, node = {root}, self.parents[root]
        while node >= 0:
            around.add(node)
            node = self.parents[node]
        holds_mark = self.marked[:]
        for i in range(n - 1, 0, -1):
            if holds_mark[i]:
                holds_mark[self.parents[i]] = True
        inside, kept = [False] * n, [False] * n  # the best container; the root, what is around it, and siblings
        for i in range(n):
            outer = self.parents[i]
            inside[i] = i == best or outer >= 0 and inside[outer]
            if i in around:
                kept[i] = True
            elif outer == root or outer not in around:
                kept[i] = kept[outer]
            else:
                kept[i] = holds_mark[i] if self.marked[root] else headed[i] or long[i] or good[i] >= SIBLING * good[best]
        listed = [own_linked[i] > LINK_SHARE * own[i] for i in range(n)]
        return "\n".join(text for holder, text, links, heading in blocks if kept[holder] and (inside[holder] or heading or not (listed[holder] and links > LINK_SHARE * len(text))))


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    return (Page(source, frozenset(page.unclosed)) if page.unclosed else page).text()


def extract_main(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the ``keep`` columns, text and n_chars (code points) of every page."""
    kinds = dict(pages.dtypes)
    schema = ", ".join([f"page_id {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch.pop("html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    chosen = [f"`{id_col}` AS page_id", *(f"`{c}`" for c in keep), f"`{html_col}` AS html"]
    return pages.selectExpr(*chosen).mapInPandas(run, schema)
