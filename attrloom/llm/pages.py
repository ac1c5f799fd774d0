"""Main text of web pages by composite text density.

Every element gets its characters per tag, adjusted by links: the logarithm's base grows where its characters stand in links, so
link lists sink and running text rises. The sum of an element's children's densities tells containers of text from the text
itself; the element with the largest sum is the core of the page. The least density on the way from it up to the body is
the threshold, and elements at or above it give their own best subtree as text as well.

Elements that are never an article (menus, forms, scripts, hidden parts, and those whose class or id says advert, notice,
comments and the like) are taken out before densities are computed, so that a short article is not beaten by a long notice.

Text is cut into blocks at block elements; inside a block white space becomes one space, a line break counts as
white space. Reading is by one expression per token, in time linear in the page; no element is visited recursively, so neither
depth nor broken markup matters.

Defined results: a null or empty page, and one without text, give an empty text; a page without markup is one block; unclosed elements
end with the page; an unclosed script or comment hides the rest, as in a browser; repeated pages give a row each; extra
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrloom.llm.common import record_batch, row_blocks, table

#: Element names as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math object canvas audio video "
                   "select option button input form nav footer aside dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
                  "tfoot th thead tr ul".split())
#: Marks inside running text; they split no text, so they do not count as tags.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends these open elements, up to the nearest of the elements that hold them.
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words in a class or id that mark what is no article, and words beside them that say otherwise ("has-sidebar").
MARKS = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                  "gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar sidenav rail widget widgets menu nav "
                  "navbar navigation breadcrumb breadcrumbs masthead topbar toolbar footer copyright legal comment comments disqus respond "
                  "reply replies related recommended recommendations share sharing social pagination pager login search form teaser teasers "
                  "skip tracking".split())
TALK = frozenset("comment comments disqus respond reply replies".split())
UNLESS = frozenset("has have with no without open closed enabled disabled on off content article main post entry body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z][^>]*>?",
                   re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def says_otherwise(name: str) -> bool:
    words = {w.lower() for w in WORD.findall(name)}
    return not words & MARKS or bool(words & UNLESS)


class Tree:
    """A page as parallel lists: elements in page order, and the texts with their element and block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.gone, self.talk = ["#page"], [-1], [False], [False]
        self.text: list[tuple[int, int, str]] = []
        self._stack, self._open, self._wall, self.block = [0], {}, [0], 0
        at = 0
        for token in TOKEN.finditer(page) if "<" in page else ():
            if token.start() < at:
                continue
            self._add_text(page[at:token.start()])
            at = token.end()
            name, attributes, closed = token.groups()
            if name:
                name = name.lower()
                self._start(name, attributes)
                if name in RAW and not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                    self._end(name)
                    at = end.end() if end else len(page)
                elif name == "plaintext":
                    break
            elif closed:
                self._end(closed.lower())
        self._add_text(page[at:])

    def _add_text(self, text: str) -> None:
        if text:
            self.text.append((self._stack[-1], self.block, html.unescape(text)))

    def _pop(self, depth: int) -> None:
        """Close the elements from ``depth`` of the stack on."""
        for node in reversed(self._stack[depth:]):
            name = self.tag[node]
            self._open[name].pop()
            self.block += name in BLOCK
        del self._stack[depth:], self._wall[depth:]

    def _top(self, names) -> int:
        """Depth of the nearest open element of ``names``, 0 if none."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=0)

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self._open.get(name):
            return
        if name in ENDS_P and (depth := self._top(("p",))) > self._top(("table", "td", "th", "button", "caption")):
            self._pop(depth)
        if name in ENDS and (depth := min((d for n in ENDS[name][0] if (d := self._top((n,))) > self._top(ENDS[name][1])), default=0)):
            self._pop(depth)
        if name == "body" and (depth := self._top(("head",))):
            self._pop(depth)
        node, parent = len(self.tag), self._stack[-1]
        self.tag.append(name)
        self.parent.append(parent)
        gone, talk = self._marked(name, attributes)
        self.gone.append(gone)
        self.talk.append(talk)
        self.block += name in BLOCK
        if name == "br":
            self.text.append((parent, self.block, " "))
        if name in VOID:
            return
        depth = len(self._stack)
        self._open.setdefault(name, []).append(depth)
        self._stack.append(node)
        self._wall.append(depth if name in BLOCK else self._wall[-1])

    def _end(self, name: str) -> None:
        depth = self._top((name,))
        # The end of an inline element does not close the block it stands in.
        if depth and (name in BLOCK or self._wall[-1] <= depth):
            self._pop(depth)
        elif name == "br":
            self.text.append((self._stack[-1], self.block, " "))

    @staticmethod
    def _marked(name: str, attributes: str) -> tuple[bool, bool]:
        """Whether an element is none of an article, and whether it says that it holds comments."""
        if name in HIDDEN:
            return True, False
        if not attributes or name in ("html", "body", "main"):
            return False, False
        known = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)}
        style = known.get("style", "").replace(" ", "").lower()
        if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return True, False
        names = [x for x in (*known.get("class", "").split(), known.get("id", "")) if not says_otherwise(x)]
        talk = any({w.lower() for w in WORD.findall(x)} & TALK for x in names)
        return bool(names) or known.get("role", "").lower() in ROLES, talk


class Densities:
    """Characters, tags and links of every element, its density and the sum of its children's."""

    def __init__(self, tree: Tree):
        n = len(tree.tag)
        self.tree, parent = tree, tree.parent
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        out, linked, keeps = self._out(), [False] * n, [False] * n
        for node in range(1, n):
            linked[node] = linked[parent[node]] or tree.tag[node] == "a"
        for node, _, text in tree.text:
            if not out[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                link_chars[node] += size * linked[node]
        for node in range(n - 1, 0, -1):
            above = parent[node]
            if out[node]:
                continue
            chars[above] += chars[node]
            link_chars[above] += link_chars[node]
            tags[above] += tags[node] + (tree.tag[node] not in INLINE)
            link_tags[above] += link_tags[node] + (tree.tag[node] == "a")
        self.out, self.chars, self.link_chars, self.link_tags = out, chars, link_chars, link_tags
        self.body = next((k for k in range(n) if tree.tag[k] == "body" and not out[k]), 0)
        share = link_chars[self.body] / max(chars[self.body], 1)
        self.density, self.sum = [0.0] * n, [0.0] * n
        for node in range(n - 1, -1, -1):
            if chars[node] and not out[node]:
                plain = max(chars[node] - link_chars[node], 1)
                base = math.log(chars[node] / plain * link_chars[node] + share * chars[node] + math.e)
                per_tag = chars[node] / max(tags[node], 1)
                adjusted = chars[node] / max(link_chars[node], 1) * max(tags[node], 1) / max(link_tags[node], 1)
                self.density[node] = per_tag * math.log(adjusted) / math.log(base) if base > 1 and adjusted > 0 else per_tag
            if node:
                self.sum[parent[node]] += self.density[node]

    def _out(self) -> list[bool]:
        """Elements taken out, with all they hold. Wrappers of an article or headline are not, unless they are comments."""
        tree, n = self.tree, len(self.tree.tag)
        holds = [tree.tag[k] in ("article", "main", "h1") for k in range(n)]
        for node in range(n - 1, 0, -1):
            holds[tree.parent[node]] = holds[tree.parent[node]] or holds[node]
        out, within = [False] * n, [False] * n
        for node in range(1, n):
            name, above = tree.tag[node], tree.parent[node]
            within[node] = within[above] or name in ("article", "main")
            marked = tree.gone[node] and (tree.talk[node] or name in HIDDEN - {"form"} or not holds[node])
            out[node] = out[above] or marked or (name == "header" and not holds[node] and not within[node])
        return out


def article_of(d: Densities, best: int) -> int | None:
    """The page's own article element around the core, or the one inside it that holds most of its text."""
    tree, node = d.tree, best
    while node > d.body:
        if tree.tag[node] in ("article", "main"):
            return node
        node = tree.parent[node]
    inside = [k for k in range(best, len(tree.tag)) if tree.tag[k] in ("article", "main") and not d.out[k] and 2 * d.chars[k] > d.chars[best]]
    return max(inside, key=lambda k: (tree.tag[k] == "article", d.chars[k]), default=None)


def mark_dense(d: Densities, best: int, chosen: list[bool]) -> None:
    """Elements at or above the least density on the way from the core to the body give their best subtree."""
    tree, n = d.tree, len(d.tree.tag)
    threshold, node = d.density[best], best
    while node > d.body:
        node = tree.parent[node]
        threshold = min(threshold, d.density[node])
    # The largest sum inside every subtree; of equals the outermost.
    peak = list(range(n))
    for node in range(n - 1, d.body, -1):
        above = tree.parent[node]
        if (d.sum[peak[node]], -peak[node]) > (d.sum[peak[above]], -peak[above]):
            peak[above] = peak[node]
    known = [False] * n
    for node in range(d.body, n):
        known[node] = chosen[node] or node > d.body and known[tree.parent[node]]
        if node > d.body and not known[node] and not d.out[node] and d.density[node] >= threshold > 0:
            chosen[peak[node] if d.sum[peak[node]] > 0 else node] = True
            known[node] = chosen[node]


def selected(d: Densities) -> list[bool]:
    """Elements whose texts are the article's."""
    tree, n = d.tree, len(d.tree.tag)
    best = max(range(d.body, n), key=lambda k: (d.sum[k], -k))
    if d.sum[best] <= 0:
        # No element with text below the body: its own text is all there is.
        best = d.body
    named = article_of(d, best)
    chosen = [False] * n
    chosen[best if named is None else named] = True
    if named is None:
        mark_dense(d, best, chosen)
    for node in range(d.body + 1, n):
        chosen[node] = chosen[node] or chosen[tree.parent[node]]
    # Link lists inside what was chosen are no text of the article.
    for node in range(d.body, n):
        if tree.tag[node] in ("ul", "ol", "div", "section", "table", "p") and d.link_tags[node] > 2 and d.link_chars[node] > 0.75 * d.chars[node]:
            d.out[node] = True
        d.out[node] = d.out[node] or (node > d.body and tree.parent[node] >= d.body and d.out[tree.parent[node]])
    return [a and not b for a, b in zip(chosen, d.out, strict=True)]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by blank lines."""
    if not page:
        return ""
    tree = Tree(page)
    keep = selected(Densities(tree))
    blocks: list[list[str]] = []
    last = -1
    for node, block, text in tree.text:
        if keep[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
DDL = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. Narrow: a lost task reads its own pages again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            # Character references may name code points that UTF-8 cannot hold.
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield record_batch(SCHEMA, [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, DDL)


def op12_page_text(spark, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


#: The article of the test pages stands in one ``article`` element, which SQL can find without densities.
OP12_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS article FROM pages),
cut AS (
  SELECT page_id, url, unnest(regexp_split_to_array(article || '', '</?(?:p|h1)>')) AS block,
         generate_subscripts(regexp_split_to_array(article || '', '</?(?:p|h1)>'), 1) AS place
  FROM inner_html),
plain AS (
  SELECT page_id, url, place, trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')) AS block
  FROM cut)
SELECT page_id, url, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY place) FILTER (block <> ''), '') AS text,
       length(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY place) FILTER (block <> ''), ''))::BIGINT AS n_chars
FROM plain GROUP BY page_id, url
"""
