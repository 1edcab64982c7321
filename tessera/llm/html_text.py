"""Main text of web pages by composite text density.

A page becomes a tree. Every node gets its characters per tag, adjusted by how much of
its text is links; a node's density sum adds up its children's densities.
The node with the largest sum is the article's body (an <article> element around it is
taken with it, which keeps its headings), and the least density on the
path from it to <body> is the threshold: below each node that reaches it, the
subtree with the largest density sum is content. Elements that are never content (menus, forms,
scripts, adverts, reader comments) leave the tree before densities are taken, unless they hold the article
itself: a form around the page's body, or a menu that is never closed. Names count as wholes,
and inside the article a name with a second meaning needs a second sign, such as a low density.

Reading is linear in the page's length, whatever its depth. A page may lack end tags, close what isn't open or
end inside a tag: a block's start tag ends an open paragraph, drawing or list of choices, a comment or script
that never ends takes the rest, and after a tag whose quotes never end tags are read without regard to quotes.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_batches

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Za-z0-9_-]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_EMPTY = re.compile(r"(?:\A|[\s\"'])/\Z")  # ends a tag like <br/>, unlike <a href=/>
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
#: What a block's start tag ends if it is open.
INLINE_ONLY = ("svg", "math", "select")
#: What may stand in <head>; any other start tag ends it.
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open element: tag -> (what it ends, where the search stops).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Never content, whatever their names: what has no shown text, and what isn't the article.
NO_TEXT = frozenset("annotation annotation-xml head iframe input script select style svg textarea title".split())
APART = frozenset("aside button footer form menu nav noscript template".split())
#: Roles of what isn't the article, like the tags in APART.
DROP_ROLES = frozenset("navigation menu menubar toolbar".split())
#: Words of names for what isn't the article. A name counts only as a whole: "related", not "related-work".
DROP_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split())
#: Words that may stand beside one of these in a name.
BESIDE = frozenset(
    "area articles bar block bottom box button buttons container form global group icons inner items label left "
    "links list main message outer page posts primary right section secondary signup site slot stories thread top "
    "unit widgets wrap wrapper".split())
#: Class names that say it by themselves, also inside the article: one of these, or first word and second word.
ADS = frozenset("ad ads advert advertisement adverts".split())
PAIRS = {
    **dict.fromkeys(ADS, frozenset("banner block box container label slot unit wrapper".split())),
    **dict.fromkeys(("cookie", "cookies"), frozenset("banner bar consent modal notice popup".split())),
    **dict.fromkeys(("comment", "comments"), frozenset("area form list respond section thread".split())),
    **dict.fromkeys(("share", "sharing", "social"), frozenset("bar button buttons icons links share sharing".split())),
    "related": frozenset("articles links posts stories".split()),
    "newsletter": frozenset("box form signup".split()),
    "nav": frozenset("bar links menu".split()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of comments, replies to them and forms for them are a second sign.
REPLIES = frozenset("comment comments reply replies respond".split())
#: Words without a second meaning as a class: such a block leaves the article too, unless it is most of it.
PLAIN_WORDS = frozenset(
    "breadcrumb breadcrumbs comment comments cookie cookies disqus navbar navigation newsletter pagination popup "
    "promo promoted sidebar sponsored subscribe widget".split())
LINKED = 0.5  # share of linked text that is a second sign
THIN = 0.25   # so is a density of unlinked characters below this share of the article's
MOST = 0.5    # a block with more of the unlinked text is the article itself
#: How an element is named: surely not content, by a plain word of its class, by its class, by its id.
SURE, BY_WORD, BY_CLASS, BY_ID = 1, 2, 3, 4


def _words(name: str) -> list[str]:
    """The words of a name if all are known, else none."""
    if not _NAME.fullmatch(name):
        return []
    words = [w.lower() for w in _WORDS.findall(name)]
    known = any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in BESIDE for w in words)
    return words if known else []


def _named(tag: str, attrs: str) -> tuple[int, bool]:
    """(SURE, BY_WORD, BY_CLASS, BY_ID or 0; whether the name is that of comments)."""
    found, replies = 0, False
    for m in _ATTR.finditer(attrs):
        attr, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if attr == "hidden" or attr == "style" and _NO_DISPLAY.search(value):
            return SURE, False
        if attr == "role":
            if value.strip().lower() in DROP_ROLES:
                return SURE, False
            if value.strip().lower() == "banner":
                found = found or BY_CLASS
        elif attr == "class":
            for words in map(_words, value.split()):
                if words and (words[0] in ADS if len(words) == 1
                              else len(words) == 2 and words[1] in PAIRS.get(words[0], ())):
                    return SURE, False
                if words and tag not in HEADINGS:
                    plain = found == BY_WORD or tag in BLOCKS and not PLAIN_WORDS.isdisjoint(words)
                    found, replies = BY_WORD if plain else BY_CLASS, replies or not REPLIES.isdisjoint(words)
        elif attr == "id" and tag in BLOCKS and tag not in HEADINGS and not found:
            if words := _words(value.strip()):
                found, replies = BY_ID, not REPLIES.isdisjoint(words)
    return found, replies


class Page:
    """A page's tree: nodes in page order, texts and block edges in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.named, self.closed = ["#root"], [-1], [(0, False)], [False]
        self.flow: list[tuple[int, str | None]] = []  # (node, text); None is a block's edge
        self._read(source)

    def _read(self, source: str):
        stack, at, look, n = [0], 0, 0, len(source)  # text from ``at``, the next tag from ``look``
        opened = defaultdict(list)  # tag -> its places in the stack
        tag, parent, flow = self.tag, self.parent, self.flow
        pattern = _TAG

        def cut(k):
            while len(stack) > k:
                opened[tag[stack.pop()]].pop()

        def last(names):
            deepest = 0
            for name in names:
                if (places := opened.get(name)) and places[-1] > deepest:
                    deepest = places[-1]
            return deepest

        def close(names, until):
            if (k := last(names)) > last(until):
                cut(k)

        while (lt := source.find("<", look)) >= 0:
            after = source[lt + 1:lt + 2]
            m = None
            if after in ("!", "?"):
                comment = source.startswith("!--", lt + 1)
                end = source.find("-->", lt + 2) + 3 if comment else source.find(">", lt) + 1
                if end == 2 and comment:
                    end = n
                if end == 0:
                    break
            else:
                m = pattern.match(source, lt)
                if not m and pattern is _TAG and _TAG_PLAIN.match(source, lt):
                    pattern = _TAG_PLAIN
                    m = pattern.match(source, lt)
                if not m:
                    if after.isalpha() and source.find(">", lt) < 0:
                        break
                    look = lt + 1
                    continue
                end = m.end()
            if lt > at:
                flow.append((stack[-1], source[at:lt]))
            at = look = end
            if m is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name in BLOCKS:
                    flow.append((stack[-1], None))
                k = last((name,))
                if k and (name in BLOCKS or k > last(("article", "body", "main", "table"))):
                    self.closed[stack[k]] = True
                    cut(k)
                continue
            if opened.get("head") and name not in IN_HEAD:
                cut(opened["head"][0])
            if name in BLOCKS:
                close(INLINE_ONLY, ("foreignobject",))
                flow.append((stack[-1], None))
                close(("p",), ("article", "body", "td", "th", "button"))
            if name in ENDS:
                close(*ENDS[name])
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            self.named.append(_named(name, m[3]) if m[3] else (0, False))
            self.closed.append(False)
            if name in BLOCKS:
                flow.append((node, None))
            elif name == "br":
                flow.append((stack[-1], " "))
            empty = m[3].endswith("/") and _EMPTY.search(m[3][-2:])
            if name in RAW and not empty:
                close_tag = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = look = close_tag.end() if close_tag else n
            elif name not in VOID and not empty:
                opened[name].append(len(stack))
                stack.append(node)
        if at < n:
            flow.append((stack[-1], source[at:]))

    def left_out(self) -> list[bool]:
        """Nodes that are never content, with all below them.

        A form, or a menu or the like that is never closed, stays if it holds most of the unlinked text, and
        so does whatever holds an article; blocks of links directly in it go. A name with a second meaning (a
        section on social reforms may be called "social") needs a second sign inside the article; so does an id
        on a page that marks no article.
        """
        tag, parent, n = self.tag, self.parent, len(self.tag)
        holds = [t in ("article", "main", "body") for t in tag]
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= holds[i]
        marked = "article" in tag or "main" in tag
        within = [0] * n  # the article a node is in, itself included; 0 if none
        for i in range(1, n):
            within[i] = i if tag[i] in ("article", "main") else within[parent[i]]
        apart = [t in APART or t in ("dialog", "header") and not a for t, a in zip(tag, within)]
        loose = any(a and (t == "form" or not c) for a, t, c in zip(apart, tag, self.closed))
        if loose or any(how > SURE for how, _ in self.named):
            prose, links, signs = self._signs(within)
        else:
            prose = links = signs = [0] * n
        out, kept = [False] * n, [False] * n
        for i in range(1, n):
            inside = within[i] > 0
            most = prose[i] > MOST * prose[within[i] if within[i] != i else 0]
            how = self.named[i][0]
            if how == BY_WORD and inside:
                named = not most
            elif how == BY_ID and not marked or how > BY_WORD and inside:
                named = signs[i] and tag[i] in BLOCKS
            else:
                named = how > 0
            kept[i] = apart[i] and (holds[i] or most and (inside or not marked)
                                    and (tag[i] == "form" or not self.closed[i]))
            menu = kept[parent[i]] and links[i] and tag[i] in BLOCKS
            out[i] = (out[parent[i]] or tag[i] in NO_TEXT or apart[i] and not kept[i]
                      or (named or menu) and not holds[i])
        return out

    def _signs(self, within: list[int]) -> tuple[list[int], list[bool], list[bool]]:
        """(unlinked characters below each node; whether it is mostly links; its second sign if it is named).

        A second sign: the text is mostly links or much less dense than the article's, or
        a node of comments holds replies or a form.
        """
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, link_chars, tags, answers = [0] * n, [0] * n, [0] * n, [False] * n
        linked, hidden = [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
            hidden[i] = hidden[parent[i]] or tag[i] in NO_TEXT
        for node, piece in self.flow:
            if piece and not hidden[node] and not piece.isspace():
                chars[node] += len(piece)
                if linked[node]:
                    link_chars[node] += len(piece)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            how, replies = self.named[i]
            answers[p] |= answers[i] or tag[i] in ("form", "textarea") or how in (BY_WORD, BY_CLASS) and replies
        prose = [c - link for c, link in zip(chars, link_chars)]
        thin = [THIN * prose[a] / max(tags[a], 1) for a in within]
        links = [link > LINKED * c for link, c in zip(link_chars, chars)]
        return prose, links, [links[i] or self.named[i][1] and answers[i] or prose[i] / max(tags[i], 1) < thin[i]
                              for i in range(n)]

    def text(self) -> str:
        out = self.left_out()
        content = self._content(out)
        blocks, parts = [], []
        for node, piece in self.flow:
            if piece is None:
                if parts:
                    blocks.append("".join(parts))
                    parts = []
            elif not out[node] and content[node]:
                parts.append(piece)
        if parts:
            blocks.append("".join(parts))
        clean = (_SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
        return "\n\n".join(b for b in clean if b)

    def _content(self, out: list[bool]) -> list[bool]:
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
        linked, article = [False] * n, list(range(n))  # the <article> that holds a node, else the node
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
            if tag[i] != "article" and tag[article[parent[i]]] == "article":
                article[i] = article[parent[i]]
        for node, piece in self.flow:
            if piece and not out[node]:
                size = len(piece) if not piece.isspace() else 0
                chars[node] += size
                if linked[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        body = next((i for i in range(n) if tag[i] == "body" and not out[i]), 0)
        ratio = link_chars[body] / max(chars[body], 1)

        density = [0.0] * n
        for i in range(n):
            c = chars[i]
            if c and not out[i]:
                lc, lt, t = max(link_chars[i], 1), max(link_tags[i], 1), max(tags[i], 1)
                base = math.log(c / max(c - link_chars[i], 1) * lc + ratio * c + math.e)
                density[i] = c / t * math.log(c / lc * t / lt) / math.log(base)
        total, best = [0.0] * n, list(range(n))
        for i in range(n - 1, 0, -1):
            if tag[i] in BLOCKS:  # formatting inside a line isn't structure
                total[parent[i]] += density[i]
        for i in range(n - 1, 0, -1):  # the largest sum below each node, the first of equals
            p = parent[i]
            if not out[i] and total[best[i]] >= total[best[p]] and (
                    best[p] != p or total[best[i]] > total[p]):
                best[p] = best[i]
        content = [False] * n
        top = best[body]
        if total[top] <= 0:  # no element below it has text: what <body> itself holds
            content[body] = True
        else:
            low, i = density[top], top
            while i != body and i > 0:
                i = parent[i]
                low = min(low, density[i])
            content[article[top]] = True
            for i in range(n):
                if not out[i] and chars[i] and density[i] >= low and i != body and parent[i] >= 0 \
                        and not (i < body and tag[i] in ("#root", "html")):
                    content[article[best[i]]] = True
        for i in range(1, n):
            content[i] = content[i] or content[parent[i]]
        return content


def main_text(source: str | None) -> str:
    """The page's main text; empty for null, empty pages and pages without content."""
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    The whole html is read. Character references are decoded, white space in a block is one
    space, blocks are joined by two line ends. Null html gives an empty text. Deep, unclosed and
    malformed pages are read as the module says, in linear time. Ids and urls
    pass unchanged, null or repeated; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def extract(batches: Iterable[pa.RecordBatch]):
        for batch in text_batches(batches):
            texts = [main_text(h) for h in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    res = map_arrow(rows, extract, f"id {kind}, url string, text string, n_chars long")
    return res.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
