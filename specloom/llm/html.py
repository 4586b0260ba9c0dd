"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles: a node is a path of elements with their classes. Over the distinct
pages of the host that have a node, its presentation (the elements below it) and its contents (its texts) have an entropy: what
repeats on most pages says little, what differs from page to page is the page's own. Branches of low importance are taken
out of every page, and a branch or a block whose own text is the same on most pages is taken out of those. The estimate of a
node that few pages have is drawn towards full importance, so nothing goes on the word of one page.

What an element says of itself is a prior: menus, headers, footers, forms, adverts and the like have no importance, and on a
page with an article (or, without one, a main part) neither has what is outside it. A class word alone never counts for
html, body or main, and neither it nor a form counts for a region that holds nearly all text of its page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import cut, small_batches, split_hot, task

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_removed long"
#: The importance below which a branch goes, and the pages of full importance that every estimate starts from.
MIN_IMPORTANCE, PRIOR_PAGES = 0.3, 2
#: Share of the presentation in a node's importance; the rest is the contents'.
PRESENTATION = 0.1
#: Share of its page's text from which a region isn't noise for a class word, a form or a header's tag.
WHOLE_PAGE = 0.9
#: Rows of unimportant nodes up to which all tasks are told them, about 2 MB; more are joined to the pages.
BROADCAST_NODES = 200_000
#: Copies of pages that a task remembers; beyond it the memory is emptied, and copies are sent twice.
KNOWN_COPIES = 1_000_000

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("dd dt li option optgroup td th tr tbody thead tfoot caption legend summary body html head".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div nav aside main select".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template noframes".split())
NOISE_TAGS = frozenset("head nav footer aside noscript template button select dialog menu svg canvas object audio video search".split()) | RAW
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "comments comment commentlist respond replies disqus share sharing social related recommended login signup search widget pager pagination".split()
)
#: Words that may stand beside a noise word in a class of noise, such as "sidebar-left".
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right primary secondary global box block bar area wrap wrapper container content section list group "
    "item items inner outer module panel row col column link links button buttons post posts article articles story entry form icon icons "
    "desktop mobile fixed sticky".split()
)
#: Of these an article of its own is noise too, as comments are often marked up.
ARTICLE_WORDS = frozenset("comment comments ad advert advertisement sponsored promo".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Elements of running text, that an article keeps unless a branch around them goes.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>|<[!?][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[^_\-]+")

_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def name_of(text: str) -> int:
    """A 64-bit name of a text."""
    return int.from_bytes(blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "big")


def joined(a: int, b: int) -> int:
    """A 64-bit name of two names in their order."""
    x = (a * _ODD + b + 1) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    return x ^ (x >> 27)


def signed(name: int) -> int:
    return name - (1 << 64) if name >> 63 else name


def noise_class(token: str) -> bool:
    """Whether a class or id says that its element isn't content: a noise word alone or among neutral ones."""
    if token in NOISE_WORDS:
        return True
    parts = PARTS.findall(token)
    return len(parts) > 1 and any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in NEUTRAL_WORDS for p in parts)


def header_class(token: str) -> bool:
    parts = PARTS.findall(token)
    return "header" in parts and all(p == "header" or p in NEUTRAL_WORDS for p in parts)


class Node:
    """An element. path: names its style, with those of the elements around it; holder: the block that its text is in; strong
    and weak: what it says of itself isn't content, whatever it holds, or unless it holds its page; chars: of the texts below
    it; digest: names the texts below it that aren't noise; shape, last: name the elements right below it."""

    __slots__ = ("tag", "path", "parent", "holder", "classed", "strong", "weak", "noise", "article", "main", "chars", "digest", "shape", "last")

    def __init__(self, tag: str, path: int, parent: "Node | None", classed: bool = False):
        self.tag, self.path, self.parent, self.classed = tag, path, parent, classed
        self.holder = self if parent is None or tag in BLOCKS else parent.holder
        self.article, self.main = (parent.article, parent.main) if parent else (False, False)
        self.strong = self.weak = self.noise = False
        self.chars = self.digest = self.shape = 0
        self.last = ""

    @property
    def running(self) -> bool:
        """Whether it is running text of an article: that goes with a branch around it alone."""
        return (self.article or self.main) and self.tag in TEXT_TAGS and not self.classed

    @property
    def branch(self) -> bool:
        """Whether it may go as a whole: a block below the page's body, article or main part that isn't running text."""
        if self.tag not in BLOCKS or self.tag in ("html", "body") or self.parent is None or self.running or self.noise:
            return False
        return (self.parent.article or self.parent.main) == (self.article or self.main) and self.parent.article == self.article


def opened(tag: str, attributes: str, parent: Node) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes or "hidden" in attributes else {}
    style = found.get("class", "").split()
    own = f"{tag}.{'.'.join(sorted(style))}" if style else tag
    node = Node(tag, joined(parent.path, name_of(own)), parent, bool(style))
    role = found.get("role", "").lower()
    node.article |= tag == "article" or found.get("itemprop", "").lower() == "articlebody"
    node.main |= tag == "main" or role == "main"
    if tag in ("html", "body", "main"):
        return node
    tokens = " ".join([*style, found.get("id", "")]).lower().split()
    if tag == "article":
        node.weak = any(t in ARTICLE_WORDS for t in tokens)
        return node
    node.strong = tag in NOISE_TAGS or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    node.weak = tag == "form" or role in NOISE_ROLES or any(map(noise_class, tokens))
    if not (node.article or node.main):
        node.weak |= tag == "header" or any(map(header_class, tokens))
    return node


class Page:
    """A page's elements in the order of their start, and its blocks: (text, node, its name) in order."""

    def __init__(self, source: str):
        self.nodes = [Node("", 0, None)]
        self._raw: list[tuple[list[str | tuple[str, Node]], Node]] = []
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        stack, text, at = [self.nodes[0]], [], 0
        open_: dict[str, int] = {}  # how many elements of a name are open, so that none is searched for in vain
        inline: list[Node] = []  # open inline elements that may be noise

        def flush() -> None:
            if text:
                self._raw.append((text.copy(), stack[-1].holder))
                text.clear()

        def say(piece: str) -> None:
            if piece:
                text.append((piece, inline[-1]) if inline else piece)

        def pop(to: int) -> None:
            for node in stack[to:]:
                open_[node.tag] -= 1
                if inline and inline[-1] is node or node in inline:
                    inline.remove(node)
            del stack[to:]

        def last(*tags: str) -> int:
            """The place of the last open element of these names, if no scope has begun since; else 0."""
            if any(open_.get(t) for t in tags):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in tags:
                        return i
                    if stack[i].tag in SCOPES:
                        return 0
            return 0

        while True:
            m = TOKENS.search(source, at)
            if m is None:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):  # an end tag closes what it names, with all that is open inside
                if tag in BLOCKS or tag in RAW:
                    flush()
                if open_.get(tag):
                    pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                continue
            if open_.get("head") and tag not in IN_HEAD:  # a head ends where anything else begins
                flush()
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "head"))
            if tag == "br":
                say(" ")
                continue
            if tag in BLOCKS:
                flush()
                if tag in CLOSES_P and (place := last("p")):
                    pop(place)
                if tag in SIBLINGS and (place := last(*SIBLINGS[tag])):
                    pop(place)
            if tag in VOID:
                continue
            if tag in RAW:  # its text isn't markup; none of it is shown
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = source.find(">", end.start()) + 1 or len(source) if end else len(source)
                continue
            if m.group(3).endswith("/") and tag not in BLOCKS:
                continue
            parent = stack[-1]
            node = opened(tag, m.group(3) or "", parent)
            if tag in BLOCKS and parent.last != tag:  # a run of one element is one
                parent.shape, parent.last = joined(parent.shape, name_of(tag)), tag
            if node.holder is not node and (node.strong or node.weak):
                inline.append(node)
            self.nodes.append(node)
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
        flush()

    def _judge(self) -> None:
        """Tell noise, and name the texts below each element."""
        for node in self.nodes[1:]:
            node.noise = node.parent.noise or node.strong
        total = self.nodes[0]
        for pieces, holder in self._raw:
            for piece in pieces:
                text, node = piece if isinstance(piece, tuple) else (piece, holder)
                if not node.noise:
                    node.chars += len(text) - text.count(" ")
        for node in reversed(self.nodes[1:]):
            node.parent.chars += node.chars
        for node in self.nodes[1:]:
            node.noise = node.noise or node.parent.noise or (node.weak and node.chars < WHOLE_PAGE * total.chars)
        self.blocks: list[tuple[str, Node, int]] = []
        for pieces, holder in self._raw:
            shown = [p if isinstance(p, str) else p[0] for p in pieces if holder.noise or isinstance(p, str) or not p[1].noise]
            words = " ".join(html.unescape("".join(shown)).split())
            if words:
                self.blocks.append((words, holder, name_of(words)))
        self._raw.clear()
        for _, node, name in self.blocks:
            if not node.noise:
                node.digest = joined(node.digest, name)
        for node in reversed(self.nodes[1:]):
            if node.digest:
                node.parent.digest = joined(node.parent.digest, node.digest)

    def content(self) -> list[tuple[str, Node, int]]:
        """The blocks that aren't noise; of a page with an article or a main part, those inside it."""
        own = [b for b in self.blocks if not b[1].noise]
        for inside in (lambda n: n.article, lambda n: n.main):
            if any(inside(n) for _, n, _ in own):
                return [b for b in own if inside(b[1])]
        return own

    def features(self) -> tuple[int, set[tuple[int, int, int]]]:
        """The name of the page's content, and (node, kind, feature): presentations (0), contents (1) and branches' texts (2)."""
        content, copy = self.content(), 0
        found = {(n.path, 0, n.shape) for n in self.nodes[1:]}
        seen: set[int] = set()
        for _, node, name in self.blocks:
            found.add((node.path, 1, name))
            while node is not None and id(node) not in seen:
                seen.add(id(node))
                if node.branch and node.digest:
                    found.add((node.path, 2, node.digest))
                node = node.parent
        for _, _, name in content:
            copy = joined(copy, name)
        return copy, found

    def main_text(self, unimportant: frozenset[int]) -> tuple[str, int, int]:
        """The text of the blocks that stay, their count, and the count of those that went."""
        told: dict[int, bool] = {}
        kept = [t for t, n, name in self.content() if not (unimportant and self.goes(n, name, unimportant, told))]
        return "\n\n".join(kept), len(kept), len(self.blocks) - len(kept)

    @staticmethod
    def goes(node: Node, name: int, unimportant: frozenset[int], told: dict[int, bool]) -> bool:
        """Whether the block's text is on most pages, its node is unimportant, or a branch that it is in is; of running text in
        an article only the last counts, since an article may well quote what others have.

        told: what is known of the branches of the page.
        """
        if not node.running and (node.path in unimportant or node.path ^ name in unimportant):
            return True
        way, out = [], False
        while node is not None:
            if id(node) in told:
                out = told[id(node)]
                break
            way.append(node)
            node = node.parent
        for node in reversed(way):
            inner = node.parent is not None and (node.article, node.main) != (node.parent.article, node.parent.main)
            out = (out and not inner) or (node.branch and joined(node.path, node.digest) in unimportant)
            told[id(node)] = out
        return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, n, drop): in how many distinct pages of a host a node has a presentation (kind 0), a content
    (1) or, as a branch, the texts below it as one content (2). drop: the name by which a page that has it finds it to go.

    Pages are told apart by their content, so that one article under many addresses counts once. A page leaves its task as the
    names of what it has, and copies from all tasks are dropped by a shuffle of these before they are added up, so the
    counts don't depend on how pages are dealt. Of copies whose frames differ, the one of the least names counts.
    """

    @task("html")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], int] = {}  # copies with a lesser frame needn't be sent again
        for batch in batches:
            rows: list[tuple[str, int, int, list[tuple]]] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                copy, found = Page(source).features()
                frame = 0
                for x in sorted(found):
                    frame = joined(joined(frame, x[0]), x[2])
                if known.get((host, copy), 1 << 64) <= frame:
                    continue
                if len(known) > KNOWN_COPIES:
                    known.clear()
                known[host, copy] = frame
                rows.append((host, signed(copy), signed(frame), [(signed(p), k, signed(f), signed(p ^ f if k == 1 else joined(p, f))) for p, k, f in found]))
            flat = [x for *_, found in rows for x in found]
            offsets = np.cumsum([0, *(len(found) for *_, found in rows)])
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            parts = [pa.array(c, t) for c, t in zip([*zip(*flat)] if flat else [()] * 4, types, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["node", "kind", "feature", "drop"]))
            columns = [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), found]
            yield pa.RecordBatch.from_arrays(columns, ["host", "copy", "frame", "found"])

    schema = "host string, copy long, frame long, found array<struct<node:bigint,kind:int,feature:bigint,drop:bigint>>"
    rows = pages.select("host", "html").mapInArrow(measure, schema)
    rows = rows.groupBy("host", "copy").agg(F.min_by("found", "frame").alias("found")).select("host", F.inline("found"))
    return rows.groupBy("host", "node", "kind", "feature", "drop").agg(F.count("*").alias("n"))


def importances(features: DataFrame, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """(host, node, pages, has_text, importance, shape): from 0, the same on all pages, to 1, different on each.

    With m pages, the presentation's part is the entropy of the presentations over log m, and the contents' one less the mean
    entropy of a content over the pages that have it, again over log m. A node without contents has its presentation's alone.
    Both are averaged with the importance 1 of `prior_pages` more pages; a node of one page is as important as can be.
    """
    n = F.col("n").cast("double")
    sums = features.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias("shape"),
        F.sum(F.when(F.col("kind") == 1, n)).alias("texts"),
        F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("text"),
    )
    m = F.log(F.col("pages").cast("double"))
    shape = (m - F.col("shape") / F.col("pages")) / m
    text = F.greatest(F.lit(0.0), 1 - F.col("text") / (F.col("texts") * m))
    drawn = lambda x: (F.col("pages") * x + prior_pages) / (F.col("pages") + prior_pages)
    both = F.when(F.col("texts") > 0, PRESENTATION * shape + (1 - PRESENTATION) * text).otherwise(shape)
    return sums.filter(F.col("pages") >= 2).select("host", "node", "pages", F.col("texts") > 0, drawn(both), shape).toDF(
        "host", "node", "pages", "has_text", "importance", "shape"
    )


def unimportant_names(features: DataFrame, min_importance: float, prior_pages: int) -> DataFrame:
    """(host, name) of what goes: nodes of low importance; branches whose own text is on so many pages that their importance
    there is low; texts of a node that most of its pages have.

    A branch or text that differs on a page stays there, whatever it is elsewhere.
    """
    told = importances(features, prior_pages)
    nodes = told.filter(F.col("has_text") & (F.col("importance") < min_importance)).select("host", F.col("node").alias("name"))
    m, n = F.col("pages"), F.col("n")
    own = 1 - F.log(n.cast("double")) / F.log(m.cast("double"))
    drawn = (m * (PRESENTATION * F.col("shape") + (1 - PRESENTATION) * own) + prior_pages) / (m + prior_pages)
    one, other = split_hot(features.filter("kind > 0 AND n > 1"), told.select("host", "node", "pages", "shape"), ["host", "node"], F.col("drop"))
    often = one.join(other, ["host", "node", "salt"])
    repeated = often.filter(((F.col("kind") == 2) & (drawn < min_importance)) | ((F.col("kind") == 1) & (2 * n > m + prior_pages)))
    return nodes.union(repeated.select("host", F.col("drop").alias("name")))


def page_texts(pages: DataFrame, min_importance: float = MIN_IMPORTANCE, prior_pages: int = PRIOR_PAGES) -> DataFrame:
    """The main text of every page of `pages` (page_id, url, html).

    Returns a row for each row: page_id, url, text (blocks in page order, parted by an empty line, white space in them as one
    space; empty if none), n_chars (its code points), n_blocks and n_removed (blocks that stayed and went). A null source
    is empty; a null url or one without a host shares the empty host; a null page_id stays null; repeated rows stay
    repeated and count once for the tree; an empty table gives none; other columns don't matter. Broken markup is
    read as browsers do in outline: unclosed elements end with what holds them. Memory: a batch of pages, the elements of one
    of them, and the names of KNOWN_COPIES pages.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    low = cut(unimportant_names(cut(style_features(rows), "features"), min_importance, prior_pages), "low")
    few = low.count() <= BROADCAST_NODES
    told: dict[str, frozenset[int]] = {}
    if few:
        for row in low.groupBy("host").agg(F.collect_set("name").alias("names")).collect():
            told[row["host"]] = frozenset(x & _MASK for x in row["names"])

    @task("html")
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = told if few else {}
            if not few:  # each host's once a batch
                hosts = batch.column("host").to_pylist()
                names = {h: frozenset(x & _MASK for x in batch.column("names")[i].as_py() or ()) for h, i in {h: i for i, h in enumerate(hosts)}.items()}
            nothing: frozenset[int] = frozenset()
            found = [Page(source).main_text(names.get(host, nothing)) for source, host in zip(*(batch.column(c).to_pylist() for c in ("html", "host")), strict=True)]
            texts = [t for t, *_ in found]
            numbers = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [k for _, k, _ in found], [r for *_, r in found])]
            columns = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), *numbers]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    if not few:
        of = low.groupBy("host").agg(F.collect_set("name").alias("names"))  # as many as a site has styles
        one, other = split_hot(rows, of, ["host"], F.xxhash64("page_id", "url"))
        rows = one.join(other, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "host", *["names"] * (not few)).mapInArrow(extract, SCHEMA)
