"""Operator 1, HTML extraction with a site style tree.

Every page is parsed once, in the tasks, into text blocks.  Two rules come first: what
declares itself furniture by tag (navigation, footers, sidebars, forms, dialogs, headers),
ARIA role or ``hidden`` goes; and a page with a declared article (``article``, ``main``)
keeps only what lies inside it.  These declarations are not left to the statistics, because
furniture that is drawn from many texts doesn't repeat enough on small hosts.

A class or id word (advert, notice, comments ...) only makes an element suspect, and no word on
the article or around it counts.  Inside a declared article two kinds go by word and shape:
reader comments (a container named for comments, by any part of the name that isn't a state such as
``comments-open``, with article text before it or with items that look like comments; an
``article`` in it is no article of the page) and notices (named for cookies, consent, notices,
newsletters, adverts, sharing, less than half of the article's text).  Lists that are nothing but links are suspect by their
shape.  Other suspect branches go if their content importance on the host is below ``SUSPECT_LOW``.

A heading has no branch of its own where text follows it: it stays or goes with that text.

All text that these rules leave, inside an article too, is in the style tree of its host:
every block element, suspect element and text directly in the body or article is a branch.
A style node is a path of tags and classes; a branch's
features are its text (content) and the sequence of its child tags (presentation).  With m
pages that have the node:

* content importance: different texts over pages that have them: 1 if no text occurs
  twice, near 0 if all pages say the same;
* presentation importance: entropy of its child sequences over the log of m, of
  ``BASE_PAGES`` at most, so that it does not fall as a host grows;
* importance: the larger of the two.

Both are shrunk towards a prior that counts like ``PRIOR_PAGES`` pages: 1 for an ordinary node, 0 for a
suspect one, so a verdict needs more pages the more it contradicts the markup, and no rule is
switched on by a number of pages.  Branches below ``LOW`` are removed from each page;
texts that differ from page to page stay, however many pages a host has.  So is a branch
whose own text is on the share ``REPEATED`` of the node's pages, shrunk alike, unless that would
leave the page without text.  Pages with the same text in all blocks (copies of one article) count as one, so repeated
articles are not taken for page furniture.  Counts are grouped aggregates by (host, node,
feature), combined before the shuffle, so a host with a third of all pages is no hot task;
texts are shuffled once only if
the pages that lose something are too many to send to every task.

Defined results: null and empty html give the empty text; null page_id and url pass
through (the null url is a host of its own); repeated pages are extracted alike; an empty
table gives an empty result; further columns are ignored.  White space is what
``str.split`` takes for it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

LOW = 0.34
PRIOR_PAGES = 1
BASE_PAGES = 100
SUSPECT_LOW = 0.7
REPEATED = 0.6

# fixed values: HTML element classes and the words that declare page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea svg math iframe object canvas select xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu button search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: a word only marks an element as suspect
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended widget toolbar pagination pager search form".split())
#: inside a declared article only whole class names and ids of containers mark, and only these
INNER_WORDS = frozenset("ads advert adverts advertisement sponsored breadcrumb breadcrumbs respond sharing newsletter pagination".split())
INNER_TAGS = frozenset("div dl ol section ul aside".split())
#: names, by their parts, of comment areas and notices; parts that only tell a state
COMMENT_WORDS = frozenset("comment comments commentlist commenting disqus replies respond discussion".split())
NOTICE_WORDS = frozenset("cookie cookies consent gdpr notice notices newsletter advert adverts advertisement advertorial sponsored sharing".split())
STATE_WORDS = frozenset("no open opened closed off on enabled disabled allowed has with without hide hidden show count".split())
NOTICE_TAGS = INNER_TAGS | {"p"}
COMMENT_TAGS = INNER_TAGS | {"article", "li", "details"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: closed by the start of a tag of the same group, up to the group's container
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
            "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select", "datalist"))}
P_SCOPE = frozenset("html table td th caption button".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _code(*parts) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _named_for(found: dict[str, str], words: frozenset[str], attributes: tuple[str, ...]) -> bool:
    """Whether a class name or id has one of ``words`` among its parts and no word of a mere state."""
    for token in " ".join(found.get(a, "") for a in attributes).split():
        parts = {w.lower() for w in _WORD.findall(token)}
        if parts & words and not parts & STATE_WORDS:
            return True
    return False


class Page:
    """Text blocks of one page and its undeclared branches."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.inside: list[tuple[int, ...]] = []  # branch numbers of each block
        self.in_main: list[bool] = []
        self.branches: list[list] = []  # [path, suspect, child tags]
        self.links: list[int] = []  # characters of each block that lie in links
        self.headings: list[bool] = []
        self.areas: dict[int, str] = {}  # branches named for comments or notices
        self.items: dict[int, int] = {}  # comment areas: parts in them named for comments, with a time or a reply
        self.weak: set[int] = set()  # articles inside a comment area
        # tag, chrome, main, branch, name, branches a text inside belongs to
        self._stack: list[tuple[str, bool, bool, int | None, str, tuple[int, ...]]] = [("", False, False, None, "", ())]
        self._linked = 0
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        self._parse(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            linked, self._linked = self._linked, 0
            self._text = []
            _, chrome, main, _, _, inside = self._stack[-1]
            if text and not chrome:
                if not inside:  # text of the body, the article or of a formatting element in it
                    inside = (len(self.branches),)
                    self.branches.append(["/".join([e[4] for e in self._stack if e[0] in BLOCK] + ["#text"]), False, []])
                self.blocks.append(text)
                self.in_main.append(main)
                self.inside.append(inside)
                self.links.append(linked)
                self.headings.append(any(e[0] in HEADINGS for e in self._stack))

    def _pop(self, size: int) -> None:
        if len(self._stack) > size:
            if any(e[0] in BLOCK or e[3] is not None for e in self._stack[size:]):
                self._flush()
            for e in self._stack[size:]:
                self._open[e[0]] -= 1
            del self._stack[size:]

    def _close_to(self, tags: tuple[str, ...], stop) -> None:
        if any(self._open.get(t) for t in tags):
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in tags:
                    return self._pop(i)
                if self._stack[i][0] in stop:
                    return None
        return None

    def _start(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P:
            self._close_to(("p",), P_SCOPE)
        if tag in SIBLINGS:
            self._close_to(*SIBLINGS[tag])
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        _, chrome, main, above, _, inside = self._stack[-1]
        if above is not None:
            self.branches[above][2].append(tag)
        if tag in VOID:
            return
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}
        names = [w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")] if found else []
        role = found.get("role", "").lower()
        was_main, suspect = main, False
        area = next((b for b in reversed(inside) if self.areas.get(b) == "comment"), None)
        said = COMMENT_WORDS & set(names) if found else ()
        if area is not None and (said or tag in ("time", "cite") or "reply" in names or "author" in names):
            self.items[area] = self.items.get(area, 0) + 1
        if tag == "main" or role == "main" or (tag == "article" and chrome and self._stack[-1][0] in ("form", "nav", "header")):
            chrome, main = False, True
        elif not chrome:
            chrome = tag in CHROME_TAGS or role in CHROME_ROLES or (tag == "header" and not main) or "hidden" in found
            main = main or (not chrome and area is None and (tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody"))
        if main and not was_main:
            inside = ()  # no ancestor, by its words or its repetition, removes a declared article
        elif main:
            suspect = tag in INNER_TAGS and not INNER_WORDS.isdisjoint([*found.get("class", "").lower().split(), found.get("id", "").lower()])
            suspect = suspect or (tag in COMMENT_TAGS and _named_for(found, COMMENT_WORDS, ("class", "id"))) or (tag in NOTICE_TAGS and _named_for(found, NOTICE_WORDS, ("class",)))
        elif tag not in ("html", "body"):
            suspect = not CHROME_WORDS.isdisjoint(names) or "header" in names
        branch, name = None, f"{tag}.{'.'.join(names)}" if names else tag
        declared = tag in ("html", "body", "main", "article") or main > was_main
        if not chrome and not declared and (suspect or tag in BLOCK):
            self._flush()
            branch = len(self.branches)
            self.branches.append(["/".join([e[4] for e in self._stack] + [name]), suspect, []])
            if tag in COMMENT_TAGS and _named_for(found, COMMENT_WORDS, ("class", "id")):
                self.areas[branch] = "comment"
            elif main and tag in NOTICE_TAGS and _named_for(found, NOTICE_WORDS, ("class",)):
                self.areas[branch] = "notice"
            inside = (*inside, branch)
        self._stack.append((tag, chrome, main, branch, name, inside))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._open.get(tag):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                return self._pop(i)
            if tag not in BLOCK and self._stack[i][0] in BLOCK:
                return  # a formatting end tag doesn't close blocks

    def _parse(self, source: str) -> None:
        at, size, lower = 0, len(source), None
        while at < size:
            found = _TAG.search(source, at)
            text = source[at:found.start()] if found else source[at:]
            if text and not self._stack[-1][1]:
                text = entities.unescape(text) if "&" in text else text
                self._text.append(text)
                if self._open.get("a"):
                    self._linked += len(text)
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._end(tag)
            elif tag in RAW:
                if not (found[3] or found[6] or "").endswith("/"):
                    lower = source.lower() if lower is None else lower
                    end = lower.find(f"</{tag}", at) if len(lower) == size else -1
                    if end < 0:
                        m = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                        end = m.start() if m else size
                    close = source.find(">", end)
                    at = size if close < 0 else close + 1
            else:
                self._start(tag, found[3] if found[2] else found[6])
        self._pop(1)
        self._flush()
        if any(self.in_main):  # a declared article: what lies outside is not the article
            self._keep(list(self.in_main))
            self._drop_areas()
        self._doubt_link_lists()
        # a heading goes with the text behind it
        behind = None
        for i in range(len(self.blocks) - 1, -1, -1):
            if not self.headings[i]:
                behind = self.inside[i]
            elif behind is not None:
                self.inside[i] = behind
        self.kept = {b for inside in self.inside for b in inside}

    def _keep(self, which: list[bool]) -> None:
        for name in ("blocks", "inside", "in_main", "links", "headings"):
            setattr(self, name, [x for x, keep in zip(getattr(self, name), which, strict=True) if keep])

    def _drop_areas(self) -> None:
        """Take reader comments and notices out of a declared article."""
        area = [next((b for b in inside if b in self.areas), None) for inside in self.inside]
        own = [i for i, b in enumerate(area) if b is None]
        text_before = [i for i in own if not self.headings[i]]
        if not own:
            return
        total, gone = sum(map(len, self.blocks)), set()
        for b in {x for x in area if x is not None}:
            at = [i for i, x in enumerate(area) if x == b]
            if self.areas[b] == "comment":
                after_text = bool(text_before) and text_before[0] < at[0]
                if after_text or self.items.get(b, 0) > 1:
                    gone.add(b)
            elif 2 * sum(len(self.blocks[i]) for i in at) < total:
                gone.add(b)
        for b in set(self.areas) - gone:  # its shape has cleared it
            self.branches[b][1] = False
        self._keep([b not in gone for b in area])

    def _doubt_link_lists(self) -> None:
        """Branches with two blocks or more that are links throughout are suspect."""
        size: dict[int, list[int]] = {}
        for block, linked, inside in zip(self.blocks, self.links, self.inside, strict=True):
            for b in inside:
                held = size.setdefault(b, [0, 0, 0])
                held[0] += 1
                held[1] += len(block)
                held[2] += linked
        doubted = {b for b, (n, chars, linked) in size.items() if n > 1 and linked >= 0.9 * chars}
        for inside in self.inside:  # what lies in such a list as well
            if doubted & set(inside):
                doubted.update(inside[min(i for i, b in enumerate(inside) if b in doubted):])
        for b in doubted:
            self.branches[b][1] = True

    def nodes(self) -> dict[int, dict]:
        """Style node, text feature, child sequence and mark of each branch that holds text."""
        out = {}
        text: dict[int, list[str]] = {b: [] for b in self.kept}
        for block, inside in zip(self.blocks, self.inside, strict=True):
            for b in inside:
                text[b].append(block)
        for b in self.kept:
            path, suspect, children = self.branches[b]
            out[b] = {"node": _code(path), "feature": _code(*text[b]), "shape": _code(*children), "suspect": suspect}
        return out


_PARSED = ("page_id long, url string, host string, copy long, blocks array<string>, "
           "inside array<array<int>>, branches array<struct<node:long,feature:long,shape:long,suspect:boolean>>")


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.struct([("node", pa.int64()), ("feature", pa.int64()), ("shape", pa.int64()), ("suspect", pa.bool_())])
    for batch in batches:
        ids, urls, sources = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        hosts, copy, blocks, inside, branches = [], [], [], [], []
        for url, source in zip(urls, sources, strict=True):
            page = Page(source or "")
            found = page.nodes()
            m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
            hosts.append(m[1].lower() if m else "")
            copy.append(_code(*page.blocks) if page.blocks else 0)
            blocks.append(page.blocks)
            place = {b: i for i, b in enumerate(found)}
            inside.append([[place[b] for b in x] for x in page.inside])
            branches.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(hosts, pa.string()), pa.array(copy, pa.int64()),
                                          pa.array(blocks, pa.list_(pa.string())), pa.array(inside, pa.list_(pa.list_(pa.int32()))), pa.array(branches, pa.list_(node))],
                                         ["page_id", "url", "host", "copy", "blocks", "inside", "branches"])


def _rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("host", "copy", F.explode("branches").alias("b")).select("host", "copy", "b.*")


def _counted(rows: DataFrame, feature: str) -> DataFrame:
    """Rows (host, node, feature, n pages with it), copies of a page counted once."""
    return rows.select("host", "node", feature, "copy").distinct().groupBy("host", "node", feature).agg(F.count("*").alias("n"))


def importance(parsed: DataFrame) -> DataFrame:
    """host, node, suspect, pages, content importance and importance of every undeclared style node."""
    rows = _rows(parsed)
    pages = (rows.select("host", "node", "suspect", "copy").groupBy("host", "node", "copy").agg(F.max("suspect").alias("suspect"))
             .groupBy("host", "node").agg(F.count("*").alias("pages"), F.max("suspect").alias("doubtful")))
    content = _counted(rows, "feature").groupBy("host", "node").agg((F.count("*") / F.sum("n")).alias("content"))
    shape = _counted(rows, "shape").groupBy("host", "node").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("weighted"))
    base = F.log(F.least(F.greatest("pages", F.lit(2)), F.lit(BASE_PAGES)))
    presentation = F.least(F.lit(1.0), (F.log("total") - F.col("weighted") / F.col("total")) / base)
    prior = F.when(F.col("doubtful"), 0.0).otherwise(1.0)
    shrunk = lambda x: (F.lit(PRIOR_PAGES) * prior + F.col("pages") * x) / (F.lit(PRIOR_PAGES) + F.col("pages"))
    return (pages.join(content, ["host", "node"]).join(shape, ["host", "node"])
            .select("host", "node", "doubtful", "pages", shrunk(F.col("content")).alias("content"),
                    shrunk(F.greatest("content", presentation)).alias("importance")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    parsed = shared_table(pages.select("page_id", "url", "html").mapInArrow(_parse_pages, _PARSED)
                          .withColumn("row_no", F.monotonically_increasing_id()), "parsed")
    known = shared_table(importance(parsed), "known")
    plain = parsed.where("size(branches) = 0")
    mixed = parsed.where("size(branches) > 0")
    rows = mixed.select("row_no", "host", F.posexplode("branches").alias("place", "b")).select("row_no", "host", "place", "b.node", "b.feature", "b.suspect")
    low = known.where((F.col("importance") < LOW) | (F.col("content") < SUSPECT_LOW))
    gone = rows.join(low, ["host", "node"]).where((F.col("importance") < LOW) | (F.col("suspect") & (F.col("content") < SUSPECT_LOW)))
    # the share of the node's pages that say the same, shrunk towards a page that doesn't
    share = (F.col("n") - PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    texts = (_counted(_rows(parsed), "feature").where(F.col("n") > 2 * PRIOR_PAGES).join(known, ["host", "node"])
             .where(share >= REPEATED).select("host", "node", "feature"))
    sure = F.col("importance") < LOW
    gone = gone.select("row_no", "place", sure.alias("sure")).unionByName(
        rows.join(texts, ["host", "node", "feature"]).select("row_no", "place", F.lit(True).alias("sure")))
    hit = shared_table(gone.groupBy("row_no").agg(  # at most the page's own branches
        F.collect_set(F.when(F.col("sure"), F.col("place"))).alias("gone"),
        F.collect_set("place").alias("doubted")), "hit")  # its size is known before texts are joined
    left = "filter({0}, x -> {1} is null or not arrays_overlap(x.inside, {1}))"
    pruned = (mixed.withColumn("held", F.arrays_zip("blocks", "inside")).join(hit, "row_no", "left")
              .withColumn("sure", F.expr(left.format("held", "gone"))).withColumn("clean", F.expr(left.format("sure", "doubted")))
              .withColumn("blocks", F.expr("if(size(clean) > 0, clean, if(size(sure) > 0, sure, held)).blocks")))  # no page is emptied
    text = F.concat_ws(" ", "blocks")
    return (plain.select("page_id", "url", text.alias("text")).unionByName(pruned.select("page_id", "url", text.alias("text")))
            .withColumn("n_chars", F.length("text").cast("long")))
