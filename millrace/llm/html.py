"""HTML extraction with consensus host paths.

A page is read as a tree by a forgiving tag scanner. Parts that are never
article (menus, headers and footers of the page, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are told by tag, role and the names in
class and id, and are left out everywhere. A name marks such a part if it says
that and nothing else: `related-posts` does, `related-work` does not. Headers
inside what is marked as article or main belong to it, and so do headers that
hold the page's only h1. Names that may mark either (`teaser`, `alert`, `widget`,
`discussion`) decide nothing: their parts are evidence for the host. Spark counts
their texts by (host, generalised path, hash of text); where one text stands in at
least two pages and in half of the parts at that path, or where most pages have
links there for the most part, the host's pages are read without them, else they
are article. The other containers are scored by
the text they hold outside links, and each page votes for one generalised path
(tags with their class words, digits as N). Spark counts the votes per host,
pre-aggregated by (host, path); the winner of the host is then used to extract
every page of it again. A page without the winning path, or without text
there, falls back on its own vote.

Up to `broadcast_hosts` rows of host evidence go to every worker; beyond that
bound they are joined by host, salted, so that a host of a third of all pages is
spread; both ways give the same rows.

Defined cases: null or empty html has empty text; text outside any tag counts as
one block; truncated tags and unclosed elements end with the page; null urls
are one host of their own; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bytesfast import frugal
from millrace.llm.keys import table
from millrace.llm.urls import host_of

BROADCAST_HOSTS = 100_000
SALTS = 16
HOLDS = 0.6

#: Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select option xmp noembed noframes".split())
OUT = frozenset("nav footer aside form button fieldset label dialog menu head audio video canvas map".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
KEEPS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())  # their names say nothing
CONTAINERS = frozenset("body article main section div td center".split())
STARTS_INSIDE = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not article, those that do so outside an article only, those
#: that say nothing beside them, and those that mark an article.
OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot adunit adbox bottombar breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies dfp disqus footer form gdpr hidden login menu
    menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall
    popup promoted related replies reply respond responses share sharing sidebar sidenav
    signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar contentinfo
    complementary""".split()
)
OUT_HEADS = frozenset("header masthead".split())
MAYBE = frozenset("alert aside banner discussion promo promotion recommended search teaser widget widgets".split())
FILLERS = frozenset(
    """a all and area articles bar block bottom box button buttons by center col column container content cookie count default desktop field
    fixed footer for from group head header holder icon icons info inner item items js large layout left left link links list
    load google leaderboard main meta mobile module n native of on outer page panel policy post posts primary recent right row secondary section side site slot
    small stories sub tab tabs the thread title to top ul unit user users view wrap wrapper zone""".split()
)
ARTICLE_WORDS = frozenset("article articlebody post entry hentry story".split())
ARTICLE_FILLERS = frozenset("area blog body box col column container content detail details full id inner layout main news page single text type view wrap wrapper".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^\s<>/]*+(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|</?[a-zA-Z][^<>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_SIZE = re.compile(r"\d+(?:x\d+)?")
_NAME = re.compile(r"</?([a-zA-Z][^\s<>/]*)")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("blocks", "heading", "inside", "kids", "mark", "mass", "parent", "semantic", "tag")

    def __init__(self, tag, mark, parent, semantic=False):
        self.tag, self.mark, self.parent, self.semantic = tag, mark, parent, semantic
        self.mass, self.heading, self.kids = 0, False, []
        self.inside = semantic or tag in STARTS_INSIDE or (parent is not None and parent.inside)
        self.blocks: tuple[int, int] = (0, 0)

    @property
    def path(self) -> str:
        """The generalised path: the marks of the containers from the root down to this one."""
        marks, node = [], self
        while node.parent is not None:
            marks.append(node.mark)
            node = node.parent
        return ">".join(reversed(marks))


def _words(value: str) -> list[str]:
    return [w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()) if w]


def _marks_out(names: list[str], inside: bool) -> str:
    """What these names (of class, id or role) say of a part: "out" (not article), "head", "maybe", or "" (nothing)."""
    said = ""
    for name in names:
        words = [w for w in _words(name) if not _SIZE.fullmatch(w)]
        out = [w for w in words if w in OUT_WORDS or w.endswith("comments")]
        head = [w for w in words if w in OUT_HEADS] if not inside else []
        maybe = [w for w in words if w in MAYBE]
        if not all(w in OUT_WORDS or w.endswith("comments") or w in OUT_HEADS or w in MAYBE or w in FILLERS for w in words):
            continue
        if out and not maybe:
            return "out"
        said = said or ("head" if head and not maybe else "maybe" if maybe else "")
    return said


def _marks_article(names: list[str]) -> bool:
    for name in names:
        words = [w for w in _words(name) if not w.isdigit()]
        if any(w in ARTICLE_WORDS for w in words) and all(w in ARTICLE_WORDS or w in ARTICLE_FILLERS for w in words):
            return True
    return False


class Part:
    """A part that is article or not, by what the page or its host shows."""

    __slots__ = ("chars", "head", "linked", "path", "texts", "titles", "up")

    def __init__(self, head, path, up):
        self.head, self.path, self.up = head, path, up
        self.chars = self.linked = self.titles = 0
        self.texts: list[str] = []


def parse(page: str) -> tuple[Node, list[str], list[int], list[Part], int]:
    """(root of the containers, blocks of text, part that each is in or -1, parts, number of h1 outside of parts):
    a container's blocks are a range of the blocks."""
    root = Node("", "", None)
    blocks: list[str] = []
    within: list[int] = []
    parts: list[Part] = []
    part, titles = -1, 0
    unclosed: set[str] = set()
    buf: list[str] = []
    stack: list[tuple[str, Node, bool, int]] = []  # element, the container and the part it is in, is it left out
    here, links, dropped = root, 0, 0
    headings = frozenset(("h1", "h2"))
    open_tags: Counter = Counter()

    def end_block(heading=False):
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                blocks.append(text)
                within.append(part)
                if part >= 0:
                    parts[part].texts.append(text)
                if heading:
                    node = here
                    while node is not None:
                        node.heading = True
                        node = node.parent

    def pop():
        nonlocal here, links, dropped, part
        tag, node, out, before = stack.pop()
        open_tags[tag] -= 1
        if tag not in INLINE:
            end_block(tag in headings)
        part = before
        if out:
            dropped -= 1
        if tag == "a":
            links -= 1
        if node is not here:
            here.blocks = (here.blocks[0], len(blocks))
            here = node

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        lo = m.start() if m else size
        if lo > at and not dropped:
            text = page[at:lo]
            if "&" in text:
                text = _html.unescape(text)
            buf.append(text)
            n = len(text.strip())
            if part >= 0:
                parts[part].chars += n
                parts[part].linked += n if links else 0
            elif not links:
                here.mass += n
        if not m:
            break
        at = m.end()
        token = m[0]
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE:
                end_block()
            continue
        if tag in VOID:
            if tag not in INLINE:
                end_block()
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not close:
                unclosed.add(tag)  # nor does one later on
            at = close.end() if close else (size if tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript", "template") else at)
            if tag not in INLINE:
                end_block()
            continue
        if tag == "p" or (tag not in INLINE and stack and stack[-1][0] == "p"):
            while open_tags["p"] and stack[-1][0] in INLINE:
                pop()  # an open paragraph ends where the next block begins; only inline elements stand in one
            if stack and stack[-1][0] == "p":
                pop()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(token[len(name[0]) :])} if len(token) > len(name[0]) + 1 else {}
        classes = _words(attrs.get("class", ""))
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split() if attrs else []
        inside = here.inside
        says = _marks_out(names, inside) if names and tag not in KEEPS else ""
        out = tag in OUT or says == "out" or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        head = (tag == "header" and not inside) or says == "head"
        if tag not in INLINE:
            end_block()
        stack.append((tag, here, out, part))
        open_tags[tag] += 1
        if out:
            dropped += 1
        elif not dropped and (head or says == "maybe"):
            mark = re.sub(r"\d+", "N", ".".join(sorted(set(classes))))
            parts.append(Part(head, f"{here.path}>{tag}.{mark}#{re.sub(r'[0-9]+', 'N', attrs.get('id', ''))}", part))
            part = len(parts) - 1
        if tag == "h1" and not dropped:
            if part >= 0:
                parts[part].titles += 1
            else:
                titles += 1
        if tag == "a":
            links += 1
        if tag in CONTAINERS and not dropped:
            mark = re.sub(r"\d+", "N", ".".join(sorted(set(classes))))
            node = Node(tag, tag + (f".{mark}" if mark else ""), here, tag == "article" or _marks_article(names))
            node.blocks = (len(blocks), len(blocks))
            here.kids.append(node)
            here = node
    while stack:
        pop()
    end_block()
    root.blocks = (0, len(blocks))
    return root, blocks, within, parts, titles


def kept_parts(parts: list[Part], titles: int, out: frozenset) -> list[bool]:
    """Which parts are article: heads that hold the only h1, and others whose path is not among those that the host shows as none."""
    for p in reversed(parts):
        if p.up >= 0:
            parts[p.up].titles += p.titles
    got: list[bool] = []
    for p in parts:
        fine = p.titles == 1 and not titles if p.head else p.path not in out
        got.append(fine and (p.up < 0 or got[p.up]))
    return got


def _total(node: Node) -> int:
    """Fills in masses with those of the containers below, without recursion."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += n.kids
    for n in reversed(order):
        if n.parent is not None:
            n.parent.mass += n.mass
    return node.mass


def vote(root: Node) -> Node:
    """The container that holds the article: down from the root while one path holds most of the text, to the first that is marked as an article."""
    _total(root)
    node = root
    while not node.semantic and node.kids:
        best = max(node.kids, key=lambda k: (k.mass, -k.blocks[0]))
        named = [k for k in node.kids if k.semantic and k.mass * 2 >= best.mass]
        if named:
            best = max(named, key=lambda k: (k.mass, -k.blocks[0]))
        if best.mass < HOLDS * node.mass and not best.semantic:
            break
        if node.heading and not best.heading and node.tag not in ("", "body") and not best.semantic:
            break
        node = best
    return node


def _at(root: Node, path: str) -> list[Node]:
    """The containers at a path, in the page's order."""
    found = [root]
    for mark in path.split(">") if path else []:
        found = [k for n in found for k in n.kids if k.mark == mark]
    return found


def extract(page: str | None, path: str | None = None, out: frozenset = frozenset()) -> tuple[str, str, int]:
    """(text, path of its container, characters outside links): of the given path, or where it has no text, of the page's
    own vote; less the parts at the paths of `out`."""
    root, blocks, within, parts, titles = parse(page or "")
    kept = kept_parts(parts, titles, out)
    text = lambda n: [blocks[i] for i in range(*n.blocks) if within[i] < 0 or kept[within[i]]]
    if path is not None:
        found = " ".join(b for n in _at(root, path) for b in text(n))
        if found:
            return found, path, 0
    node = vote(root)
    return " ".join(text(node)), node.path, node.mass


@frugal
def _vote_batches(it):
    """For each page its vote (kind 0; weight: characters), and for each part that may be article its text (kind 1; weight: is most of it links?)."""
    for whole in it:
        for batch in (whole.slice(z, 256) for z in range(0, whole.num_rows, 256)):
            got = []
            for i, page in enumerate(batch.column("html").to_pylist()):
                root, _, _, parts, _ = parse(page or "")
                node = vote(root)
                got.append((i, 0, node.path, "", node.mass))
                got += [(i, 1, p.path, hashlib.md5("\n".join(p.texts).encode("utf-8", "surrogatepass")).hexdigest(), int(2 * p.linked > p.chars)) for p in parts if not p.head and p.chars]
            rows, kinds, paths, hashes, weights = zip(*got, strict=True) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(rows, pa.int64())), pa.array(kinds, pa.int32()), pa.array(paths, pa.string()), pa.array(hashes, pa.string()), pa.array(weights, pa.int64())], names=["host", "kind", "path", "hash", "weight"])


def host_evidence(pages: DataFrame) -> DataFrame:
    """host, path, out: for each host the path with the most pages (ties go to more text, then to the path's order), and
    the paths of parts that its pages show not to be article. pages: host, html."""
    seen = pages.select("host", "html").mapInArrow(_vote_batches, "host string, kind int, path string, hash string, weight long")
    seen = table(seen.groupBy("host", "kind", "path", "hash").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "seen")
    votes = seen.where("kind = 0 and weight > 0").groupBy("host").agg(F.max(F.struct("n", "weight", "path"))["path"].alias("path"))
    parts = seen.where("kind = 1").groupBy("host", "path").agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.sum("weight").alias("linked"))
    out = parts.where("(same >= 2 and 2 * same >= n) or 2 * linked > n").groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("out"))
    both = votes.join(out.withColumnRenamed("host", "h"), votes["host"].eqNullSafe(F.col("h")), "full")
    return both.select(F.coalesce("host", "h").alias("host"), "path", F.coalesce("out", F.array().cast("array<string>")).alias("out"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """A row for each page: its id, url, text, and path (of the container the text is from)."""
    src = pages.select(pages[page_id].alias("id"), pages[url].alias("url"), host_of(pages[url].cast("string")).alias("host"), pages[html].cast("string").alias("html"))
    won = table(host_evidence(src), "paths")
    schema = T.StructType([src.schema["id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])

    def texts(batch, evidence):
        got = [extract(h, *e) for h, e in zip(batch.column("html").to_pylist(), evidence, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["id", "url", "text", "path"])

    rows = won.select(F.size("out") + 1).groupBy().sum().first()[0] or 0
    if rows <= broadcast_hosts:
        held = src.sparkSession.sparkContext.broadcast({r["host"]: (r["path"], frozenset(r["out"])) for r in won.collect()})

        def run(it):
            for batch in it:
                yield texts(batch, [held.value.get(host, (None, frozenset())) for host in batch.column("host").to_pylist()])

        return src.mapInArrow(run, schema).toDF(page_id, url, "text", "path")
    salted = won.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).withColumnRenamed("host", "of")
    dealt = src.withColumn("salt0", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, dealt["host"].eqNullSafe(salted["of"]) & (F.col("salt0") == F.col("salt")), "left").select("id", "url", "html", "path", "out")

    def run(it):
        for batch in it:
            yield texts(batch, [(p, frozenset(o or ())) for p, o in zip(batch.column("path").to_pylist(), batch.column("out").to_pylist(), strict=True)])

    return joined.mapInArrow(run, schema).toDF(page_id, url, "text", "path")
