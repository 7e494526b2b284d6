"""Main text of web pages by wrapper induction.

Pages of a host are instances of a few templates, told apart by the set of their block
elements and classes. One page of each kind is its reference tree, and every page of the
kind is aligned with it by simple tree matching: nodes match only if their labels agree,
and the children of matching nodes are aligned in order so that most nodes match. Counts
per reference node and text over all pages of the kind tell what is constant (template:
the most frequent text) and what varies (content slots). They are combined per task before
they are shuffled, so a host with a third of all pages is counted like any other; only
the reference tree, one page, is sent along with the pages. A text block of a page is
dropped if its node is template or lies in a region whose role is known from its tag or
class. What is left is kept: the text in article or main elements if there are any, or else
every block with words outside links, every heading, and the whole of the densest region.

Defined cases: null html gives an empty text; pages without a url share one nameless
host; copies of a page are extracted one by one, but count as one page of their host, so a page is never
template because it is repeated; an empty table gives an empty result; clashing column names are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, without

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object canvas xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table body html article main section div select".split())
# Tags and class or id words of regions that are not the main text.
OFF_TAGS = RAW | set("nav footer aside form button select input head menu dialog".split())
OFF_WORDS = set(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination paywall popup promo promoted promotion related replies respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
HEADER_WORDS = {"header", "masthead"}
OFF_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S
)
#: A name and its value, quoted or not; quotes elsewhere are plain characters.
_ATTR = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"\w")
#: Numbers of pages and posts in class names, which tell no templates apart.
_DIGITS = re.compile("[0-9]+")


@dataclass(frozen=True)
class WrapperConfig:
    """least: pages with a node before it can be template; constant, constant_in_main: share of them with equal text;
    least_kind: pages of a shape before it has a reference of its own;
    cells: pairs of children up to which plain lists are faster than arrays, with the same result."""

    least: int = 5
    constant: float = 0.8
    least_in_main: int = 20
    least_kind: int = 20
    constant_in_main: float = 0.95
    cells: int = 2500


@dataclass
class Node:
    tag: str
    label: str
    parent: int
    off: int
    kids: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def _marks(tag: str, attrs: str) -> tuple[str, int]:
    """The class attribute, and whether class, id or role mark a region that is not main text.

    0: no; 1: a page header, which inside the main text is its own heading; 2: yes.
    An article's own class counts only by whole names: comments-open says nothing of its role.
    """
    cls, off = "", 0
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        name = name.lower()
        if name == "class":
            cls = value
        if name in ("class", "id"):
            low = _CAMEL.sub(" ", value).lower()
            words = set(low.split() if tag in MAIN_TAGS else _WORDS.findall(low))
            off = max(off, 2 * (not OFF_WORDS.isdisjoint(words)), int(not HEADER_WORDS.isdisjoint(words)))
        elif name == "role":
            off = max(off, 2 * (value.lower() in OFF_ROLES))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            off = 2
        elif name == "style":
            off = max(off, 2 * ("display:none" in value.replace(" ", "").lower()))
    return cls, off


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The element tree, as a list with node 0 the root, and the texts in page order as (node, text).

    An empty text stands for the border of a block.
    """
    nodes = [Node("", "", -1, 0)]
    texts: list[tuple[int, str]] = []
    stack, open_ = [0], {}
    at, n = 0, len(page)

    def close(k: int) -> None:
        while len(stack) > k:
            t = nodes[stack.pop()].tag
            open_[t] -= 1
            if t not in INLINE:
                texts.append((stack[-1], ""))

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        if text:
            texts.append((stack[-1], text))
            nodes[stack[-1]].text.append(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if open_.get(tag):
                k = len(stack) - 1
                while nodes[stack[k]].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in CLOSES_P and open_.get("p"):
            k = len(stack) - 1
            while nodes[stack[k]].tag != "p":
                k -= 1
            close(k)
        elif tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]].tag
                if t in SAME[tag]:
                    close(k)
                    break
                if t in SCOPE:
                    break
        cls, off = _marks(tag, m.group(3)) if m.group(3) else ("", 0)
        if tag not in INLINE:
            texts.append((stack[-1], ""))
        elif tag == "br":
            texts.append((stack[-1], " "))
        if tag in VOID or m.group(3).endswith("/") and tag in RAW:
            continue
        if tag in RAW:  # its content is not markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            texts.append((stack[-1], ""))
            continue
        nodes.append(Node(tag, f"{tag}.{_DIGITS.sub('', cls)}" if cls else tag, stack[-1], off))
        nodes[stack[-1]].kids.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        open_[tag] = open_.get(tag, 0) + 1
    return nodes, texts


def own_text(node: Node) -> str:
    return _BLANK.sub(" ", "".join(node.text)).strip()


def shapes(nodes: list[Node], ids: dict[tuple, int]) -> list[int]:
    """For each node the number of its subtree's labels and structure; equal subtrees have equal numbers in ids."""
    out = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        key = (nodes[i].label, *[out[k] for k in nodes[i].kids])
        out[i] = ids.setdefault(key, len(ids))
    return out


def matching(g: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The in-order matching of rows and columns with the greatest sum of g, and its places."""
    n, m = len(g), len(g[0])
    w = [[0] * (m + 1) for _ in range(n + 1)]
    for p in range(n):
        row, up, x = w[p + 1], w[p], g[p]
        for q in range(m):
            row[q + 1] = max(up[q] + x[q], up[q + 1], row[q])
    pairs, p, q = [], n, m
    while p and q:
        if g[p - 1][q - 1] and w[p][q] == w[p - 1][q - 1] + g[p - 1][q - 1]:
            p, q = p - 1, q - 1
            pairs.append((p, q))
        elif w[p][q] == w[p - 1][q]:
            p -= 1
        else:
            q -= 1
    return w[-1][-1], pairs


def long_matching(gains: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """matching() of g[p][q] = gains[x[p], y[q]], row by row, with two bits kept of each cell."""
    up = np.zeros(len(y) + 1, np.int64)
    took, above = [], []
    for p in x:
        g = gains[p, y]
        with_ = up[:-1] + g
        row = np.concatenate((up[:1], np.maximum.accumulate(np.maximum(with_, up[1:]))))
        took.append(np.packbits((g > 0) & (row[1:] == with_)))
        above.append(np.packbits(row[1:] == up[1:]))
        up = row
    pairs, p, q = [], len(x), len(y)
    while p and q:
        k, bit = (q - 1) >> 3, 128 >> ((q - 1) & 7)
        if took[p - 1][k] & bit:
            p, q = p - 1, q - 1
            pairs.append((p, q))
        elif above[p - 1][k] & bit:
            p -= 1
        else:
            q -= 1
    return int(up[-1]), pairs


def align(a: list[Node], b: list[Node], cfg: WrapperConfig) -> dict[int, int]:
    """Simple tree matching: for nodes of a the matching nodes of b.

    What two subtrees gain depends on their shapes alone, so it is found once per pair of shapes, the inner ones first.
    """
    ids: dict[tuple, int] = {}
    sa, sb = shapes(a, ids), shapes(b, ids)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def solve(i: int, j: int) -> list[tuple[int, int]]:
        """Pairs of nodes that must be solved before i and j; none if they are solved now."""
        x, y = a[i].kids, b[j].kids
        if not x or not y:
            memo[sa[i], sb[j]] = 0, []
            return []
        xs, ys = {sa[k]: k for k in x}, {sb[k]: k for k in y}
        by: dict[str, list[int]] = {}
        for k in ys.values():
            by.setdefault(b[k].label, []).append(k)
        met = [(k, r) for k in xs.values() for r in by.get(a[k].label, ())]
        if missing := [(k, r) for k, r in met if (sa[k], sb[r]) not in memo]:
            return missing
        gain = {(sa[k], sb[r]): 1 + memo[sa[k], sb[r]][0] for k, r in met}
        if len(x) * len(y) <= cfg.cells:
            memo[sa[i], sb[j]] = matching([[gain.get((sa[k], sb[r]), 0) for r in y] for k in x])
        else:  # the same, faster for long lists
            px, py = {s: n for n, s in enumerate(xs)}, {s: n for n, s in enumerate(ys)}
            gains = np.zeros((len(px), len(py)), np.int64)
            for (s, t), v in gain.items():
                gains[px[s], py[t]] = v
            memo[sa[i], sb[j]] = long_matching(gains, np.array([px[sa[k]] for k in x]), np.array([py[sb[k]] for k in y]))
        return []

    out, pairs = {0: 0}, [(0, 0)]
    todo = [(0, 0)]
    while todo:
        if (sa[todo[-1][0]], sb[todo[-1][1]]) in memo:
            todo.pop()
        elif missing := solve(*todo[-1]):
            todo += missing
        else:
            todo.pop()
    while pairs:
        i, j = pairs.pop()
        for p, q in memo[sa[i], sb[j]][1]:
            i2, j2 = a[i].kids[p], b[j].kids[q]
            out[i2] = j2
            pairs.append((i2, j2))
    return out


def blocks(nodes: list[Node], texts: list[tuple[int, str]], template: set[int]) -> list[str]:
    """The main text's blocks, without the nodes in ``template``."""
    off = [False] * len(nodes)
    main = [-1] * len(nodes)  # the outermost article or main element around a node
    holds = [False] * len(nodes)  # has an article or main element inside
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in MAIN_TAGS or holds[i]:
            holds[nodes[i].parent] = True
    for i in range(1, len(nodes)):
        n, p = nodes[i], nodes[i].parent
        main[i] = main[p] if main[p] >= 0 else (i if n.tag in MAIN_TAGS else -1)
        off_here = (n.tag in OFF_TAGS or n.off == 2 or ((n.tag == "header" or n.off) and main[i] < 0)) and not holds[i]
        off[i] = off[p] or i in template or off_here
    live: dict[int, int] = {}
    for i, t in texts:
        if not off[i] and main[i] >= 0:
            live[main[i]] = live.get(main[i], 0) + len(t.strip())
    if any(live.values()):
        # an element inside another main element belongs to that one
        allowed = [main[i] >= 0 and live.get(main[i], 0) > 0 for i in range(len(nodes))]
    else:
        allowed = [x or y for x, y in zip(_densest(nodes, texts, off), _running(nodes, texts, off), strict=True)]
    out, now = [], []
    for i, t in [*texts, (0, "")]:
        if t == "":
            if now and (block := _BLANK.sub(" ", "".join(now)).strip()):
                out.append(block)
            now = []
        elif not off[i] and allowed[i]:
            now.append(t)
    return out


def _densest(nodes: list[Node], texts: list[tuple[int, str]], off: list[bool]) -> list[bool]:
    """Without article or main elements: nodes in the region that gathers most running text."""
    score = [0.0] * len(nodes)
    prose = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd".split())
    for i, t in texts:
        size = len(t.strip())
        if off[i] or not size:
            continue
        k, linked = i, False
        while k > 0 and nodes[k].tag not in prose and (nodes[k].tag in INLINE):
            linked |= nodes[k].tag == "a"
            k = nodes[k].parent
        if linked:
            continue
        holder = nodes[k].parent if nodes[k].tag in prose and k else k
        while holder > 0 and nodes[holder].tag in ("ul", "ol", "dl", "table", "tbody", "tr", "blockquote"):
            holder = nodes[holder].parent
        score[holder] += size
    best = max(range(len(nodes)), key=lambda i: score[i])
    if not score[best]:
        return [True] * len(nodes)
    # go up while that adds much text
    total = list(score)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    while best > 0 and total[nodes[best].parent] > 1.3 * total[best]:
        best = nodes[best].parent
    inside = [False] * len(nodes)
    inside[best] = True
    for i in range(1, len(nodes)):
        inside[i] = inside[i] or inside[nodes[i].parent]
    return inside


def _running(nodes: list[Node], texts: list[tuple[int, str]], off: list[bool]) -> list[bool]:
    """Without article or main elements: nodes in blocks with words outside links, and in headings."""
    block = list(range(len(nodes)))  # the nearest element around a node that is not inline
    linked = [False] * len(nodes)
    for i in range(1, len(nodes)):
        if nodes[i].tag in INLINE:
            p = nodes[i].parent
            block[i], linked[i] = block[p], linked[p] or nodes[i].tag == "a"
    prose = {block[i] for i, t in texts if not off[i] and (not linked[i] or nodes[block[i]].tag in HEADINGS) and _WORD.search(t)}
    return [block[i] in prose for i in range(len(nodes))]


class References:
    """Parsed reference trees lately met by this task."""

    def __init__(self, limit: int = 200):
        self.limit, self.by = limit, {}

    def of(self, host: str, kind: int, page: str) -> list[Node]:
        if (host, kind) not in self.by:
            if len(self.by) >= self.limit:
                self.by.clear()
            self.by[host, kind] = parse(page)[0]
        return self.by[host, kind]


def digest(text: str) -> int:
    """A number of 64 bits for a node's text, 0 for none."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if text else 0


def shape(page: Column) -> Column:
    """A number for the set of block elements with their classes; pages of one template mostly share it.

    Digits in class names count for nothing, since they number pages and posts.
    """
    tags = F.regexp_extract_all(page, F.lit(r"<((?i:article|aside|body|div|footer|form|header|main|nav|section)(?=[\s/>])[^>]*)>"), F.lit(1))
    name = lambda t: F.regexp_extract(t, "^[a-z]+", 0)
    cls = lambda t: F.regexp_replace(F.regexp_extract(t, r"\sclass\s*=\s*[\"']?([^\"'>]*)", 1), "[0-9]+", "")
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.concat_ws(".", name(F.lower(t)), cls(F.lower(t)))))))


def node_counts(pages: DataFrame, cfg: WrapperConfig) -> DataFrame:
    """(host, kind, node, digest, n): pages aligned with a reference node, by their text there; each counts by its ``_weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = References()
        for b in batches:
            count: dict[tuple[str, int, int, int], float] = {}
            for host, kind, page, ref, weight in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                nodes, _ = parse(page)
                for i, j in align(nodes, refs.of(host, kind, ref), cfg).items():
                    key = host, kind, j, digest(own_text(nodes[i]))
                    count[key] = count.get(key, 0) + weight
            if count:
                host, kind, node, text = zip(*count, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host), pa.array(kind, pa.int64()), pa.array(node, pa.int32()), pa.array(text, pa.int64()), pa.array(count.values(), pa.float64())],
                    names=["host", "kind", "node", "digest", "n"],
                )

    columns = [F.col("_host").alias("host"), F.col("_kind").alias("kind"), F.col("_page").alias("page"), F.col("_ref").alias("ref"), F.col("_weight").alias("weight")]
    return pages.select(*columns).mapInArrow(run, "host string, kind long, node int, digest long, n double")


def weighted(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with ``_weight``: one part in as many as their host has of the same page.

    Copies are counted by digest, combined before the shuffle; only repeated pages have a row to join.
    """
    page = F.xxhash64("_page").alias("_copy")
    copies = scratch.save(pages.groupBy("_host", page).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"))
    met = with_known(pages.withColumn("_copy", page), copies, ["_host", "_copy"], F.octet_length("_host") + 24, "left")
    return met.withColumn("_weight", 1 / F.coalesce("_copies", F.lit(1))).drop("_copy", "_copies")


def extract(pages: DataFrame, cfg: WrapperConfig, carried: list[str]) -> DataFrame:
    """The ``carried`` columns with text and n_chars."""
    kept = pages.select(*[F.col(f"`{c}`") for c in carried])
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = References()
        for b in batches:
            out = []
            inputs = ("_host", "_kind", "_page", "_ref", "_template")
            for host, kind, page, ref, template in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True):
                nodes, texts = parse(page)
                fixed = set()
                if template and ref:
                    want = {t["node"]: (t["digest"], t["in_main"]) for t in template}
                    inner = [False] * len(nodes)
                    for i in range(1, len(nodes)):
                        inner[i] = inner[nodes[i].parent] or nodes[i].tag in MAIN_TAGS
                    for i, j in align(nodes, refs.of(host, kind, ref), cfg).items():
                        if j in want and (want[j][1] or not inner[i]) and digest(own_text(nodes[i])) == want[j][0]:
                            fixed.add(i)
                out.append("\n".join(blocks(nodes, texts, fixed)))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(carried))] + [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=[*carried, "text", "n_chars"],
            )

    return pages.select(*kept.columns, "_host", "_kind", "_page", "_ref", "_template").mapInArrow(run, schema)


#: A side of fewer bytes, measured first, is broadcast.
BROADCAST_BYTES = 32 << 20
SALTS = 16


def with_known(pages: DataFrame, known: DataFrame, keys: list[str], size: Column, how: str) -> DataFrame:
    """pages with what known has for their keys; size is the bytes of a row of known.

    A host may hold a third of all pages, so pages are never gathered by host: a small side is
    broadcast, and a larger one is repeated for each of SALTS parts that a key's pages are dealt to.
    """
    if known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return pages.join(F.broadcast(known), keys, how)
    salted = known.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = pages.withColumn("_salt", F.pmod(F.xxhash64("_page"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def references(base: DataFrame, scratch: Scratch, cfg: WrapperConfig) -> tuple[DataFrame, DataFrame]:
    """base with the kind of each page, and (_host, _kind, _ref): one page of each kind.

    A host's most frequent shape is its kind 0, and so is every shape of fewer than cfg.least_kind pages; the others
    are kinds of their own. Hosts of fewer than cfg.least pages have no reference. A page without tags is
    only taken where its kind has no other.
    """
    pick = F.struct(F.instr("_page", "<") == 0, F.xxhash64("_page"), F.length("_page"))
    by_shape = scratch.save(base.groupBy("_host", "_shape").agg(F.count(F.lit(1)).alias("_n"), F.min(pick).alias("_pick")))
    per_host = by_shape.groupBy("_host").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "_shape")).alias("_most"))
    ranked = by_shape.join(per_host.filter(F.col("_all") >= cfg.least), "_host").withColumn("_main", F.col("_shape") == F.col("_most._shape"))
    chosen = scratch.save(
        ranked.filter(F.col("_main") | (F.col("_n") >= cfg.least_kind)).select("_host", "_shape", F.when(F.col("_main"), F.lit(0)).otherwise(F.col("_shape")).alias("_kind"), "_pick")
    )
    named = with_known(base, chosen.select("_host", "_shape", "_kind"), ["_host", "_shape"], F.octet_length("_host") + 16, "left")
    refs = base.withColumn("_pick", pick).join(chosen, ["_host", "_shape", "_pick"]).groupBy("_host", "_kind").agg(F.min("_page").alias("_ref"))
    return named.withColumn("_kind", F.coalesce("_kind", F.lit(0).cast("long"))), scratch.save(refs)


def main_text(pages: DataFrame, cfg: WrapperConfig = WrapperConfig(), html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages without html, with the main text and its length."""
    scratch = Scratch(pages.sparkSession)
    inner = ["_host", "_page", "_shape", "_kind", "_pick", "_salt", "_ref", "_template", "_weight", "_copy", "_copies"]
    carried = without(pages.drop(html_col), ["text", "n_chars", *inner]).columns
    host = F.coalesce(F.regexp_extract(F.lower(url_col), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    page = F.coalesce(html_col, F.lit(""))
    base = pages.select(*[F.col(f"`{c}`") for c in carried], host.alias("_host"), page.alias("_page"), shape(page).alias("_shape"))
    named, refs = references(base, scratch, cfg)
    size = F.octet_length("_ref")
    counts = node_counts(with_known(weighted(named, scratch), refs, ["_host", "_kind"], size, "inner"), cfg)
    by_text = counts.groupBy("host", "kind", "node", "digest").agg(F.round(F.sum("n"), 3).alias("n"))  # parts of copies add up to whole pages
    summed = by_text.groupBy("host", "kind", "node").agg(F.sum("n").alias("met"), F.max(F.when(F.col("digest") != 0, F.struct("n", "digest"))).alias("top"))
    strict = (F.col("met") >= cfg.least_in_main) & (F.col("top.n") >= cfg.constant_in_main * F.col("met"))
    fixed = summed.filter((F.col("met") >= cfg.least) & (F.col("top.n") >= cfg.constant * F.col("met")))
    node = F.struct("node", F.col("top.digest").alias("digest"), strict.alias("in_main"))
    template = fixed.groupBy(F.col("host").alias("_host"), F.col("kind").alias("_kind")).agg(F.collect_list(node).alias("_template"))
    known = scratch.save(refs.join(template, ["_host", "_kind"]))
    return extract(with_known(named, known, ["_host", "_kind"], size, "left"), cfg, carried)
