"""Main text of web pages by wrapper induction.

Pages of a host come from one program, so their trees align. A page's tree of block elements is folded
first: children of the same shape under one parent are one node, as a list's items are. The distinct
trees of a host are merged into its wrapper by simple tree matching: nodes that match are one, others
are put between them; then each tree is aligned with the wrapper in the same way, once however many
pages have it. What a wrapper node holds on nearly all pages is template; nodes outside the main region
whose text is links are menus; the others are slots. The main region is found by what varies: from the root down, the
child that holds most of the letters of slots, as long as that is a container and its parent holds no headings or paragraphs of its own
(see region_of()); an element called article or main only breaks ties. Text is what slots hold in it, without elements that
HTML says are no content (menus, headers, footers, asides, forms, scripts) or whose class, id or role says so (adverts,
notices, comments), as their texts vary from page to page, too.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Generator, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import on_workers, shared_dir, stored
from .urls import host_and_path

#: Different pages that must agree on a text, the share of a node's pages that they must be, and the share of a node's
#: letters that must be links to make it a menu.
TEMPLATE, SHARE, LINKS = 3, 0.9, 0.7
#: Share of its parent's letters that a child must hold to be the way to the main region.
DOMINANT = 0.6
#: Parts in which the trees of a host are merged before those are, and in which its pages meet the wrapper; rows are
#: dealt by them, nothing is left out.
PARTS, SALT = 64, 16
#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html option td th tr tbody thead tfoot legend summary".split())
NEVER = frozenset("head script style noscript template iframe textarea title nav header footer aside form button select dialog svg math object".split())
AWAY = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
FLAT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# A quote counts after an equals sign only, as in browsers; a tag that doesn't end is none.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "away", "parts", "kids", "number")

    def __init__(self, tag: str, away: bool):
        self.tag, self.away, self.parts, self.kids, self.number = tag, away, [], [], -1


@lru_cache(4096)
def _away(tag: str, attrs: str) -> bool:
    if tag in NEVER:
        return True
    if not attrs.strip():
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id") and AWAY.intersection(re.split(r"[^a-z0-9]+", value)) or name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def parse(source: str) -> Node:
    """A tree with end tags supplied as browsers do for paragraphs, items and cells."""
    root = Node("html", False)
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].parts.append(source[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br", False))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack[:3]):
            continue
        if tag == "body":
            del stack[1:]
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in SAME_CLOSES else ():
            if stack[i].tag in SAME_CLOSES[tag]:
                del stack[i:]
            elif stack[i].tag in ("ul", "ol", "dl", "table", "select", "tbody", "thead", "tfoot"):
                break
        node = Node(tag, _away(tag, m[3]))
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            node.parts.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


Tree = tuple[tuple[str, int], ...]  # (tag, number of children) of every node, parents first


class Shape:
    """A node of a folded tree."""

    __slots__ = ("tag", "kids")

    def __init__(self, tag: str, kids: list[Shape]):
        self.tag, self.kids = tag, kids


def fold(root: Node) -> str:
    """The folded tree of a page's block elements as text; every element gets its node's number in it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if k.tag not in VOID)
    known: dict[tuple, int] = {}
    shapes: list[tuple[str, tuple[int, ...]]] = []
    size: list[int] = []
    of: dict[int, int] = {}
    under: dict[int, tuple[int, ...]] = {}  # of an inline element: the blocks in it, which count as its parent's
    for node in reversed(order):
        kids = tuple(dict.fromkeys(x for k in node.kids if k.tag not in VOID for x in ((of[id(k)],) if k.tag in BLOCK else under[id(k)])))
        if node.tag not in BLOCK:
            under[id(node)] = kids
            continue
        shape = known.setdefault((node.tag, kids), len(known))
        if shape == len(shapes):
            shapes.append((node.tag, kids))
            size.append(1 + sum(size[k] for k in kids))
        of[id(node)] = shape
    root.number = 0
    places: dict[int, dict[int, int]] = {}
    for node in order:
        place = places.pop(id(node), None)
        if place is None:
            at, place = node.number + 1, {}
            for k in shapes[of[id(node)]][1]:
                place[k] = at
                at += size[k]
        for k in node.kids:
            if k.tag in VOID:
                continue
            if k.tag in BLOCK:
                k.number = place[of[id(k)]]
            else:
                k.number, places[id(k)] = node.number, place
    out, todo = [], [of[id(root)]]
    while todo:
        tag, kids = shapes[todo.pop()]
        out.append(f"{tag} {len(kids)}")
        todo.extend(reversed(kids))
    return ";".join(out)


def unfold(text: str) -> Shape:
    """The tree that fold() wrote."""
    top = Shape("", [])
    stack = [(top, 1)]
    for x in text.split(";"):
        tag, n = x.rsplit(" ", 1)
        while not stack[-1][1]:
            stack.pop()
        node, left = stack[-1]
        stack[-1] = (node, left - 1)
        node.kids.append(Shape(tag, []))
        stack.append((node.kids[-1], int(n)))
    return top.kids[0]


def written(tree: Shape) -> str:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(f"{node.tag} {len(node.kids)}")
        todo.extend(reversed(node.kids))
    return ";".join(out)


def _match(a: Shape, b: Shape) -> Generator:
    """Simple tree matching of two nodes of one tag: (matched nodes, pairs as nested lists). Yields the pairs of
    children it needs to know first, so depth costs no recursion."""
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return 1, [(a, b)]
    weight, under = np.zeros((m, n), np.int64), {}
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            if x.tag == y.tag:
                if x.kids and y.kids:
                    weight[i, j], under[i, j] = yield x, y
                else:
                    weight[i, j] = 1
    best = np.zeros((m + 1, n + 1), np.int64)
    for i in range(m):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, :-1] + weight[i], best[i, 1:]))
    i, j, pairs = m, n, [(a, b)]
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append(under.get((i, j)) or (a.kids[i], b.kids[j]))
    return 1 + int(best[m, n]), pairs


def align(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Pairs of nodes of a best simple tree matching; none if the roots differ."""
    if a.tag != b.tag:
        return []
    stack, got = [_match(a, b)], None
    while stack:
        try:
            x, y = stack[-1].send(got)
            stack.append(_match(x, y))
            got = None
        except StopIteration as done:
            stack.pop()
            got = done.value
    out, todo = [], [got[1]]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x)
        else:
            todo.extend(x)
    return out


def merge(tree: Shape, other: Shape) -> Shape:
    """tree with all nodes of both; those that simple tree matching pairs are one."""
    pairs = align(tree, other)
    mine = {id(b): a for a, b in pairs}
    for a, b in pairs:
        place = {id(k): i for i, k in enumerate(a.kids)}
        kids, done = [], 0
        for k in b.kids:
            if (x := mine.get(id(k))) is None:
                kids.append(k)
            else:
                at = place[id(x)]
                kids += a.kids[done : at + 1]
                done = at + 1
        a.kids = kids + a.kids[done:]
    return tree


def numbers(tree: Shape, wrapper: Shape) -> list[int]:
    """For every node of tree, parents first, the number of its node in the wrapper, or -1."""
    number, todo, i = {}, [wrapper], 0
    while todo:
        node = todo.pop()
        number[id(node)] = i
        i += 1
        todo.extend(reversed(node.kids))
    at = {id(a): number[id(b)] for a, b in align(tree, wrapper)}
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(at.get(id(node), -1))
        todo.extend(reversed(node.kids))
    return out


def region_of(tree: Shape, letters: dict[int, int], tags: bool = True) -> range:
    """The numbers of the main region's nodes; letters: of the texts that count, by node.

    From the root down to the child with most letters below it, if those are at least DOMINANT of its parent's. The way
    ends above a child that is no container (half of its letters are its own), and where the parent has text, headings or
    paragraphs of its own. tags: an article or main with half of the letters goes before that.
    """
    order, kids, todo = [], [], [(tree, -1)]
    while todo:
        node, parent = todo.pop()
        if parent >= 0:
            kids[parent].append(len(order))
        kids.append([])
        todo.extend((k, len(order)) for k in reversed(node.kids))
        order.append(node)
    size, total = np.ones(len(order), np.int64), np.array([letters.get(i, 0) for i in range(len(order))], np.int64)
    own = total.copy()
    for i in reversed(range(len(order))):
        for k in kids[i]:
            size[i] += size[k]
            total[i] += total[k]
    at = 0
    while kids[at] and total[at]:
        best = max(kids[at], key=lambda k: (total[k], -k))
        named = [k for k in kids[at] if tags and order[k].tag in ("article", "main") and 2 * total[k] >= total[at]]
        if named:
            at = max(named, key=lambda k: (total[k], -k))
            continue
        flat = own[at] * 10 > total[at] or any(order[k].tag in FLAT and total[k] for k in kids[at])
        if flat or total[best] < DOMINANT * total[at] or 2 * own[best] > total[best]:
            break
        at = best
    return range(at, at + int(size[at]))


def blocks(root: Node) -> list[tuple[int, int, str]]:
    """(node, characters in links, text) of every run of text between block ends."""
    out: list[tuple[int, int, str]] = []
    run: list[str] = []
    where = [-1, 0]

    def end() -> None:
        text = " ".join(_html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append((where[0], min(where[1], len(text)), text))
        where[1] = 0

    stack = [(root, iter(root.parts), root.number, False)]
    while stack:
        node, parts, number, link = stack[-1]
        for x in parts:
            if isinstance(x, str):
                where[0] = number
                if link:
                    where[1] += len(x.strip())
                run.append(x)
                continue
            if x.away or x.tag in RAW:
                if x.tag in BLOCK or x.tag in NEVER:
                    where[0] = number
                    end()
                continue
            block = x.tag in BLOCK
            if block:
                where[0] = number
                end()
            if x.tag in VOID:
                continue
            stack.append((x, iter(x.parts), x.number if block else number, link or x.tag == "a"))
            break
        else:
            if node.tag in BLOCK:
                where[0] = number
                end()
            stack.pop()
    end()
    return out


BLOCKS = "page_id long, url string, host string, blocks array<struct<node: int, main: boolean, links: int, text: string>>, page long, tree string"


def read_pages(rows: Iterable, tags: bool = True) -> list[tuple]:
    """The texts of pages (main: in the page's own main region), a digest of each, and its folded tree."""
    out = []
    for page, url, host, source in rows:
        if not source or not source.strip():
            out.append((page, url, host, [], 0, None))
            continue
        root = parse(source)
        tree = fold(root)
        runs, letters = blocks(root), {}
        for n, k, x in runs:
            letters[n] = letters.get(n, 0) + len(x) - k
        main = region_of(unfold(tree), letters, tags)
        own = [{"node": n, "main": n in main, "links": k, "text": x} for n, k, x in runs]
        digest = hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((page, url, host, own, int.from_bytes(digest, "little", signed=True), tree if host else None))
    return out


def _parsed(tags: bool):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(read_pages(zip(pdf["page_id"], pdf["url"], pdf["host"], pdf["html"], strict=True), tags), columns=["page_id", "url", "host", "blocks", "page", "tree"])

    return run


def _regions(tags: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for host, wrapper, nodes in zip(pdf["host"], pdf["wrapper"], pdf["nodes"], strict=True):
                main = region_of(unfold(wrapper), {x["node"]: x["letters"] for x in nodes}, tags)
                out.append((host, main.start, main.stop))
            yield pd.DataFrame(out, columns=["host", "first", "stop"])

    return run


def _merged(batches):
    """One tree for each (host, part), whose rows follow each other."""
    at, tree = None, None
    for pdf in batches:
        for host, part, t in zip(pdf["host"], pdf["part"], pdf["tree"], strict=True):
            if (host, part) == at:
                tree = merge(tree, unfold(t))
                continue
            if at:
                yield pd.DataFrame({"host": [at[0]], "part": [at[1]], "tree": [written(tree)]})
            at, tree = (host, part), unfold(t)
    if at:
        yield pd.DataFrame({"host": [at[0]], "part": [at[1]], "tree": [written(tree)]})


def _numbered(batches):
    for pdf in batches:
        yield pd.DataFrame({"host": pdf["host"], "key": pdf["key"], "numbers": [numbers(unfold(t), unfold(w)) for t, w in zip(pdf["tree"], pdf["wrapper"], strict=True)]})


def extract(pages: DataFrame, template: int = TEMPLATE, tags: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    Null or empty html: empty text. A host of less than template different pages has no template: there the main region is that
    of the page's own letters. A page that has no text in its host's main region keeps its own one's; and if the template would
    take all of it, nothing is taken. A page without a host has no wrapper. tags: whether article and main break ties. Repeated rows stay, and count as one page; other columns are
    not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    on_workers(spark)
    work = shared_dir(spark, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_and_path(F.col("url"))[0], F.lit("")))
    found = stored(rows.select("page_id", "url", "host", "html").mapInPandas(_parsed(tags), BLOCKS).withColumn("key", F.xxhash64("tree", F.length("tree"))), f"{work}/blocks", compression="zstd")

    # Sorted, so the wrapper is the same in every run.
    shape = "host string, part int, tree string"
    trees = stored(found.where("tree IS NOT NULL").select("host", "key", "tree").distinct(), f"{work}/trees")
    part = trees.select("host", F.pmod("key", F.lit(PARTS)).cast("int").alias("part"), "tree").repartition("host", "part").sortWithinPartitions("host", "part", "tree").mapInPandas(_merged, shape)
    whole = part.select("host", F.lit(0).alias("part"), "tree").repartition("host").sortWithinPartitions("host", "part", "tree").mapInPandas(_merged, shape)
    wrappers = stored(whole.select("host", F.col("tree").alias("wrapper")), f"{work}/wrappers")
    aligned = stored(trees.join(wrappers, "host").repartition("host", "key").mapInPandas(_numbered, "host string, key long, numbers array<int>"), f"{work}/aligned")

    # A host's pages meet its rows in SALT parts; small tables go to every task if Spark finds them under its threshold.
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = found.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALT)))
    met = found.select("host", "key", "page", "salt", F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["main"].alias("main"), b["links"].alias("links"), F.length(b["text"]).alias("n"), F.xxhash64(b["text"]).alias("h"))).alias("b"))
    met = met.join(salted(aligned), ["host", "key", "salt"]).select("host", "page", F.inline(F.transform("b", lambda b: F.struct(F.get("numbers", b["node"]).alias("node"), b["main"].alias("main"), b["links"].alias("links"), b["n"].alias("n"), b["h"].alias("h")))))
    each = met.where("node >= 0").groupBy("host", "node", "page", "h").agg(F.max("main").alias("main"), F.sum("links").alias("links"), F.sum("n").alias("n"))
    same = stored(each.groupBy("host", "node", "h").agg(F.count("*").alias("n"), F.sum(F.col("n") - F.col("links")).alias("letters")), f"{work}/same")
    per = each.groupBy("host", "node", "page").agg(F.max("main").alias("main"), F.sum("links").alias("links"), F.sum("n").alias("n"))
    per = stored(per.groupBy("host", "node").agg(F.count("*").alias("pages"), F.max("main").alias("main"), (F.sum("links") >= LINKS * F.sum("n")).alias("menu")), f"{work}/nodes")
    fixed = F.coalesce((F.col("n") >= template) & (F.col("n") >= SHARE * F.col("pages")), F.lit(False))
    judged = stored(same.join(per, ["host", "node"]).withColumn("fixed", fixed), f"{work}/judged")
    constant = judged.where("fixed").groupBy("host").agg(F.collect_set(F.struct("node", "h")).alias("fixed"))
    menus = per.where(f"pages >= {template} AND menu AND NOT main").groupBy("host").agg(F.collect_set("node").alias("menus"))
    # The main region of a host, by the letters that its slots have.
    slots = judged.groupBy("host", "node").agg(F.sum(F.when(~F.col("fixed"), F.col("letters")).otherwise(0)).alias("letters"), F.max("pages").alias("pages"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("node", "letters")).alias("nodes"), F.max("pages").alias("most")).where(f"most >= {template}")
    regions = wrappers.join(slots, "host").select("host", "wrapper", "nodes").mapInPandas(_regions(tags), "host string, first int, stop int")
    learnt = stored(constant.join(menus, "host", "full").join(regions, "host", "full"), f"{work}/template")

    ruled = stored(aligned.join(learnt, "host"), f"{work}/ruled")
    out = found.join(salted(ruled), ["host", "key", "salt"], "left")
    node = lambda b: F.get("numbers", b["node"])
    no = F.lit(False)
    taken = lambda b: F.coalesce(F.array_contains("fixed", F.struct(node(b).alias("node"), F.xxhash64(b["text"]).alias("h"))), no) | F.coalesce(F.array_contains("menus", node(b)), no)
    inside = lambda b: F.coalesce((node(b) >= F.col("first")) & (node(b) < F.col("stop")), no)
    first = lambda *arrays: F.coalesce(*(F.when(F.size(a) > 0, F.col(a)) for a in arrays), F.col("blocks"))
    out = out.withColumns({"own": F.filter("blocks", lambda b: b["main"]), "common": F.filter("blocks", inside)})
    out = out.withColumn("region", first("common", "own"))
    out = out.withColumn("slots", F.filter("region", lambda b: ~taken(b)))
    out = out.withColumn("text", F.array_join(F.transform(first("slots", "region"), lambda b: b["text"]), " "))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
