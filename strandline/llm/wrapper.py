"""HTML extraction by wrapper induction.

A page's region is its article and main elements, or where it has none, all but furniture. Of the pages of a host that share a skeleton (the paths of
the outer blocks) one is the base, and the block tree of each other page is aligned with it by simple tree matching (``align``). A line of text is constant
if it stands at the same node of the base with the same text on nearly all distinct pages: such lines are template, in the content region as well as
around it. Lines that vary are slots, which are content. All pages count, by a pre-aggregated shuffle of hashes; lines without a partner in the base
count by their path, and so do the lines of all pages of a host, whatever their skeletons.

Names of roles, classes and ids are needed where furniture varies from page to page (adverts, links to other articles, comments) and on hosts of few pages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import derive, materialise
from .align import LINE, Tree, Trees, digest, line_keys
from .dom import BLOCK, RAW, Node, decoded, parse, squeezed

#: A line is template from so many distinct pages on, and from this share of them all.
SUPPORT, SHARE = 3, 0.9
#: Template lines may make up this share of the region's mean length; beyond it the pages are near copies of one text, not a template.
MOST = 0.5
#: Blocks down to this depth make a page's skeleton.
OUTER = 3
#: Elements that never hold article text.
ROLES = frozenset("nav header footer aside form script style noscript template iframe head title button select option input textarea svg dialog menu".split())
#: Words of class, id and role names that mark furniture: always beside the second or third set, or beside the second alone.
ALWAYS = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|cookie\w*|consent|gdpr|newsletter|subscribe|signup|popup|modal|comment\w*|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|toolbar|pager|pagination|login|complementary|contentinfo")
ALONE = re.compile(r"header|footer|masthead|banner|side|notice\w*|widget\w*|search|searchbox|alert")
BESIDE = frozenset("area bar block bottom box btn button buttons col column container count fixed form global google group head home icon inner inline item items left link links list main mobile desktop module outer page panel primary right row secondary section site slot sticky tags text title top unit us user wrap wrapper".split())
CONTENT = frozenset("article articles content entries entry more news post posts stories story thread topics".split())
MAIN = re.compile(r"^(?:article|main)(?:\.|$)")
DIGITS = re.compile(r"[0-9]+")
FRAME = BLOCK - frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td tfoot th thead tr ul".split())


def _marked(name: str) -> bool:
    """Whether a class, id or role in ``name`` marks furniture: a word of it does, and no other word says something else, as in "related-work"."""
    for token in name.split():
        parts = [p for p in re.split(r"[-_0-9]+", token) if p]
        if any(map(ALWAYS.fullmatch, parts)):
            if all(p in BESIDE or p in CONTENT or ALWAYS.fullmatch(p) or ALONE.fullmatch(p) for p in parts):
                return True
        elif any(map(ALONE.fullmatch, parts)) and all(p in BESIDE or ALONE.fullmatch(p) for p in parts):
            return True
    return False


def is_furniture(node: Node, inside: bool = False) -> bool:
    """``inside``: below an article, whose own header is part of it unless its name says otherwise."""
    if node.tag in ROLES and not (inside and node.tag == "header"):
        return True
    return bool(node.name) and node.tag not in ("html", "body") and _marked(node.name)


def _plain(key: str) -> str:
    """The key without the numbers in names, which tell one page from another."""
    return DIGITS.sub("#", key)


def _outline(tree: Node) -> tuple[str, list[Node]]:
    """The paths of a page's outer blocks, in order of their names, and its article and main elements that stand in no other and in no furniture."""
    paths, regions = set(), []
    todo = [(c, "", 1, False, False) for c in reversed(tree.children) if not isinstance(c, str)]
    while todo:
        node, above, depth, bad, inside = todo.pop()
        path = f"{above}/{_plain(node.key)}" if depth <= OUTER else above
        if depth <= OUTER and node.tag in FRAME:
            paths.add(path)
        bad = bad or is_furniture(node, inside)
        if not bad and not inside and MAIN.match(node.key):
            regions.append(node)
            inside = True
        if node.tag not in RAW and (depth < OUTER or not (bad or inside)):
            todo += [(c, path, depth + 1, bad, inside) for c in reversed(node.children) if not isinstance(c, str)]
    return "\n".join(sorted(paths)), regions


def read(source: str | None) -> tuple[str, Tree, list[str]]:
    """The skeleton of a page, the tree of the blocks and lines of its region, and the lines' texts."""
    root = parse(source)
    outline, regions = _outline(root)
    tree, texts, line = Tree(), [], []
    tree.add(0, 1)

    def flush(depth: int) -> None:
        if line:
            text = squeezed(decoded("".join(line)))
            line.clear()
            if text:
                tree.add(depth, LINE, digest(text))
                texts.append(text)

    inside = bool(regions)
    for region in regions or [root]:
        todo: list[tuple[Node | str | None, int]] = [(region, 1)]  # None: the end of a block
        while todo:
            node, depth = todo.pop()
            if node is None:
                flush(depth)
            elif isinstance(node, str):
                line.append(node)
            elif node.tag == "br":
                line.append(" ")
            elif node is region or not (is_furniture(node, inside) or node.tag in RAW):
                if node.tag in BLOCK or node is region:
                    flush(depth)
                    tree.add(depth, digest(_plain(node.key)))
                    depth += 1
                    todo.append((None, depth))
                todo += [(c, depth) for c in reversed(node.children)]
    tree.link()
    return outline, tree, texts


def _keys(site: str, outline: str) -> tuple[int, int]:
    """Hashes of the host, and of the host with the skeleton."""
    return digest(site), digest(f"{site}\n\n{outline}")


def host(url) -> F.Column:
    """Lower-case host of a URL; a null URL or one without host is the host ""."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, base, template): for each host and skeleton that has template lines, its base page's tree and the lines' keys, from all distinct pages. Pages of equal trees are one page.

    The base is the page with the smallest hash. Tasks drop equal pages and add up equal lines before each shuffle, so a host with a third of all pages costs no
    more than others. Null html counts for nothing; an empty table has no wrappers.
    """
    rows = pages.where(F.col("html").isNotNull()).select("html", host(F.col("url")).alias("host"))

    def make():
        def run(sources, sites):
            out = []
            for source, site in zip(sources, sites, strict=True):
                outline, tree, texts = read(source)
                out.append((*_keys(site, outline), tree.content[0], tree.pack() if texts else None, [len(t) for t in texts]))
            return list(zip(*out, strict=True)) if out else [[]] * 5

        return run

    read_pages = derive(rows, make, ["html", "host"], "site long, key long, page long, tree binary, sizes array<int>", keep=[])
    distinct = read_pages.where(F.col("tree").isNotNull()).groupBy("site", "key", "page").agg(F.first("tree").alias("tree"), F.first("sizes").alias("sizes"))
    distinct = materialise(distinct, "html-pages")
    base = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("page").alias("draw"), "tree")).alias("b")).where(F.col("n") >= support).select("key", F.col("b.tree").alias("base"))
    base = materialise(base, "html-bases")

    def aligned():
        known_bases = Trees()

        def run(trees, bases, sizes):
            found = []
            for data, known, size in zip(trees, bases, sizes, strict=True):
                page = Tree.unpack(data)
                # a line counts once a page
                at_host = dict(zip(line_keys(None, page), size, strict=True))
                at_key = dict(zip(line_keys(known_bases[known], page), size, strict=True)) if known is not None else {}
                found.append((list(at_host), list(at_host.values()), list(at_key), list(at_key.values())))
            return list(zip(*found, strict=True))

        return run

    both = derive(distinct.join(base, "key", "left"), aligned, ["tree", "base", "sizes"], "host_lines array<long>, host_sizes array<int>, key_lines array<long>, key_sizes array<int>", keep=["site", "key"])
    part = lambda level, name: F.struct(F.col(level).alias("level"), F.col(f"{name}_lines").alias("lines"), F.col(f"{name}_sizes").alias("sizes"))
    levels = both.select(F.explode(F.array(part("site", "host"), part("key", "key"))).alias("x")).select("x.*").where(F.size("lines") > 0)
    levels = materialise(levels, "html-lines")
    total = levels.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("mass"))
    seen = levels.select("level", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).groupBy("level", F.col("x.lines").alias("line")).agg(F.count("*").alias("times"), F.max("x.sizes").alias("size"))
    constant = seen.where(F.col("times") >= support).join(total.where(F.col("n") >= support), "level").where(F.col("times") >= share * F.col("n"))
    template = constant.groupBy("level").agg(F.collect_list("line").alias("template"), F.sum("size").alias("size"), F.first("n").alias("n"), F.first("mass").alias("mass"))
    template = template.where(F.col("size") * F.col("n") <= most * F.col("mass")).select("level", "template")
    keys = distinct.select("site", "key").distinct().select("key", F.explode(F.array("site", "key")).alias("level"))
    rules = keys.join(template, "level").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("template"))).alias("template"))
    return rules.join(base, "key", "left").select("key", "base", "template")


def main_text(pages: DataFrame, **options) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null and empty html give the empty text; repeated rows equal texts; nothing is cut off.

    Pages are read twice, once for the wrappers, which are written to the shared folder; what meets them in the join are trees and lines of text, not pages, and
    only where there are wrappers at all.
    """
    rules = materialise(wrappers(pages, **options), "html-wrappers")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))

    def make():
        def run(sources, sites):
            out = []
            for source, site in zip(sources, sites, strict=True):
                outline, tree, texts = read(source)
                out.append((_keys(site, outline)[1], tree.pack(), texts))
            return list(zip(*out, strict=True)) if out else [[]] * 3

        return run

    lines = derive(rows, make, ["html", "host"], "key long, tree binary, texts array<string>", keep=["page_id", "url"])
    if rules.isEmpty():
        whole = lines.select("page_id", "url", F.array_join("texts", " ").alias("text"))
        return whole.withColumn("n_chars", F.length("text").cast("long"))

    def kept():
        known_bases = Trees()

        def run(trees, bases, templates):
            out = []
            for data, known, template in zip(trees, bases, templates, strict=True):
                if template is None:
                    out.append(None)
                    continue
                page, constant = Tree.unpack(data), set(template)
                out.append([k not in constant and h not in constant for k, h in zip(line_keys(None if known is None else known_bases[known], page), line_keys(None, page), strict=True)])
            return [out]

        return run

    marked = derive(lines.join(rules, "key", "left"), kept, ["tree", "base", "template"], "slots array<boolean>", keep=["page_id", "url", "texts"])
    slots = F.when(F.col("slots").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda _, i: F.get("slots", i)))
    whole = marked.select("page_id", "url", F.array_join(slots, " ").alias("text"))
    return whole.withColumn("n_chars", F.length("text").cast("long"))
