"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of block elements (tag and first class, digits squeezed), furniture
and all. A node's presentation importance is the entropy of its child sequences over the pages that have it; a
leaf's content importance is one less the mean entropy of its texts over those pages: what each page has
alone weighs 1, what all pages share weighs 0. A node is as important as its child sequences and, the more
so the fewer styles it has, what is below it. A branch is removed from each page if all of its nodes are
less important than a limit.

What entropy can't see goes by name: scripts, styles, forms, media, readers' comments, and, since a host of few
pages or of many adverts and menus repeats too little, elements that declare themselves as navigation, header,
footer, sidebar, notice or advert. Of a page with an article or main element, the text inside it counts.

The tree is counted, not gathered: (host, path, text, page) keys are pre-aggregated before each shuffle, and
one task sees of a host only sums of the paths that LEAST pages share. A host's few low branches join its
pages, and the pages of hot hosts are dealt over many tasks.

Cases: null or empty html gives an empty text; a null url is a host of its own name ""; equal pages of a
host count once in its tree; rows that repeat a page_id are taken each for itself; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, materialize, salted_left_join, table

#: Branches of less importance go, if so many distinct pages have them; weight of presentation.
THRESHOLD, LEAST, DAMPING = 0.15, 5, 0.9

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul svg canvas object video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Elements that are never main text, and names in class, id or role of what readers write: fixed values.
HIDDEN = frozenset("script style noscript template head form iframe svg button select textarea dialog canvas object video audio title".split())
READERS = frozenset("comment comments commentlist disqus replies respond login signup searchform".split())
#: Elements that declare themselves as page furniture, and names that say the same: fixed values.
FURNITURE = frozenset("nav footer aside menu".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay sidebar side aside nav navbar navigation menu submenu breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended newsletter subscribe subscription search widget pagination pager skip contentinfo complementary".split())
#: An open element that a start tag of the second kind ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Element:
    """A block element: `hidden` is never main text, `declared` stands in furniture, `inside` in an article."""

    __slots__ = ("children", "declared", "hidden", "inside", "path", "tag")

    def __init__(self, tag: str, path: str, hidden: bool, declared: bool, inside: bool):
        self.tag, self.path, self.hidden, self.declared, self.inside, self.children = tag, path, hidden, declared, inside, []


def label(tag: str, rest: str, inside: bool) -> tuple[str, bool, bool]:
    """Name of an element in the tree, whether it is never main text, and whether it declares itself as furniture."""
    hidden, declared = tag in HIDDEN, tag in FURNITURE or tag == "header" and not inside
    if "=" not in rest and "hidden" not in rest:
        return tag, hidden, declared
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    names = re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower())
    if tag not in ("html", "body", "main"):
        hidden = hidden or not READERS.isdisjoint(names) and (tag != "article" or not {"comment", "comments"}.isdisjoint(names))
        declared = declared or tag != "article" and not NAMES.isdisjoint(names)
    hidden = hidden or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest) is not None or "display:none" in found.get("style", "").replace(" ", "")
    first = found.get("class", "").split()
    return (f"{tag}.{re.sub(r'[0-9]+', '#', first[0].lower().replace('/', ''))}" if first else tag), hidden, declared


def parse(html: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Text blocks in page order, each with its element, and all block elements."""
    root = Element("", "", False, False, False)
    stack, blocks, elements, held = [root], [], [root], []

    def flush():
        if held:
            text = "".join(held)
            held.clear()
            text = SPACE.sub(" ", entities.unescape(text) if "&" in text else text).strip()
            if text:
                owner = next(e for e in reversed(stack) if e.tag in BLOCK or not e.tag)
                blocks.append((stack[-1] if stack[-1].hidden else owner, text))

    pos, size = 0, len(html)
    while pos < size:
        m = TOKEN.search(html, pos)
        if m is None:
            held.append(html[pos:])
            break
        if m.start() > pos:
            held.append(html[pos : m.start()])
        pos = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag not in BLOCK and tag not in RAW:
            if tag == "br":
                held.append(" ")
            elif tag not in VOID and not rest.endswith("/"):
                here = stack[-1]
                _, hidden, declared = label(tag, rest, here.inside)
                if (hidden or declared) and not here.hidden:  # inside a line there is no branch to judge
                    flush()
                stack.append(Element(tag, here.path, here.hidden or hidden or declared, here.declared, here.inside))
            continue
        flush()
        ends = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in ends:
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
        here = stack[-1]
        name, hidden, declared = label(tag, rest, here.inside)
        path = f"{here.path}/{name}"
        e = Element(tag, path, here.hidden or hidden, here.declared or declared, here.inside or (tag in ("article", "main") and not hidden and not declared))
        elements.append(e)
        owner = next(x for x in reversed(stack) if x.tag in BLOCK or not x.tag)
        if not e.hidden:
            owner.children.append(name)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            if end is None and tag in ("script", "style", "textarea", "title"):
                pos = size
            elif end is not None and tag not in ("noscript", "template", "iframe", "svg"):
                pos = end.end()
            else:
                stack.append(e)
        elif tag not in VOID:
            stack.append(e)
    flush()
    return blocks, elements


def main_text(html: str | None, low: list[str] | None) -> str:
    """The blocks of a page that stay, by the low paths of its host. Of a page that they leave nothing of, names alone decide."""
    blocks, _ = parse(html or "")
    blocks = [(e, t) for e, t in blocks if not e.hidden]

    def rest(cut):
        kept = [(e, t) for e, t in blocks if not any(e.path == x or e.path.startswith(x + "/") for x in cut) and not e.declared]
        inner = [(e, t) for e, t in kept if e.inside]
        return inner or kept

    return "\n\n".join(t for _, t in rest(tuple(low or ())) or rest(()))


def host_of(url: str):
    """Host of a URL, lower case, without user, port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), "^www\\.", "")


NODES = "host string, path string, leaf boolean, feature bigint, page bigint"


def tree_rows(pages: DataFrame) -> DataFrame:
    """One row for each child sequence of a node (leaf false) and each text of a leaf (leaf true) of a page."""

    def run(batches):
        h = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not html:
                    continue
                page, (blocks, elements) = h(html), parse(html)
                # runs of one child count once: a style is not the number of paragraphs
                rows = {(e.path, False, h("|".join(c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]))) for e in elements if not e.hidden}
                rows |= {(e.path, True, h(t)) for e, t in blocks if not e.hidden}
                out += [(host, *r, page) for r in rows]
            cols = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "path", "leaf", "feature", "page"])

    return pages.select("host", "html").mapInArrow(run, NODES)


def importance(nodes: dict[str, tuple[int, int, float, float | None]]) -> dict[str, float]:
    """Composite importance of each path: pages, styles, node importance and leaf importance (None: no text) of `nodes`."""
    below: dict[str, list[float]] = {}
    out: dict[str, float] = {}
    for path in sorted(nodes, key=lambda p: -p.count("/")):
        _, styles, node, leaf = nodes[path]
        parts = below.get(path, []) + ([leaf] if leaf is not None else [])
        inner = sum(parts) / len(parts) if parts else node
        weight = DAMPING**styles
        out[path] = inner if not below.get(path) else (1 - weight) * node + weight * inner
        if "/" in path:
            below.setdefault(path.rpartition("/")[0], []).append(out[path])
    return out


def parents(path: str):
    return (path[:i] for i, c in enumerate(path) if c == "/" and i)


def low_paths(nodes: dict[str, tuple[int, int, float, float | None]], least: int = LEAST) -> list[str]:
    """Top-most paths whose nodes are all of low importance. `nodes`: path to (pages, styles, node importance, leaf importance or None)."""
    own, most = importance(nodes), {}
    for path, x in own.items():
        for p in (path, *parents(path)):
            most[p] = max(most.get(p, 0.0), x)
    poor = {p for p in nodes if p and most[p] < THRESHOLD and nodes[p][0] >= least}
    return sorted(p for p in poor if poor.isdisjoint(parents(p)))


LOW = "host string, low array<string>"


def low_branches(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, low): the paths of low importance of each host that has some."""
    rows = materialize(tree_rows(pages).distinct(), "tree-rows")
    sizes = rows.filter("NOT leaf").groupBy("host", "path").agg(F.count_distinct("page").alias("m")).filter(F.col("m") >= least)
    seen = rows.groupBy("host", "path", "leaf", "feature").agg(F.count(F.lit(1)).alias("n"))
    sums = seen.groupBy("host", "path").agg(
        F.sum(F.expr("if(leaf, 0, n)")).alias("all"),
        F.sum(F.expr("if(leaf, 0, 1)")).alias("styles"),
        F.sum(F.expr("if(leaf, 0.0D, n * ln(n))")).alias("styled"),
        F.sum(F.expr("if(leaf, 1, 0)")).alias("texts"),
        F.sum(F.expr("if(leaf, ln(n), 0.0D)")).alias("shared"),
    )
    nodes = sums.join(sizes, ["host", "path"])

    def host_tree(rows: pa.Table) -> pa.Table:
        nodes = {}
        for r in rows.to_pylist():
            scale = math.log(r["m"]) if r["m"] > 1 else 0.0
            # entropy of styles over pages: ln(all) - sum(n ln n) / all
            node = min(1.0, max(0.0, math.log(r["all"]) - r["styled"] / r["all"]) / scale) if scale and r["all"] else 1.0
            leaf = None if not r["texts"] else max(0.0, 1 - r["shared"] / r["texts"] / scale) if scale else 1.0
            nodes[r["path"]] = (r["m"], r["styles"], node, leaf)
        low = low_paths(nodes, least)
        return pa.table({"host": pa.array([rows.column("host")[0].as_py()] if low else [], pa.string()), "low": pa.array([low] if low else [], pa.list_(pa.string()))})

    return nodes.groupBy("host").applyInArrow(host_tree, LOW)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    low = materialize(low_branches(pages), "low-branches", slim=True)
    pages = salted_left_join(pages, low, "host", hot_keys(pages, "host"), spread=F.xxhash64("page_id"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h, x) for h, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html", "low").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
