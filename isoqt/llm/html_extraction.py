"""Main text of web pages by site style trees.

Each page becomes a tree whose nodes are named by their presentation: tag, class and id. A path is a 64 bit hash of its
parent's path and the node's name, so a page takes memory in proportion to its length however deep it nests. The trees of
one host are merged by adding up their paths in Spark, equal pages once: for every path, the pages that have it, the
distribution of the text in it and that of its own children and number. The content importance of a node is the entropy of its
texts over the maximum: a branch that says the same on every page of a host is near 0, an article's is 1. The presentation
importance is the entropy of its own style, or ``DEPTH`` times its parent's if that is more: menus and footers are built
alike on all pages, an article is not. What one page says about a path is no evidence, so importances are drawn to "not
boilerplate" and "not varied" with the weight of ``weight`` pages; no number of pages switches the tree on or off.

Tags and class names are a prior. A page's main text is that of its article elements, or without any that outside markup
that rarely holds an article, or article elements inside such markup. Menus, headers, footers, sidebars and reader comments
are out for good; forms and blocks with a class name for adverts, notices and the like are doubtful. Class names say
nothing on ``html``, ``body``, ``article`` and ``main``, and names such as ``has-sidebar`` nothing at all. Branches of low
content importance leave the main text. Only where nothing would be left of it, text elsewhere on the page, outside what is
out for good, takes its place if its content and presentation importances are high; if there is no such text, the page
keeps its main text. What is left is joined block by block.

Defined cases: a null or empty html has an empty text; a null url's pages form a site of their own; html of any length is
parsed whole; unclosed and unknown tags are closed with their parents; quotes belong to a tag only after an equals sign;
equal pages get equal texts; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from isoqt.llm.common import written
from isoqt.llm.url_filters import host_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)|[^>=])*+)(?:>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul head").split())
#: An opening tag of the key closes the open tags of the value, up to the nearest list or table.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("ul ol table dl body html article main nav div section".split())
#: Presentation that holds no article (fixed lists), and class names that make one doubtful.
NEVER_TAGS = frozenset("head title nav footer aside menu".split())
DOUBTFUL_TAGS = frozenset("form dialog".split())
NEVER_WORDS = frozenset((
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies pagination pager contentinfo complementary").split())
DOUBTFUL_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "social share sharing related newsletter subscribe subscription login signup widget search").split())
#: First words of class names that describe the page and not the node; nodes whose class names describe the page.
LAYOUT_WORDS = frozenset("has no with without hide show is".split())
LAYOUT_TAGS = frozenset("html body article main".split())
ARTICLE = ("article", "main")
CLEAR, DOUBTFUL, NEVER = 0, 1, 2
#: Share of its parent's presentation importance that a node takes over.
DEPTH = 0.5


def signature(tag: str, attributes: str) -> tuple[str, int]:
    """Name of a node in the style tree, and whether its presentation leaves room for an article."""
    words = []
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id", "role"):
                words += (m[2] or m[3] or m[4] or "").lower().split()
    noise = NEVER if tag in NEVER_TAGS else DOUBTFUL if tag in DOUBTFUL_TAGS else CLEAR
    if tag not in LAYOUT_TAGS:
        for word in words:
            parts = re.split(r"[-_]+", word)
            if parts[0] not in LAYOUT_WORDS:
                noise = max(noise, NEVER if not NEVER_WORDS.isdisjoint(parts) else DOUBTFUL if not DOUBTFUL_WORDS.isdisjoint(parts) else CLEAR)
    return (f"{tag}.{'.'.join(words)}" if words else tag), noise


def below(path: int, name: str) -> int:
    """Path of a child."""
    return xxh3_64_intdigest(f"{path}/{name}") - (1 << 63)


def parse(html: str, children: dict[int, list[str]] | None = None, parents: dict[int, int] | None = None) -> list[tuple[int, int, bool, str]]:
    """Blocks in page order: (path, CLEAR, DOUBTFUL or NEVER, inside an article element, text).

    ``children`` takes the names of the block children of every path, in page order; "" begins a node's. ``parents`` takes
    the path above every path.
    """
    blocks: list[tuple[int, int, bool, str]] = []
    stack: list[tuple[str, tuple[int, int, bool]]] = [("", (0, CLEAR, False))]  # tag, place of the nearest block
    opened: Counter = Counter()
    text: list[str] = []

    def flush():
        if text:
            whole = "".join(text)
            text.clear()
            whole = " ".join((unescape(whole) if "&" in whole else whole).split())
            if whole:
                blocks.append((*stack[-1][1], whole))

    def close(k):
        """Ends the open tags from position ``k`` of the stack on."""
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                text.append(" ")
            continue
        tag = m[3].lower()
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK
        if m[2]:
            if block:
                flush()
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if block:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends at any block
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            ended = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[k][0] in ended:
                    close(k)
                elif stack[k][0] in FENCE:
                    break
        if tag in VOID or m[4].endswith("/"):
            continue
        path, noise, article = place = stack[-1][1]
        if block:
            name, own = signature(tag, m[4])
            # A header introduces an article when it stands inside one, and the page elsewhere.
            own = NEVER if tag == "header" and not article else own
            place = (below(path, name), max(noise, own), article or tag in ARTICLE)
            if children is not None:
                children.setdefault(path, []).append(name)
                children.setdefault(place[0], []).append("")
                parents[place[0]] = path
        stack.append((tag, place))
        opened[tag] += 1
    if at < len(html):
        text.append(html[at:])
    flush()
    return blocks


def main_text(found: list[tuple[int, int, bool, str]]) -> list[bool]:
    """Which blocks of a page are its main text by tags and class names."""
    for chosen in (lambda noise, article: noise == CLEAR and article, lambda noise, article: noise == CLEAR, lambda noise, article: noise == DOUBTFUL and article):
        marks = [chosen(noise, article) for _, noise, article, _ in found]
        if any(marks):
            break
    return marks


def page_blocks(pages: DataFrame) -> DataFrame:
    """Key, page_id, url, host, page (digest of the html), the blocks (path, noise, prior, text) and every path's parent, content and style digest of a page."""
    block = "array<struct<path:bigint,noise:int,prior:boolean,text:string>>"
    node = "array<struct<path:bigint,parent:bigint,content:bigint,style:bigint>>"

    def digest(words):
        return xxh3_64_intdigest("\n".join(words)) - (1 << 63)

    def run(batches):
        for batch in batches:
            keep, nodes = [], []
            for html in batch.column("html").to_pylist():
                children: dict[int, list[str]] = {}
                parents: dict[int, int] = {}
                found = parse(html or "", children, parents)
                keep.append([{"path": p, "noise": noise, "prior": prior, "text": t} for (p, noise, _, t), prior in zip(found, main_text(found))])
                texts: dict[int, list[str]] = {}
                for path, _, _, t in found:
                    texts.setdefault(path, []).append(t)
                nodes.append([{"path": p, "parent": parents.get(p), "content": digest(texts[p]) if p in texts else None, "style": digest(children.get(p, ()))}
                              for p in dict.fromkeys([*texts, *children])])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "page_id", "url", "host", "page")] + [
                pa.array(keep, pa.list_(pa.struct([("path", pa.int64()), ("noise", pa.int32()), ("prior", pa.bool_()), ("text", pa.string())]))),
                pa.array(nodes, pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("content", pa.int64()), ("style", pa.int64())])))],
                names=["key", "page_id", "url", "host", "page", "blocks", "nodes"])

    html = F.col("html").cast("string")
    return pages.select(F.xxhash64("page_id", "url", html).alias("key"), "page_id", F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"),
                        html.alias("html")).mapInArrow(run, f"key long, page_id {dict(pages.dtypes)['page_id']}, url string, host string, page long, blocks {block}, nodes {node}")


def entropies(nodes: DataFrame, digest: str) -> DataFrame:
    """Host, path, parent, pages and entropy of ``digest`` over that of all-different ones, from one row for each page and path.

    Equal digests are counted before anything else, so a host with a third of all pages is summed map-side.
    """
    counted = nodes.where(F.col(digest).isNotNull()).groupBy("host", "path", digest).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    n = F.col("n").cast("double")
    sums = counted.groupBy("host", "path").agg(F.sum(n).alias("pages"), F.sum(n * F.log(n)).alias("s"), F.min("parent").alias("parent"))
    entropy = F.log("pages") - F.col("s") / F.col("pages")
    return sums.select("host", "path", "parent", "pages", F.when(F.col("pages") > 1, entropy / F.log("pages")).otherwise(1.0).alias("entropy"))


def style_tree(nodes: DataFrame) -> DataFrame:
    """Host, path, pages, content and presentation importance of every path with text, from (host, page, path, parent, content, style) rows."""
    once = written(nodes.select("host", "page", "path", "parent", "content", "style").distinct())
    style = written(entropies(once, "style").select("host", "path", F.col("entropy").alias("style")))
    content = entropies(once, "content").withColumnRenamed("entropy", "content").join(style, ["host", "path"])
    above = style.select("host", F.col("path").alias("parent"), F.col("style").alias("around"))
    presentation = F.greatest("style", DEPTH * F.coalesce("around", F.lit(0.0)))
    return content.join(above, ["host", "parent"], "left").select("host", "path", "pages", "content", presentation.alias("presentation"))


def verdicts(tree: DataFrame, limit: float, weight: float) -> DataFrame:
    """Host, path, low (boilerplate by content), high (an article by content and presentation) of every path."""
    seen = F.col("pages") - 1
    drawn = lambda importance, start: (seen * F.col(importance) + weight * start) / (seen + weight)
    return tree.select("host", "path", (drawn("content", 1.0) < limit).alias("low"), ((drawn("content", 0.0) >= limit) & (drawn("presentation", 0.0) >= limit)).alias("high"))


def extract(pages: DataFrame, limit: float = 0.3, weight: float = 2.0) -> DataFrame:
    """Page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    parsed = written(page_blocks(pages))
    nodes = parsed.select("host", "page", F.explode("nodes").alias("node")).select("host", "page", "node.*")
    judged = verdicts(style_tree(nodes), limit, weight).where("low OR high")
    places = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["prior"].alias("prior"), b["noise"].alias("noise"))))
    found = parsed.select("key", "host", F.exists("blocks", lambda b: b["prior"]).alias("any"), F.explode(places).alias("b")).select("key", "host", "any", "b.*")
    met = found.where(F.col("prior") | (F.col("noise") < NEVER)).join(judged, ["host", "path"]).where("(prior AND low) OR (NOT prior AND high)")
    # Only pages whose main text loses a branch, or that have none. Written, so that its size is known: a small one is sent to the pages, and their blocks need no shuffle.
    low, high = F.collect_set(F.when(F.col("prior"), F.col("path"))), F.collect_set(F.when(~F.col("prior"), F.col("path")))
    changed = written(met.groupBy("key").agg(low.alias("low"), high.alias("high"), F.max("any").alias("any")).where("size(low) > 0 OR NOT any").drop("any"))
    within = lambda b, name: F.array_contains(F.coalesce(name, F.array().cast("array<bigint>")), b["path"])
    prior = F.filter("blocks", lambda b: b["prior"])
    left = F.filter("blocks", lambda b: b["prior"] & ~within(b, "low"))
    other = F.filter("blocks", lambda b: ~b["prior"] & within(b, "high"))
    kept = F.when(F.col("low").isNull(), prior).when(F.size(left) > 0, left).when(F.size(other) > 0, other).otherwise(prior)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return (parsed.select("key", "page_id", "url", "blocks").join(changed, "key", "left").select("page_id", "url", text.alias("text"))
            .select("*", F.length("text").cast("long").alias("n_chars")))
