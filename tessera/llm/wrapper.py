"""Main text of web pages by wrapper induction.

For each host one page, that of the least hash, is the pivot.  Every page of the
host is aligned with it by simple tree matching, where it is read, and tells for
each text slot of the pivot whether its own text there is the same.  Summed over
all pages of the host, slots that never change are its template, and all other text is
content, wherever it stands.  A second pass aligns each page again and writes the content.  No pages
are gathered by host: what is shuffled are sums by host and slot, so a host with
a third of all pages is as cheap as any other.

What the alignment can't tell is told by markup: menus, footers, forms and the
like vary between pages but are no content.  A paragraph of an article may be the
same on all pages of a small host but is content, so a slot inside an article or
main element is template on the evidence of more pages than one elsewhere.  Only
where no slot of a host was compared often enough does markup alone choose the
article.
"""

from __future__ import annotations

import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dom
from tessera.runtime import join_small, materialise, ship

#: pages that differ from the pivot and hold a slot, for the slot to be called template
LEAST_PAGES = 3
#: hosts whose pivots or wrappers may be broadcast, at some kilobytes each
BROADCAST_HOSTS = 4000
#: the same for a slot inside an article or main element
LEAST_ARTICLE_PAGES = 6

#: elements that hold no main text
DROP_TAGS = frozenset("head nav footer aside form button select option textarea script style noscript template iframe svg title dialog menu".split())
#: words of class, id and role that say the same
DROP_MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising aside breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr hidden login menu menubar modal "
    "nav navbar navigation newsletter notice notification overlay pager pagination popup promo recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: the same, but for inside an article, where they hold its headline
OUTER_TAGS, OUTER_MARKS = frozenset({"header"}), frozenset({"banner", "header", "masthead", "topbar"})


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def within(tree: dom.Tree) -> list[bool]:
    """For each node: it stands in some article or main element."""
    inside = [False] * len(tree.tag)
    for node in range(1, len(inside)):
        inside[node] = inside[tree.parent[node]] or tree.tag[node] in ("article", "main") or "main" in tree.marks[node]
    return inside


def regions(tree: dom.Tree) -> tuple[list[bool], list[bool]]:
    """For each node: it stands in markup that holds no main text; it stands in an article or a main element that markup alone chooses."""
    n = len(tree.tag)
    inside = within(tree)
    dropped = [False] * n
    for node in range(1, n):
        tag, marks = tree.tag[node], tree.marks[node]
        dropped[node] = dropped[tree.parent[node]] or tag in DROP_TAGS or not marks.isdisjoint(DROP_MARKS) or (not inside[node] and (tag in OUTER_TAGS or not marks.isdisjoint(OUTER_MARKS)))
    length = [0] * n
    for node in range(n - 1, 0, -1):
        length[node] += 0 if dropped[node] or tree.tag[node] else len(tree.text[node])
        length[tree.parent[node]] += length[node]
    # Articles of a main element that hold half of its text or more speak for it; otherwise the whole of it counts.
    told = [0] * n
    for node in range(n - 1, 0, -1):
        told[tree.parent[node]] += length[node] if tree.tag[node] == "article" else told[node]
    article = [False] * n
    for node in range(1, n):
        own = tree.tag[node] == "article" or tree.tag[node] == "main" and 2 * told[node] < length[node]
        article[node] = article[tree.parent[node]] or (own and length[node] > 0 and not dropped[node])
    return dropped, article


def main_text(tree: dom.Tree, template: list[bool], compared: bool = False) -> str:
    """Blocks of the page's content in page order, white space collapsed, joined by a space.

    Content of a page whose host's slots were compared is all text but the template and
    what markup drops; of any other page, its articles and main elements if it has any."""
    dropped, article = regions(tree)
    only = not compared and any(article)
    blocks, held = [], []
    for node in (*tree.items, dom.BREAK):
        if node == dom.BREAK:
            if block := " ".join("".join(held).split()):
                blocks.append(block)
            held = []
        elif not dropped[node] and (article[node] or not only) and not template[node]:
            held.append(tree.text[node])
    return " ".join(blocks)


def _skeleton(batches):
    for batch in batches:
        made = []
        for page in batch.column(1).to_pylist():
            s = dom.Skeleton.of(dom.parse(page or ""))
            made.append(json.dumps([s.label, s.parent, s.digest], separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "skeleton"])


class _Pivots:
    """Skeletons read lately."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, {}

    def get(self, text: str):
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            skeleton = dom.Skeleton(*json.loads(text))
            self.held[text] = skeleton, skeleton.shapes()
        return self.held[text]


def _compare(batches):
    """Sums by host and slot: pages unlike the pivot that hold the slot, and those with the pivot's text there."""
    pivots, sums = _Pivots(), defaultdict(lambda: [0, 0])
    for batch in batches:
        for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pivot, shapes = pivots.get(text)
            tree = dom.parse(page or "")
            own = tree.digests()
            slots = [(to, own[node] == pivot.digest[to]) for node, to in enumerate(dom.align(tree, own, pivot, shapes)) if to >= 0 and pivot.digest[to] and own[node]]
            if all(same for _, same in slots):
                continue
            for to, same in slots:
                held = sums[host, to]
                held[0] += 1
                held[1] += same
        if len(sums) > 200_000:
            yield _sum_batch(sums)
            sums.clear()
    yield _sum_batch(sums)


def _sum_batch(sums) -> pa.RecordBatch:
    rows = [(h, s, n, k) for (h, s), (n, k) in sums.items()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["host", "slot", "pages", "same"])


def _extract(batches):
    pivots = _Pivots()
    for batch in batches:
        ids, urls, pages, skeletons, constant, surely = (c.to_pylist() for c in batch.columns)
        texts = []
        for page, skeleton, slots, sure in zip(pages, skeletons, constant, surely, strict=True):
            tree = dom.parse(page or "")
            template = [False] * len(tree.tag)
            if skeleton and slots:
                pivot, shapes = pivots.get(skeleton)
                fixed, own, inside = (set(slots), set(sure)), tree.digests(), within(tree)
                for node, to in enumerate(dom.align(tree, own, pivot, shapes)):
                    template[node] = to in fixed[inside[node]] and own[node] == pivot.digest[to]
            texts.append(main_text(tree, template, skeleton is not None))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html); other columns are ignored.

    Returns page_id, url and text.  A null or empty page has the empty text.  Pages
    without a host in their url, and hosts of too few different pages, have no
    template; their text is told by markup alone: all articles and main elements (of a main element
    whose articles hold half of its text, these), else all that is not dropped.  Copies of the pivot tell nothing
    about its slots and are not counted.  Repeated rows are pages of their own.
    Pages of any length and depth are read whole; an empty table gives none.
    """
    ship(spark)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = rows.filter("host is not null and html <> ''")
    order = F.struct(F.xxhash64("page_id").alias("h"), F.col("page_id").alias("page_id"))
    chosen = known.groupBy("host").agg(F.min(order).alias("m")).select(F.col("m.page_id").alias("page_id"), F.col("host").alias("of"))
    first = join_small(known, chosen.dropDuplicates(["page_id"]), "page_id", "inner").filter("host = of")
    pivots = first.select("host", "html").mapInArrow(_skeleton, "host string, skeleton string").groupBy("host").agg(F.min("skeleton").alias("skeleton"))
    pivots = materialise(spark, pivots)

    paired = join_small(known, pivots, "host", "inner", BROADCAST_HOSTS).select("host", "html", "skeleton")
    sums = paired.mapInArrow(_compare, "host string, slot int, pages long, same long").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = F.col("same") == F.col("pages")
    fixed = [F.sort_array(F.collect_list(F.when(constant & (F.col("pages") >= least), F.col("slot")))).alias(name) for least, name in ((LEAST_PAGES, "slots"), (LEAST_ARTICLE_PAGES, "sure"))]
    slots = sums.filter(F.col("pages") >= LEAST_PAGES).groupBy("host").agg(*fixed)
    wrappers = materialise(spark, pivots.join(slots, "host"))
    return join_small(rows, wrappers, "host", "left", BROADCAST_HOSTS).select("page_id", "url", "html", "skeleton", "slots", "sure").mapInArrow(_extract, "page_id long, url string, text string")
