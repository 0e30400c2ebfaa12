"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: an element is a path of tags with
their normalised classes and ids; its layouts are the sequences of its
children, runs of like ones as one; its content are the text runs, link targets
and images in and under it.  Layout and content that differ from page to page
make a branch important, those that repeat make it a template's:

- presentation importance: entropy of an element's layouts over its pages;
- content importance: one minus the mean entropy, over its features, of how a
  feature is spread over the pages;
- both to the base of the number of pages that hold the element.

A branch is as important as the greater of the two.  Few pages say little, so
``PRIOR_PAGES`` pages are added that speak for what lies inside an element
marked as an article (or for everything, on a page that marks none) and against
what lies outside.  Branches below ``LEAST`` are cut from each page.  Elements
that say by their own name that they are menus, adverts, comments and so on are
cut wherever they stand, since comments differ from page to page as articles do.
Paragraphs and headings go with the container that they stand in: a line that
many articles share is still the article's.

Pages of a host that say the same count once.  Statistics are sums, aggregated
in the tasks first; keys are (host, path, feature), so that a host with a third
of all pages is spread.  The judged paths are broadcast only below
``BROADCAST_BYTES``; beyond, pages are joined to them on (host, salt).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm import kernels
from slantframe.llm.html_tree import ARTICLES, CONTAINERS, Page, blocks, digest, plain, read_page
from slantframe.llm.scratch import Scratch

LEAST = 0.5
PRIOR_PAGES = 4
BROADCAST_BYTES = 16 << 20
SALTS = 32
#: Rows of pages in memory at once.
ROWS = 64

TREE = "host string, said long, nodes array<struct<path:long,parents:array<long>,style:long>>, features array<struct<path:long,feature:long,n:int>>"
_NODES = pa.list_(pa.struct([("path", pa.int64()), ("parents", pa.list_(pa.int64())), ("style", pa.int64())]))
_FEATURES = pa.list_(pa.struct([("path", pa.int64()), ("feature", pa.int64()), ("n", pa.int32())]))


def page_host(url: F.Column) -> F.Column:
    """After the first ://, up to /, ?, # or the end, lower-case; null without."""
    found = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _judged(page: Page, i: int) -> bool:
    """Whether the tree has the node: containers, articles, and the tops of branches that are noise by name."""
    node = page.nodes[i]
    return i > 0 and not page.nodes[node.parent].noise and (node.noise or node.tag in CONTAINERS or node.tag in ARTICLES)


def summarised(page: Page) -> tuple[int, list[dict], list[dict]]:
    """(what the page's unnamed branches say, its elements, the features of their content)."""
    around: list[list[int]] = []  # the tree's elements around each node and itself, innermost first
    for i, node in enumerate(page.nodes):
        over = around[node.parent] if i else []
        around.append([i, *over] if _judged(page, i) else over)
    counts: Counter[tuple[int, int]] = Counter()
    said = []
    texts = ((i, plain(raw).lower()) for i, raw in filter(None, page.items))
    for kind, found in (("", texts), ("@", page.links)):
        for i, x in found:
            if x:
                feature = digest(kind + x)
                if around[i]:
                    counts[page.nodes[around[i][0]].path, feature] += 1
                if not page.nodes[i].noise:
                    said.append(feature)
    nodes = {page.nodes[i].path: {"path": page.nodes[i].path, "parents": [page.nodes[j].path for j in around[i]], "style": digest("|".join(page.nodes[i].children))} for i in range(len(page.nodes)) if _judged(page, i)}
    return digest(repr(said)), list(nodes.values()), [{"path": p, "feature": f, "n": n} for (p, f), n in counts.items()]


def style_trees(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path, pages, presentation, content): the merged trees of all hosts.

    Pages without a host belong to no site.
    """

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [summarised(read_page(x or "")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], _NODES), pa.array([x[2] for x in out], _FEATURES)], ["host", "said", "nodes", "features"])

    sited = pages.select(page_host(F.col(url_column)).alias("host"), F.col(html_column).alias("html")).where("host is not null")
    seen = sited.mapInArrow(run, TREE).where(F.size("nodes") > 0).dropDuplicates(["host", "said"])
    scratch = Scratch(pages.sparkSession, "style-trees")
    seen = scratch.save(seen)
    log = F.log
    nodes = seen.select("host", F.inline("nodes"))
    styles = nodes.groupBy("host", "path", "style").agg(F.count("*").alias("c"), F.any_value("parents").alias("parents"))
    layout = styles.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * log(F.col("c"))).alias("s"), F.any_value("parents").alias("parents"))
    features = seen.select("host", F.inline("features")).groupBy("host", "path", "feature").agg(F.sum("n").alias("n"), F.sum(F.col("n") * log(F.col("n"))).alias("s"))
    content = features.groupBy("host", "path").agg(F.count("*").alias("features"), F.sum(log(F.col("n")) - F.col("s") / F.col("n")).alias("spread"))
    own = scratch.save(layout.join(content, ["host", "path"], "left"))
    base = F.nullif(log(F.col("pages")), F.lit(0.0))
    # What stands in an element counts for the containers around it, too; entropies are to the base of its own pages.
    below = own.select("host", F.explode("parents").alias("path"), "features", (F.col("features") - F.coalesce(F.col("spread") / base, F.lit(0.0))).alias("held"))
    whole = below.groupBy("host", "path").agg((F.sum("held") / F.sum("features")).alias("content"))
    presentation = F.when(base.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), (base - F.col("s") / F.col("pages")) / base))
    return own.select("host", "path", "pages", presentation.alias("presentation")).join(whole, ["host", "path"], "left").fillna(0.0, ["content"])


def judged(trees: DataFrame) -> DataFrame:
    """(host, cut, kept): the paths that are cut even inside an article, and those that are kept even outside."""
    importance = F.greatest("presentation", "content")
    inside = (importance * F.col("pages") + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)
    outside = importance * F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    odd = trees.where((inside < LEAST) | (outside >= LEAST))
    return odd.groupBy("host").agg(F.collect_list(F.when(inside < LEAST, F.col("path"))).alias("cut"), F.collect_list(F.when(outside >= LEAST, F.col("path"))).alias("kept"))


def main_text(html: str | None, cut: list[int] | None = None, kept: list[int] | None = None) -> str:
    """The blocks of a page's main text, joined by two line ends."""
    page = read_page(html or "")
    marked = page.marked
    cut_, kept_ = set(cut or ()), set(kept or ())
    keeps, shown, anywhere = [True], [not marked], [not marked]
    for node in page.nodes[1:]:
        judged_ = node.tag in CONTAINERS
        keeps.append(keeps[node.parent] and not node.noise and not (judged_ and node.path in cut_))
        anywhere.append(anywhere[node.parent] or (judged_ and node.path in kept_))  # text outside an article is kept here
        shown.append(keeps[-1] and (node.inside or anywhere[-1]))
    return "\n\n".join(blocks(page, shown))


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_column, url_column, text and n_chars (code points) of every page's main text.

    A null or empty page has no text; a null url, or one without a host, has
    no site: its page is judged by its own names alone.  Repeated rows and
    null ids give a row each; an empty table gives none; other columns are not
    looked at.
    """
    scratch = Scratch(pages.sparkSession, "html")
    verdicts = scratch.save(judged(style_trees(pages, url_column, html_column)))
    held = verdicts.agg(F.sum(F.octet_length("host") + 16 + 8 * (F.size("cut") + F.size("kept")))).first()[0] or 0
    own = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), page_host(F.col(url_column)).alias("host"))
    if held <= broadcast_bytes:
        met = own.join(F.broadcast(verdicts), "host", "left")
    else:
        salts = F.array(*[F.lit(i) for i in range(SALTS)])
        met = own.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(verdicts.withColumn("salt", F.explode(salts)), ["host", "salt"], "left")

    @kernels.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(*x) for x in zip(*[part.column(i).to_pylist() for i in (2, 3, 4)])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_column, url_column, "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return met.select("id", "url", "html", "cut", "kept").mapInArrow(run, f"`{id_column}` {kind}, `{url_column}` string, text string, n_chars long")
