"""Merkle manifest of a dataset: leaves, subroots by source, root, proofs and their check.

Every step is a DataFrame join, grouping or window.  Rows are numbered within
ranges of (source, id), so that no task sorts a whole source; a level groups
``fanout`` consecutive nodes into their parent, and levels shrink by that
factor.  Going down again, each node joins its parent's run of children, which
are its siblings, and takes over what stands above them.  Levels are written to
the shared folder.

Nulls: a null value is '-' in its leaf; null sources are a source of their own,
the first one; rows without an id come first in their source.  Rows of one id
are ordered by their leaves; equal rows keep a place each.  A table without
rows gives none.  Columns other than the five of a leaf are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slantframe.llm.scratch import Scratch, partitions

#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
STEPS = "array<struct<left:string,right:string>>"


def sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def numbered(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """df, saved, with idx: each row's place from 0 on in the order of its keys, which hold no nulls.

    Rows are dealt by ranges of (keys, order); a range is numbered by itself,
    and what its keys hold in earlier ranges is added.  The counts are a row
    for each range and key.
    """
    rows = scratch.save(df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("range", *keys).agg(F.count("*").alias("held"))
    offsets = counts.select("range", *keys, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy("range", *keys).orderBy(*order)))
    out = scratch.save(own.join(offsets, ["range", *keys]).select(*df.columns, (F.col("place") - 1 + F.col("offset")).cast("long").alias("idx")))
    scratch.drop(rows)
    return out


@dataclass
class Forest:
    """A tree a group.  levels[k] has (tree, idx, children) of the trees that have several nodes below it;
    tops is (tree, digest, height): height is the number of levels that a tree has."""

    levels: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, fanout: int, scratch: Scratch) -> Forest:
    """Levels over nodes (tree, idx, digest) until each tree has one node; children are a run's digests in order.

    A first run of one node is a whole tree, since places have no gaps.
    """
    levels, tops = [], None
    alone = (F.col("idx") == 0) & (F.size("children") == 1)
    while True:
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        level = scratch.save(runs.select("tree", F.col("parent").alias("idx"), F.col("run")["digest"].alias("children")))
        single = level.where(alone).select("tree", F.col("children")[0].alias("digest"), F.lit(len(levels)).alias("height"))
        tops = single if tops is None else tops.unionAll(single)
        level = level.where(~alone)
        if level.isEmpty():
            return Forest(levels, scratch.save(tops))
        levels.append(level)
        nodes = level.select("tree", "idx", sha(F.concat_ws("", "children")).alias("digest"))


def _below(nodes: DataFrame, runs: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, idx, ...) with steps and what else runs have: a node's siblings, left and right, before those over its run."""
    more = [c for c in runs.columns if c not in ("tree", "idx", "children", "steps")]
    at = F.col("idx") - F.col("run_idx") * fanout
    step = F.struct(F.concat_ws("", F.slice("run_children", F.lit(1), at.cast("int"))).alias("left"), F.concat_ws("", F.slice("run_children", at.cast("int") + 2, F.lit(fanout))).alias("right"))
    over = runs.select(F.col("tree").alias("run_tree"), F.col("idx").alias("run_idx"), F.col("children").alias("run_children"), F.col("steps").alias("run_steps"), *more)
    met = nodes.join(over, (F.col("tree") == F.col("run_tree")) & (F.floor(F.col("idx") / fanout) == F.col("run_idx")))
    return met.select(*nodes.columns, F.concat(F.array(step), "run_steps").alias("steps"), *more)


def proven(nodes: DataFrame, forest: Forest, above: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, idx, ...), the leaves of the forest, with steps: all siblings up to the last root.

    above is (tree, steps, ...): what stands over each tree's top; its further
    columns are passed on.  Only joins on (tree, place) touch many rows of a
    tree; joins on the tree alone take one row of each.
    """
    over = above.join(forest.tops.select("tree", "height"), "tree")
    at = lambda height: over.where(F.col("height") == height).drop("height")
    runs = None
    for k in reversed(range(len(forest.levels))):
        level = forest.levels[k]
        whole = level.where("idx = 0").join(at(k + 1), "tree")
        runs = whole if runs is None else _below(level, runs, fanout).unionByName(whole)
    alone = nodes.where("idx = 0").join(at(0), "tree")
    return alone if runs is None else _below(nodes, runs, fanout).unionByName(alone)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its steps give."""
    return F.aggregate(steps, digest, lambda acc, step: sha(F.concat(step["left"], acc, step["right"])))


def manifest(docs: DataFrame, changed_text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from what the row holds now.

    changed_text is what a row's text has become (null where the text is null;
    by default nothing has changed).  Returns doc_id, source, idx (place in the
    source), leaf, subroot, root, steps (left and right siblings a level,
    upwards), proof_sha256 (of all siblings), folded_root and verified.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    values = [docs[c] for c in FIELDS]
    own = leaf(values)
    now = leaf([*values[:-1], changed_text]) if changed_text is not None else own
    rows = scratch.save(docs.select(docs["doc_id"], docs["source"], field(docs["source"]).alias("tree"), own.alias("leaf"), F.nullif(now, own).alias("now"), F.monotonically_increasing_id().alias("row")))
    leaves = numbered(rows, ["tree"], ["doc_id", "leaf", "row"], scratch)
    forest = build(leaves.select("tree", "idx", F.col("leaf").alias("digest")), fanout, scratch)

    sources = numbered(leaves.select(F.lit("").alias("over"), "source", "tree").distinct(), ["over"], ["source"], scratch)
    tops = scratch.save(sources.join(forest.tops, "tree").select(F.lit("").alias("tree"), "idx", "digest", F.col("tree").alias("below")))
    crown = build(tops.select("tree", "idx", "digest"), fanout, scratch)
    ends = docs.sparkSession.createDataFrame([("", [])], f"tree string, steps {STEPS}")
    above = proven(tops, crown, ends, fanout).join(crown.tops.select("tree", F.col("digest").alias("root")), "tree")
    above = scratch.save(above.select(F.col("below").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"))

    found = proven(leaves, forest, above, fanout)
    folded = fold(F.coalesce("now", "leaf"), F.col("steps"))
    siblings = F.transform("steps", lambda s: F.concat(s["left"], s["right"]))
    out = found.select("doc_id", "source", "idx", "leaf", "subroot", "root", "steps", sha(F.concat_ws("", siblings)).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
