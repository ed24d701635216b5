"""Merkle manifest of a dataset: one root digest, a subroot per group, and an inclusion proof for every row.

A tree is built level by level. Each level is one group-by in which conditional aggregates spread the up to 16
children of a parent into slot columns; all slot columns concatenated hash to the parent, all but the own slot are
the siblings in a child's proof. The trees of all groups climb together, so the number of jobs follows the depth of
the largest one. The way back carries each parent's path to its children, again one equi-join a level.

* Positions inside a group come from a range sort that is written once: a row's number within its range plus the
  sizes of the ranges before. A group that holds a third of all rows spreads over as many ranges as its rows fill.
* Digests travel as hex text. Beyond the leaves' own scan, no text is shuffled, and paths meet parents, not leaves.
* Only the number of levels and the root, 64 characters, reach the driver.
* A null in any column counts as absent ("-"), an empty text as zero bytes. Rows of a group ascend by id, null ids
  first; ties ascend by leaf digest. Repeated rows are leaves of their own. The null group is a group and comes first.
  An empty table has no root and no rows. Texts are hashed whole. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

FANOUT = 16
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hex digest of the values one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf's level upwards, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``pos`` (from 0, in order within the key) and ``n`` (rows of the key).

    Rows are sorted by range and written with their number in the range, so a lost executor cannot renumber them.
    """
    ranges = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = stage(ranges.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    parts = placed.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        key, "_range", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n")
    )
    return placed.join(stage(offsets), [key, "_range"]).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_off")).alias("pos"), "n"
    )


def pivoted(nodes: DataFrame, *carried: str) -> DataFrame:
    """Parents of nodes(key, pos, n, digest): slot columns of every carried column, and the digest of the parent."""
    slot = F.col("pos") % FANOUT
    spread = [F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j}") for c in ("digest", *carried) for j in range(FANOUT)]
    parents = nodes.groupBy("key", F.expr(f"pos div {FANOUT}").alias("pos"), "n").agg(*spread)
    return parents.withColumn("digest", F.sha2(F.concat_ws("", *[f"digest{j}" for j in range(FANOUT)]), 256))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """The pivoted levels over nodes(key, pos, n, digest, kid), and (key, digest) of every key's single last node.

    The first level holds all leaves, lone ones too; a lone leaf is its key's last node and is not hashed again.
    """
    levels = [stage(pivoted(nodes, "kid"))]
    most = levels[0].agg(F.max("n")).first()[0]
    if most is None:
        return [], None
    tops = levels[0].filter("n = 1").select("key", F.col("digest0").alias("digest"))
    while most > 1:
        up = levels[-1].filter("n > 1").select("key", "pos", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "digest")
        tops = tops.unionByName(up.filter("n = 1").select("key", "digest"))
        most = -(-most // FANOUT)
        if most > 1:
            levels.append(stage(pivoted(up.filter("n > 1"))))
    return levels, tops


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(kid, digest, top, path) of every leaf; above(key, top, path) is what stands over each key's last node."""
    down = None
    for k in reversed(range(len(levels))):
        level, first = levels[k], k == 0
        rows = level.filter(F.col("n") <= FANOUT).join(above, "key")
        if down is not None:
            rows = rows.unionByName(level.filter(F.col("n") > FANOUT).join(down, ["key", "pos"]))
        kids = []
        for j in range(FANOUT):
            step = F.struct(
                F.concat_ws("", *[f"digest{i}" for i in range(j)]).alias("before"),
                F.concat_ws("", *[f"digest{i}" for i in range(j + 1, FANOUT)]).alias("after"),
            )
            kid = [F.lit(j).alias("slot"), F.col(f"digest{j}").alias("digest"), step.alias("step")]
            kids.append(F.when(F.col(f"digest{j}").isNotNull(), F.struct(*kid, *([F.col(f"kid{j}").alias("kid")] if first else []))))
        each = rows.select("key", "pos", "n", "top", "path", F.explode(F.array_compact(F.array(*kids))).alias("child"))
        own = F.concat(F.array("child.step").cast(PATH), "path")
        if first:
            path = F.when(F.col("n") > 1, own).otherwise(F.col("path"))
            return each.select("child.kid", "child.digest", "top", path.alias("path"))
        down = stage(each.select("key", (F.col("pos") * FANOUT + F.col("child.slot")).alias("pos"), "top", own.alias("path")))
    raise ValueError("a tree has at least one level")


def proofs(rows: DataFrame, group: str, order: str, leaf: str, *carried: str) -> DataFrame:
    """(carried..., leaf, subroot, root, path) of every row: the manifest with an inclusion proof.

    Leaves of a group ascend by ``order``; groups ascend by the bytes of ``group``, null first, under the root.
    """
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(
        key.alias("key"), F.col(order).alias("sort"), F.col(leaf).alias("digest"), F.struct(*carried).alias("kid")
    )
    nodes = numbered(leaves, "key", "sort", "digest").drop("sort")
    levels, tops = climbed(nodes)
    if tops is None:
        kinds = [rows.select(*carried).schema[c].dataType.simpleString() for c in carried]
        named = ", ".join(f"`{c}` {kind}" for c, kind in zip(carried, kinds))
        return rows.sparkSession.createDataFrame([], f"{named}, leaf string, subroot string, root string, path {PATH}")
    groups = tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", F.struct(F.col("key").alias("name")).alias("kid"))
    over, top = climbed(numbered(groups, "key", "name").drop("name"))
    summit = top.select("key", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    above = stage(descended(over, summit).select(F.col("kid.name").alias("key"), F.col("digest").alias("top"), "path"))
    root = top.first().digest
    return descended(levels, above).select(
        *[F.col(f"kid.`{c}`").alias(c) for c in carried],
        F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path",
    )


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, changed, leaf, subroot, root, path) of documents; ``changed`` is the leaf of a tampered copy, or null.

    Tampered are the rows whose id has a checksum divisible by five: their text's A-Z become a-z.
    """
    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_digest(*whole, F.col("text")).alias("leaf"),
        F.when(picked, leaf_digest(*whole, F.translate("text", upper, lower))).alias("changed"),
    )
    return proofs(stage(leaves), "source", "doc_id", "leaf", "doc_id", "changed")
