"""Merkle manifest of a table: leaves, a tree per group, a tree over the groups, proofs.

A level is a slot pivot: conditional aggregates over the children of one parent spread
their digests into ``FANOUT`` columns. The columns end to end hash to the parent; without
the own slot's column they are the siblings that a proof needs. ``LEVELS`` levels at a time
stay in blocks of ``FANOUT ** LEVELS`` consecutive nodes that are moved once, so a group of
any size is spread over the cluster; block roots are the nodes of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revuelens.session import materialize

FANOUT = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def number_nodes(nodes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``at``, the place of each row within its group from 0, and the group's ``size``; stored.

    Rows are dealt out by range and sorted there; one short row per group and range
    carries the offset, so no group is ordered in one task.
    """
    placed = materialize(
        nodes.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_place", 33))
    )
    group = W.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        placed.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
        .select(
            *keys,
            "_range",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(group).alias("size"),
        )
    )
    return materialize(
        placed.join(ranges, [*keys, "_range"])
        .withColumn("at", F.col("_place") + F.col("_shift"))
        .drop("_place", "_range", "_shift")
    )


def pivot_levels(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``LEVELS`` levels up: ``block``, the digest ``up`` reached there, and the ``steps`` to it.

    A step holds the siblings left and right of the node. A group that is down to one node
    rises no further. The block is the only thing that moves rows: each level's groups lie
    inside it, so their windows need no exchange.
    """
    width = FANOUT**LEVELS
    rows = nodes.withColumn("block", F.expr(f"at div {width}")).repartition(*keys, "block").withColumn("up", F.col("node"))
    steps = []
    for level in range(LEVELS):
        below = FANOUT**level
        slot = F.expr(f"at div {below} % {FANOUT}")
        children = W.partitionBy(*keys, "block", F.expr(f"at div {below * FANOUT}"))
        columns = [f"_c{level}_{s}" for s in range(FANOUT)]
        rows = rows.withColumns(
            {c: F.coalesce(F.max(F.when(slot == s, F.col("up"))).over(children), F.lit("")) for s, c in enumerate(columns)}
        )
        rising = F.col("size") > below
        sides = [
            F.concat(F.lit(""), *[F.when(side, F.col(c)).otherwise("") for c, side in zip(columns, there, strict=True)])
            for there in ([slot > s for s in range(FANOUT)], [slot < s for s in range(FANOUT)])
        ]
        steps.append(F.when(rising, F.struct(sides[0].alias("left"), sides[1].alias("right"))))
        rows = rows.withColumn("up", F.when(rising, digest(*[F.col(c) for c in columns])).otherwise(F.col("up")))
    whole = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "block", "up", whole.alias("steps"))


def climb(nodes: DataFrame, keys: Sequence[str], beyond=None) -> DataFrame:
    """Adds each node's ``steps`` to the top, its group's ``subroot`` and the ``root``.

    ``nodes`` is a stored table of ``keys``, ``at``, ``size`` and ``node``, other columns are
    carried. ``beyond`` gives the groups' own steps and root; without it a group's top is both.
    One number a round, the size of the largest group, comes to the driver.
    """
    here = pivot_levels(nodes, keys)
    most = nodes.agg(F.max("size")).first()[0] or 0
    if most <= FANOUT**LEVELS:
        if beyond is None:
            return here.drop("block").withColumnRenamed("up", "subroot").withColumn("root", F.col("subroot"))
        tops = materialize(here.groupBy(*keys).agg(F.max("up").alias("subroot")))
        above = beyond(tops)
    else:
        lifted = F.ceil(F.max("size") / FANOUT**LEVELS).cast("long").alias("size")
        blocks = here.groupBy(*keys, "block").agg(F.max("up").alias("node"), lifted)
        above = climb(materialize(blocks.withColumnRenamed("block", "at")), keys, beyond)
        above = above.withColumnRenamed("at", "block")
        keys = [*keys, "block"]
    above = above.select(*keys, "subroot", "root", F.col("steps").alias("_above"))
    return (
        here.join(above, list(keys))
        .withColumn("steps", F.concat("steps", "_above"))
        .drop("block", "up", "_above")
    )


def fold(steps: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof(steps: Column) -> Column:
    """All siblings from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def build_manifest(
    docs: DataFrame,
    id_column: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = FIELDS,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: id, ``leaf``, ``steps``, ``subroot``, ``root`` and ``carried`` columns.

    Leaves ascend by id within a group; groups ascend bytewise, null first. Only the named
    columns are read, whatever else the table holds. Rows of one id, or without an id
    (first), are ordered by their digest; equal rows change places without changing any digest.
    An empty table has no rows; a single document is leaf, subroot and root.
    """
    carried = carried or {}
    leaves = materialize(
        docs.select(
            F.col(id_column).alias("_id"),
            F.col(group).isNotNull().alias("_named"),
            F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_name"),
            leaf_digest(*[F.col(f) for f in fields]).alias("node"),
            F.monotonically_increasing_id().alias("_row"),
            *[c.alias(f"_with_{n}") for n, c in carried.items()],
        )
    )

    def over_groups(tops: DataFrame) -> DataFrame:
        nodes = tops.select(F.lit(0).alias("_all"), "_named", "_name", F.col("subroot").alias("node"))
        reached = climb(number_nodes(nodes, ["_all"], ["_named", "_name"]), ["_all"])
        return reached.select("_named", "_name", "steps", F.col("node").alias("subroot"), "root")

    nodes = number_nodes(leaves, ["_named", "_name"], ["_id", "node", "_row"])
    proved = climb(nodes, ["_named", "_name"], over_groups)
    return proved.select(
        F.col("_id").alias(id_column),
        F.col("node").alias("leaf"),
        "steps",
        "subroot",
        "root",
        *[F.col(f"_with_{n}").alias(n) for n in carried],
    )


def verify_against(docs: DataFrame, changed: dict[str, Column], **options) -> DataFrame:
    """The manifest of ``docs``, and the root that each row gives as ``changed`` reads it.

    ``changed`` maps fields to the expressions that stand in for them. ``folded_root`` is
    computed from the changed leaf and the original siblings; ``verified`` tells whether it
    is the root.
    """
    fields = options.get("fields", FIELDS)
    other = leaf_digest(*[changed.get(f, F.col(f)) for f in fields])
    manifest = build_manifest(docs, carried={"changed_leaf": other}, **options)
    folded = manifest.withColumn("folded_root", fold(F.col("steps"), F.col("changed_leaf")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(id_column: str = "doc_id", text: str = "text") -> Column:
    """The text without line ends where the crc32 of the id is even; a row without an id stays."""
    even = F.crc32(F.col(id_column).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
