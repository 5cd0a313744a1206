"""Exact nearest vectors by cosine, in an inverted file of cells.

Vectors of a stratum are dealt out over a tree of cells: a crowded cell takes some of its
own vectors as centres, and every vector goes to the nearest one, until a cell holds
``CELL`` vectors at most. A cell keeps its centre and the least cosine to it, so by the
triangle inequality of angles no vector of the cell is closer to a request than the angle to
the centre less the angle of the radius. A request first goes down to the nearest leaf;
what it finds there rules out all cells whose bound lies below. Neighbouring leaves lie
together on a page of ``PAGE`` vectors, and a request is sent once to every page that still
holds a cell for it; there it visits the cells best first. So a vector is moved once for
each page it asks and each block of requests it answers, never once for each cell, and the
answer is that of comparing all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from revuelens.session import materialize

CELL = 1024  # vectors of a leaf
BRANCH = 16  # centres of a crowded cell
BLOCK = 2048  # rows that meet a cell's centres or vectors in one matrix product
PAGE = 16384  # vectors of neighbouring leaves, and requests, that meet in one task
PRODUCTS = 1 << 22  # similarities that a task holds at a time
ONE_DIRECTION = 1 - 1e-9  # a cell of this radius is not parted further
MAX_LEVELS = 24
SLACK = 1e-7  # of a bound, for rounding


@dataclass
class Cells:
    """Leaves with their vectors, and the tree above them, level by level."""

    vectors: DataFrame  # _node, _id, _v
    levels: list[DataFrame]  # _node, _child, _center, _low
    keys: list[str]
    id_column: str


def stratum(keys: Sequence[str]) -> Column:
    """One text per combination of keys; null is a value."""
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("{}")


def _usable(vector: str) -> Column:
    """Neither null nor zero, and finite in every element."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vector: str) -> Column:
    wide = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))
    return F.transform(F.arrays_zip(wide.alias("x"), F.array_repeat(norm, F.size(wide)).alias("n")), lambda p: p["x"] / p["n"])


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _meet(
    rows: DataFrame, others: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, piece: int = 0
) -> DataFrame:
    """Rows of a node beside the ``others`` of it, at most ``BLOCK`` of them at a time.

    Rows are dealt out to hashed blocks, the others are repeated for each. With
    ``piece`` others are dealt out as well, and rows repeated for each piece.
    """

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("_node").agg(F.ceil(F.count("*") / size).cast("long").alias(name))

    counts = parts(rows, BLOCK, "_n").join(
        parts(others, piece, "_m") if piece else others.select("_node").distinct().withColumn("_m", F.lit(1).cast("long")), "_node"
    )

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    left = rows.join(counts, "_node").withColumn("_i", F.pmod(F.xxhash64("_id"), "_n")).withColumn("_j", every("_m"))
    right = others.join(counts, "_node")
    right = right.withColumn("_j", F.pmod(F.xxhash64("_id"), "_m") if piece else F.lit(0).cast("long")).withColumn("_i", every("_n"))
    key = ["_node", "_i", "_j"]

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], kind) for n, kind in kinds.items()})
        return meet(a, b)

    kinds = {f.name: f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))}
    found = left.drop("_n", "_m").groupBy(*key).cogroup(right.drop("_n", "_m").groupBy(*key))
    return found.applyInArrow(both, schema)


def _nearest_child(rows: DataFrame, level: DataFrame, id_type: str, *keep: str) -> DataFrame:
    """Rows of crowded nodes with the child whose centre is nearest, and the cosine to it; ``keep`` names long columns."""

    def assign(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("_child")
        similar = _matrix(a, "_v") @ _matrix(b, "_center").T
        at = similar.argmax(axis=1)
        return pa.table(
            {
                "_id": a.column("_id"),
                "_node": b.column("_child").take(pa.array(at)),
                "_v": a.column("_v"),
                "_dot": similar[np.arange(len(at)), at],
                **{c: a.column(c) for c in keep},
            }
        )

    kept = "".join(f", {c} long" for c in keep)
    return _meet(rows, level, assign, f"_id {id_type}, _node string, _v array<double>, _dot double{kept}")


def build_cells(
    reviews: DataFrame, vector: str, keys: Sequence[str], id_column: str = "review_id", seed: int = 0
) -> Cells:
    """Cells of the usable vectors of each stratum; equal vectors are one, with the smallest id.

    A level is a count per cell, a seeded sample of centres and one pass over the vectors of
    crowded cells; the number of levels grows with the logarithm of the largest stratum.
    """
    id_type = reviews.schema[id_column].dataType.simpleString()
    rows = materialize(
        reviews.filter(_usable(vector))
        .select(F.col(id_column).alias("_id"), stratum(keys).alias("_node"), F.col(vector).alias("_w"))
        .groupBy("_node", "_w")
        .agg(F.min("_id").alias("_id"))
        .select("_id", "_node", _unit("_w").alias("_v"), F.lit(-1.0).alias("_dot"))
    )
    leaves, levels, centres = [], [], None
    while True:
        sizes = materialize(rows.groupBy("_node").agg(F.count("*").alias("_size"), F.min("_dot").alias("_low")))
        if centres is not None:
            levels.append(materialize(centres.join(sizes.select(F.col("_node").alias("_child"), "_low"), "_child")))
        crowded = sizes.filter((F.col("_size") > CELL) & (F.col("_low") < ONE_DIRECTION)).select("_node", "_size")
        if len(levels) == MAX_LEVELS or not crowded.take(1):
            leaves.append(rows)
            break
        leaves.append(rows.join(crowded, "_node", "left_anti"))
        full = rows.join(crowded, "_node")
        place = F.xxhash64("_id", F.lit(seed + len(levels)))
        # Some four times as many as are wanted, so that a sample too small is out of the question.
        share = F.pmod(place, F.lit(1 << 40)) < F.lit(4 * BRANCH * (1 << 40)) / F.col("_size")
        order = W.partitionBy("_node").orderBy(place, "_id")
        picked = full.filter(share).withColumn("_slot", F.row_number().over(order)).filter(F.col("_slot") <= BRANCH)
        centres = materialize(
            picked.select(
                "_node",
                F.concat("_node", F.lit("/"), F.lpad(F.col("_slot").cast("string"), 2, "0")).alias("_child"),
                F.col("_v").alias("_center"),
            )
        )
        rows = materialize(_nearest_child(full.drop("_size", "_dot"), centres, id_type))
    vectors = reduce(DataFrame.unionByName, leaves).drop("_dot")
    return Cells(materialize(vectors) if levels else vectors, levels, list(keys), id_column)


def _compare(pairs: DataFrame, cells: Cells, id_type: str, request_type: str) -> DataFrame:
    """Of each (request, leaf) the best review, and how many were looked at."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("_id")
        similar = _matrix(a, "_v") @ _matrix(b, "_v").T
        at = similar.argmax(axis=1)
        return pa.table(
            {
                "_id": a.column("_id"),
                "_found": b.column("_id").take(pa.array(at)),
                "_sim": similar[np.arange(len(at)), at],
                "_compared": np.full(len(at), b.num_rows, dtype=np.int64),
            }
        )

    schema = f"_id {request_type}, _found {id_type}, _sim double, _compared long"
    return _meet(pairs.select("_id", "_node", "_v"), cells.vectors, meet, schema, piece=CELL)


def _best(found: DataFrame) -> DataFrame:
    """The largest similarity of each request, then the smallest id."""
    first = F.min(F.struct((-F.col("_sim")).alias("d"), F.col("_found").alias("id")))
    return (
        found.groupBy("_id")
        .agg(first.alias("_b"), F.sum("_compared").alias("_compared"))
        .select("_id", F.col("_b.id").alias("_found"), (-F.col("_b.d")).alias("_sim"), "_compared")
    )


def _bound(vectors: np.ndarray, centres: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest cosine that each vector can have with a vector of each cell."""
    angle = np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))
    return np.cos(np.maximum(angle - np.arccos(np.clip(low, -1.0, 1.0)), 0.0))


def _slices(n: int, width: int) -> Iterator[slice]:
    """Rows of a matrix so many at a time that ``PRODUCTS`` numbers are held."""
    step = max(1, PRODUCTS // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _leaves(cells: Cells) -> DataFrame:
    """Leaves below a parted stratum: ``_node``, ``_leaf``, ``_center``, ``_low``, and pages ``_page`` on, ``_pages`` of them; stored.

    Leaves lie on pages in the order of the tree. One of more than ``PAGE`` vectors, which no
    centre can part, has several.
    """
    found = []
    for depth, level in enumerate(cells.levels, 1):
        inner = cells.levels[depth].select(F.col("_node").alias("_child")).distinct() if depth < len(cells.levels) else None
        ends = level if inner is None else level.join(inner, "_child", "left_anti")
        # A level adds three characters to the name of its stratum.
        root = F.expr(f"substring(_child, 1, length(_child) - {3 * depth})")
        found.append(ends.select(root.alias("_node"), F.col("_child").alias("_leaf"), "_center", "_low"))
    sizes = cells.vectors.groupBy(F.col("_node").alias("_leaf")).agg(F.count("*").alias("_size"))
    leaves = reduce(DataFrame.unionByName, found).join(sizes, "_leaf")
    before = F.sum("_size").over(W.partitionBy("_node").orderBy("_leaf")) - F.col("_size")
    places = leaves.select("_leaf", F.floor(before / PAGE).alias("_page"), F.ceil(F.col("_size") / PAGE).alias("_pages"))
    return materialize(leaves.drop("_size").join(places, "_leaf"))


def _pages_to_ask(asking: DataFrame, leaves: DataFrame) -> DataFrame:
    """``_row``, ``_node``, ``_page``: each page with a leaf that may hold something as close as what the request has; stored."""

    def expand(a: pa.Table, b: pa.Table) -> pa.Table:
        wanted, centres = _matrix(a, "_v"), _matrix(b, "_center")
        low, sim = b.column("_low").to_numpy(), a.column("_sim").to_numpy()
        own = pa.compute.index_in(a.column("_own"), b.column("_id").combine_chunks()).fill_null(-1).to_numpy()
        first, pages = b.column("_page").to_numpy(), b.column("_pages").to_numpy()
        rows, asked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _slices(len(wanted), len(centres)):
            alive = _bound(wanted[part], centres, low) >= sim[part, None] - SLACK
            known = np.flatnonzero(own[part] >= 0)
            alive[known, own[part][known]] = False
            at, leaf = np.nonzero(alive)
            # Of the few leaves on more than one page, every page.
            times = pages[leaf]
            on = np.repeat(first[leaf], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pair = np.unique(np.stack([np.repeat(at, times), on], axis=1), axis=0)
            rows.append(pair[:, 0] + part.start)
            asked.append(pair[:, 1])
        taken = a.take(pa.array(np.concatenate(rows)))
        return pa.table({"_row": taken.column("_row"), "_node": taken.column("_node"), "_page": np.concatenate(asked)})

    centres = leaves.withColumnRenamed("_leaf", "_id")
    pairs = _meet(asking, centres, expand, "_row long, _node string, _page long", piece=PAGE)
    # Pieces of a stratum's leaves may name a page twice.
    return materialize(pairs.distinct())


def _ask_pages(asking: DataFrame, cells: Cells, leaves: DataFrame, id_type: str, request_type: str) -> DataFrame:
    """What each request finds on the pages it has to ask, page by page, as ``_compare`` returns it."""
    pairs = _pages_to_ask(asking, leaves)
    blocks = asking.groupBy("_node").agg(F.ceil(F.count("*") / PAGE).cast("long").alias("_n"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i")
    asked = pairs.join(asking.drop("_node"), "_row").join(blocks, "_node").withColumn("_i", F.pmod(F.xxhash64("_row"), "_n")).drop("_n")
    page = F.col("_page") + F.pmod(F.xxhash64("_id"), "_pages")
    vectors = cells.vectors.withColumnRenamed("_node", "_leaf").join(leaves.select("_node", "_leaf", "_page", "_pages"), "_leaf")
    vectors = vectors.select("_node", page.alias("_page"), "_leaf", "_id", "_v", F.lit(None).cast("double").alias("_low"))
    on = F.explode(F.sequence(F.col("_page"), F.col("_page") + F.col("_pages") - 1)).alias("_page")
    centres = leaves.select("_node", on, "_leaf", F.lit(None).cast(id_type).alias("_id"), F.col("_center").alias("_v"), "_low")
    needed = pairs.select("_node", "_page").distinct()
    pages = vectors.unionByName(centres).join(needed, ["_node", "_page"], "left_semi").join(blocks, "_node").select("*", every).drop("_n")
    schema = f"_id {request_type}, _found {id_type}, _sim double, _compared long"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def visit(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        is_cell = b.column("_low").is_valid()
        tops, b = b.filter(is_cell).sort_by("_leaf"), b.filter(pa.compute.invert(is_cell)).sort_by("_id")
        names = tops.column("_leaf").combine_chunks()
        leaf_of = pa.compute.index_in(b.column("_leaf"), names).to_numpy()
        order = np.argsort(leaf_of, kind="stable")
        ends = np.searchsorted(leaf_of[order], np.arange(len(names) + 1))
        wanted, held = _matrix(a, "_v"), _matrix(b, "_v")[order]
        centres, low = _matrix(tops, "_v"), tops.column("_low").to_numpy()
        own = pa.compute.index_in(a.column("_own"), names).fill_null(-1).to_numpy()
        known, n = a.column("_sim").to_numpy(), a.num_rows
        best, place, compared = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, dtype=np.int64)
        for part in _slices(n, len(centres)):
            bound = _bound(wanted[part], centres, low)
            for leaf in np.argsort(-bound.mean(axis=0), kind="stable"):
                here = slice(ends[leaf], ends[leaf + 1])
                limit = np.maximum(known[part], best[part]) - SLACK
                rows = np.flatnonzero((bound[:, leaf] >= limit) & (own[part] != leaf)) + part.start
                for few in _slices(len(rows), ends[leaf + 1] - ends[leaf]) if ends[leaf + 1] > ends[leaf] else ():
                    at = rows[few]
                    similar = wanted[at] @ held[here].T
                    top = similar.argmax(axis=1)
                    value, where = similar[np.arange(len(at)), top], order[here][top]
                    closer = (value > best[at]) | ((value == best[at]) & (where < place[at]))
                    best[at], place[at] = np.where(closer, value, best[at]), np.where(closer, where, place[at])
                    compared[at] += similar.shape[1]
        hit = np.flatnonzero(place >= 0)
        return pa.table(
            {
                "_id": a.column("_id").take(pa.array(hit)),
                "_found": b.column("_id").take(pa.array(place[hit])),
                "_sim": best[hit],
                "_compared": compared[hit],
            }
        )

    key = ["_node", "_page", "_i"]
    return asked.groupBy(*key).cogroup(pages.groupBy(*key)).applyInArrow(visit, schema)


def search_cells(cells: Cells, requests: DataFrame, vector: str, request_id: str = "request_id") -> DataFrame:
    """For each usable request ``request_id``, the nearest review's id, ``similarity`` and ``compared``.

    ``compared`` counts the vectors that the request was compared with. A request whose stratum
    has no cell is left out. Requests have distinct ids.
    """
    request_type = requests.schema[request_id].dataType.simpleString()
    id_type = cells.vectors.schema["_id"].dataType.simpleString()
    wanted = requests.filter(_usable(vector)).select(
        F.col(request_id).alias("_id"), stratum(cells.keys).alias("_node"), _unit(vector).alias("_v")
    )
    # Rows are told apart by a stored number, since ids may repeat.
    wanted = materialize(wanted.withColumn("_row", F.monotonically_increasing_id()))
    if not cells.levels:
        best = _best(_compare(wanted, cells, id_type, request_type))
    else:
        best = _search_tree(cells, wanted, id_type, request_type)
    return best.select(
        F.col("_id").alias(request_id),
        F.col("_found").alias(cells.id_column),
        F.col("_sim").alias("similarity"),
        F.col("_compared").alias("compared"),
    )


def _search_tree(cells: Cells, wanted: DataFrame, id_type: str, request_type: str) -> DataFrame:
    down = wanted
    for level in cells.levels:
        moved = _nearest_child(down, level, request_type, "_row").drop("_dot")
        down = materialize(moved.unionByName(down.join(level.select("_node").distinct(), "_node", "left_anti")))
    best = materialize(_best(_compare(down, cells, id_type, request_type)))
    # Requests of a stratum that is one leaf have been compared with all of it.
    leaves = _leaves(cells)
    asking = down.select(F.col("_row"), F.col("_node").alias("_own")).join(wanted, "_row").join(best.select("_id", "_sim"), "_id")
    asking = materialize(asking.join(leaves.select("_node").distinct(), "_node", "left_semi"))
    found = _ask_pages(asking, cells, leaves, id_type, request_type)
    return _best(found.unionByName(best.select("_id", "_found", "_sim", "_compared")))
