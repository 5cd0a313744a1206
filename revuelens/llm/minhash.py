"""Near duplicates by bottom-k sketches of one hash function.

Retained values are inverted into lists, lists give candidate pairs, the sketch of
the union estimates their similarity, and full shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import connected_components, lean, text_slices, utf8
from revuelens.llm.shingles import set_digests, shingle_sets
from revuelens.session import materialize

SKETCH = 64


def least_overlap(percent: int, size: int = SKETCH) -> int:
    """Values that two sketches share at this similarity, six deviations below the mean."""
    p = percent / 100
    return max(1, math.floor(size * p - 6 * math.sqrt(size * p * (1 - p))))


def signatures(docs: DataFrame, length: int, id_column: str, text: str, size: int = SKETCH) -> DataFrame:
    """Per row: ``doc_id``, set size ``n``, set digest ``d1``, ``d2``, and the bottom-k ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                values, bounds = shingle_sets(*utf8(piece.column(1)), length)
                first, second = set_digests(values, bounds)
                n = np.diff(bounds)
                kept = np.minimum(n, size)
                ends = np.concatenate([[0], np.cumsum(kept)])
                where = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], kept)
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[where], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second), sketch],
                    ["doc_id", "n", "d1", "d2", "sketch"],
                )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, length: int) -> DataFrame:
    """``rep`` and the whole shingle set ``items`` of each row of ``docs(rep, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch):
                piece = batch.slice(start, stop - start)
                values, bounds = shingle_sets(*utf8(piece.column(1)), length)
                items = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), items], ["rep", "items"])

    return docs.mapInArrow(lean(run), "rep long, items array<long>")


def _sketch_prefix(n: Column, percent: int) -> Column:
    """Rarest retained values of which linked sets share one at least.

    Sets whose partners fit a sketch whole need the exact overlap; longer ones the
    overlap that sketches have but for a chance below one in ten million.
    """
    kept = F.least(n, F.lit(SKETCH))
    return F.when(n * 100 <= SKETCH * percent, _set_prefix(n, percent)).otherwise(kept - least_overlap(percent) + 1)


def _set_prefix(n: Column, percent: int) -> Column:
    """The same for whole sets: all but the least overlap with any linked set, and one."""
    return n - F.ceil(n * percent / 100) + 1


def rare_lists(sets: DataFrame, kept: Column, prefix: Column) -> DataFrame:
    """Inverted lists ``v``, ``rep``, ``n``, ``pos`` of the rarest ``prefix`` of each set's ``kept`` values.

    ``sets`` has ``rep``, ``n`` and ``items``. Linked sets share so many values that
    a prefix of each, in any common order, meets. Rarest first keeps frequent values,
    whose lists would be long, out of the prefix of every set that has enough
    others; values of one set only take their place in the prefix and then go, since
    they link nothing. ``pos`` is a value's place in its set's order.
    """
    values = sets.select("rep", "n", F.explode("items").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    found = values.join(shared, "v").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")
    )
    alone = (kept - F.size("vs")).cast("int")
    room = F.greatest((prefix.cast("int") - alone).cast("int"), F.lit(0))
    lists = found.select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("vs", F.lit(1), room)).alias("i", "s")).select(
        F.col("s.v").alias("v"), "rep", "n", (F.col("alone") + F.col("i") + 1).alias("pos")
    )
    # A list of one is left where the other set has the value outside its prefix.
    several = lists.groupBy("v").agg(F.count("*").alias("k")).filter("k > 1").select("v")
    return lists.join(several, "v")


def _enough_left(percent: int) -> Column:
    """Whole sets only: what both hold from the shared value on can still make a link.

    Everything before it in either order is rarer, and would be a shared value of its
    own; so a pair is looked at for the first value it shares only.
    """
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    return most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _similar_sizes(percent: int) -> Column:
    return (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch holds enough values that both sketches have."""
    a = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    # A union that fits the sketch is the whole union: the estimate is exact then.
    whole = (F.size("sa") < SKETCH) & (F.size("sb") < SKETCH) & (F.size(F.array_union("sa", "sb")) <= SKETCH)
    enough = F.when(whole, both * 100 >= F.size(union) * percent).otherwise(both >= least_overlap(percent))
    return joined.filter(enough).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("rep").alias("b"), F.col("items").alias("ib"))
    joined = pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size(F.array_intersect("ia", "ib")).alias("i"), (F.size("ia") + F.size("ib")).alias("s")
    )
    return joined.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Rows with equal sets are one class first, whatever their number. Lists of shared
    rare retained values compare their members with one hub each, and components are
    found; lists within one component are done. Members of the others are put on
    exact lists of their whole sets, compared with each list's most central member, and
    at last pair by pair across the components that are left, as far as the
    places of the shared value leave room for a link. So no link between components is
    lost, yet a group of thousands of near copies costs a few comparisons per member.

    Null, empty and blank texts have no shingles and link with nothing; a null id
    is returned with a null component and kept. Rows are judged one by one where an
    id repeats.
    """
    signed = materialize(signatures(docs, length, id_column, text))
    whole = signed.filter("n > 0 and doc_id is not null")
    classes = materialize(
        whole.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    n = F.col("n")
    lists = materialize(
        rare_lists(
            classes.withColumnRenamed("sketch", "items"), F.least(n, F.lit(SKETCH)), _sketch_prefix(n, percent)
        ).drop("pos")
    )
    # Only sets on some list are fetched whole; the text is moved once for that.
    wanted = lists.select("rep").distinct().hint("shuffle_hash")
    narrow = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text).alias("text"))
    sets = materialize(full_sets(narrow.join(wanted, "rep", "left_semi").select("rep", "text"), length))

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(_verified(_estimated(materialize(pairs), classes, percent), sets, percent))

    def opened(lists: DataFrame, component: DataFrame) -> DataFrame:
        """Lists over several components, each member with its component ``c``."""
        placed = materialize(
            lists.join(component, lists.rep == component.id, "left").select(
                *lists.columns, F.coalesce("component", "rep").alias("c")
            )
        )
        parts = placed.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
        return placed.join(parts.select("v"), "v")

    hub = lists.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("h")).select(
        "v", F.col("h.rep").alias("ra"), F.col("h.n").alias("na")
    )
    met = hub.join(lists.select("v", F.col("rep").alias("rb"), F.col("n").alias("nb")), "v").filter("ra <> rb")
    links = linked(_pairs(met.filter(_similar_sizes(percent))))
    component = connected_components(links)

    left = opened(lists, component).select("rep").distinct()
    chosen = sets.join(left, "rep").select("rep", F.size("items").alias("n"), "items")
    exact = materialize(rare_lists(chosen, n, _set_prefix(n, percent)))
    for last in (False, True):
        members = opened(exact, component)
        other = members.select("v", *[F.col(x).alias(y) for x, y in (("rep", "rb"), ("n", "nb"), ("pos", "pb"), ("c", "cb"))])
        if last:
            first = members.select("v", *[F.col(x).alias(y) for x, y in (("rep", "ra"), ("n", "na"), ("pos", "pa"), ("c", "ca"))])
        else:
            # The fewest rarer values: the member that most others are copies of.
            central = members.groupBy("v").agg(F.min(F.struct("pos", "rep", "n", "c")).alias("h"))
            first = central.select("v", *[F.col(f"h.{x}").alias(y) for x, y in (("rep", "ra"), ("n", "na"), ("pos", "pa"), ("c", "ca"))])
        order = F.col("ra") < F.col("rb") if last else F.col("ra") != F.col("rb")
        fits = order & (F.col("ca") != F.col("cb")) & _similar_sizes(percent) & _enough_left(percent)
        fresh = linked(_pairs(first.join(other, "v").filter(fits)))
        links = links.unionByName(fresh)
        component = connected_components(links)

    by_class = classes.select("d1", "d2", "n", "rep").join(component, F.col("rep") == F.col("id"), "left").select(
        "d1", "d2", "n", F.coalesce("component", "rep").alias("_component")
    )
    # A signature without a class (no shingles, no id) is alone.
    found = signed.drop("sketch").join(by_class, ["d1", "d2", "n"], "left")
    component_id = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(
    docs: DataFrame, length: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns unchanged.

    Rows that share an id are one document, of which one row stays; rows without an
    id stay all.
    """
    found = materialize(near_duplicates(docs, length, percent, id_column, text))
    named = docs.filter(F.col(id_column).isNotNull())
    unnamed = docs.filter(F.col(id_column).isNull())
    by_id = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("any"))
    # Stored, so that its size is known: few ids are sent to the texts, many meet them by id.
    gone = materialize(by_id.filter("not any").select(F.col("doc_id").alias("_gone")))
    chosen = named.join(gone, F.col(id_column).cast("long") == F.col("_gone"), "left_anti")
    # Ids rarely repeat; only then are whole rows put in order to choose one.
    if not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty():
        chosen = chosen.dropDuplicates([id_column])
    return chosen.unionByName(unnamed)
