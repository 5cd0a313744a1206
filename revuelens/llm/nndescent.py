"""Near-duplicate embeddings by NN-descent: a neighbour graph, refined until it stands still."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revuelens.llm.common import connected_components, groups, seeded_sample
from revuelens.session import materialize

NEIGHBOURS = 10  # list length; doubled where a list holds links only
LONGEST = 40  # a list of so many links is no longer doubled; what it lacks is compared block by block
TREES, BITS = 8, 48  # orders by hyperplane signs that the first graph is read from
BLOCK = 64  # neighbours in such an order that are compared
REVERSE = 32  # reverse neighbours that join one local comparison
STILL = 0.01  # share of list places changed in a round that counts as standing still
COUNT_BLOCK = 256
CENTRES = 512  # centres of blocks that meet those of as many others
AUDIT = 512  # vectors compared with all rows to measure recall, at most
RECALL = 0.97
_PAIR = "a long, b long, s double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows in double precision; all vectors have one length here."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie together what a square matrix of links ties together."""
    n = len(linked)
    seen = np.zeros(n, dtype=bool)
    out = []
    for root in np.flatnonzero(linked.sum(axis=1) > 1).tolist():
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            out += [(x, y) for y in new.tolist()]
            stack += new.tolist()
    return out


def _compared(ids: np.ndarray, unit: np.ndarray, least: np.ndarray, own: np.ndarray, threshold: float):
    """Best ``own`` of each among these vectors, if better than its ``least``; and a forest of links.

    Rows (a, b, s): list entries have a similarity, forest edges come with s null.
    """
    similar = unit @ unit.T
    same = ids[:, None] == ids[None, :]
    forest = [(int(ids[x]), int(ids[y])) for x, y in _forest((similar >= threshold) & ~same | np.eye(len(ids), dtype=bool))]
    similar[same] = -2.0
    k = min(int(own.max()), len(ids) - 1)
    if k < 1:
        return [], [], [], forest
    best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(similar, best, axis=1)
    # Best first, as many as the row's own list is long.
    order = np.argsort(-value, axis=1, kind="stable")
    best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
    keep = (value > least[:, None]) & (value > -2.0) & (np.arange(k)[None, :] < own[:, None])
    row = np.nonzero(keep)[0]
    return ids[row], ids[best[keep]], value[keep], forest


def _emit(parts) -> Iterator[pa.RecordBatch]:
    """Buffers rows of ``_compared`` into batches."""
    held, size = [], 0  # until 20,000 rows are together
    for a, b, s, forest in parts:
        held.append((a, b, s, forest))
        size += len(a) + len(forest)
        if size >= 20_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held) -> pa.RecordBatch:
    """Entries once each, then forest edges."""
    a, b, s = (np.concatenate([np.asarray(h[i], dtype=t) for h in held]) for i, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    edges = np.array(sorted({e for h in held for e in h[3]}), dtype=np.int64).reshape(-1, 2)
    sims = pa.concat_arrays([pa.array(s[fresh]), pa.nulls(len(edges), pa.float64())])
    ids = (pa.array(np.concatenate([x[fresh], e])) for x, e in ((a, edges[:, 0]), (b, edges[:, 1])))
    return pa.RecordBatch.from_arrays([*ids, sims], ["a", "b", "s"])


def first_graph(vectors: DataFrame, threshold: float, k: int, seed: int, trees: int = TREES) -> DataFrame:
    """Rows (a, b, s) from ``trees`` orders by the signs at random hyperplanes.

    Vectors that share many leading signs stand together in an order; a block of
    ``BLOCK`` of them is compared. Orders are sorted by range, whatever a label's size.
    The blocks of each tree begin at another offset, so that vectors whose codes are
    equal in all trees do not meet the same others every time.
    """

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column(2).to_numpy()).tolist():
                rows = batch.filter(pa.array(batch.column(2).to_numpy() == dim))
                vector = rows.column(3)
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS))
                positive = (_matrix(vector) @ planes > 0).reshape(len(vector), trees, BITS)
                codes = positive @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(1), rows.column(2), pa.array(np.full(len(vector), t)), pa.array(codes[:, t]), rows.column(0), vector],
                        ["label", "dim", "tree", "code", "id", "v"],
                    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for group in groups(batches, 3):
                ids = group.column("id").to_numpy()
                lead = group.column("tree")[0].as_py() * BLOCK // trees
                for start in range(lead - BLOCK if lead else 0, len(ids), BLOCK):
                    at, stop = max(0, start), start + BLOCK
                    unit = _matrix(group.column("v").slice(at, stop - at))
                    yield _compared(ids[at:stop], unit, np.full(len(unit), -2.0), np.full(len(unit), k), threshold)

        yield from _emit(parts())

    kind = vectors.schema["v"].dataType.simpleString()
    coded = vectors.select("id", "label", "dim", "v").mapInArrow(
        signs, f"label long, dim long, tree long, code long, id long, v {kind}"
    )
    order = ["label", "dim", "tree", "code", "id"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, _PAIR)


def best_lists(entries: DataFrame, lengths: DataFrame | None, k: int) -> DataFrame:
    """The nearest ``k`` (or the id's own length) distinct neighbours of each id."""
    distinct = entries.filter("s is not null").groupBy("a", "b").agg(F.max("s").alias("s"))
    ordered = distinct.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("d"), "b"))).alias("l"))
    if lengths is not None:
        ordered = ordered.join(lengths, "a", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    else:
        ordered = ordered.withColumn("k", F.lit(k))
    cut = ordered.select("a", "k", F.slice("l", F.lit(1), F.col("k")).alias("l"))
    return cut.select("a", "k", F.explode("l").alias("e")).select("a", "k", F.col("e.b").alias("b"), (-F.col("e.d")).alias("s"))


def refine(lists: DataFrame, vectors: DataFrame, lengths: DataFrame, threshold: float, k: int) -> DataFrame:
    """One round: at every id its neighbours, and those that list it, meet each other.

    Reverse neighbours of an id come in parts, each with all its own neighbours, so
    an id that many others list makes more comparisons, not a larger one.
    """
    forward = lists.select(F.col("a").alias("at"), F.col("b").alias("id"))
    reverse = lists.select(F.col("b").alias("at"), F.col("a").alias("id"))
    parts = reverse.groupBy("at").agg(F.ceil(F.count("*") / REVERSE).cast("long").alias("parts"))
    placed = reverse.join(parts, "at").select("at", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id")
    spread = forward.join(parts, "at", "left").select(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "id"
    )
    members = placed.unionByName(spread).distinct()
    with_vector = members.join(vectors.select("id", "v"), "id").join(
        lengths.select(F.col("a").alias("id"), "least", F.col("k").alias("own")), "id", "left"
    )
    rows = with_vector.select(
        "at", "part", "id", F.coalesce("least", F.lit(-2.0)).alias("least"), F.coalesce("own", F.lit(k)).alias("own"), "v"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for group in groups(batches, 2):
                ids = group.column("id").to_numpy()
                if len(ids) > 1:
                    least, own = group.column("least").to_numpy(), group.column("own").to_numpy()
                    yield _compared(ids, _matrix(group.column("v")), least, own, threshold)

        yield from _emit(parts())

    return rows.repartition("at", "part").sortWithinPartitions("at", "part").mapInArrow(meet, _PAIR)


def list_lengths(lists: DataFrame, threshold: float) -> DataFrame:
    """Per id its list length for the next round and the similarity that a new entry must beat.

    A list that holds links only may miss some: it is doubled, and further links are
    all that it takes. At ``LONGEST`` it stays; ``links_across`` finds what it lacks.
    """
    state = lists.groupBy("a").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.min("s").alias("least"))
    saturated = (F.col("n") >= F.col("k")) & (F.col("least") >= threshold) & (F.col("k") < LONGEST)
    return state.select(
        "a",
        F.when(saturated, F.col("k") * 2).otherwise(F.col("k")).alias("k"),
        F.when(saturated, F.lit(threshold - 1e-9)).when(F.col("n") < F.col("k"), -2.0).otherwise(F.col("least")).alias("least"),
    )


def saturated_ids(lists: DataFrame, threshold: float) -> DataFrame:
    """``id`` of the lists that are full and hold links only, so that they may lack some."""
    state = lists.groupBy("a").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.min("s").alias("least"))
    return state.filter((F.col("n") >= F.col("k")) & (F.col("least") >= threshold)).select(F.col("a").alias("id"))


def links_across(vectors: DataFrame, component: DataFrame, threshold: float, by_component: bool) -> DataFrame:
    """Edges (a, b): a forest of all links between vectors of different components.

    Every vector of ``vectors`` is compared with all others of its label and length, block
    against block, unless their angles to the centres of the blocks rule a link out.
    Blocks hold vectors with alike signs, of one component if ``by_component``.
    """
    kind = vectors.schema["v"].dataType.simpleString()
    own = vectors.join(component, "id", "left").select(
        "label", "dim", F.coalesce("component", "id").alias("component"), "id", "v"
    )
    near = F.col("component") if by_component else F.lit(0).cast("long")

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column(1).to_numpy()).tolist():
                rows = batch.filter(pa.array(batch.column(1).to_numpy() == dim))
                planes = np.random.default_rng([0, dim]).standard_normal((dim, BITS))
                code = (_matrix(rows.column(5)) @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code)], [*rows.schema.names, "code"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            for at in range(0, len(group), COUNT_BLOCK):
                block = group.slice(at, COUNT_BLOCK)
                name = pa.array(np.full(len(block), block.column("id")[0].as_py(), dtype=np.int64))
                for part in block.select(["label", "dim", "component", "id", "v"]).append_column("block", name).combine_chunks().to_batches():
                    yield part

    columns = f"component long, id long, v {kind}"
    order = ["label", "dim", "near", "code", "id"]
    coded = own.select("label", "dim", near.alias("near"), "component", "id", "v").mapInArrow(
        signs, f"label long, dim long, near long, {columns}, code long"
    )
    blocks = materialize(
        coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"label long, dim long, {columns}, block long")
    )

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            unit, of = _matrix(group.column("v")), group.column("component").to_numpy()
            mean = unit.sum(axis=0)
            length = np.sqrt(mean @ mean)
            mean = mean / length if length > 0 else unit[0]
            radius = float(np.arccos(np.clip((unit @ mean).min(), -1.0, 1.0)))
            row = ([group.column(c)[0].as_py()] for c in ("label", "dim", "block"))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (*row, [int(of.min())], [int(of.max())])), pa.array([radius]), pa.array([mean.tolist()], pa.list_(pa.float64()))],
                ["label", "dim", "block", "low", "high", "radius", "v"],
            )

    centres = materialize(
        blocks.select("block", "label", "dim", "component", "v").repartition("block").sortWithinPartitions("block").mapInArrow(
            centre, "label long, dim long, block long, low long, high long, radius double, v array<double>"
        )
    )
    cells = centres.groupBy("label", "dim").agg(F.ceil(F.count("*") / CENTRES).cast("long").alias("cells"))
    placed = centres.join(cells, ["label", "dim"]).withColumn("cell", F.pmod(F.xxhash64("block"), "cells"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).select(
        "label", "dim", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"),
        "cell", "block", "low", "high", "radius", "v",
    )
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 4):
            i, j, cell, block, low, high, radius = (
                group.column(c).to_numpy() for c in ("i", "j", "cell", "block", "low", "high", "radius")
            )
            unit = _matrix(group.column("v"))
            first, second = np.flatnonzero(cell == i[0]), np.flatnonzero(cell == j[0])
            angle = np.arccos(np.clip(unit[first] @ unit[second].T, -1.0, 1.0))
            close = angle <= radius[first][:, None] + radius[second][None, :] + reach
            # Blocks of one and the same component have nothing to find.
            close &= (np.minimum(low[first][:, None], low[second][None, :]) != np.maximum(high[first][:, None], high[second][None, :]))
            if i[0] == j[0]:
                close = np.triu(close)
            x, y = np.nonzero(close)
            yield pa.RecordBatch.from_arrays([pa.array(block[first[x]]), pa.array(block[second[y]])], ["x", "y"])

    keys = ["label", "dim", "i", "j"]
    pairs = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(pair, "x long, y long")
    sides = materialize(pairs).select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = sides.join(blocks.select("block", "component", "id", "v"), "block").select("x", "y", "component", "id", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            ids, of, unit = group.column("id").to_numpy(), group.column("component").to_numpy(), _matrix(group.column("v"))
            linked = (unit @ unit.T >= threshold) & (of[:, None] != of[None, :])
            edges = np.array(_forest(linked | np.eye(len(ids), dtype=bool)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], ["a", "b"])

    found = rows.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(compare, "a long, b long")
    return materialize(found.distinct())


def link_counts(vectors: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """Links of each id within its component, counted block against block.

    This enlarges the lists of a saturated neighbourhood to the whole component
    without writing its pairs: a comparison of two blocks returns one number a row.
    A linked vector counts with the ``size`` of its class.
    """
    sizes = component.groupBy("component").agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("long").alias("blocks"))
    placed = component.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    # A row meets every block of its component once: as the first of the pair, or the second.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block"
    )
    rows = pairs.join(vectors.select("id", "size", "v"), "id").select("component", "i", "j", "id", "block", "size", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
            unit, size = _matrix(group.column("v")), group.column("size").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
            linked = unit[first] @ unit[second].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
                found, n = ids[first], linked @ size[first]
            else:
                found = np.concatenate([ids[first], ids[second]])
                n = np.concatenate([linked @ size[second], size[first] @ linked])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["id", "n"])

    met = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return met.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def audit(vectors: DataFrame, seed: int, threshold: float) -> DataFrame:
    """True links (a, b) of a bounded seeded sample of ids, compared with all rows."""
    chosen = seeded_sample(vectors, "id", AUDIT, seed).select("id", "label", "dim", "v").toArrow()
    tests = []
    keys = list(zip(chosen.column("label").to_pylist(), chosen.column("dim").to_pylist(), strict=True))
    for key in sorted(set(keys)):
        at = [i for i, k in enumerate(keys) if k == key]
        rows = chosen.take(at)
        tests.append((key, rows.column("id").to_numpy(), _matrix(rows.column("v"))))
    shared = vectors.sparkSession.sparkContext.broadcast(tests)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label, dim = (batch.column(i).to_numpy() for i in range(3))
            for key, names, unit in shared.value:
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if len(at):
                    similar = unit @ _matrix(batch.column(3).take(pa.array(at))).T
                    x, y = np.nonzero((similar >= threshold) & (names[:, None] != ids[at][None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(ids[at][y])], ["a", "b"])

    return vectors.select("id", "label", "dim", "v").mapInArrow(compare, "a long, b long")


def recall(truth: DataFrame, component: DataFrame) -> float:
    """Share of the true links of a sampled id that lie within its component: the least mean of any stratum.

    Ids are weighed alike, and apart for each power of two of their number of links, so that a
    large group does not hide what small ones lack.
    """
    of = component.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = component.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    each = (
        truth.join(of, "a", "left").join(other, "b", "left").groupBy("a")
        .agg(F.count("*").alias("n"), F.avg(F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0)).alias("r"))
    )
    strata = each.groupBy(F.floor(F.log2("n")).alias("stratum")).agg(F.avg("r").alias("r"))
    least = strata.agg(F.min("r")).first()[0]
    return 1.0 if least is None else least


def _joined(component: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that ``edges`` tie together as well."""
    return connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges))


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.93,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    k: int = NEIGHBOURS,
    seed: int = 7,
) -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label (and one length) are compared by cosine in double precision.
    Equal vectors are one class, searched for by one of them.
    A first graph is refined in rounds, lists that hold links only being doubled, until
    a round changes next to nothing. Every comparison also reports which of its vectors
    are linked, so components rest on all pairs ever compared. Vectors whose lists still
    hold links only are then compared across components. Recall is
    measured on a sample against all rows, apart for each order of the number of links;
    below ``RECALL`` in any the search goes on with more orders and longer lists, and at
    last compares all. Links are finally counted within components.

    Null, zero or empty vectors, vectors with null or non-finite components, and null labels
    link with nothing; a null id keeps a null component. Every row is a vector of its own,
    whether or not its id repeats; a component is named by the smallest id of its rows. Ties in
    a list go to any.
    """
    value = F.col(vector)
    usable = (
        F.col(id_column).isNotNull()
        & F.col(label).isNotNull()
        & value.isNotNull()
        & (F.size(value) > 0)
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    # Rows are told apart by a number that is stored with them; ids only name the result.
    numbered = materialize(
        rows.select(
            F.col(id_column).alias("vec_id"),
            usable.alias("usable"),
            F.when(usable, F.col(label).cast("long")).alias("label"),
            F.when(usable, value).alias("v"),
            F.monotonically_increasing_id().alias("id"),
        )
    )
    single = numbered.filter("usable").select(
        "id", "label", F.size("v").cast("long").alias("dim"), "v", F.col("vec_id").cast("long").alias("name")
    )
    distinct = materialize(
        single.groupBy("label", "dim", "v").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.min("name").alias("name"))
    )
    vectors = distinct.select("id", "label", "dim", "v", "size")
    links = None
    entries = None
    for attempt in range(3):
        found = materialize(first_graph(vectors, threshold, k, seed + attempt))
        links = found.filter("s is null") if links is None else links.unionByName(found.filter("s is null"))
        entries = found if entries is None else entries.unionByName(found)
        lists = materialize(best_lists(entries, None, k))
        while True:
            lengths = materialize(list_lengths(lists, threshold))
            better = materialize(refine(lists, vectors, lengths, threshold, k))
            links = links.unionByName(better.filter("s is null"))
            total = lists.count()
            merged = lists.select("a", "b", "s").unionByName(better)
            fresh = materialize(best_lists(merged, lengths.select("a", "k"), k))
            new = fresh.join(lists, ["a", "b"], "left_anti").count()
            lists = fresh
            if new <= STILL * total:
                break
        edges = links.select("a", "b").unionByName(lists.filter(F.col("s") >= threshold).select("a", "b"))
        component = materialize(connected_components(edges))
        crowded = vectors.join(saturated_ids(lists, threshold), "id", "left_semi")
        more = links_across(crowded, component, threshold, True)
        if more.count():
            links = links.unionByName(more.withColumn("s", F.lit(None).cast("double")))
            component = materialize(_joined(component, more))
        if recall(audit(vectors, seed, threshold), component) >= RECALL:
            break
        entries, k = lists.select("a", "b", "s"), 2 * k
    else:
        component = materialize(_joined(component, links_across(vectors, component, threshold, False)))
    counts = link_counts(vectors, component, threshold)
    classes = materialize(
        distinct.select("id", "size", "name").join(component, "id", "left").join(counts, "id", "left").select(
            F.col("id").alias("first"),
            F.coalesce("component", "id").alias("component"),
            "name",
            # The others of its class are linked with it.
            (F.coalesce("n_links", F.lit(0)) + (F.col("size") - 1 if threshold <= 1 else F.lit(0))).alias("n_links"),
        )
    )
    called = classes.groupBy("component").agg(F.min("name").alias("component_id"))
    several = distinct.filter("size > 1").select("label", "v", F.col("id").alias("first"))
    of = materialize(single.join(several, ["label", "v"], "left").select("id", F.coalesce("first", "id").alias("first")))
    names = of.join(classes, "first").join(called, "component").select("id", "component_id", "n_links")
    joined = numbered.select("vec_id", "id").join(names, "id", "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("vec_id")).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
