"""Near-duplicate vectors by an exact metric range join.

Among unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Every label (and
dimension) gets pivots in proportion to its vectors; each vector has its home cell at the nearest pivot. By the
triangle inequality no vector of cell j lies within r of x unless x is within r of the plane between its own pivot
and j's, and so d(x, j) - d(x, home) <= 2r; x is sent along to those cells only, and of two cells to the one with
the higher number, so that every pair meets in exactly one place. Cells join independently. A cell of more than
``BLOCK`` vectors is dealt into blocks, and each two blocks meet in a task of their own, by one matrix product.

A task never gives back pairs: only how many links each vector found there and edges to the least vector of each
group that hangs together inside it. Equal vectors of a label count as one with a weight before any of this. So a
hot group costs products, but no rows.

Vectors are checked, scaled to length one and hashed in one pass in numpy, and travel as packed doubles. Which of them
are equal is settled by ids and hashes of 128 bits alone. Pivots are those whose id has one of the least hashes: a
threshold leaves about as many candidates as wanted, and only their ids are ranked. How many come does not change the
result. The number of pivots is bounded (``PIVOTS``); beyond that cells grow and are dealt into more blocks.

Defined cases: a vector links with nothing if its label or itself is null, if it is empty or zero, or holds null or
non-finite components. Vectors of different length never link. An id that repeats stands for its least vector (by
label, then components) and comes back once. Rows with a null id come back with no links and a null component,
kept. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, pieces, shipped
from quoteflow.llm.components import components
from quoteflow.llm.words import mix

#: Vectors that one pivot is for, pivots in all, and vectors in one side of a matrix product.
CELL, PIVOTS, BLOCK = 2048, 4096, 2048
_UNITS = "id long, label int, dim int, k1 long, k2 long, vector binary"
_PLACED = "label int, dim int, id long, copies long, vector binary, cell int, home boolean"
_FOUND = "id long, links long, root long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row once: with its vector at length one and two hashes of that, or without if it can't link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("embedding")
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is a nan
        named = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        named &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        left = np.ones(len(sizes), bool)
        for size in np.unique(sizes[named & (sizes > 0)]).tolist():
            rows = np.flatnonzero(named & (sizes == size))
            part = values[begins[rows][:, None] + np.arange(size)]
            most = np.abs(part).max(1)
            sound = np.isfinite(part).all(1) & (most > 0)
            rows, part = rows[sound], part[sound] / most[sound, None]
            part = part / np.sqrt((part * part).sum(1))[:, None] + 0.0  # no negative zeros
            left[rows] = False
            bits, place = part.view(np.uint64), mix(np.arange(1, size + 1, dtype=np.uint64))
            keys = [np.add.reduce(mix(bits ^ place), 1, np.uint64), np.add.reduce(mix(bits + mix(~place)), 1, np.uint64)]
            packed = pa.array([x.tobytes() for x in part], pa.binary())
            same = pa.array(np.full(len(rows), size, np.int32))
            yield _row(batch.take(pa.array(rows)), same, *[pa.array(x.view(np.int64)) for x in keys], packed)
        rest = np.flatnonzero(left)
        nulls = [pa.nulls(len(rest), kind) for kind in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield _row(batch.take(pa.array(rest)), *nulls)


def _row(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
    names = ["id", "label", "dim", "k1", "k2", "vector"]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *columns], names)


def _unpacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 1))
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    begin, end = int(ends[0]), int(ends[-1])
    return np.frombuffer(column.buffers()[2], np.uint8, end - begin, begin).view(np.float64).reshape(len(column), -1)


def _place(pivots, radius: float):
    """Home and neighbouring cells of vectors; rows of one batch may be of many labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            keys = label.astype(np.int64) << 32 | dim
            for key in np.unique(keys).tolist():
                rows = np.flatnonzero(keys == key)
                part = batch.take(pa.array(rows))
                centre = known.get(key)
                if centre is None:
                    yield _sent(part, np.arange(len(rows)), np.zeros(len(rows), np.int32), np.ones(len(rows), bool))
                    continue
                for i in range(0, len(rows), 4096):
                    some = part.slice(i, 4096)
                    away = 2 - 2 * (_unpacked(some.column("vector")) @ centre.T)  # squared distances
                    home = away.argmin(1)
                    gap = away - away.min(1)[:, None]
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (centre[home] @ centre.T)))
                    near = (gap <= 2 * apart * (radius + 1e-6) + 1e-9) & (np.arange(len(centre)) > home[:, None])
                    near[np.arange(len(home)), home] = True
                    row, cell = np.nonzero(near)
                    yield _sent(some, row, cell.astype(np.int32), cell == home[row])

    return run


def _sent(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    part = batch.take(pa.array(row))
    columns = [part.column(c) for c in ("label", "dim", "id", "copies", "vector")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(cell), pa.array(home)], ["label", "dim", "id", "copies", "vector", "cell", "home"]
    )


def _meet(least: float):
    """One side against the other, or against itself: each vector's links, and the least vector it hangs on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        side = table.column("side").to_numpy()
        vectors = _unpacked(table.column("vector").chunk(0)) if table.num_rows else np.zeros((0, 1))
        order = np.lexsort((ids, side))
        ids, copies, side, vectors = ids[order], copies[order], side[order], vectors[order]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        same = not len(right) and bool(table.column("same")[0].as_py())
        if same:
            right = left
        cosine = vectors[left] @ vectors[right].T
        hit = cosine >= least
        close = np.argwhere(np.abs(cosine - least) < 1e-12)
        for i, j in close.tolist():
            a, b = vectors[left[i]], vectors[right[j]]
            hit[i, j] = float(a @ b) / (float(a @ a) ** 0.5 * float(b @ b) ** 0.5) >= least
        if same:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(ids), np.int64)
        weigh = hit.astype(np.float64)  # sums of counts below 2**53 are exact
        links[left] += (weigh @ copies[right].astype(np.float64)).astype(np.int64)
        if not same:
            links[right] += (weigh.T @ copies[left].astype(np.float64)).astype(np.int64)
        root = _roots(ids, left, right, hit)
        met = links > 0
        return pa.table([pa.array(ids[met]), pa.array(links[met]), pa.array(root[met])], names=["id", "links", "root"])

    return run


def _roots(ids: np.ndarray, left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The least id of what hangs together."""
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return least[root]


def _tasks(placed: DataFrame) -> DataFrame:
    """Each vector once for every task of its cell that it takes part in."""
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.expr(f"cast(ceil(count_if(home) / {BLOCK}) as int)").alias("homes"),
        F.expr(f"cast(ceil(count_if(not home) / {BLOCK}) as int)").alias("guests"),
    )
    joined = placed.join(sizes, cell).withColumn("block", F.expr("pmod(xxhash64(id), if(home, homes, guests))"))
    # home block a meets home blocks b >= a as (a, b) and guest block g as (a, -1 - g)
    native = F.expr(
        "concat(transform(sequence(0, homes - 1), b -> struct(cast(least(block, b) as int) as a, cast(greatest(block, b) as int) as b,"
        " cast(block > b as int) as side, block = b as same)),"
        " if(guests > 0, transform(sequence(0, guests - 1), g -> struct(cast(block as int) as a, -1 - g as b, 0 as side, false as same)),"
        " array()))"
    )
    guest = F.expr(
        "transform(sequence(0, homes - 1), h -> struct(h as a, cast(-1 - block as int) as b, 1 as side, false as same))"
    )
    return joined.withColumn("task", F.explode(F.when(F.col("home"), native).otherwise(guest))).select(
        *cell, "task.a", "task.b", "task.side", "task.same", "id", "copies", "vector"
    )


def _pivots(units: DataFrame, every: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Of every label and length with more different vectors than one cell is for, about one in so many."""
    kind = ["label", "dim"]
    each = max(CELL, pieces(rows or 1, PIVOTS))
    wanted = units.groupBy(*kind).agg(F.count("*").alias("m")).filter(F.col("m") > each)  # at most PIVOTS rows
    wanted = wanted.select(*kind, "m", F.expr(f"cast(ceil(m / {each}) as int)").alias("k"))
    spread = F.expr("shiftrightunsigned(xxhash64(id), 11) / double(9007199254740992) < (k + 4 * sqrt(k) + 8) / m")
    some = units.select(*kind, "id").join(wanted, kind).filter(spread)
    order = F.row_number().over(Window.partitionBy(*kind).orderBy(F.xxhash64("id"), "id"))
    chosen = some.withColumn("nth", order).filter("nth <= k").select("id")  # at most 2 * PIVOTS ids
    found: dict[int, list] = {}
    for row in every.join(F.broadcast(chosen), "id").select(*kind, "vector").toLocalIterator():
        found.setdefault(row["label"] << 32 | row["dim"], []).append(np.frombuffer(row["vector"], np.float64))
    return {key: np.array(x) for key, x in found.items()}


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    components_of = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        components_of = components_of.cast("array<double>")
    rows = shipped(vectors).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), components_of.alias("embedding")
    )
    counts = rows.agg(F.count("id").alias("n"), F.countDistinct("id").alias("ids")).first()
    if counts["n"] > counts["ids"]:
        known = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("label", "embedding")).alias("x"))
        rows = known.select("id", "x.label", "x.embedding").unionByName(rows.filter("id is null"))
    every = cut(rows.mapInArrow(_units, _UNITS), "units")
    usable = every.filter("dim is not null")
    key = ["label", "dim", "k1", "k2"]
    groups = usable.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    copies = cut(usable.select("id", *key).join(groups, key).select("id", "rep", "copies"), "copies")
    units = usable.join(copies, "id", "left").filter("rep is null or rep = id")
    units = units.select("label", "dim", "id", F.coalesce("copies", F.lit(1)).alias("copies"), "vector")
    shared = spark.sparkContext.broadcast(_pivots(units, usable, counts["n"]))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    placed = cut(units.mapInArrow(_place(shared, radius), _PLACED), "placed")
    found = _tasks(placed).groupBy("label", "dim", "cell", "a", "b").applyInArrow(_meet(least), _FOUND)
    found = cut(found, "met")
    member = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    member = member.select(F.col("node").alias("rep"), "component")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    named = every.select("id").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    linked = named.join(links, "rep", "left").join(member, "rep", "left")
    component = F.coalesce("component", "rep")
    return linked.select(
        F.col("id").alias("vec_id"),
        F.expr("coalesce(copies, 1) - 1 + coalesce(links, 0)").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
