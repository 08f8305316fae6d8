"""Trie of conversations by shared openings, rolled up in bands of depth.

Every conversation is a sequence of turns; a node is a distinct opening of d turns. What a node's subtree holds is
summed in bands of ``height`` depths: inside a band each node is counted once for itself and each node above it, so
no node gives more than ``height`` rows. The tops of bands then form a tree of their own, ``height`` times less
deep, whose totals are found in the same way; a completed top counts for all nodes above it in the band before. The
number of rounds is the logarithm of the depth to the base ``height``, and no round sees more than one band of a path.

Turns are numbered and summed without gathering a conversation: they are dealt by ranges of (conversation, place),
numbered inside a partition, and the at most one conversation that a partition goes on with gets the count so far.
An opening is named by 128 bits, sums over its turns of hashes of place and SHA-256, which are made band by band as
well. Only these names and sizes are shuffled, never texts. A node's own ids are joined in blocks of ids, and the
blocks go through the digest one after the other, so that a node where a third of all conversations end takes
no more memory than others.

Defined cases: turns without a conversation id are left out. A null role or text is empty. Turns of one place come
by role and text joined by U+0001, by their first 64 characters, then by SHA-256; equal turns stay as many as they
are. A null place comes first. Other columns are ignored. A table without rows gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, shipped

HEIGHT = 32
#: Conversations of one family open with the same turns: ids that a multiple of ``FAMILY`` follows, up to ``OPENING`` - 1 turns.
FAMILY, OPENING = 5, 9
_BLOCK = 4096
#: A parent with more than this share of all nodes as children is joined apart; there are at most so many.
_HEAVY = 1000
_SUMS = ["s1", "s2", "s3", "s4"]
_KEY = ["hi", "lo"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of every row among those of its conversation in this partition."""
    part, last, after = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if ids[0] == last:
            at[: starts[1] if len(starts) > 1 else n] += after
        last, after = ids[-1], int(at[-1]) + 1
        columns = [batch.column("conv_id"), pa.array(at), pa.array(np.full(n, part, np.int64))]
        columns += [batch.column("digest"), batch.column("size")]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "part", "digest", "size"])


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, the place ``at`` of each turn from 0, a digest of role and text, and the text's bytes."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = shipped(conversations).filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.concat(role, F.lit("\x01"), text), 1, 64).alias("head"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("copy"),
    )
    place = ["conv_id", "turn", "head", "digest", "copy"]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    rows = cut(dealt.mapInArrow(_numbered, "conv_id long, at long, part long, digest binary, size long"), "turns")
    # a row for each partition: its first and last conversation, and how many of the last's turns it holds
    parts = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last"))
    asked = parts.select(F.col("first").alias("conv_id"), "part", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    told = parts.select(F.col("last.conv_id").alias("conv_id"), "part", (F.col("last.at") + 1).alias("n"), F.lit(False).alias("asks"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.unionByName(told).withColumn("before", F.sum("n").over(earlier)).filter("asks and before > 0")
    # at most one row for each partition of the table
    out = rows.join(F.broadcast(carried.select("conv_id", "part", "before")), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, opening: int = OPENING) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first, and the rows of their turns.

    Conversation c opens with the first h turns of c - c % family, where h is crc32 of the decimal id % opening, and
    goes on with its own from place h. Gives (conv_id, length) and (conv_id, depth from 1, digest, size, last).
    """
    convs = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % opening
    convs = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("donor"))
    sizes = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    convs = convs.join(sizes, "donor", "left").withColumn("given", F.least("h", F.coalesce("donor_n", F.lit(0))))
    convs = convs.withColumn("length", F.expr("given + greatest(n - h, 0)")).drop("donor_n")
    # a conversation of any size meets its one row in blocks of turns
    blocks = convs.filter("n > h").select(
        "conv_id", "given", "length", F.explode(F.expr(f"sequence(h div {_BLOCK}, (n - 1) div {_BLOCK})")).alias("block")
    )
    own = turns.filter(F.col("at") >= h).withColumn("h", h).withColumn("block", F.expr(f"at div {_BLOCK}"))
    own = own.join(blocks, ["conv_id", "block"]).withColumn("depth", F.expr("at - h + given + 1"))
    heads = turns.filter(F.col("at") < opening - 1).withColumnRenamed("conv_id", "donor")
    given = heads.join(convs.select("conv_id", "donor", "h", "length"), "donor").filter("at < h")
    given = given.withColumn("depth", F.col("at") + 1)
    columns = ["conv_id", "depth", "digest", "size", F.expr("depth = length").alias("last")]
    return convs.select("conv_id", "length"), own.select(*columns).unionByName(given.select(*columns))


def _before(sums: DataFrame, most: int, height: int) -> DataFrame:
    """For each (conv_id, at) the sums of all lower places, by blocks of ``height`` places."""
    rows = sums.withColumn("block", F.expr(f"at div {height}"))
    lower = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("conv_id", "at", "block", *[F.coalesce(F.sum(s).over(lower), F.lit(0)).alias(s) for s in _SUMS])
    if most >= height:
        totals = rows.groupBy("conv_id", F.col("block").alias("at")).agg(*[F.sum(s).alias(s) for s in _SUMS])
        over = _before(totals, most // height, height).withColumnRenamed("at", "block")
        over = over.select("conv_id", "block", *[F.col(s).alias(f"{s}_") for s in _SUMS])
        out = out.join(over, ["conv_id", "block"])
        out = out.select("conv_id", "at", *[(F.col(s) + F.col(f"{s}_")).alias(s) for s in _SUMS])
    return out.select("conv_id", "at", *_SUMS)


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), depth, *sums).alias(k) for i, k in enumerate(_KEY)]


def openings(convs: DataFrame, turns: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, int]:
    """A row for each conversation and depth, with the name of that opening and of the one before; and the most depth."""
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"))
    none = none.withColumn("size", F.lit(0).cast("long")).join(convs, "conv_id").withColumn("last", F.expr("length = 0"))
    rows = turns.unionByName(none.drop("length"))
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(7))
    half = F.lit((1 << 32) - 1)
    parts = [one.bitwiseAND(half), F.shiftrightunsigned(one, 32), two.bitwiseAND(half), F.shiftrightunsigned(two, 32)]
    for s, x in zip(_SUMS, parts, strict=True):
        rows = rows.withColumn(s, F.when(F.col("depth") > 0, x).otherwise(F.lit(0).cast("long")))
    rows = rows.drop("digest").withColumn("band", F.expr(f"depth div {height}"))
    most = convs.agg(F.max("length")).first()[0] or 0
    within = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.select("*", *[F.sum(s).over(within).alias(f"to_{s}") for s in _SUMS])
    if most >= height:
        totals = rows.groupBy("conv_id", F.col("band").alias("at")).agg(*[F.sum(s).alias(s) for s in _SUMS])
        lower = _before(totals, most // height, height).filter("at > 0").withColumnRenamed("at", "band")
        lower = lower.select("conv_id", "band", *[F.col(s).alias(f"under_{s}") for s in _SUMS])
        whole = whole.join(lower, ["conv_id", "band"], "left")
        for s in _SUMS:
            whole = whole.withColumn(f"to_{s}", F.col(f"to_{s}") + F.coalesce(f"under_{s}", F.lit(0)))
    here = _name(F.col("depth"), [F.col(f"to_{s}") for s in _SUMS])
    up = _name(F.col("depth") - 1, [F.col(f"to_{s}") - F.col(s) for s in _SUMS])
    up = [F.when(F.col("depth") > 0, c).alias(f"up_{k}") for c, k in zip(up, _KEY, strict=True)]
    return cut(whole.select("conv_id", "depth", "size", "last", *here, *up), "openings"), most


def _rollup(paths: DataFrame, nodes: DataFrame, most: int, height: int, values: list[str]) -> DataFrame:
    """The sums of ``values`` over the subtree of every node.

    ``paths`` has every conversation's node at each place ``at``; ``nodes`` one row for each node, with a conversation
    that goes through it.
    """
    band = F.expr(f"at div {height}").alias("band")
    sums = [F.sum(v).alias(v) for v in values]
    path = F.array_sort(F.collect_list(F.struct("at", *_KEY)))  # at most ``height`` of them
    bands = paths.groupBy("conv_id", band).agg(path.alias("path"))
    up = F.explode(F.expr(f"slice(path, 1, cast(at % {height} + 1 as int))")).alias("top")
    inside = nodes.select("conv_id", band, "at", *values).join(bands, ["conv_id", "band"]).select(up, *values)
    totals = inside.groupBy("top.hi", "top.lo").agg(*sums)
    if most < height:
        return totals
    totals = cut(totals, "band-totals")
    level = F.expr(f"at div {height}").alias("at")
    tops = nodes.filter(f"at % {height} = 0").select(*_KEY, "conv_id", level).join(totals, _KEY)
    upper = paths.filter(f"at % {height} = 0").select("conv_id", level, *_KEY)
    whole = cut(_rollup(upper, tops, most // height, height, values), "tops")
    # a completed top counts for every node on its path in the band before
    done = tops.drop(*values).join(whole, _KEY).filter("at > 0").withColumn("band", F.col("at") - 1)
    above = done.join(bands, ["conv_id", "band"]).select(F.explode("path").alias("top"), *values).select("top.hi", "top.lo", *values)
    return totals.unionByName(above).groupBy(*_KEY).agg(*sums)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's blocks of ids, which come one after the other."""

    def made(rows):
        columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hi", "lo", "ends_sha256"])

    key = state = None
    for batch in batches:
        done = []
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (hi, lo), hashlib.sha256(ids.encode())
        if done:
            yield made(done)
    if key:
        yield made([(*key, state.hexdigest())])


def _ends(rows: DataFrame) -> DataFrame:
    """For each node where conversations end, the digest of their ids in order."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = rows.filter("last").groupBy(*_KEY, F.expr(f"conv_id div {_BLOCK}").alias("block")).agg(ids.alias("ids"))
    dealt = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.select(*_KEY, "ids").mapInArrow(_digest, "hi long, lo long, ends_sha256 string")


def _parents(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes with their parent's conversation; parents of very many children are joined apart."""
    heavy = nodes.filter(F.col("n_children") * _HEAVY > n)  # fewer than _HEAVY, as every node is one node's child
    parent = [F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo")]
    few = F.broadcast(heavy.select(*parent, F.col("conv_id").alias("heavy_conv_id"), F.lit(True).alias("heavy")))
    rows = nodes.join(few, ["up_hi", "up_lo"], "left")
    rest = rows.filter("heavy is null").join(nodes.select(*parent, F.col("conv_id").alias("parent_conv_id")), ["up_hi", "up_lo"], "left")
    return rest.drop("heavy", "heavy_conv_id").unionByName(
        rows.filter("heavy").withColumnRenamed("heavy_conv_id", "parent_conv_id").drop("heavy")
    )


def trie(convs: DataFrame, turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each node: its least conversation, depth, parent, members, children and what its subtree holds."""
    rows, most = openings(convs, turns, height)
    nodes = rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("at"),
        F.count("*").alias("n_convs"),
        F.min("size").alias("size"),
        F.min("up_hi").alias("up_hi"),
        F.min("up_lo").alias("up_lo"),
    )
    nodes = cut(nodes, "nodes")
    children = nodes.filter("at > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("n_leaves", F.expr("cast(n_children = 0 as bigint)"))
    nodes = cut(nodes.withColumn("saved_tokens", F.expr("(n_convs - 1) * size")).drop("size"), "nodes")
    values = ["n_leaves", "saved_tokens"]
    totals = _rollup(rows.select("conv_id", F.col("depth").alias("at"), *_KEY), nodes, most, height, values)
    full = _parents(nodes.drop(*values), nodes.count()).join(totals, _KEY).join(_ends(rows), _KEY, "left")
    return full.select(
        "conv_id",
        F.col("at").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        *values,
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(ordered(conversations)), height)
