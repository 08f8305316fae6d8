"""Set-similarity join of documents on word n-grams: rare-first prefix filtering.

Every document is its set of n-gram hashes. Jaccard similarity of at least ``num / den`` forces two sets to share
one of the few rarest n-grams of each, its prefix. The steps:

1. Sets: size, a 128-bit key and counts by cell of the hash range. Equal sets become one, its representative.
2. Document frequencies: n-grams are dealt by hash in packed blocks, counted exactly, and those of two documents or
   more go back to their documents, in rare-first order. An n-gram of one document can't be shared: it takes
   its place in the prefix but is never moved again.
3. Candidates: documents that share a prefix n-gram, under length, positional and suffix filters. For components,
   each n-gram's documents are first held against one of them only; what that leaves in one component needs no
   further pair, so a group of thousands of near copies costs one pair for each, not one for each two. All pairs
   that are still in different components are then joined on their prefix n-grams, with no cap.
4. Each distinct candidate pair is verified once by exact overlap.

Blocks hold about ``BLOCK`` n-grams, so their number follows the input and their size does not.

Defined cases: null or blank text, or no words: the empty set, which links with nothing. Fewer words than n: the
whole sequence is the one n-gram. Ids that repeat: one row comes back for an id, judged by its least text. Rows
with a null id come back with a null component. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import cut, give_back, pieces, shipped, sliced
from quoteflow.llm.components import components
from quoteflow.llm.words import mix, shingles, words

#: N-grams in a block that one group function holds.
BLOCK = 1_000_000
#: N-grams that a map task gathers before it deals them out.
GATHER = 750_000
_CELLS = 8
_SETS = "id long, n int, k1 long, k2 long, " + ", ".join(f"c{i} int" for i in range(_CELLS))
_PACKED = "bucket int, ids binary, sizes binary, at binary, low binary, mid binary"
_SHARED = "g int, ids binary, sizes binary, lens binary, tokens binary, rank binary"
_RECORD = "id long, n int, prefix int, tokens binary"


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = np.zeros((batch.num_rows, 3 + _CELLS), np.int64)
            for i, s in enumerate(shingles(*words(batch.column("text")), n)):
                s = np.unique(s)
                rows[i, 0] = len(s)
                if len(s):
                    rows[i, 1] = np.add.reduce(s).view(np.int64)
                    rows[i, 2] = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))).view(np.int64)
                    rows[i, 3:] = np.bincount((s >> np.uint64(61)).astype(np.int64), minlength=_CELLS)
            columns = [batch.column("id"), pa.array(rows[:, 0].astype(np.int32))]
            columns += [pa.array(rows[:, 1]), pa.array(rows[:, 2])]
            columns += [pa.array(rows[:, 3 + i].astype(np.int32)) for i in range(_CELLS)]
            names = ["id", "n", "k1", "k2", *[f"c{i}" for i in range(_CELLS)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _deal(n: int, buckets: int):
    """Pack n-grams by bucket: 48 bits of each and its document's place among the ids sent along."""

    def packed(ids: list, sets: list) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int32)
        at = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        hashes = np.concatenate(sets)
        bucket = (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(order) else None
        if bounds is None:
            present, first = np.unique(bucket[order], return_index=True)
            bounds = np.append(first, len(order))
        else:
            present = np.flatnonzero(np.diff(bounds))
            bounds = np.append(bounds[present], len(order))
        hashes, at = hashes[order], at[order]
        low, mid = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)
        known, sizes_of = np.array(ids, np.int64), sizes
        out: list[list] = [[], [], [], [], [], []]
        for b, i, j in zip(present.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            used, place = np.unique(at[i:j], return_inverse=True)
            row = (known[used], sizes_of[used], place.astype(np.uint16), low[i:j], mid[i:j])
            out[0].append(b)
            for k, x in enumerate(row):
                out[k + 1].append(x.tobytes())
        columns = [pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "sizes", "at", "low", "mid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in sliced(batches, "text"):
            for key, s in zip(
                batch.column("id").to_pylist(), shingles(*words(batch.column("text")), n), strict=True
            ):
                if len(s) and key is not None:
                    ids.append(key)
                    sets.append(np.unique(s))
                    held += len(sets[-1])
                if held >= GATHER or len(ids) >= 65000:
                    yield packed(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield packed(ids, sets)

    return run


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    """Ids in any steps spread evenly over the groups."""
    return (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _grouped(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = _group(batch.column("id").to_numpy(), groups).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column("id")], ["g", "id"])

    return run


def _count(groups: int):
    """Of one bucket, the n-grams of two documents or more, with a class of their frequency, by document."""

    def run(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table.column("bucket")[0].as_py() & 0xFFFF)
        counts = [len(x) // 4 for x in table.column("low").to_pylist()]
        docs = [len(x) // 8 for x in table.column("ids").to_pylist()]
        ids, sizes = _join(table.column("ids"), np.int64), _join(table.column("sizes"), np.int32)
        at = _join(table.column("at"), np.uint16).astype(np.int64)
        at += np.repeat(np.cumsum([0, *docs[:-1]]), counts)
        token = _join(table.column("mid"), np.uint16).astype(np.uint64) << np.uint64(32)
        token |= _join(table.column("low"), np.uint32)
        order = np.argsort(token)
        token, at = token[order], at[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        run_length = np.diff(np.append(first, len(token)))
        each = np.repeat(run_length, run_length)
        kept = each >= 2
        token, at = token[kept] | (bucket << np.uint64(48)), at[kept]
        rank = np.minimum(255, 8 * np.log2(each[kept])).astype(np.uint8)
        group = _group(ids, groups)[at]
        order = np.lexsort((ids[at], group))
        token, at, rank, group = token[order], at[order], rank[order], group[order]
        bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        out: list[list] = [[] for _ in range(6)]
        for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(group)], strict=False):
            known, where, lens = np.unique(ids[at[i:j]], return_index=True, return_counts=True)
            row = (known, sizes[at[i:j]][where], lens.astype(np.int32), token[i:j], rank[i:j])
            out[0].append(int(group[i]))
            for k, x in enumerate(row):
                out[k + 1].append(x.tobytes())
        del ids, sizes, at, token, order, rank, group, each, kept
        give_back()
        return pa.table(
            [pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:]]],
            names=["g", "ids", "sizes", "lens", "tokens", "rank"],
        )

    return run


def _records(num: int, den: int):
    """Each document's shared n-grams, rarest first, and how many of them are in its prefix."""

    def run(table: pa.Table, copies: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if table.num_rows:
            lens = _join(table.column("lens"), np.int32)
            ids = np.repeat(_join(table.column("ids"), np.int64), lens)
            sizes = np.repeat(_join(table.column("sizes"), np.int32), lens)
            token, rank = _join(table.column("tokens"), np.uint64), _join(table.column("rank"), np.uint8)
            order = np.lexsort((token, rank, ids))
            ids, sizes, token = ids[order], sizes[order], token[order]
            bounds = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            gone = set(copies.column("id").to_pylist())
            for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(ids)], strict=True):
                n = int(sizes[i])
                prefix = n + 1 + (-num * n) // den - (n - (j - i))  # less those that no other document has
                if prefix > 0 and int(ids[i]) not in gone:
                    for x, value in zip(out, (int(ids[i]), n, prefix, token[i:j].tobytes()), strict=True):
                        x.append(value)
            del lens, ids, sizes, token, rank, order
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        made = pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["id", "n", "prefix", "tokens"])
        del out
        give_back()
        return made

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, most = (batch.column(c).to_numpy() for c in ("n", "prefix"))
        blobs = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
        kept = [x[:p] for x, p in zip(blobs, most.tolist(), strict=True)]
        lens = np.array([len(x) for x in kept])
        place = np.concatenate([np.arange(k) for k in lens]) + np.repeat(sizes - [len(x) for x in blobs], lens)
        columns = [np.repeat(batch.column("id").to_numpy(), lens), np.repeat(sizes, lens)]
        columns += [np.concatenate(kept), place.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "n", "token", "pos"])


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            hit = []
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                if u[i] != last:
                    last, left = u[i], np.frombuffer(a.as_buffer(), np.uint64)
                right = np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((left, right))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                hit.append(den * shared >= num * (n[i] + m[i] - shared))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("u", "v")], ["u", "v"])
        give_back()

    return run


def _verified(pairs: DataFrame, records: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold, from (u, v) without repeats."""
    left = records.select(F.col("id").alias("u"), "n", F.col("tokens").alias("a"))
    right = records.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("tokens").alias("b"))
    joined = pairs.join(left, "u").join(right, "v")
    return cut(joined.mapInArrow(_verify(num, den), "u long, v long"), "links")


def _lengths(n: str, m: str, num: int, den: int) -> str:
    return f"{den} * least({n}, {m}) >= {num} * greatest({n}, {m})"


def _suffix(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Drop pairs whose sets differ too much in how they spread over cells of the hash range."""
    cells = [f"c{i}" for i in range(_CELLS)]
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("an"), *[F.col(c).alias(f"a{c}") for c in cells])
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("bn"), *[F.col(c).alias(f"b{c}") for c in cells])
    apart = " + ".join(f"abs(a{c} - b{c})" for c in cells)
    needed = f"ceil({num}D * (an + bn) / {num + den})"
    return pairs.join(a, "u").join(b, "v").filter(f"{apart} <= an + bn - 2 * {needed}").select("u", "v")


def _tidy(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return shipped(docs).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )


class NgramJoin:
    """The join of one table with itself; ``links`` and ``classes`` are its results."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_column="doc_id", text_column="text"):
        self.n, self.num, self.den = n, num, den
        self.docs = _tidy(docs, id_column, text_column)
        self.sets = cut(self.docs.mapInArrow(_sets(n), _SETS), "sets")
        facts = self.sets.agg(
            F.count("id").alias("rows"), F.countDistinct("id").alias("ids"), F.sum("n").alias("grams")
        ).first()
        self.repeated = facts["rows"] > facts["ids"]
        if self.repeated:
            known = self.docs.filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
            self.docs = known.unionByName(self.docs.filter("id is null"))
            self.sets = cut(self.docs.mapInArrow(_sets(n), _SETS), "sets")
        self.grams = facts["grams"] or 0
        self.equal = cut(
            self.sets.filter("n > 0 and id is not null")
            .groupBy("n", "k1", "k2")
            .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
            .filter("copies > 1"),
            "equal",
        )
        self.copies = self.sets.join(self.equal, ["n", "k1", "k2"]).select("id", "rep", F.col("copies"))
        self.records = self._records()

    def _records(self) -> DataFrame:
        blocks = pieces(self.grams, BLOCK)
        packed = self.docs.mapInArrow(_deal(self.n, blocks), _PACKED)
        shared = packed.groupBy("bucket").applyInArrow(_count(blocks), _SHARED)
        others = self.copies.filter("id <> rep").select("id").mapInArrow(_grouped(blocks), "g int, id long")
        made = shared.groupBy("g").cogroup(others.groupBy("g")).applyInArrow(_records(self.num, self.den), _RECORD)
        return cut(made, "records")

    def _prefix(self) -> DataFrame:
        return self.records.mapInArrow(_prefixes, "id long, n int, token long, pos int")

    def _pairs(self, prefix: DataFrame, apart: str = "true") -> DataFrame:
        """All candidate pairs of documents, each once; ``prefix`` has the component c of each."""
        a = prefix.select("token", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "pos", "c")])
        b = prefix.select("token", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "pos", "c")])
        rest = "1 + least(a_n - a_pos, b_n - b_pos) - 1"
        needed = f"ceil({self.num}D * (a_n + b_n) / {self.num + self.den})"
        joined = a.join(b, "token").filter(
            f"a_id < b_id and {_lengths('a_n', 'b_n', self.num, self.den)} and {rest} >= {needed} and {apart}"
        )
        return joined.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()

    def links(self) -> DataFrame:
        """All pairs u < v of representatives of different sets that reach the threshold."""
        prefix = self._prefix().withColumn("c", F.col("id"))
        pairs = _suffix(self._pairs(prefix), self.sets, self.num, self.den)
        return _verified(pairs, self.records, self.num, self.den)

    def _component_links(self) -> DataFrame:
        """Links that give the same components as all links.

        Rounds of one partner for each n-gram go on while they at least halve the pairs left to compare.
        """
        prefix = cut(self._prefix(), "prefix")
        found, seen, member, before = None, None, None, None
        for turn in count():
            known = prefix.withColumn("c", F.col("id"))
            if member is not None:
                known = prefix.join(member, "id", "left").withColumn("c", F.coalesce("c", "id"))
            hub = "max" if turn % 2 else "min"
            open_ = cut(
                known.groupBy("token")
                .agg(F.expr(f"{hub}(struct(id, n, c))").alias("h"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"))
                .filter("lo <> hi"),
                "open",
            )
            left = open_.agg(F.sum("m"), F.sum(F.expr("cast(m as double) * m"))).first()
            if not left[0]:
                break
            few = left[1] <= 4 * left[0] or (before is not None and left[1] > before / 2)
            before = left[1]
            if few:
                pairs = self._pairs(known.join(open_.select("token"), "token", "left_semi"), "a_c <> b_c")
            else:
                pairs = (
                    known.join(open_.select("token", "h"), "token")
                    .filter("c <> h.c and " + _lengths("n", "h.n", self.num, self.den))
                    .select(F.least("id", "h.id").alias("u"), F.greatest("id", "h.id").alias("v"))
                    .distinct()
                )
            if seen is not None:
                pairs = pairs.join(seen, ["u", "v"], "left_anti")
            pairs = cut(_suffix(pairs, self.sets, self.num, self.den), "pairs")
            links = _verified(pairs, self.records, self.num, self.den)
            seen = pairs if seen is None else seen.unionByName(pairs)
            found = links if found is None else found.unionByName(links)
            if few:
                break
            member = components(found).select(F.col("node").alias("id"), F.col("component").alias("c"))
        return found

    def classes(self) -> DataFrame:
        """doc_id, n_shingles and component_id, the least id that links reach, of every document."""
        links = self._component_links()
        member = components(links if links is not None else self.copies.select(F.col("id").alias("u"), F.col("rep").alias("v")))
        reps = self.copies.select("id", "rep")
        joined = self.sets.select("id", "n").join(reps, "id", "left").withColumn("node", F.coalesce("rep", "id"))
        return joined.join(member, "node", "left").select(
            F.col("id").alias("doc_id"),
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("component", "node").alias("component_id"),
        )


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    return NgramJoin(docs, n, num, den).classes()


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    return NgramJoin(docs, n, num, den).links()


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each class, that of the least id; of rows with one id, that of the least text.

    Rows of a null id stay. Columns stay as they are.
    """
    joined = NgramJoin(docs, n, num, den)
    gone = cut(joined.classes().filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")), "gone")
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if joined.repeated:
        first = F.struct(F.col("text").cast("string"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        lone = kept.filter("doc_id is null")
        kept = kept.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(first).alias("x"))
        kept = kept.select("x.row.*").unionByName(lone)
    return kept
