"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts become flat arrays of code points with the dummy space in front. They are cut wherever no piece of the
vocabulary has the two neighbouring characters inside it, since no merge can ever cross such a place; white space is
the usual one. Equal segments are encoded once for each slice of rows. All segments then go through rounds: the
least pair rank of each segment, one merge at its leftmost place in all segments at once, compaction, until no
pair remains. Merging one place at a time keeps the library's order exactly, also where a merge makes a pair of a
better rank. Segments of over ``LONG`` symbols, where rounds would be quadratic, go through the same merges with
a heap instead.

Segments are told apart by 64-bit hashes of their characters and length. A worker keeps the ids of the first
segments it met. Long texts are encoded in parts that are cut at single spaces.

Defined cases: null and empty texts have no ids. U+2581 in a text is the same symbol as a space and decodes to one.
Characters outside the vocabulary become their UTF-8 bytes' pieces. Decoding gives U+FFFD for each byte that is not
UTF-8, nothing for control pieces and the unknown surface for the unknown piece.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import shipped, sliced
from quoteflow.llm.words import mix, polynomials

MODEL = "piece_bpe_32k.model"
LONG = 400
#: Characters of text whose segments are encoded together, and of a part of a long text.
SLICE = 1 << 20
PART = 1 << 19
_NONE = np.int64(1) << np.int64(62)
_PLACE = np.int64(32)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def model_path(name: str = MODEL) -> str:
    """Where a public tokenizer's file is on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """The tables that encoding and decoding look up, made from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(size)]
        self.size, self.unknown, self.plain = size, sp.unk_id(), plain
        symbol = {x: i for i, x in enumerate(names) if plain[i]}
        whole = dict(symbol)
        for x in list(symbol):
            for c in x:
                symbol.setdefault(c, len(names) + len(symbol) - len(whole))
        self.symbols = symbol
        scores = np.array([sp.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self._characters(symbol, whole)
        self._pairs(symbol, whole)
        byte = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_id = np.array([byte.get(b, self.unknown) for b in range(256)], np.int32)
        surface = [x.replace("▁", " ").encode() if p else b"" for x, p in zip(names, plain, strict=True)]
        surface[self.unknown] = sp.decode([self.unknown]).encode() or b" \xe2\x81\x87 "
        for b, i in byte.items():
            surface[i] = bytes([b])
        self.surface = Strings(surface)
        self.known = Known()

    def _characters(self, symbol: dict, whole: dict) -> None:
        chars = sorted({c for x in symbol for c in x})
        self.char = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.char_symbol = np.full(len(chars) + 1, -1, np.int32)
        for k, c in enumerate(chars, 1):
            self.char[ord(c)] = k
            self.char_symbol[k] = symbol[c]
        self.char[32] = self.char[0x2581]
        self.char_hash = mix(np.arange(len(chars) + 1, dtype=np.uint64) + np.uint64(0x123456789))
        self.char_piece = np.array([-1, *[whole.get(c, -1) for c in chars]], np.int32)
        self.meets = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in whole:
            for a, b in zip(x, x[1:], strict=False):
                self.meets[self.char[ord(a)], self.char[ord(b)]] = True

    def _pairs(self, symbol: dict, whole: dict) -> None:
        found = {}
        for x, made in whole.items():
            for k in range(1, len(x)):
                a, b = symbol.get(x[:k]), symbol.get(x[k:])
                if a is not None and b is not None:
                    found[a << 20 | b] = made
        self.pair = found
        bits = max(4, (8 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.zeros(1 << bits, np.int32)
        for key, slot, made in zip(found, self._slot(np.array(list(found), np.int64)).tolist(), found.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & len(self.keys) - 1
            self.keys[slot], self.made[slot] = key, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) << np.int64(20) | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.made[slot], np.int32(-1))
        rest = np.flatnonzero((there >= 0) & (there != key))
        while len(rest):
            slot[rest] = slot[rest] + 1 & len(self.keys) - 1
            there = self.keys[slot[rest]]
            hit = there == key[rest]
            out[rest[hit]] = self.made[slot[rest[hit]]]
            rest = rest[(there >= 0) & ~hit]
        return out


class Strings:
    """Byte strings by number, to be laid end to end for an array of numbers."""

    def __init__(self, parts: list[bytes]):
        self.lens = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def laid(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all, and where each begins and the last ends."""
        lens = self.lens[numbers]
        at = np.concatenate(([0], np.cumsum(lens)))
        place = np.arange(at[-1]) + np.repeat(self.begin[numbers] - at[:-1], lens)
        return self.data[place], at


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_rounds(v: Vocabulary, symbol: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge segments laid end to end. The symbols left, and how many each segment has."""
    done_symbols, done_segments, done_lens = [], [], []
    segments = np.arange(len(lens))

    def keys(left, right, place):
        made = v.merged(left, right)
        return np.where(made >= 0, v.rank[made] << _PLACE | place, _NONE)

    begin = np.cumsum(lens) - lens
    key = np.full(len(symbol), _NONE, np.int64)
    inner = np.ones(len(symbol), bool)
    inner[begin + lens - 1] = False
    at = np.flatnonzero(inner)
    key[at] = keys(symbol[at], symbol[at + 1], at)
    while len(lens):
        least = np.minimum.reduceat(key, begin)
        over = least == _NONE
        if over.any():
            gone = np.repeat(over, lens)
            done_symbols.append(symbol[gone])
            done_segments.append(segments[over])
            done_lens.append(lens[over])
            stay = ~over
            symbol, lens, segments, least = symbol[~gone], lens[stay], segments[stay], least[stay]
            if not len(lens):
                break
            # the place in a key is the symbol's number: it falls by what went before it
            fall = np.cumsum(gone)[~gone]
            key = key[~gone]
            moved = key != _NONE
            key[moved] -= fall[moved]
            least = least - np.cumsum(gone)[least & np.int64(0xFFFFFFFF)]
            begin = np.cumsum(lens) - lens
        at = least & np.int64(0xFFFFFFFF)
        symbol[at] = v.merged(symbol[at], symbol[at + 1])
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol = symbol[keep]
        lens = lens - 1
        begin = np.cumsum(lens) - lens
        # one symbol went from each segment, so what lies in segment k moves by k, and by one more behind the merge
        key = key[keep]
        moved = np.flatnonzero(key != _NONE)
        number = np.arange(len(key))
        key[moved] = key[moved] >> _PLACE << _PLACE | number[moved]
        at = at - np.arange(len(at))
        key[at] = _NONE
        right = at[at + 1 < begin + lens]
        key[right] = keys(symbol[right], symbol[right + 1], right)
        left = at[at > begin] - 1
        key[left] = keys(symbol[left], symbol[left + 1], left)
    segment = np.concatenate(done_segments) if done_segments else np.zeros(0, np.int64)
    left_lens = np.concatenate(done_lens) if done_lens else np.zeros(0, np.int64)
    symbols = np.concatenate(done_symbols) if done_symbols else symbol
    order = np.argsort(segment, kind="stable")
    return _gathered(symbols, np.cumsum(left_lens) - left_lens, left_lens, order), left_lens[order]


def _gathered(values: np.ndarray, begin: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that are named in ``order``, end to end."""
    each = lens[order]
    at = np.cumsum(each) - each
    return values[np.arange(int(each.sum())) + np.repeat(begin[order] - at, each)]


def _by_heap(v: Vocabulary, symbol: list[int]) -> list[int]:
    n = len(symbol)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list = []

    def offer(i: int) -> None:
        j = after[i]
        made = v.pair.get(symbol[i] << 20 | symbol[j]) if j >= 0 else None
        if made is not None:
            heapq.heappush(heap, (int(v.rank[made]), i, j, symbol[i], symbol[j], made))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, a, b, made = heapq.heappop(heap)
        if symbol[i] != a or after[i] != j or symbol[j] != b:
            continue
        symbol[i], symbol[j] = made, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in symbol if x >= 0]


def _distinct(v: Vocabulary, cid: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of segments without repeats, and how many each has."""
    symbols = v.char_symbol[_gathered(cid, begin, lens, np.arange(len(begin)))]
    long = lens > LONG
    if not long.any():
        return _by_rounds(v, symbols, lens)
    inside = np.repeat(long, lens)
    short_ids, short_lens = _by_rounds(v, symbols[~inside], lens[~long])
    edges = np.cumsum(lens) - lens
    heaped = [_by_heap(v, symbols[edges[k] : edges[k] + lens[k]].tolist()) for k in np.flatnonzero(long)]
    values = np.concatenate([short_ids, *[np.array(x, np.int32) for x in heaped]])
    all_lens = np.concatenate([short_lens, [len(x) for x in heaped]]).astype(np.int64)
    order = np.empty(len(lens), np.int64)
    order[np.flatnonzero(~long)] = np.arange(len(short_lens))
    order[np.flatnonzero(long)] = len(short_lens) + np.arange(len(heaped))
    return _gathered(values, np.cumsum(all_lens) - all_lens, all_lens, order), all_lens[order]


class Known:
    """Ids of segments met before by this worker, by hash; the first ``most`` segments stay."""

    def __init__(self, most: int = 250_000):
        self.most, self.number = most, {}
        self.ids, self.each = np.zeros(1 << 20, np.int32), np.zeros(most, np.int64)
        self.begin, self.used = np.zeros(most, np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        get = self.number.get
        return np.array([get(h, -1) for h in hashes.tolist()], np.int64)

    def add(self, hashes: np.ndarray, ids: np.ndarray, each: np.ndarray) -> None:
        have = len(self.number)
        room = min(self.most - have, len(each))
        size = int(each[:room].sum())
        if room <= 0:
            return
        if self.used + size > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(size, len(self.ids)), np.int32)))
        self.ids[self.used : self.used + size] = ids[:size]
        self.each[have : have + room] = each[:room]
        self.begin[have : have + room] = self.used + np.cumsum(each[:room]) - each[:room]
        self.used += size
        self.number.update(zip(hashes[:room].tolist(), range(have, have + room), strict=True))


def _parts(text: str) -> list[str]:
    """A long text cut in front of single spaces, each part without its own: encoding puts it back."""
    out, begin = [], 0
    while len(text) - begin > PART:
        at = begin + PART // 2
        while 0 <= at < len(text):
            at = text.find(" ", at + 1)
            if 0 <= at < len(text) - 1 and text[at - 1] not in " ▁" and text[at + 1] not in " ▁":
                break
        if not 0 <= at < len(text) - 1:
            break
        out.append(text[begin:at])
        begin = at + 1
    return [*out, text[begin:]]


def encode(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's begin and the last's end."""
    parts, at, ids = [], [0], []
    for t in texts:
        parts += _parts(t) if t else []
        at.append(len(parts))
    edges, held, begin = [np.zeros(1, np.int64)], 0, 0
    for i, t in enumerate(parts):
        held += len(t)
        if held >= SLICE or i + 1 == len(parts):
            got, ends = _encode(v, parts[begin : i + 1])
            ids.append(got)
            edges.append(ends[1:] + edges[-1][-1])
            held, begin = 0, i + 1
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(edges)[at]


def _encode(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(length)
    points = np.frombuffer(" ".join(["", *texts]).encode("utf-32-le"), np.uint32)
    cid = v.char[points]
    joint = np.zeros(len(points), bool)  # whether a place goes on with the segment before it
    joint[1:] = v.meets[cid[:-1], cid[1:]]
    joint[ends - length] = False
    begin = np.flatnonzero(~joint)
    lens = np.diff(np.append(begin, len(points)))
    known = v.char_hash[cid]
    other = cid == 0
    if other.any():
        known[other] = mix(points[other].astype(np.uint64) << np.uint64(20))
    which, hashes = pd.factorize(polynomials(known, begin, begin + lens))
    first = np.empty(len(hashes), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    place = v.known.find(hashes)
    new = np.flatnonzero(place < 0)
    each, at = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    old = place >= 0
    each[old], at[old] = v.known.each[place[old]], v.known.begin[place[old]]
    flat_ids = v.known.ids[: v.known.used]
    if len(new):
        ids, sizes = _distinct(v, cid, begin[first[new]], lens[first[new]])
        ids, sizes = _finished(v, ids, sizes, points[begin[first[new]]])
        each[new], at[new] = sizes, len(flat_ids) + np.cumsum(sizes) - sizes
        flat_ids = np.concatenate((flat_ids, ids))
        v.known.add(hashes[new], ids, sizes)
    out = _gathered(flat_ids, at, each, which)
    upto = np.concatenate(([0], np.cumsum(each[which])))
    return out, upto[np.searchsorted(begin, np.concatenate(([0], ends)))]


def _finished(v: Vocabulary, ids: np.ndarray, each: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no piece, which are single characters, give way to the pieces of their bytes."""
    odd = np.flatnonzero((ids < 0) | (ids >= v.size))
    if not len(odd):
        return ids, each
    back = {i: c for c, i in v.symbols.items() if i >= v.size}
    segment = np.repeat(np.arange(len(each)), each)
    parts, grown, last = [], each.copy(), 0
    for k in odd.tolist():
        char = back[int(ids[k])] if ids[k] >= 0 else chr(int(first[segment[k]]))
        made = v.byte_id[np.frombuffer(char.encode(), np.uint8)]
        parts += [ids[last:k], made]
        grown[segment[k]] += len(made) - 1
        last = k + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32), grown


def decode(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """The texts of runs of ids laid end to end."""
    data, edges = v.surface.laid(ids)
    data, edges = data.tobytes(), edges[at].tolist()
    out = []
    for a, b, i, j in zip(edges[:-1], edges[1:], at[:-1].tolist(), at[1:].tolist(), strict=True):
        text = data[a:b].decode("utf-8", "each_byte")
        if text[:1] == " ":
            while i < j and not v.surface.lens[ids[i]]:
                i += 1
            text = text[1:] if v.plain[ids[i]] else text  # the dummy space, not one that came as a byte
        out.append(text)
    return out


def _encoder(model: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path(model))
        for batch in sliced(batches, "text", 2 * SLICE):
            ids, at = encode(v, batch.column("text").to_pylist())
            columns = [batch.column("id"), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids, pa.int32()))]
            if decoded:
                columns.append(pa.array(decode(v, ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def piece_ids(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """doc_id and the ids of each text, with ``decoded`` also the text that they give back."""
    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    more = ", decoded string" if decoded else ""
    return rows.mapInArrow(_encoder(model, decoded), f"doc_id long, ids array<int>{more}")


def _decoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path(model))
        for batch in batches:
            lists = batch.column("ids")
            if lists.null_count:
                lists = lists.fill_null([])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            texts = pa.array(decode(v, ids, at), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return run


def piece_texts(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of each row's ids."""
    rows = shipped(ids).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(model), "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """Of rows with ids and decoded text, the count and digests of both."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
