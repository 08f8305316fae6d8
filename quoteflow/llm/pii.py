"""Personal data: patterns for e-mail, IP, card and phone, extended by a skip-chain conditional random field.

The patterns give the base spans. Units of the field are the base spans, whose labels are observed, and what else in
a text could be a mention: numbers of ``DIGITS`` digits or more, addresses without a full domain, and words that
are the name part of an address in the same text. A unit's own potential comes from its form and the word before
it; neighbours in the text share a chain potential; units that repeat each other, by their last digits or by name,
share a skip potential that favours one label, however far apart and however many they are. Free units are tied to
every base span that they repeat; where there is none, all repeats are tied to one label that they share. So a text
with many repeats has about as many ties and not one for each two, and support reaches each repeat directly. Loopy
message passing, run until it settles, gives every unit's probabilities; a free unit becomes a span where one label
has ``SURE`` or more.

All potentials are trained on the table itself: the base spans are labelled units, also with their ``+`` taken away,
and free units count as weaker examples of no label, unless they repeat a base span of their text. Their forms are
counted over all texts, by form, of which there is a bounded number; the fit is on those counts.

Defined cases: a null text counts as empty and has no spans. Spans of different kinds may overlap. A text without
free units has the base spans only. Repeated rows come back as often as they came. Other columns are ignored by
``find`` and kept by ``redact``, which sets ``n_chars``, where there is such a column, to the new length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import shipped, sliced

KINDS = ("email", "ip", "card", "phone")
DIGITS = 7
SURE = 0.8
_NONE = 4  # the label of a unit that is nothing personal
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a number begins where no digit is before it; that is where the leftmost match begins, and is tried once a number
_ips = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}").finditer
_cards = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phones = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_numbers = re.compile(r"\+?(?<![0-9])[0-9](?:[ ().-]{0,2}[0-9])*").finditer
_digits = re.compile("[0-9]+").finditer
_names = re.compile(r"[A-Za-z0-9._%+-]+").finditer
_digit = re.compile("[0-9]").search
_marked = re.compile("[0-9@]").search  # without one of them a text has no spans and no units

#: Messages settle within some dozens of rounds; after each ``_ROUNDS`` that were not enough, steps are halved.
_ROUNDS, _HALVINGS, _SETTLED = 100, 10, 1e-4

#: How many values each feature of a unit has: digits, separators, plus, checksum, dots, name, word before.
_SIZES = (8, 16, 2, 2, 5, 3, 32)
_STARTS = np.cumsum((0, *_SIZES))
_WHERE = np.cumprod((1, *_SIZES[:-1]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kind) of what the patterns find, by kind and place."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            part = text[done:at]
            size = len(part) - len(part.rstrip(_NAME))
            found = _domain(text, at + 1) if size else None
            if found:
                out.append((at - size, found.end(), 0))
            done = found.end() if found else at + 1
            at = text.find("@", done)
    if not _digit(text):
        return out
    if "." in text:
        for m in _ips(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
    for m in _cards(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _phones(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


def _told_apart(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Numbers of enough digits. In a run of several, those that end like an observed number stand alone, and so do
    others that a full stop with a space after it sets apart."""
    known: dict[str, set[str]] = {}
    for b, e, k in base:
        number = "".join(x.group() for x in _digits(text, b, e)) if k else ""
        if len(number) >= DIGITS:
            known.setdefault(number[-DIGITS:], set()).add(number.replace("0", ""))
    out = []
    for m in _numbers(text):
        if m.end() - m.start() < DIGITS:
            continue
        parts = [x.span() for x in _digits(text, *m.span())]
        n = [0, *accumulate(e - b for b, e in parts)]  # digits before each part
        ranges, lo = [], 0
        for hi in range(1, len(parts) + 1 if known else 0):
            at = _repeated(text, parts, lo, hi, known)
            if at is not None:
                ranges += [*_sentences(text, parts, n, lo, at), (at, hi)]
                lo = hi
        ranges += _sentences(text, parts, n, lo, len(parts))
        out += [(parts[i][0] if i else m.start(), parts[j - 1][1]) for i, j in ranges if n[j] - n[i] >= DIGITS]
    return out


def _repeated(text: str, parts: list[tuple[int, int]], lo: int, hi: int, known: dict[str, set[str]]) -> int | None:
    """Where the parts begin, after lo, that end at hi and like an observed number; zeros before it may differ."""
    digits, found = "", None
    for i in range(hi - 1, lo - 1, -1):
        digits = text[slice(*parts[i])] + digits
        if found is None:
            if len(digits) < DIGITS:
                continue
            if digits[-DIGITS:] not in known:
                break
        elif not any(x.endswith(digits.replace("0", "")) for x in known[digits[-DIGITS:]]):
            break
        found = i
    return found


def _sentences(text: str, parts: list[tuple[int, int]], n: list[int], lo: int, hi: int) -> list[tuple[int, int]]:
    """Ranges of parts between full stops followed by a space; what has too few digits stays with its like."""
    stops = [i for i in range(lo + 1, hi) if text[parts[i - 1][1] : parts[i][0]] == ". "]
    out, short = [], lo
    for i, j in pairwise([lo, *stops, hi]):
        if n[j] - n[i] >= DIGITS:
            out += [(short, i), (i, j)]
            short = j
    return [*out, (short, hi)]


def _free(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Possible mentions that touch no base span, in order."""
    taken = sorted((b, e) for b, e, _ in base)
    out = []
    if _digit(text):
        out += _told_apart(text, base)
    names = {text[b:e].split("@")[0].lower() for b, e, k in base if k == 0}
    names = {x for x in names if len(x) >= 4 and not x.isdigit()}
    if names or "@" in text:
        for m in _names(text):
            if m.group().lower().rstrip(".-") in names:
                out.append((m.start(), m.start() + len(m.group().rstrip(".-"))))
            elif text[m.end() : m.end() + 1] == "@" and (rest := _names(text, m.end() + 1)):
                host = next(rest, None)
                if host and host.start() == m.end() + 1:
                    out.append((m.start(), host.end()))
    kept, i, last = [], 0, 0
    for b, e in sorted(set(out)):
        while i < len(taken) and taken[i][1] <= b:
            i += 1
        if b >= last and not (i < len(taken) and taken[i][0] < e):
            kept.append((b, e))
            last = e
    return kept


def _form(text: str, b: int, e: int) -> tuple[int, ...]:
    unit = text[b:e]
    digits = [c for c in unit if "0" <= c <= "9"]
    n = len(digits)
    size = 0 if not n else 1 + int(np.searchsorted((5, 7, 10, 12, 14, 20), n, side="right"))
    marks = (("." in unit) + 2 * ("-" in unit) + 4 * (" " in unit) + 8 * ("(" in unit)) if "@" not in unit else 0
    sound = 14 <= n <= 19 and luhn("".join(digits))
    if unit.count(".") == 3 and n == len(unit) - 3:
        sound = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in unit.split("."))
    name = 2 if "@" in unit else int(any(c.isalpha() for c in unit))
    before = text[max(0, b - 24) : b].split()
    word = sum(ord(c) * 31**k for k, c in enumerate(before[-1].lower().strip(".,:;()")[:8])) % 32 if before else 0
    return size, marks, int(unit[0] == "+"), int(sound), min(4, unit.count(".")) if not name else 0, name, word


def _key(text: str, b: int, e: int) -> str:
    """What units that repeat each other have in common."""
    unit = text[b:e]
    if any(c.isalpha() for c in unit):
        return unit.split("@")[0].lower()
    digits = "".join(c for c in unit if "0" <= c <= "9")
    return digits[-DIGITS:]


def _groups(keys: list[str]) -> list[list[int]]:
    """The units of each key that has two or more."""
    same: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        same.setdefault(k, []).append(i)
    return [x for x in same.values() if len(x) > 1]


def _units(text: str, base: list) -> tuple[list, list[int]]:
    """All units in order, and their observed labels; a free unit has -1."""
    rows = sorted([(b, e, k) for b, e, k in base] + [(b, e, -1) for b, e in _free(text, base)])
    return [(b, e) for b, e, _ in rows], [k for *_, k in rows]


def _code(form: tuple[int, ...]) -> int:
    return int(np.dot(form, _WHERE))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the fit needs, counted: 0 forms by label, 1 neighbours' labels, 2 repeats that agree or not."""
    seen: Counter = Counter()
    for batch in sliced(batches, "text"):
        for text in batch.column("text").to_pylist():
            if not text or not _marked(text):
                continue
            base = base_spans(text)
            units, labels = _units(text, base)
            repeats = set()  # free units that are no examples of no label
            for group in _groups([_key(text, b, e) for b, e in units]):
                known = [labels[i] for i in group if labels[i] >= 0]
                seen.update((2, int(x == y), 0) for x, y in zip(known, known[1:], strict=False))
                if known:
                    repeats.update(i for i in group if labels[i] < 0)
            for i, ((b, e), k) in enumerate(zip(units, labels, strict=True)):
                if i not in repeats:
                    seen[0, _code(_form(text, b, e)), k] += 1
            filled = [None if i in repeats else k if k >= 0 else _NONE for i, k in enumerate(labels)]
            seen.update((1, x * 8 + y, 0) for x, y in zip(filled, filled[1:], strict=False) if x is not None and y is not None)
    if seen:
        kind, code, label = (np.array(x) for x in zip(*seen, strict=True))
        columns = [kind.astype(np.int32), code.astype(np.int64), label.astype(np.int32), np.array(list(seen.values()))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "code", "label", "n"])


class Field:
    """Potentials: of forms (a row for each feature's value), of neighbours, of repeats."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.chain = np.zeros((5, 5))
        pairs, agree = np.ones((5, 5)), [1.0, 20.0]
        x, y, n = [], [], []
        for kind, code, label, count in rows:
            if kind == 1:
                pairs[code // 8, code % 8] += count
            elif kind == 2:
                agree[code] += count
            elif label < 0:
                x, y, n = [*x, code], [*y, _NONE], [*n, 0.25 * count]
            else:
                bare = code - _WHERE[2] * (code // _WHERE[2] % 2)
                x, y, n = [*x, code, bare], [*y, label, label], [*n, 0.5 * count, 0.5 * count]
        expected = pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum()
        self.chain = np.clip(np.log(pairs / expected), -1, 1)
        self.skip = float(np.clip(np.log(agree[1] / agree[0]), 0, 4)) * np.eye(5)
        self.form = self._fit(np.array(x, np.int64), np.array(y, np.int64), np.array(n))

    @staticmethod
    def _columns(codes: np.ndarray) -> np.ndarray:
        return codes[:, None] // _WHERE % np.array(_SIZES) + _STARTS[:-1]

    def _fit(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.zeros((_STARTS[-1], 5))
        w[:, _NONE] = 0.3  # with nothing learned, nothing is personal
        if not len(x):
            return w
        at, want, total = self._columns(x), np.eye(5)[y], n.sum()
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 201):
            score = w[at].sum(1)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - want) * (n / total)[:, None]
            slope = np.zeros_like(w)
            for f in range(at.shape[1]):
                np.add.at(slope, at[:, f], error)
            slope += 1e-4 * w
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w -= 0.1 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        return w

    def marginals(self, codes: list[int], labels: list[int], groups: list[list[int]]) -> np.ndarray:
        """Each unit's probabilities, by loopy sum-product messages over chain edges and groups of repeats."""
        own = self.form[self._columns(np.array(codes, np.int64))].sum(1)
        own -= own.max(1, keepdims=True)
        for i, k in enumerate(labels):
            if k >= 0:
                own[i] = -50.0
                own[i, k] = 0.0
        m = n = len(codes)
        spokes = []
        for group in groups:
            known = [labels[i] for i in group if labels[i] >= 0]
            free = [i for i in group if labels[i] < 0]
            if known:
                own[free] += self.skip[known].sum(0)
            else:
                spokes += [(n, i) for i in free]
                n += 1
        own = np.concatenate((own, np.zeros((n - m, 5))))
        chain = [(i, i + 1) for i in range(m - 1)]
        edges = np.array([*chain, *spokes], np.int64).reshape(-1, 2)
        if not len(edges):
            return _normal(own)
        # two units that share a label are tied by it just as by a skip potential between them
        e = np.exp(self.skip[0, 0])
        spoke = np.log(e + np.sqrt(e * e + 3 * e - 4)) * np.eye(5)
        shared = np.array([self.chain] * len(chain) + [spoke] * len(spokes))
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        shared = np.concatenate((shared, shared.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        sent, step = np.zeros((len(source), 5)), 0.5
        for t in range(1, _ROUNDS * _HALVINGS + 1):
            belief = own.copy()
            np.add.at(belief, target, sent)
            out = (belief[source] - sent[back])[:, :, None] + shared
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - sent).max()
            sent = (1 - step) * sent + step * new
            if moved < _SETTLED:
                break
            if t % _ROUNDS == 0:
                step /= 2
        belief = own.copy()
        np.add.at(belief, target, sent)
        return _normal(belief[:m])


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(field: Field, text: str | None) -> list[tuple[int, int, int, bool]]:
    """(begin, end, kind, from a pattern) by begin, then kind."""
    if not text or not _marked(text):
        return []
    base = base_spans(text)
    out = [(b, e, k, True) for b, e, k in base]
    units, labels = _units(text, base)
    if min(labels, default=0) < 0:
        codes = [_code(_form(text, b, e)) for b, e in units]
        p = field.marginals(codes, labels, _groups([_key(text, b, e) for b, e in units]))
        for (b, e), k, q in zip(units, labels, p, strict=True):
            best = int(q.argmax())
            if k < 0 and best != _NONE and q[best] >= SURE:
                out.append((b, e, best, False))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def learn(docs: DataFrame) -> Field:
    texts = shipped(docs).select(F.col("text").cast("string").alias("text"))
    seen = texts.mapInArrow(_count, "kind int, code long, label int, n long")
    seen = seen.groupBy("kind", "code", "label").agg(F.sum("n").alias("n"))
    return Field(sorted(tuple(r) for r in seen.collect()))  # as many rows as there are forms, a bounded number


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_SPANS_DDL = "array<struct<kind:string,begin:bigint,end:bigint,base:boolean>>"


def _find(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = field.value
        for batch in sliced(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                found.append([{"kind": KINDS[k], "begin": b, "end": e, "base": x} for b, e, k, x in all_spans(known, text)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return run


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and the spans of every row, by begin, then kind; begins and ends are in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if field is None else field)
    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(shared), f"doc_id long, spans {_SPANS_DDL}")


def hidden(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with a mark of its kind for each span; of spans that overlap, one mark for all."""
    out, end = [], 0
    for b, e, k, _ in spans:
        if b >= end:
            out += [text[end:b], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows with all spans of their texts replaced by marks."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    n_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in sliced(batches, "text"):
            texts = [None if t is None else hidden(t, all_spans(known, t)) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, columns["text"].type)
            if n_chars:
                sizes = [len(t) if t is not None else None for t in texts]
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return shipped(docs).mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and a digest of the base spans, and all spans as text."""
    line = "array_join(transform({}, x -> concat_ws(':', x.kind, cast(x.begin as string), cast(x.end as string))), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(F.expr(line.format("filter(spans, x -> x.base)")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(line.format("spans")).alias("spans"))
