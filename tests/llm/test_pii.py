import hashlib
import random
import re

from brute import documents

from quoteflow.llm import pii
from quoteflow.llm.pii import KINDS, Field, all_spans, base_spans, digests, find, luhn, redact


def plain(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return out


def test_patterns_against_the_expressions_themselves():
    rng = random.Random(5)
    stock = ["1", "2", "25", "255", "4111111111111111", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "x@y.z", "+1 234 567 8901", "10.0.0.1", "%", "_", "\n", "٣"]
    for _ in range(20000):
        t = "".join(rng.choices(stock, k=rng.randint(1, 30)))
        assert base_spans(t) == plain(t), t


def test_long_runs_take_no_more_than_linear_time():
    for t in ("a" * 400000, "1" * 400000, "1." * 200000, "a@" * 200000, "+1" + " " * 400000, "1 " * 200000):
        base_spans(t)


def trained(spark):
    lines = [f"call +1 ({200 + i}) 555-{1000 + i} or mail first.name{i}@mail.example.com now" for i in range(60)]
    lines += [f"order {1234567 + i * 991} of 2024, part {i}" for i in range(60)]
    return pii.learn(documents(spark, list(enumerate(lines))))


def test_repeats_share_a_label(spark):
    field = trained(spark)
    text = "ring +1 (867) 555-2364 soon. Again: 867 555 2364, or 1234567 as the part. jane.doe@site.example.com; Jane.Doe said"
    got = [(KINDS[k], text[b:e], base) for b, e, k, base in all_spans(field, text)]
    assert got == [
        ("phone", "+1 (867) 555-2364", True),
        ("phone", "867 555 2364", False),
        ("email", "jane.doe@site.example.com", True),
        ("email", "Jane.Doe", False),
    ]
    assert all(x[3] for x in all_spans(field, "order 1234567 of 7654321, +1 (867) 555-2364"))


def test_marginals_are_exact_on_a_chain(spark):
    import itertools

    import numpy as np

    field = trained(spark)
    codes, labels = [3, 40, 977, 12], [-1, 3, -1, -1]
    own = field.form[field._columns(np.array(codes))].sum(1)
    want = np.zeros((4, 5))
    for ys in itertools.product(range(5), repeat=4):
        if ys[1] == 3:
            score = sum(own[i, y] for i, y in enumerate(ys) if i != 1) + sum(field.chain[a, b] for a, b in zip(ys, ys[1:], strict=False))
            for i, y in enumerate(ys):
                want[i, y] += np.exp(score)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(field.marginals(codes, labels, []), want, atol=1e-3)


def weak():
    """A field whose forms favour no label by 0.5, without chain potentials."""
    import numpy as np

    field = Field([])
    field.form[:, 4] = 0.5 / 7
    field.skip = 4.0 * np.eye(5)
    return field


def test_every_repeat_of_an_observed_span_is_reached():
    field = weak()
    for n in (5, 50, 500):
        for seen, again in (("+1 (867) 555-2364", "867 555 2364"), ("jane.doe@site.example.com", "Jane.Doe")):
            for text in (f"{seen} is it" + f", then {again} again" * n, f"{again}, then " * n + f"{seen} at last"):
                got = [text[b:e] for b, e, _, base in all_spans(field, text) if not base]
                assert got == [again] * n, (n, again, len(got))
        assert all_spans(field, "then 867 555 2364 again, " * n) == []


def test_marginals_of_repeats_that_nothing_is_known_of():
    import itertools

    import numpy as np

    field = weak()
    field.form[:, 3] += np.linspace(-0.5, 0.7, len(field.form))
    codes = [3, 40, 977]
    own = field.form[field._columns(np.array(codes))].sum(1)
    want = np.zeros((2, 5))
    for y, z in itertools.product(range(5), repeat=2):
        want[[0, 1], [y, z]] += np.exp(own[0, y] + own[1, z] + field.skip[y, z])
    want /= want.sum(1, keepdims=True)
    assert np.allclose(field.marginals(codes, [-1] * 3, [[0, 1]])[:2], want, atol=1e-3)
    # what is known of a repeat counts once for each repeat of it, and the order does not matter
    known = np.exp(own[2] + 2 * field.skip[3])
    got = field.marginals([codes[i] for i in (0, 2, 1)], [3, -1, 3], [[0, 1, 2]])
    assert np.allclose(got[1], known / known.sum(), atol=1e-3)


def test_repeats_of_observed_spans_are_no_examples_of_no_label():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": ["+1 (867) 555-2364 or 867 555 2364, not 1234567"]})
    got = [r for b in pii._count(iter([rows])) for r in b.to_pylist()]
    assert sorted((r["label"], r["n"]) for r in got if r["kind"] == 0) == [(-1, 1), (3, 1)]
    assert [r for r in got if r["kind"] == 1] == []


def test_addresses_without_a_domain_in_texts_without_digits(spark):
    field = trained(spark)
    for text in ("mail jane.doe@intranet please", "mail jane.doe@intranet please 5"):
        assert [(KINDS[k], text[b:e], base) for b, e, k, base in all_spans(field, text)] == [("email", "jane.doe@intranet", False)]
    docs = documents(spark, [(i, "mail first.name@mail.example.com now") for i in range(60)] + [(60, "mail jane.doe@intranet please")])
    assert {r.doc_id: r.text for r in redact(docs).collect()}[60] == "mail [EMAIL] please"
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": ["write to jane.doe@intranet please", "nothing here", None]})
    assert [(r["label"], r["n"]) for b in pii._count(iter([rows])) for r in b.to_pylist()] == [(-1, 1)]


def test_numbers_beside_a_repeat_stay_apart():
    seen = "+1 (867) 555-2364 is it, "
    for again, after in (
        ("867 555 2364", ". 12 people"), ("867 555 2364", " 12 people"), ("867. 555. 2364", ". 12"), ("867 555 2364", "-7654321"),
        ("001 867 555 2364", " 12"), ("5552364", ".1"),
    ):
        text = f"{seen}call {again}{after}"
        assert [text[b:e] for b, e, _, base in all_spans(weak(), text) if not base] == [again], text
        text = f"{seen}for 12 {again} or so"
        assert [text[b:e] for b, e, _, base in all_spans(weak(), text) if not base] == [again], text
    units = {
        "867 555 2364. 12": ["867 555 2364"], "1234567. 7654321.5": ["1234567", "7654321.5"], "867. 555. 2364": ["867. 555. 2364"],
        "867. 555. 2364. 1234567. 12": ["867. 555. 2364", "1234567"], "+12 345 678. 12": ["+12 345 678"], "123. 456": [],
    }
    for text, want in units.items():
        assert [text[b:e] for b, e in pii._free(text, [])] == want, text
    assert len(pii._free("+1 (867) 555-2364, " + "1 " * 200000, base_spans("+1 (867) 555-2364, "))) == 1


def test_rows_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.d and 10.0.0.1, +1 (867) 555-2364"), (3, "mail a.b@c.d and 10.0.0.1, +1 (867) 555-2364")]
    rows += [(None, "no data"), (4, "é 4111 1111 1111 1111!"), (5, "+4111111111111111" + " x" * 50000)]
    docs = documents(spark, rows)
    field = Field([])
    got = sorted(map(tuple, digests(find(docs, field)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = sorted((b, k, e) for b, e, k in plain(t or ""))
        line = ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in spans)
        want.append((i, *[sum(x == k for _, x, _ in spans) for k in range(4)], hashlib.sha256(line.encode()).hexdigest(), line))
    assert got == sorted(want, key=str)
    hidden = redact(docs)
    assert hidden.schema == docs.schema
    out = {r.doc_id: (r.text, r.n_chars) for r in hidden.collect()}
    assert out[1] == (None, None) and out[2] == ("", 0) and out[None] == ("no data", 7)
    assert out[3] == ("mail [EMAIL] and [IP], [PHONE]", 30) and out[4][0] == "é [CARD]!"


def test_counts_are_of_the_patterns_alone(spark):
    text = "ring +1 (867) 555-2364 soon. Again: 867 555 2364. jane.doe@site.example.com; Jane.Doe said"
    (got,) = digests(find(documents(spark, [(1, text)]), trained(spark))).collect()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 0, 0, 1)
    assert got.spans.count("phone") == 2 and got.spans.count("email") == 2
    line = ",".join(f"{KINDS[k]}:{b}:{e}" for b, e, k in sorted(plain(text)))
    assert got.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_no_rows(spark):
    assert digests(find(documents(spark, []))).collect() == []
    assert redact(documents(spark, [])).collect() == []
