"""Lines of text files and their places, wherever the files are cut."""

import gzip
import io
import os
import re

import pytest

from quoteflow.operators import audit, normalize
from quoteflow.sources.frames import text_frames
from quoteflow.sources.lines import lines, text_lines

TEXTS = [
    b"", b"\n", b"\r\n", b"\r", b"one", b"one\n", b"one\ntwo", b"a\r\nb\rc\n\n\r\r\nd", b"\n\na\n", b"\xef\xbb\xbfone\ntwo\n",
    b"x" * 40 + b"\r\n" + b"y" * 25 + b"\r" + b"z" * 3, "слово\nまる\r\n".encode(),
]


def plain(text):
    out, at = [], 0
    for found in re.finditer(rb"\r\n|\n|\r", text):
        out.append((at, text[at : found.start()]))
        at = found.end()
    out += [(at, text[at:])] if at < len(text) else []
    return [(place, line.removeprefix(b"\xef\xbb\xbf") if not place else line) for place, line in out]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_every_cut_gives_every_line_once(text, chunk):
    for cut in (1, 2, 3, 5, 11, 1000):
        got = []
        for begin in range(0, len(text), cut):
            file = io.BytesIO(text)
            file.seek(max(0, begin - 1))
            got += lines(file, begin, begin + cut, chunk)
        assert got == plain(text), (text, cut)


def test_files_cut_or_packed_read_alike(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i, text in enumerate(TEXTS):
        (folder / f"f{i}").write_bytes(text)
    (folder / "packed.gz").write_bytes(gzip.compress(TEXTS[7]))
    want = {(f"f{i}", p, x.decode()) for i, text in enumerate(TEXTS) for p, x in plain(text)}
    want |= {("packed.gz", p, x.decode()) for p, x in plain(TEXTS[7])}
    for cut in (4, 1 << 20):
        rows = text_lines(spark, str(folder), cut=cut).collect()
        assert len(rows) == len(want) and {(os.path.basename(r.path), r.place, r.raw) for r in rows} == want


def test_lines_of_one_moment_keep_their_order(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    prices = [1, 1, 2, 1, 1, 1, 3, 3, 2] * 40  # 4 of 9 repeat the one before, and 2 is followed by 1
    (folder / "a.txt").write_text("".join(f"KIWI|{p}|1|5\n" for p in prices))
    feed = text_frames(spark, str(folder), "exchange-c", "C")
    row = audit.adjacent_duplicates(normalize.ticks(normalize.classify(feed))).first()
    assert (row.received, row.adjacent_duplicates) == (360, sum(a == b for a, b in zip(prices, prices[1:], strict=False)))
    assert [r.raw for r in feed.orderBy("arrival_ts", "frame_seq").collect()] == [f"KIWI|{p}|1|5" for p in prices]
