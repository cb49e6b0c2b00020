import pathlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import chunking


def test_separator_opens_the_next_piece():
    assert list(chunking.split_text("aaa。bbb。ccc", size=4, overlap=0)) == ["aaa", "。bbb", "。ccc"]


def test_overlap_is_made_of_whole_pieces():
    assert list(chunking.split_text("aa bb cc dd", size=6, overlap=3)) == ["aa bb", "bb cc", "cc dd"]


def test_falls_back_to_characters():
    assert list(chunking.split_text("abcdefgh", size=3, overlap=1)) == ["abc", "cde", "efg", "gh"]


def test_empty_and_blank_texts_have_no_chunks():
    assert list(chunking.split_text("")) == []
    assert list(chunking.split_text(" \n\n ")) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n。", max_size=300), st.integers(3, 40), st.integers(0, 2))
def test_chunks_are_short_and_come_from_the_text(text, size, overlap):
    for chunk in chunking.split_text(text, size, overlap):
        assert 0 < len(chunk) <= size
        assert chunk in text


def test_fixed_windows_cover_the_text(spark):
    rows = spark.createDataFrame([(0, "x" * 512), (1, "y" * 513), (2, ""), (3, "äb" * 700), (4, None)], "i int, t string")
    got = {r["i"]: r["w"] for r in rows.select("i", chunking.fixed_windows(F.col("t")).alias("w")).collect()}
    assert [len(w) for w in got[0]] == [512]
    assert [len(w) for w in got[1]] == [512, 101]
    assert got[2] == []
    assert "".join(w if k == 0 else w[100:] for k, w in enumerate(got[3])) == "äb" * 700


def test_line_blocks(spark):
    rows = spark.createDataFrame([("aa\nbb\ncccccc\n\nd",)], "t string")
    assert rows.select(chunking.line_blocks(F.col("t"), 5).alias("b")).first()["b"] == ["aa\nbb", "cccccc", "\nd"]


def test_recursive_chunks_number_the_chunks_of_each_text(spark):
    rows = spark.createDataFrame([("a", "one two three four"), ("b", None)], "source string, text string")
    got = chunking.with_chunk_ids(chunking.recursive_chunks(rows, ["source"], size=9, overlap=0)).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == ["a_0", "a_1", "a_2"]
    assert [r["content"] for r in got] == ["one two", "three", "four"]


def plain_split(text, size, overlap, marks=chunking.SEPARATORS):
    """The rule by places in the text instead of pieces: cuts at the first mark that occurs, then windows over whole pieces."""
    mark = next((m for m in marks if m == "" or m in text), None)
    weaker = marks[marks.index(mark) + 1 :] if mark is not None else ()
    if mark is None:
        cuts = [0, len(text)]
    elif mark == "":
        cuts = list(range(len(text) + 1))
    else:
        cuts, at = [0], text.find(mark)
        while at >= 0:
            cuts.append(at)
            at = text.find(mark, at + len(mark))
        cuts.append(len(text))
    spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    out, run = [], []

    def merge():
        first = 0
        for last in range(len(run)):
            total = sum(b - a for a, b in run[first:last])
            own = run[last][1] - run[last][0]
            if total + own > size and last > first:
                out.append(text[run[first][0] : run[last - 1][1]])
                while first < last and (sum(b - a for a, b in run[first:last]) > overlap or sum(b - a for a, b in run[first:last]) + own > size):
                    first += 1
        if run[first:]:
            out.append(text[run[first][0] : run[-1][1]])
        run.clear()

    for a, b in spans:
        if b - a < size:
            run.append((a, b))
            continue
        merge()
        if weaker:
            out.extend(plain_split(text[a:b], size, overlap, weaker))
        else:
            out.append(text[a:b])
    merge()
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("ab 。！\n；", max_size=60), st.integers(1, 12), st.integers(0, 11))
def test_recursive_split_equals_a_plain_version(text, size, overlap):
    overlap = min(overlap, size - 1)
    want = [c.strip() for c in plain_split(text, size, overlap)]
    assert list(chunking.split_text(text, size, overlap)) == [c for c in want if c]


def golden():
    """The folder, and the lengths of each file's chunks, that the table of fixtures names."""
    path = pathlib.Path(__file__).parent.parent / "FIXTURES.md"
    text = path.read_text(encoding="utf-8") if path.exists() else ""
    folder = re.search(r"\(`(/[^`]+/)`", text)
    rows = re.findall(r"^\| (\S+\.txt) \|.*?\| (\d+) \| (\d+) \| ([\d, ]+) \|$", text, re.MULTILINE)
    return pathlib.Path(folder[1]) if folder else None, {name: (int(size), [int(x) for x in lengths.split(",")]) for name, size, _, lengths in rows}


def test_recorded_chunk_lengths():
    folder, files = golden()
    if folder is None or not folder.is_dir() or not files:
        pytest.skip("the recorded texts are not here")
    got = {}
    for name, (size, _) in files.items():
        text = (folder / name).read_text(encoding="utf-8")
        assert len(text) == size
        got[name] = [len(c) for c in chunking.split_text(text)]
    assert got == {name: lengths for name, (_, lengths) in files.items()} and sum(map(len, got.values())) == 16
