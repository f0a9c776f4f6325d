import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import split


def check(messages, limit, overlap):
    parts = split.pieces(messages, limit, overlap)
    full = "".join(messages).encode("utf-16-le")
    end = 0
    for n, (text, a, b, _) in enumerate(parts):
        assert full[2 * a : 2 * b] == text.encode("utf-16-le")
        assert split.units(text) == b - a <= limit
        assert a <= end < b and (n == 0 or overlap <= end - a <= overlap + 1 or a == 0)
        end = b
    assert 2 * end == len(full)
    return parts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n😀é", max_size=80), max_size=5), st.integers(12, 40), st.integers(0, 8))
def test_pieces_are_the_text(messages, limit, overlap):
    check(messages, limit, overlap)


def test_natural_places_come_first():
    kinds = lambda m, limit: [c for *_, c in split.pieces([m] if isinstance(m, str) else m, limit, 0)]
    assert kinds(["a" * 10, "b" * 10], 12) == ["message", "end"]
    assert kinds("aaa bbb\n\nccc ddd", 10) == ["paragraph", "end"]
    assert kinds("aaa bbb\nccc ddd", 10) == ["line", "end"]
    assert kinds("aaa bb. ccc ddd", 10) == ["sentence", "end"]
    assert kinds("aaa bbbb cccc ddd", 10) == ["word", "end"]
    assert kinds("a" * 15, 10) == ["character", "end"]


def test_no_room_is_an_error():
    with pytest.raises(ValueError):
        split.pieces(["x"], 10, 10)


def test_table(spark):
    schema = "segment_id string, messages array<struct<role: string, text: string>>, id string, texts int, n_units int"
    long = [("user", "word " * 5000), ("assistant", None), None]
    rows = [("a", long, "x", 1, 1), ("a", long, "y", 2, 2), ("b", [("user", "short")], None, None, None), ("c", None, None, None, None), (None, long, None, None, None), ("d", [], None, None, None), ("e", [("user", "😀" * 10_001)], None, None, None), ("f", [("user", "x" * 20_000)], None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = split.split(df, "segment_id", "messages").collect()
    assert {r["id"] for r in out} == {"a", "e"}
    assert [r["piece_no"] for r in sorted(out, key=lambda r: (r["id"], r["piece_no"]))] == [1, 2, 1, 2]
    assert split.split(df.limit(0), "segment_id", "messages").count() == 0


def test_sections_come_before_paragraphs():
    words = "some words of text here. " * 12
    block = "```\n# no heading here\n\n" + "code line\n" * 20 + "```\n"
    text = f"{words}\n\n{words}\n# Second\n\n{words}\n{block}Title\n=====\n\n{words}\n***\n{words}"
    got = split.pieces([text], limit=700, overlap=0)
    assert "".join(p[0] for p in got) == text
    starts = [p[0].lstrip("\n") for p in got]
    assert starts[1].startswith("# Second") and any(x.startswith("Title\n=====") for x in starts) and not any(x.startswith("# no heading") for x in starts)
    assert {p[3] for p in got[:-1]} == {"section"}
