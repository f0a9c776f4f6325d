"""Items over a size limit as pieces under it, cut at the most natural place there is, consecutive pieces sharing an overlap.

Sizes are UTF-16 code units. The text of an item is its messages one after another. It is cut into atoms by a hierarchy of
separators - message, section, paragraph, line, sentence, word, character - where only an atom that is still too large goes to the
next level; atoms are then packed greedily. Each piece but the first starts with the last `overlap` units of the piece before
it (one unit more rather than half a surrogate pair). Nothing is lost: without their overlaps the pieces are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 20_000, 200
#: Where an atom may end, from the largest unit to the smallest; the separator stays with what precedes it.
LEVELS = (
    # before a heading, after a rule, after a fenced block as a whole (headings inside one are none)
    ("section", re.compile(r"^```[^\n]*\n(?:.*?\n)?```[ \t]*(?:\n+|\Z)|\n+(?=\#{1,6} |[^\n]+\n(?:={3,}|-{3,})[ \t]*\n)|\n(?:-{3,}|\*{3,}|_{3,})[ \t]*\n+", re.M | re.S)),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s+")),
    ("word", re.compile(r"\s+")),
)


def units(text: str) -> int:
    """UTF-16 code units of a text."""
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


def units_of(text: Column) -> Column:
    """UTF-16 code units of a text column; null has none."""
    return F.coalesce((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"), F.lit(0).cast("long"))


def _characters(text: str, room: int) -> Iterator[str]:
    start = size = 0
    for i, c in enumerate(text):
        w = 2 if c > "￿" else 1
        if size + w > room and i > start:
            yield text[start:i]
            start, size = i, 0
        size += w
    if start < len(text):
        yield text[start:]


def atoms(text: str, room: int, level: int = 0) -> Iterator[tuple[str, str]]:
    """(atom, what kind of place it ends at), each of at most `room` units where a character allows it."""
    if level == len(LEVELS):
        yield from ((x, "character") for x in _characters(text, room))
        return
    name, pattern = LEVELS[level]
    at = 0
    for m in pattern.finditer(text):
        if m.end() < len(text):
            part, at = text[at : m.end()], m.end()
            yield from [(part, name)] if units(part) <= room else _last(atoms(part, room, level + 1), name)
    part = text[at:]
    yield from [(part, name)] if units(part) <= room else atoms(part, room, level + 1)


def _last(parts: Iterator[tuple[str, str]], name: str) -> Iterator[tuple[str, str]]:
    held = None
    for part in parts:
        if held is not None:
            yield held
        held = part
    if held is not None:
        yield held[0], name


def _tail(text: str, size: int) -> str:
    """The last `size` units of a text, one more rather than half a pair."""
    i = len(text)
    while i and size > 0:
        i -= 1
        size -= 2 if text[i] > "￿" else 1
    return text[i:]


def pieces(messages: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, str]]:
    """(text, start, end, cut) of each piece: offsets in units of the whole text, and the kind of place it ends at."""
    if not 0 <= overlap < limit - 2:
        raise ValueError("the overlap must leave room for two units")
    room = limit - overlap - (overlap > 0)
    flow: list[tuple[str, str]] = []
    for m in messages:
        if m:
            flow += _last(iter([(m, "message")]) if units(m) <= room else atoms(m, room), "message")
    out: list[tuple[str, int, int, str]] = []
    lead = body = cut = ""
    size = lead_size = start = 0
    held: list[str] = []
    for atom, kind in flow:
        w = units(atom)
        if held and lead_size + size + w > limit:
            body = lead + "".join(held)
            out.append((body, start - lead_size, start + size, cut))
            lead = _tail(body, overlap) if overlap else ""
            lead_size, start, size, held = units(lead), start + size, 0, []
        held.append(atom)
        size, cut = size + w, kind
    if held:
        out.append((lead + "".join(held), start - lead_size, start + size, "end"))
    return out


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("piece_no", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cut", pa.string())])
    for batch in batches:
        for i, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = pieces([t or "" for t in texts or []], limit, overlap)
            yield pa.RecordBatch.from_pylist([{"id": i, "piece_no": n, "text": t, "start": a, "end": b, "cut": c} for n, (t, a, b, c) in enumerate(rows, 1)], schema)


def oversized(df: DataFrame, id_col: str, messages_col: str, limit: int = LIMIT) -> DataFrame:
    """(id, texts, n_units): one row per item whose message texts together exceed the limit.

    Only the texts are counted, never a stored count. Null messages and null texts count as empty; of rows that repeat an id
    with different content the greatest oversized one counts; rows without id take no part.
    """
    texts = F.transform(F.coalesce(F.col(f"`{messages_col}`"), F.array()), lambda m: F.coalesce(m["text"], F.lit("")))
    total = F.aggregate(F.transform(texts, units_of), F.lit(0).cast("long"), lambda a, x: a + x)
    large = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), texts.alias("texts"), total.alias("n_units")).where(F.col("id").isNotNull() & (F.col("n_units") > limit))
    return large.groupBy("id").agg(F.max(F.struct("texts", "n_units")).alias("x")).select("id", "x.texts", "x.n_units")


def split(df: DataFrame, id_col: str, messages_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, text, start, end, cut) of every item over the limit; items within it give no row (see `oversized`)."""
    return oversized(df, id_col, messages_col, limit).select("id", "texts").mapInArrow(lambda it: _split(it, limit, overlap), "id string, piece_no int, text string, start long, end long, cut string")
