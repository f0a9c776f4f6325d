"""Token counts by a public byte-level BPE vocabulary; the file's path is a parameter and must exist on every executor."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.session import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(path: str):
    """The encoding of a rank file, read once per process (a function sent by value has no module of its own to keep it in)."""
    import tiktoken

    kept = sys.__dict__.setdefault("_skeinwork_encodings", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def encode(text: str, path: str = RANKS) -> list[int]:
    return _encoding(path).encode_ordinary(text)


def decode(ids: list[int], path: str = RANKS) -> bytes:
    return _encoding(path).decode_bytes(ids)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(encode(t, path)) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])


def counted(df: DataFrame, id_col: str, text_col: str, keep: dict[str, str], path: str = RANKS) -> DataFrame:
    """(id, the kept columns under their new names, n_tokens): one row per id. Whole texts are counted; null texts count as empty.

    Rows without id take no part; of rows that repeat an id the greatest (kept columns, then tokens) counts.
    """
    few = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(n) for c, n in keep.items()), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[:-1]) + ", n_tokens long"
    sized = spread(few).mapInArrow(lambda it: _count(it, path), schema)
    return sized.groupBy("id").agg(F.max(F.struct(*keep.values(), "n_tokens")).alias("x")).select("id", *(F.col(f"x.{n}").alias(n) for n in keep.values()), "x.n_tokens")
