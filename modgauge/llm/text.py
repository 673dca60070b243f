"""Arrow text columns as flat byte arrays, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Bytes of text one numpy pass looks at; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: The bytes between words: space and 09-0D, as bytes.split() takes them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return held, offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes; null is an empty text."""
    data, offsets = flat(column)
    view = memoryview(data)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[start:end])


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [first, last) of at most `size` bytes, or one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def free_name(wanted: str, columns: list[str]) -> str:
    """`wanted`, made longer until no column is called so, whatever the case."""
    taken = {column.lower() for column in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
