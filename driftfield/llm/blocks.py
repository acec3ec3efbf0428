"""Texts of an Arrow column as flat byte arrays, and words and hashes of them without a Python loop per word.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Hashes have 64 bits; equal hashes are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The words of a text as a regular expression, for Spark, DuckDB and Python alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 512

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def unused_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def map_whole_rows(df: DataFrame, run) -> DataFrame:
    """``df`` with batches changed by ``run(batches)``; columns keep their names, whatever these are."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def named(batches):
        for batch in run((b.rename_columns(names) for b in batches)):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    return plain.mapInArrow(named, plain.schema).toDF(*names)


@dataclass
class Block:
    """Some whole texts one after another: row number of the first, bytes, and n + 1 offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; null counts as empty. A longer text is a block of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), at + max_rows, len(column))
        part = offsets[at : end + 1]
        yield Block(at, data[part[0] : part[-1]], part - part[0])
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[65:91] = _BYTE_VALUE[97:123]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 2)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of the bytes of every span; with ``lower``, A-Z count as a-z."""
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row within the block of every word."""
    inside = IN_WORD[block.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    # a text ends a word, whatever the next text begins with
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, rows_of(block, starts)


def rows_of(block: Block, positions: np.ndarray) -> np.ndarray:
    """Row within the block of each byte position, which must ascend."""
    return np.repeat(np.arange(len(block)), np.diff(np.searchsorted(positions, block.offsets)))


def by_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell rows apart."""
    return mix64(hashes + (rows.astype(np.uint64) + np.uint64(1)) * _STEP)


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k lie in its row."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        same = rows[j:] == rows[: n - j]
        total[: n - j] += np.where(same, hashes[j:] * np.uint64(pow(int(_BASE), j, 1 << 64)), np.uint64(0))
    whole = np.zeros(n, bool)
    if n >= k:
        whole[: n - k + 1] = rows[k - 1 :] == rows[: n - k + 1]
    return mix64(total), whole


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """Mask of the first occurrence of each key."""
    return ~pd.Series(keys).duplicated().to_numpy()


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of lower-cased texts as (row, hash), in text order.

    A text with 1 to k - 1 words has its whole sequence as its only shingle; one without words has none.
    """
    starts, ends, rows = words(block)
    hashes, whole = windows(span_hashes(block.data, starts, ends, lower=True), rows, k)
    counts = np.bincount(rows, minlength=len(block))
    firsts = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < k)
    hashes[firsts[short]] = mix64(hashes[firsts[short]] + counts[short].astype(np.uint64))
    whole[firsts[short]] = True
    rows, hashes = rows[whole], hashes[whole]
    new = first_of_each(by_row(rows, hashes))
    return rows[new], hashes[new]
