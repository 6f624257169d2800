"""Byte-level text helpers shared by the operators of this subpackage.

Python stages receive Arrow batches, so a text column is one byte buffer and one array of offsets; words are
found and hashed for a whole shard of documents at once, never one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z to a-z and every other byte to itself.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: True for bytes of a word cut at white space: everything but space and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: True for bytes of a word of letters and digits: digits, a-z and all of a character outside ASCII (A-Z is lowered first).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows in them; a null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Consecutive rows in tables of about ``limit`` bytes of text; a longer text is a table of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        for row, length in enumerate(lengths.tolist()):
            if size and size + length > limit:
                if row > begin:
                    held.append(batch.slice(begin, row - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, row
            size += length
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def word_spans(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in ``data``) and rows of the words, maximal runs of ``kept`` bytes inside a row."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kept[data]
    step = np.diff(inside)
    begins, finishes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    edges = np.unique(offsets[1:-1])  # a run across the border of two rows is two words
    edges = edges[(edges > 0) & (edges < len(data))]
    if len(edges):
        cut = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        if len(cut):
            begins, finishes = np.sort(np.concatenate([begins, cut])), np.sort(np.concatenate([finishes, cut]))
    rows = np.searchsorted(offsets, begins, side="right") - 1
    return begins, finishes, rows


#: Bytes hashed at a time, and so the size of the only table that a worker keeps.
PIECE = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    made = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        row, ones = np.ones(1, np.uint64), base
        while len(row) < n:
            row = np.concatenate([row, row * np.uint64(ones)])
            ones = ones * ones & _MASK
        made.append(row[:n].copy())
    return made[0], made[1]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(PIECE + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _running(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers before each byte of at most PIECE bytes, and after the last."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _powers()[0][:len(data)], out=total[1:])
    return total


def _long_word(data: np.ndarray) -> np.uint64:
    """What ``_running`` gives for a whole word of any length, piece by piece."""
    got = sum(int(_running(data[k:k + PIECE])[-1]) * pow(_ODD, k, 1 << 64) for k in range(0, len(data), PIECE))
    return np.uint64(got & _MASK)


def word_hashes(data: np.ndarray, begins: np.ndarray, finishes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from running sums of byte values times powers; equal words have equal hashes.

    Words are in order and do not overlap. They are taken in runs that lie within PIECE bytes, so memory beside the
    result does not grow with the text.
    """
    value = np.zeros(len(begins), np.uint64)
    inverse, i = _powers()[1], 0
    while i < len(begins):
        first = int(begins[i])
        j = int(np.searchsorted(finishes, first + PIECE, side="right"))
        if j <= i:  # a word longer than a piece
            value[i] = _long_word(data[first:int(finishes[i])])
            i += 1
            continue
        total = _running(data[first:int(finishes[j - 1])])
        b, e = begins[i:j] - first, finishes[i:j] - first
        value[i:j] = (total[e] - total[b]) * inverse[b]
        i = j
    return mix64(value + (finishes - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_pieces(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive pieces of a shard of about ``limit`` bytes.

    A text is cut only at a byte outside words, so a long text comes in several pieces that repeat its row and a word
    longer than ``limit`` stays whole.
    """
    begin, row, end = 0, 0, int(offsets[-1])
    if not end:
        yield 0, data[:0], np.zeros(len(offsets), np.int64)
        return
    while begin < end:
        finish = min(begin + limit, end)
        while finish < end and kept[data[finish]]:
            ahead = np.flatnonzero(~kept[data[finish:finish + limit]])
            finish = finish + int(ahead[0]) if len(ahead) else min(finish + limit, end)
        last = int(np.searchsorted(offsets, finish, side="left"))  # rows row .. last - 1 have bytes in the piece
        yield row, data[begin:finish], np.clip(offsets[row:last + 1], begin, finish) - begin
        row = last if offsets[last] == finish else last - 1
        begin = finish
