"""64-bit FNV-1a hashes with an avalanche step, computed in Arrow batches.

The arithmetic wraps at 64 bits, which column expressions refuse under ANSI
rules; numpy's unsigned integers wrap by nature. All results are BIGINT in two's
complement; a null input gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a, the two multipliers of the avalanche step.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Byte that ends a string when a whole string value, not its bytes, is hashed.
TEXT_END = 0xFF

_U64 = np.uint64


def mix64(h: np.ndarray) -> np.ndarray:
    """The avalanche step of unsigned 64-bit hashes."""
    h = h.astype(_U64)
    for m in (MIX_1, MIX_2):
        h = (h ^ (h >> _U64(33))) * _U64(m)
    return h ^ (h >> _U64(33))


def hash_words(*words: np.ndarray) -> np.ndarray:
    """Hash of the little-endian bytes of one or more unsigned 64-bit words a row."""
    state = np.full(len(words[0]), FNV_OFFSET, _U64)
    for w in words:
        w = w.astype(_U64, copy=False)
        for k in range(8):
            state = (state ^ ((w >> _U64(8 * k)) & _U64(0xFF))) * _U64(FNV_PRIME)
    return mix64(state)


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, tail: int | None = None) -> np.ndarray:
    """Hash of each byte slice ``data[start:end]``; ``tail`` is one more byte after each.

    Longest slices come first, so position k concerns a prefix of the rows: the
    loop runs over positions, never over rows.
    """
    n = (end - start).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    at, left = start[order].astype(np.int64), n[order]
    state = np.full(len(n), FNV_OFFSET, _U64)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        state[:live] = (state[:live] ^ data[at[:live] + k].astype(_U64)) * _U64(FNV_PRIME)
    if tail is not None:
        state = (state ^ _U64(tail)) * _U64(FNV_PRIME)
    out = np.empty(len(n), _U64)
    out[order] = mix64(state)
    return out


def words_of(part: pa.Array) -> np.ndarray:
    """A BIGINT batch as unsigned words; nulls as 0."""
    return part.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U64)


def as_bigint(h: np.ndarray, like: pa.Array) -> pa.Array:
    """Unsigned words as BIGINT, null where ``like`` is null."""
    mask = like.is_null().to_numpy(zero_copy_only=False) if like.null_count else None
    return pa.array(h.view(np.int64), pa.int64(), mask=mask)


def _hash_bytes_batch(part: pa.Array, tail: int | None) -> pa.Array:
    flat = part.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return as_bigint(hash_slices(bytes_, ends[:-1], ends[1:], tail), part)


def hash_long(c: Column) -> Column:
    """Hash of a BIGINT by its eight little-endian bytes."""

    @F.arrow_udf("long")
    def h(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            yield as_bigint(hash_words(words_of(p)), p)

    return h(c.cast("long"))


def hash_pair(low: Column, high: Column) -> Column:
    """Hash of a 128-bit number by its sixteen little-endian bytes, given as two BIGINT halves; null if ``low`` is null."""

    @F.arrow_udf("long")
    def h(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            yield as_bigint(hash_words(words_of(a), words_of(b)), a)

    return h(low.cast("long"), high.cast("long"))


def hash_bytes(c: Column, *, as_text_value: bool = False) -> Column:
    """Hash of the bytes of a STRING (UTF-8) or BINARY; with ``as_text_value`` a terminating byte is added."""
    tail = TEXT_END if as_text_value else None

    @F.arrow_udf("long")
    def h(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            yield _hash_bytes_batch(p, tail)

    return h(c)


def unsigned(c: Column) -> Column:
    """A BIGINT in two's complement as the DECIMAL(20,0) that it stands for."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, (d + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(d)


def register(spark) -> None:
    """The hashes as SQL functions: ``rs_hash_long``, ``rs_hash_bytes``."""

    @F.arrow_udf("long")
    def rs_hash_long(p: pa.Array) -> pa.Array:
        return as_bigint(hash_words(words_of(p.cast(pa.int64()))), p)

    @F.arrow_udf("long")
    def rs_hash_bytes(p: pa.Array) -> pa.Array:
        return _hash_bytes_batch(p, None)

    spark.udf.register("rs_hash_long", rs_hash_long)
    spark.udf.register("rs_hash_bytes", rs_hash_bytes)
