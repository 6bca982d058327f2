"""Compact binary payloads of metric events: type code, name hash and value in 17 bytes, little-endian.

Codes: 0 counter, 1 gauge, 2 histogram, 3 unique. The time is not carried.
Coding and decoding are numpy views over Arrow batches, without a loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.functions.hashing import hash_long

TYPES = ("counter", "gauge", "histogram", "unique")
SIZE = 17
_LAYOUT = np.dtype([("code", "u1"), ("hash", "<i8"), ("value", "<f8")])


def encode_payload(kind: Column, name_hash: Column, value: Column) -> Column:
    """BINARY(17) payload; null where the type is unknown or any part is null."""

    @F.arrow_udf("binary")
    def pack(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for k, h, v in parts:
            code = pc.index_in(pc.utf8_lower(pc.utf8_trim(k, " ")), value_set=pa.array(TYPES))
            lost = pc.or_(pc.or_(code.is_null(), h.is_null()), v.is_null()).to_numpy(zero_copy_only=False)
            rows = np.zeros(len(k), _LAYOUT)
            rows["code"] = code.fill_null(0).to_numpy(zero_copy_only=False)
            rows["hash"] = h.fill_null(0).to_numpy(zero_copy_only=False)
            rows["value"] = v.fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = pa.py_buffer(np.arange(0, SIZE * (len(k) + 1), SIZE, dtype=np.int32))
            whole = pa.Array.from_buffers(pa.binary(), len(k), [None, ends, pa.py_buffer(rows.tobytes())])
            yield pc.if_else(pa.array(lost), pa.scalar(None, pa.binary()), whole)

    return pack(kind.cast("string"), name_hash.cast("long"), value.cast("double"))


def parse_payload(payload: Column) -> Column:
    """STRUCT<metric_type, name_hash, value>; null for a null payload, one of less than 17 bytes or with an unknown code. Further bytes are ignored.

    All is decided inside one function over the batch: as column conditions the
    tests would be copied into every expression that reads a field.
    """

    @F.arrow_udf("struct<metric_type:string,name_hash:long,value:double>")
    def unpack(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            flat = p.cast(pa.large_binary())
            long_enough = pc.fill_null(pc.greater_equal(pc.binary_length(flat), SIZE), False)
            # a slice of fixed width, zeros where there is no sound payload
            cut = pc.if_else(long_enough, pc.binary_slice(flat.cast(pa.binary()), 0, SIZE), pa.scalar(bytes(SIZE), pa.binary()))
            _, offsets, data = cut.buffers()
            at = int(np.frombuffer(offsets, np.int32)[cut.offset]) if len(cut) else 0
            rows = np.frombuffer(data, _LAYOUT, len(cut), at) if len(cut) else np.zeros(0, _LAYOUT)
            code = rows["code"].astype(np.int64)
            sound = long_enough.to_numpy(zero_copy_only=False) & (code < len(TYPES))
            names = pa.array(TYPES).take(pa.array(np.where(sound, code, 0)))
            yield pa.StructArray.from_arrays([names, pa.array(rows["hash"].astype(np.int64)), pa.array(rows["value"].astype(np.float64))], names=["metric_type", "name_hash", "value"], mask=pa.array(~sound))

    return unpack(payload)


def decode_payloads(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """``messages`` with ``metric_type``, ``name_hash``, ``value`` and ``is_error``, true where the payload can't be read."""
    out = messages.withColumn("_rs_e", parse_payload(F.col(payload)))
    return out.withColumn("is_error", F.col("_rs_e").isNull()).select(*[c for c in messages.columns if c not in ("metric_type", "name_hash", "value", "is_error")], "_rs_e.metric_type", "_rs_e.name_hash", "_rs_e.value", "is_error")


def consume(messages: DataFrame, payload: str = "payload", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(metric state of the readable messages, one row with ``total_consumed`` and ``total_parse_errors``). Nothing is dropped for lack of room."""
    from rillstat.operators.metrics import metric_state

    read = decode_payloads(messages, payload)
    v = F.col("value")
    # an identifier travels as the double of an unsigned number, whose low bits are lost: it is hashed again
    word = F.when((v >= 0) & (v < 2.0**63), v).when((v >= 2.0**63) & (v < 2.0**64), v - 2.0**64).cast("long")
    hashed = hash_long(F.when(F.col("metric_type") == "unique", word))
    good = read.where(~F.col("is_error")).select("name_hash", "metric_type", "value", F.lit(0).cast("long").alias("ts_ms"), F.col(order).alias("seq"), hashed.alias("item_hash"))
    counts = read.agg(F.count(F.lit(1)).alias("total_consumed"), F.coalesce(F.sum(F.col("is_error").cast("long")), F.lit(0)).alias("total_parse_errors"))
    return metric_state(good), counts
