"""Metric registry: names, their hashes and types, and lookups by either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.functions.events import event_type
from rillstat.functions.hashing import hash_bytes

#: Bytes of a name that an entry keeps; the hash is always that of the whole name.
NAME_BYTES = 64
#: A registry of at most this many bytes, as the optimizer estimates it, may be broadcast.
BROADCAST_BYTES = 64 * 2**20


def register(names: DataFrame, *, name: str = "name", kind: str = "metric_type") -> DataFrame:
    """Entries (``name``, ``name_len``, ``name_hash``, ``metric_type``) of the named metrics, each once.

    A name is cut to 64 bytes for display; if that splits a character the name is
    empty. A metric registered under several types keeps the least one. Null
    names are left out.
    """
    full = F.col(name)
    once = names.where(full.isNotNull()).groupBy(full.alias("_rs_name")).agg(F.min(event_type(F.col(kind))).alias("metric_type"))
    cut = F.substring(F.encode("_rs_name", "UTF-8"), 1, NAME_BYTES)
    shown = F.when(F.is_valid_utf8(cut.cast("string")), F.decode(cut, "UTF-8")).otherwise("")
    return once.select(shown.alias("name"), F.octet_length(cut).alias("name_len"), hash_bytes(F.col("_rs_name")).alias("name_hash"), "metric_type")


def entries(registry: DataFrame) -> DataFrame:
    """A stored registry without its repeated entries: one row a hash, the least name and type of each."""
    return registry.where(F.col("name_hash").isNotNull()).groupBy("name_hash").agg(F.min("name").alias("name"), F.min("name_len").alias("name_len"), F.min(event_type(F.col("metric_type"))).alias("metric_type"))


def lookup(registry: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``name_hash`` and ``registered_type``, null where unknown. Names are found by the hash of the whole name."""
    wanted = names.withColumn("_rs_h", hash_bytes(F.col(name)))
    known = _sized(entries(registry).select(F.col("name_hash").alias("_rs_k"), F.col("metric_type").alias("registered_type")), registry)
    out = wanted.join(known, F.col("_rs_h") == F.col("_rs_k"), "left")
    return out.withColumn("name_hash", F.col("_rs_k")).drop("_rs_h", "_rs_k")


def lookup_by_hash(registry: DataFrame, df: DataFrame, key: str = "name_hash") -> DataFrame:
    """``df`` with ``registered_name`` and ``registered_type`` of its hash, null where unknown."""
    known = _sized(entries(registry).select(F.col("name_hash").alias("_rs_k"), F.col("name").alias("registered_name"), F.col("metric_type").alias("registered_type")), registry)
    return df.join(known, F.col(key) == F.col("_rs_k"), "left").drop("_rs_k")


def _sized(known: DataFrame, registry: DataFrame) -> DataFrame:
    """Broadcast only where the registry's estimated size is below the bound; a larger one is joined by shuffle, with skew handling."""
    size = registry._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(known) if int(size) <= BROADCAST_BYTES else known
