"""Snapshots as JSON and as Prometheus text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstat.functions.hashing import unsigned
from rillstat.operators.metrics import SNAPSHOT

#: Samples of the text format: (name, labels, column, TYPE line before it).
_SAMPLES = (
    ("counter", "", "counter", "counter"),
    ("gauge", "", "gauge", "gauge"),
    ("cardinality", "", "cardinality", "gauge"),
    ("latency", ',quantile="0.5"', "p50", "summary"),
    ("latency", ',quantile="0.95"', "p95", None),
    ("latency", ',quantile="0.99"', "p99", None),
    ("events_total", "", "event_count", None),
)


def number_text(c: Column, *, bare: bool = False) -> Column:
    """Shortest text that reads back as the same DOUBLE, without exponent and without '.0'.

    NaN is null, infinities are "+Inf" and "-Inf" in quotation marks; ``bare``
    writes NaN, +Inf and -Inf as the text format of Prometheus has them.
    """
    nan, up, down = ("NaN", "+Inf", "-Inf") if bare else ("null", '"+Inf"', '"-Inf"')

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            yield pa.array([None if v is None else nan if v != v else up if v == np.inf else down if v == -np.inf else np.format_float_positional(v, unique=True, trim="-") for v in p.to_pylist()], pa.string())

    return text(c.cast("double"))


def _texts(snapshots: DataFrame, key: str, bare: bool) -> tuple[Column, dict[str, Column]]:
    return unsigned(F.col(key)).cast("string"), {c: number_text(F.col(c), bare=bare) if c != "event_count" else F.col(c).cast("string") for c in SNAPSHOT}


def to_json(snapshots: DataFrame, key: str = "name_hash") -> DataFrame:
    """(key, ``json``): one object a metric, fields in fixed order; the key as unsigned number. A null key is null."""
    h, t = _texts(snapshots, key, False)
    parts = [F.lit('{"name_hash":'), F.coalesce(h, F.lit("null"))]
    for c in SNAPSHOT:
        parts += [F.lit(f',"{c}":'), F.coalesce(t[c], F.lit("null"))]
    return snapshots.select(key, F.concat(*parts, F.lit("}")).alias("json"))


def to_prometheus(snapshots: DataFrame, prefix: str, key: str = "name_hash", *, strict: bool = True) -> DataFrame:
    """(key, ``text``): one block a metric, ending with a line end. ``strict`` writes NaN and infinities as the format has them, otherwise as in JSON."""
    h, t = _texts(snapshots, key, strict)
    parts = []
    for name, labels, column, kind in _SAMPLES:
        if kind:
            parts.append(F.lit(f"# TYPE {prefix}_{name} {kind}\n"))
        parts += [F.lit(f'{prefix}_{name}{{name_hash="'), F.coalesce(h, F.lit("")), F.lit(f'"{labels}}} '), t[column], F.lit("\n")]
    return snapshots.select(key, F.concat(*parts).alias("text"))


def write_json_lines(snapshots: DataFrame, path: str, key: str = "name_hash") -> None:
    """One object a line; the files are written in parallel."""
    to_json(snapshots, key).select("json").write.mode("overwrite").text(path)


def json_array(snapshots: DataFrame, key: str = "name_hash") -> DataFrame:
    """One row, ``json``: an array of all objects in order of key. For few metrics: the array is one value."""
    rows = to_json(snapshots, key).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "json"))).alias("a"))
    return rows.select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["json"]), ","), F.lit("]")).alias("json"))


def write_prometheus(snapshots: DataFrame, path: str, prefix: str, key: str = "name_hash") -> None:
    """Blocks with an empty line between them."""
    to_prometheus(snapshots, prefix, key).select("text").write.mode("overwrite").text(path)
