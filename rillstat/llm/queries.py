"""Queries p2, p5, p6, p7 and p8 over the project's tables, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstat.functions.events import is_finite, timed_events, unsigned_to_double, utc_day
from rillstat.llm import bpe, packing, radix, stuffing, ultraloglog
from rillstat.operators.intervals import attach_intervals
from rillstat.session import ensure_checkpoint_dir
from rillstat.sources import table

TOLERANCE = 0.10
#: Up to so many (metric, day) pairs are broadcast: 16 bytes each.
PICKED_ROWS = 100_000
#: Packing blocks hold about this many bytes of the stored table each.
BLOCK_BYTES = 32 * 2**20


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    """(name_hash, day_no, id) of the timed unique events that carry an identifier."""
    e = timed_events(table(spark, d, "metric_events"), "unique", columns=("name_hash", "value", "item_hash", "ts_ms"))
    ident = F.when(is_finite(F.col("value")), F.col("value")).otherwise(unsigned_to_double(F.col("item_hash")))
    return e.select("name_hash", utc_day(F.col("ts_ms")).alias("day_no"), ident.alias("id")).where(F.col("name_hash").isNotNull() & F.col("id").isNotNull())


def _day(c: Column) -> Column:
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


def p2_metric_day(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct identifiers per metric and day."""
    by = ["name_hash", "day_no"]
    est = ultraloglog.estimate(ultraloglog.register_counts(ultraloglog.build(_identifiers(spark, d), by, "id"), by), by)
    return est.select("name_hash", _day(F.col("day_no")).alias("day"), F.round("estimate").cast("long").alias("distinct_ids"), "standard_error")


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct identifiers per metric over all days, from its united daily sketches."""
    days = ultraloglog.build(_identifiers(spark, d), ["name_hash", "day_no"], "id")
    est = ultraloglog.estimate(ultraloglog.register_counts(ultraloglog.unite(days, ["name_hash"]), ["name_hash"]), ["name_hash"])
    return est.select("name_hash", F.round("estimate").cast("long").alias("distinct_ids"), "standard_error")


def p2_scope_day(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct identifiers per scope and day, for every day on which a metric of the scope has any."""
    ids, scopes = _identifiers(spark, d), table(spark, d, "metric_scopes")
    # read anew: columns of one frame on both sides of the later cogroup would be ambiguous
    days = _identifiers(spark, d).select("name_hash", "day_no").dropDuplicates()
    wanted = table(spark, d, "metric_scopes").select("scope_id", "name_hash").dropna().dropDuplicates().join(days, "name_hash").select("day_no", "scope_id").dropDuplicates()
    rows = ultraloglog.counts_by_scope(ids, scopes, wanted, day="day_no", member="name_hash", scope="scope_id", identifier="id")
    est = ultraloglog.estimate(rows, ["scope_id", "day_no"])
    return est.select("scope_id", _day(F.col("day_no")).alias("day"), F.round("estimate").cast("long").alias("distinct_ids"), "standard_error")


def p2_errors_hold(spark: SparkSession, d: str) -> DataFrame:
    """Per metric and day: the exact number of distinct identifiers, and whether the estimate lies within five standard errors (or 2) of it."""
    exact = _identifiers(spark, d).dropDuplicates().groupBy("name_hash", "day_no").agg(F.count(F.lit(1)).alias("exact"))
    met = p2_metric_day(spark, d).join(exact.select("name_hash", _day(F.col("day_no")).alias("day"), "exact"), ["name_hash", "day"], "full")
    off = F.abs(F.col("distinct_ids") - F.col("exact"))
    return met.select("name_hash", "day", "exact", F.coalesce(off <= F.greatest(5 * ultraloglog.standard_error() * F.col("exact"), F.lit(2.0)), F.lit(False)).alias("holds"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose claim is null or off by more than a tenth.

    The sketches decide; where a claim lies so near to the tolerance that the
    sketch's error could turn the verdict (five standard errors), the pair of
    scope and day is counted exactly.
    """
    reports = table(spark, d, "cardinality_reports").select("report_id", F.unix_date("report_day").alias("day_no"), "scope_id", F.col("claimed").cast("double").alias("claimed")).dropDuplicates()
    ids, scopes = _identifiers(spark, d), table(spark, d, "metric_scopes")
    wanted = reports.where(F.col("claimed").isNotNull()).select("scope_id", "day_no").dropna()
    rows = ultraloglog.counts_by_scope(ids, scopes, wanted, day="day_no", member="name_hash", scope="scope_id", identifier="id")
    est = ultraloglog.estimate(rows, ["scope_id", "day_no"])
    # one estimate a reported scope and day; the verdicts are cut off here because two branches read them
    ensure_checkpoint_dir(spark)
    at = reports.join(est, ["scope_id", "day_no"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0.0)))
    band = 5 * ultraloglog.standard_error()
    off = F.abs(F.col("claimed") - F.col("estimate"))
    low, high = F.col("estimate") * (1 - band) * TOLERANCE - F.col("estimate") * band, F.col("estimate") * (1 + band) * TOLERANCE + F.col("estimate") * band
    verdict = F.when(F.col("claimed").isNull(), "yes").when(off > high, "yes").when(off < low, "no").otherwise("near")
    at = at.withColumn("verdict", verdict).select("report_id", "scope_id", "day_no", "claimed", "verdict").checkpoint()
    near = at.where(F.col("verdict") == "near")
    pairs = near.select("scope_id", "day_no").dropDuplicates().join(scopes.select("scope_id", "name_hash").dropDuplicates(), "scope_id")
    want = pairs.groupBy("name_hash", "day_no").agg(F.collect_set("scope_id").alias("scopes"))
    # few pairs are doubtful: their metrics are picked at the scan where their number is small, by a join of distinct rows otherwise
    picked = want.select("name_hash", "day_no")
    few = picked.count() <= PICKED_ROWS
    # a metric's identifiers are made distinct, hashed by all three columns, before they meet a hot (metric, day)
    per_metric = ids.join(F.broadcast(picked), ["name_hash", "day_no"], "left_semi").dropDuplicates() if few else ids.dropDuplicates()
    per_scope = per_metric.join(want, ["name_hash", "day_no"]).select(F.explode("scopes").alias("scope_id"), "day_no", "id").dropDuplicates()
    exact = per_scope.groupBy("scope_id", "day_no").agg(F.count(F.lit(1)).alias("n"))
    checked = near.join(exact, ["scope_id", "day_no"], "left").where(F.abs(F.col("claimed") - F.coalesce("n", F.lit(0))) > F.coalesce("n", F.lit(0)) * F.lit(TOLERANCE))
    return at.where(F.col("verdict") == "yes").select("report_id").unionByName(checked.select("report_id")).dropDuplicates()


def _histogram_values(spark: SparkSession, d: str) -> DataFrame:
    """Timed histogram events with a finite value; repeated deliveries still there."""
    return timed_events(table(spark, d, "metric_events"), "histogram").where(is_finite(F.col("value")) & F.col("name_hash").isNotNull())


def _keyed(values: DataFrame, *by: str) -> DataFrame:
    """Ordered keys of values, made once the deliveries are out."""
    return values.select(*by, radix.ordered_key(F.col("value")).alias("key"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored windows whose p99 is null, not finite or off by more than 5 %."""
    windows = table(spark, d, "window_results").select("name_hash", "start_ms", "end_ms", "p99").dropDuplicates()
    by = ["name_hash", "start_ms", "end_ms"]
    met = attach_intervals(_histogram_values(spark, d), windows, key="name_hash", ts="ts_ms", start="start_ms", end="end_ms", keep=("seq", "value"), shards=4, shard_by="seq", dedupe=True)
    true = radix.select_exact(_keyed(met, *by), by, [9900])
    bad = (~is_finite(F.col("p99"))) | F.coalesce(F.abs(F.col("p99") - F.col("value")) > F.abs(F.col("value")) * F.lit(0.05), F.lit(False))
    return windows.join(true, by, "left").where(bad).select(*by).dropDuplicates()


def _by_period(spark: SparkSession, d: str, name: str, period: Column) -> DataFrame:
    once = _histogram_values(spark, d).withColumn(name, period).select("name_hash", name, "seq", "value").dropDuplicates()
    return _keyed(once, "name_hash", name)


def p5_metric_day(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, p90 and p99 per metric and day."""
    out = radix.select_exact(_by_period(spark, d, "day_no", utc_day(F.col("ts_ms"))), ["name_hash", "day_no"], [5000, 9000, 9900])
    return out.select("name_hash", _day(F.col("day_no")).alias("day"), "q", "n", "value")


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of each metric's median and p99 over all days, from the united histograms of its hours."""
    hours = radix.histogram(_by_period(spark, d, "hour_no", F.expr("ts_ms div 3600000")), ["name_hash", "hour_no"])
    return radix.bounded(radix.merge(hours, ["name_hash"]), ["name_hash"], [5000, 9900])


def p5_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """Of each united percentile: whether its bounds hold the exact one and lie within 0.8 % of each other."""
    exact = radix.select_exact(_by_period(spark, d, "hour_no", F.expr("ts_ms div 3600000")).drop("hour_no"), ["name_hash"], [5000, 9900])
    met = p5_combined(spark, d).drop("n").join(exact, ["name_hash", "q"])
    holds = (F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper")) & (F.col("upper") - F.col("lower") <= 0.008 * F.greatest(F.abs("lower"), F.abs("upper")))
    return met.select("name_hash", "q", "n", "value", holds.alias("holds"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's ids by byte_bpe_50k."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.encode(docs).alias("ids"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text that its ids give back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", bpe.encode(docs).alias("ids"))
    return coded.select("doc_id", bpe.decode(coded).alias("text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    # from the files' size, so that nothing runs while the plan is made
    blocks = max(1, round(int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / BLOCK_BYTES))
    docs = docs.select("doc_id", "text")
    return packing.pack(docs.select("doc_id", bpe.count_tokens(docs).alias("n_tokens")), blocks=blocks)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Where every document goes, in containers of 2,048 tokens."""
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, d))


def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether its pieces cover all its tokens once, none but a long document is split, and its containers hold no more than they can."""
    placed = _packed(spark, d)
    tokens = table(spark, d, "documents").select("doc_id", F.size(bpe.encode(table(spark, d, "documents"))).alias("n"))
    full = placed.where(F.col("container").isNotNull()).groupBy("block", "container").agg((F.sum("n_tokens") <= packing.CAPACITY).alias("fits"))
    pieces = placed.join(full, ["block", "container"], "left").groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"))
    met = tokens.join(pieces, "doc_id", "full")
    ok = (F.col("got") == F.col("n")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))) & F.col("fits")
    return met.select("doc_id", F.coalesce(ok, F.lit(False)).alias("sound"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split."""
    return _packed(spark, d).where(F.col("piece") == 1).select("doc_id").dropDuplicates()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages mostly of repeated keywords, links or product tags that lie far from the pages of their language."""
    ensure_checkpoint_dir(spark)
    # the texts are read once; medians, deviations, covariance and distances all come from the few numbers of a page
    rows = stuffing.features(table(spark, d, "documents")).checkpoint()
    return stuffing.distances(rows).where((F.col("density") > stuffing.SHARE) & (F.col("distance") > stuffing.CUTOFF) & (F.col("direction") > 0)).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_metric_day": p2_metric_day, "p2_scope_day": p2_scope_day, "p2_combined": p2_combined, "p2_errors_hold": p2_errors_hold, "p5_found": p5_found, "p5_metric_day": p5_metric_day, "p5_combined": p5_combined, "p5_bounds_hold": p5_bounds_hold, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_pack": p7_pack, "p7_report": p7_report, "p7_covered": p7_covered, "p8_found": p8_found}

_TIMED = "SELECT DISTINCT seq, name_hash, lower(trim(metric_type)) AS type, value, item_hash, ts_ms FROM metric_events WHERE ts_ms >= 946684800000"

_IDENTIFIERS = """SELECT DISTINCT name_hash, ts_ms // 86400000 AS d, CASE WHEN isfinite(value) THEN value
                WHEN item_hash >= 0 THEN CAST(item_hash AS DOUBLE) ELSE CAST(CAST(item_hash AS HUGEINT) + 18446744073709551616 AS DOUBLE) END AS id
            FROM e WHERE type = 'unique'"""
_DAY = "strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d')"

SQL = {
    "p2_found": f"""
        WITH e AS ({_TIMED}), i AS ({_IDENTIFIERS}),
        r AS (SELECT DISTINCT report_id, report_day, scope_id, claimed FROM cardinality_reports),
        s AS (SELECT DISTINCT scope_id, name_hash FROM metric_scopes),
        n AS (SELECT s.scope_id, i.d, count(DISTINCT i.id) AS n FROM s JOIN i USING (name_hash) GROUP BY ALL)
        SELECT DISTINCT report_id FROM r LEFT JOIN n ON n.scope_id = r.scope_id AND n.d = r.report_day - DATE '1970-01-01'
        WHERE claimed IS NULL OR abs(claimed - coalesce(n, 0)) > 0.1 * coalesce(n, 0)""",
    "p5_found": f"""
        WITH e AS ({_TIMED}), w AS (SELECT DISTINCT name_hash, start_ms, end_ms, p99 FROM window_results),
        v AS (SELECT w.name_hash, w.start_ms, w.end_ms, quantile_disc(e.value, 0.99) AS t FROM (SELECT DISTINCT name_hash, start_ms, end_ms FROM w) w
              JOIN e ON e.name_hash = w.name_hash AND e.ts_ms >= w.start_ms AND e.ts_ms < w.end_ms WHERE e.type = 'histogram' AND isfinite(e.value) GROUP BY ALL)
        SELECT DISTINCT name_hash, start_ms, end_ms FROM w LEFT JOIN v USING (name_hash, start_ms, end_ms)
        WHERE p99 IS NULL OR NOT isfinite(p99) OR abs(p99 - t) > 0.05 * abs(t)""",
    "p2_errors_hold": f"""
        WITH e AS ({_TIMED}), i AS ({_IDENTIFIERS})
        SELECT name_hash, {_DAY} AS day, count(DISTINCT id) AS exact, true AS holds FROM i WHERE name_hash IS NOT NULL AND id IS NOT NULL GROUP BY name_hash, d""",
    "p5_bounds_hold": f"""
        WITH e AS ({_TIMED}), g AS (SELECT name_hash, list_sort(list(value)) AS v FROM e WHERE type = 'histogram' AND isfinite(value) AND name_hash IS NOT NULL GROUP BY ALL)
        SELECT name_hash, CAST(q AS INTEGER) AS q, len(v) AS n, v[(len(v) * q + 9999) // 10000] AS value, true AS holds FROM g, (VALUES (5000), (9900)) t(q)""",
    "p7_covered": "SELECT doc_id, true AS sound FROM documents",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p5_metric_day": f"""
        WITH e AS ({_TIMED}), g AS (SELECT name_hash, ts_ms // 86400000 AS d, list_sort(list(value)) AS v FROM e WHERE type = 'histogram' AND isfinite(value) AND name_hash IS NOT NULL GROUP BY ALL)
        SELECT name_hash, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, CAST(q AS INTEGER) AS q, len(v) AS n, v[(len(v) * q + 9999) // 10000] AS value
        FROM g, (VALUES (5000), (9000), (9900)) t(q)""",
}
