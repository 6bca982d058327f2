"""The SQL that each statistics query must agree with. Parts that recur are made by small functions.

Measured numbers are compared as FLOAT, as sums depend on the order of their terms.
"""

from __future__ import annotations

import math

from rillstat.functions.hashing import FNV_OFFSET, FNV_PRIME, MIX_1, MIX_2
from rillstat.operators.cardinality import alpha
from rillstat.operators.frequency import ROW_STRIDE
from rillstat.operators.quantile import gamma

SEED = "rillstat-check"
HOUR, SIX_HOURS, DAY = 3_600_000, 21_600_000, 86_400_000
_U = str(2**64)
_R33 = str(2**33)


def _u(x: str) -> str:
    """A BIGINT as unsigned."""
    return f"CAST(CASE WHEN ({x}) < 0 THEN CAST({x} AS HUGEINT) + {_U} ELSE CAST({x} AS HUGEINT) END AS UHUGEINT)"


def _signed(h: str) -> str:
    return f"CAST(CAST({h} AS HUGEINT) - CASE WHEN {h} >= {2**63} THEN {_U} ELSE 0 END AS BIGINT)"


def _steps(x: str, multipliers: list[int]) -> str:
    """xor-shift by 33 and multiply for each multiplier, then one more xor-shift."""
    m = ", ".join(f"CAST({k} AS UHUGEINT)" for k in multipliers)
    g = f"list_reduce([{x}, {m}], lambda a, b: (xor(a, a // {_R33}) * b) % {_U})"
    return f"list_transform([{g}], lambda a: xor(a, a // {_R33}))[1]"


def _fnv(bytes_: str) -> str:
    """Unsigned hash of a list of bytes (UHUGEINT)."""
    return _steps(f"list_reduce([CAST({FNV_OFFSET} AS UHUGEINT)] || {bytes_}, lambda a, b: (xor(a, b) * {FNV_PRIME}) % {_U})", [MIX_1, MIX_2])


def _word(x: str) -> str:
    return f"list_transform(range(8), lambda k: CAST(({_u(x)} // CAST(pow(256, k) AS UHUGEINT)) % 256 AS UHUGEINT))"


def _hash_long(x: str) -> str:
    return _fnv(_word(x))


def _text(x: str) -> str:
    hexed = f"hex(encode({x}))"
    return f"list_transform(range(length({hexed}) // 2), lambda k: CAST(CAST('0x' || substr({hexed}, CAST(2 * k + 1 AS BIGINT), 2) AS INTEGER) AS UHUGEINT))"


def _hll(rows: str, by: str, p: int, h: str = "h") -> str:
    """Estimates from rows with an unsigned hash."""
    m = 2**p
    rank = f"CASE WHEN {h} // {m} = 0 THEN {65 - p} ELSE {65 - p} - length(bin(CAST({h} // {m} AS UBIGINT))) END"
    return f"""(WITH r AS (SELECT {by}, {h} % {m} AS i, max({rank}) AS k FROM {rows} WHERE {h} IS NOT NULL GROUP BY ALL),
        s AS (SELECT {by}, sum(pow(2.0, -k)) AS s, count(*) AS u FROM r GROUP BY {by}),
        t AS (SELECT {by}, u, CAST({alpha(p) * m * m!r} AS DOUBLE) / (s + {m} - u) AS raw FROM s)
        SELECT {by}, CASE WHEN raw <= {2.5 * m} AND u < {m} THEN {m} * ln({m}.0 / ({m} - u)) ELSE raw END AS cardinality FROM t)"""


def _slot(v: str, a: float, bins: int) -> str:
    b = f"(greatest(0, CAST(ceil(ln(abs({v})) * {1 / math.log(gamma(a))!r}) AS BIGINT) + {bins // 4}) + 1)"
    return f"CASE WHEN {v} = 0 THEN 0 WHEN {b} <= {bins} THEN CASE WHEN {v} > 0 THEN {b} ELSE -{b} END END"


def _bound(slot: str, a: float, bins: int) -> str:
    size = f"pow({gamma(a)!r}, abs({slot}) - {2 + bins // 4})"
    return f"CASE WHEN {slot} = 0 THEN 0.0 WHEN {slot} > 0 THEN {size} ELSE -{size} END"


def _dd(rows: str, by: str, v: str, a: float, bins: int, qs: list[float]) -> str:
    """(by, q, estimate) of rows."""
    values = ", ".join(f"({q})" for q in qs)
    return f"""(WITH x AS (SELECT {by}, {v} AS v, {_slot(v, a, bins)} AS slot FROM {rows} WHERE isfinite({v})),
        g AS (SELECT {by}, count(*) AS n, max(v) AS top FROM x GROUP BY {by}), b AS (SELECT {by}, slot, count(*) AS c FROM x WHERE slot IS NOT NULL GROUP BY {by}, slot),
        r AS (SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY slot) AS upto FROM b)
        SELECT {', '.join('g.' + c.strip() for c in by.split(','))}, q, coalesce(min(CASE WHEN upto >= greatest(1, ceil(q * n)) THEN slot END), NULL) AS s,
               CASE WHEN s IS NULL THEN any_value(top) ELSE {_bound('s', a, bins)} END AS estimate
        FROM g LEFT JOIN r ON {' AND '.join(f'g.{c.strip()} IS NOT DISTINCT FROM r.{c.strip()}' for c in by.split(','))}, (VALUES {values}) t(q) GROUP BY {', '.join('g.' + c.strip() for c in by.split(','))}, q)"""


_EVENTS = "e AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value FROM events)"
_ORDER = "PARTITION BY event_type ORDER BY ts_ms, event_id"
_NUMBERED = f"{_EVENTS}, o AS (SELECT *, row_number() OVER ({_ORDER}) AS rn FROM e)"


def _blend(weight: float) -> str:
    """Rows with averages and variances before and after, by recursion over row numbers."""
    b = 1 - weight
    return f"""{_NUMBERED}, r AS (SELECT event_type, event_id, value, rn, value AS m, CAST(0 AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS m0, CAST(NULL AS DOUBLE) AS v0 FROM o WHERE rn = 1
        UNION ALL SELECT o.event_type, o.event_id, o.value, o.rn, r.m + {weight!r} * (o.value - r.m), {b!r} * (r.v + {weight!r} * (o.value - r.m) * (o.value - r.m)), r.m, r.v FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1)"""


def _windows(rows: str, by: str, width: int, a: float, bins: int, start: str = "ts_ms - ts_ms % {w}", value: str = "value") -> str:
    """Window result rows of rows, by window start."""
    s = start.format(w=width)
    return f"""(WITH z AS (SELECT {by}, {s} AS start_ms, {value} AS value FROM {rows}),
        a AS (SELECT {by}, start_ms, count(*) AS event_count, avg(value) AS mean, min(value) AS min, max(value) AS max FROM z GROUP BY ALL),
        q AS (SELECT {by}, start_ms, max(CASE WHEN q = 0.5 THEN estimate END) AS p50, max(CASE WHEN q = 0.99 THEN estimate END) AS p99 FROM {_dd('z', by + ', start_ms', 'value', a, bins, [0.5, 0.99])} GROUP BY ALL)
        SELECT a.*, start_ms + {width} AS end_ms, p50, p99 FROM a JOIN q USING ({by}, start_ms))"""


_RESULT = "start_ms, end_ms, event_count, 0.0 AS counter, 0.0 AS gauge, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean, min, max, CAST(CAST(p50 AS FLOAT) AS DOUBLE) AS p50, CAST(CAST(p99 AS FLOAT) AS DOUBLE) AS p99"


def _uniform(purpose: str, row: str) -> str:
    return f"((CAST('0x' || substr(sha256('{SEED}:{purpose}:' || {row}), 1, 13) AS BIGINT) + 0.5) / {float(16**13)!r})"


def _laplace(v: str, row: str, scale: float) -> str:
    u = f"({_uniform('laplace', row)} - 0.5)"
    return f"({v} - sign({u}) * {scale!r} * ln(1 - 2 * abs({u})))"


def _draw(purpose: str, row: str) -> str:
    return " || ".join(f"sha256('{SEED}:{purpose}{k}:' || {row})" for k in range(4))


def _bits() -> str:
    """CTE ``rep`` (p_partkey, p_size, bits): reports as lists of 0 and 1."""
    part = "CAST('0x' || substr({d}, CAST(4 * i + 1 AS BIGINT), 4) AS INTEGER)"
    held = ", ".join(f"CAST({_fnv(_word('size') + ' || ' + _word(str(i)))} % 64 AS INTEGER)" for i in range(3))
    kept = f"CASE WHEN {part.format(d='flip')} < 32768 THEN {part.format(d='coin')} < 32768 ELSE list_contains(b, i) END"
    return f"""f AS (SELECT size, [{held}] AS b FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS size FROM part)),
        dr AS (SELECT p_partkey, p_size, b, {_draw('flip', "p_partkey || ':' || p_size")} AS flip, {_draw('coin', "p_partkey || ':' || p_size")} AS coin, {_draw('tell', 'p_partkey')} AS tell FROM part JOIN f ON f.size = p_size),
        rep AS (SELECT p_partkey, p_size, list_transform(range(64), lambda i: CASE WHEN {part.format(d='tell')} < CASE WHEN {kept} THEN 49152 ELSE 16384 END THEN 1 ELSE 0 END) AS bits FROM dr)"""


def _snapshot(rows: str, key: str, a: float = 0.05, bins: int = 256) -> str:
    """Snapshot rows of events (key, type, value, item, seq)."""
    h = f"(SELECT {key}, value AS v FROM {rows} WHERE type = 'histogram')"
    q = f"SELECT {key}, " + ", ".join(f"max(CASE WHEN q = {x} THEN estimate END) AS {n}" for x, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + f" FROM {_dd(h, key, 'v', a, bins, [0.5, 0.95, 0.99])} GROUP BY ALL"
    items = f"(SELECT {key}, {_u('item')} AS h FROM {rows} WHERE type = 'unique' AND item IS NOT NULL)"
    return f"""(WITH a AS (SELECT {key}, coalesce(sum(value) FILTER (WHERE type = 'counter' AND isfinite(value)), 0) AS counter, coalesce(arg_max(value, seq) FILTER (WHERE type = 'gauge'), 0) AS gauge,
            coalesce(avg(value) FILTER (WHERE type = 'histogram' AND isfinite(value)), 0) AS mean, coalesce(min(value) FILTER (WHERE type = 'histogram' AND isfinite(value)), CAST('inf' AS DOUBLE)) AS min,
            coalesce(max(value) FILTER (WHERE type = 'histogram' AND isfinite(value)), CAST('-inf' AS DOUBLE)) AS max, count(*) AS event_count FROM {rows} GROUP BY {key}),
        q AS ({q}), c AS (SELECT * FROM {_hll(items, key, 10)})
        SELECT a.*, coalesce(cardinality, 0) AS cardinality, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99
        FROM a LEFT JOIN q ON q.{key} IS NOT DISTINCT FROM a.{key} LEFT JOIN c ON c.{key} IS NOT DISTINCT FROM a.{key})"""


_SNAP = "CAST(CAST(counter AS FLOAT) AS DOUBLE) AS counter, gauge, CAST(CAST(cardinality AS FLOAT) AS DOUBLE) AS cardinality, CAST(CAST(p50 AS FLOAT) AS DOUBLE) AS p50, CAST(CAST(p95 AS FLOAT) AS DOUBLE) AS p95, CAST(CAST(p99 AS FLOAT) AS DOUBLE) AS p99, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean, min, max, event_count"
_STREAM = f"""{_EVENTS}, k AS (SELECT *, {_signed(_fnv(_text('event_type')))} AS name_hash FROM (SELECT DISTINCT event_type FROM e)),
    us AS (SELECT user_id, {_signed(_hash_long('user_id'))} AS item FROM (SELECT DISTINCT user_id FROM e)),
    m AS (SELECT name_hash, event_id AS seq, unnest(['counter', 'gauge', 'histogram', 'unique']) AS type, unnest([1.0, value, value, NULL]) AS value, unnest([NULL, NULL, NULL, item]) AS item FROM e JOIN k USING (event_type) JOIN us USING (user_id))"""
_DELIVERIES = "m AS (SELECT DISTINCT name_hash, lower(trim(metric_type)) AS type, value, item_hash AS item, ts_ms, seq FROM metric_events WHERE ts_ms >= 946684800000)"
_PAYLOADS = "m AS (SELECT DISTINCT seq, metric_type, name_hash, value FROM metric_events WHERE {w})"
_KNOWN = "lower(trim(metric_type)) IN ('counter', 'gauge', 'histogram', 'unique')"


def _cms(width: int, depth: int) -> str:
    col = f"{_steps(f'CAST((h + CAST(r AS UHUGEINT) * {ROW_STRIDE}) % {_U} AS UHUGEINT)', [MIX_1])} % {width}"
    return f"""k AS (SELECT o_custkey, {_hash_long('o_custkey')} AS h, count(*) AS c FROM orders GROUP BY ALL), x AS (SELECT h, c, unnest(range({depth})) AS r FROM k),
        y AS (SELECT h, c, CAST(r AS INTEGER) AS row, CAST({col} AS INTEGER) AS col FROM x), s AS (SELECT row, col, CAST(sum(c) AS BIGINT) AS n FROM y GROUP BY ALL)"""


_SNAP_TEXT = f"WITH {_STREAM}, s AS (SELECT * FROM {_snapshot('m', 'name_hash')})"


def _number(c: str) -> str:
    return f"regexp_replace(CAST(round({c}, 3) AS VARCHAR), '\\.0$', '')"


_FLOATS = ["counter", "gauge", "cardinality", "p50", "p95", "p99", "mean", "min", "max"]
_JSON = "'{\"name_hash\":' || h || " + " || ".join(f"',\"{c}\":' || {_number(c)}" for c in _FLOATS) + " || ',\"event_count\":' || event_count || '}'"


def _sample(name: str, column: str, labels: str = "", kind: str = "") -> str:
    head = f"'# TYPE app_{name} {kind}' || chr(10) || " if kind else ""
    value = column if column == "event_count" else _number(column)
    return f"{head}'app_{name}{{name_hash=\"' || h || '\"{labels}}} ' || {value} || chr(10)"


_PROMETHEUS = " || ".join([
    _sample("counter", "counter", kind="counter"), _sample("gauge", "gauge", kind="gauge"), _sample("cardinality", "cardinality", kind="gauge"), _sample("latency", "p50", ',quantile="0.5"', "summary"),
    _sample("latency", "p95", ',quantile="0.95"'), _sample("latency", "p99", ',quantile="0.99"'), _sample("events_total", "event_count"),
])

_TRUTH = math.e / (1 + math.e)
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS row, '{b}' AS col, CAST(CAST(covar_samp({a}, {b}) AS FLOAT) AS DOUBLE) AS covariance, {'1.0' if a == b else f'CAST(CAST(corr({a}, {b}) AS FLOAT) AS DOUBLE)'} AS correlation, count(*) AS count FROM lineitem GROUP BY l_returnflag"
    for a in _MEASURES for b in _MEASURES
)
_MAD = f"""{_NUMBERED}, w AS (SELECT *, median(value) OVER b AS med, mad(value) OVER b AS dev FROM o WINDOW b AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    j AS (SELECT *, rn - 1 AS seen, abs(value - med) AS off FROM w),
    mad AS (SELECT event_type, event_id, rn, coalesce(med, 0) AS mad_median, coalesce(dev, 0) AS mad, CASE WHEN seen < 3 THEN 0.0 WHEN dev < 1e-10 THEN CASE WHEN off > 1e-10 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END ELSE off / (dev * 1.4826) END AS mad_score,
        CASE WHEN seen < 3 THEN false WHEN dev < 1e-10 THEN off > 1e-10 ELSE off > 3 * dev * 1.4826 END AS mad_anomaly FROM j)"""
_EWMA = """ew AS (SELECT event_type, event_id, m0 AS ewma, sqrt(v0) AS ewma_std, CASE WHEN rn = 1 THEN 0.0 WHEN sqrt(v0) < 1e-10 THEN CASE WHEN abs(value - m0) > 1e-10 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END ELSE abs(value - m0) / sqrt(v0) END AS ewma_score,
        CASE WHEN rn <= 3 THEN false WHEN sqrt(v0) < 1e-10 THEN abs(value - m0) > 1e-10 ELSE abs(value - m0) > 3 * sqrt(v0) END AS ewma_anomaly FROM r)"""
_Z = """zw AS (SELECT *, coalesce(avg(value) OVER b, 0) AS zm, CASE WHEN rn < 3 THEN 0.0 ELSE stddev_samp(value) OVER b END AS zs FROM o WINDOW b AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT event_type, event_id, zm AS z_mean, zs AS z_std, CASE WHEN zs < 1e-10 THEN CASE WHEN abs(value - zm) > 1e-10 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END ELSE (value - zm) / zs END AS z_score,
        CASE WHEN rn <= 3 THEN false WHEN zs < 1e-10 THEN abs(value - zm) > 1e-10 ELSE abs(value - zm) > 3 * zs END AS z_anomaly FROM zw)"""
_ALL = f"WITH RECURSIVE {_blend(0.1)}, {_MAD.replace(_NUMBERED + ', ', '')}, {_EWMA}, {_Z}, every_one AS (SELECT *, greatest(mad_score, ewma_score, abs(z_score)) AS score FROM mad JOIN ew USING (event_type, event_id) JOIN z USING (event_type, event_id))"
_FIRST = "CASE WHEN ts_ms < t0 + {w} THEN t0 ELSE ts_ms - ts_ms % {w} END"


def _closed(level: int, rows: str, width: int) -> str:
    """CTEs of one roll-up level over (event_type, ts_ms, value): w{level} result rows, n{level} what goes on."""
    return f"""f{level} AS (SELECT *, {_FIRST.format(w=width)} AS start_ms FROM (SELECT *, min(ts_ms) FILTER (WHERE ts_ms > 0) OVER (PARTITION BY event_type) AS t0 FROM {rows})),
        w{level} AS (SELECT * FROM {_windows(f'f{level}', 'event_type', width, 0.05, 256, start='start_ms')}),
        c{level} AS (SELECT event_type, start_ms, lead(min(ts_ms)) OVER (PARTITION BY event_type ORDER BY start_ms) AS ts_ms, avg(value) AS value FROM f{level} GROUP BY event_type, start_ms),
        n{level} AS (SELECT event_type, ts_ms, value, start_ms AS closed FROM c{level} WHERE ts_ms IS NOT NULL)"""


_QUARTILES = ", ".join(f"CASE WHEN count(*) >= 4 THEN quantile_cont(l_extendedprice, {q}) END AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))

SQL = {
    "fnv_hash_u64": f"SELECT l_orderkey, l_linenumber, {_signed('h')} AS h FROM lineitem JOIN (SELECT o, {_hash_long('o')} AS h FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem)) ON o = l_orderkey",
    "fnv_hash_bytes": f"SELECT c_custkey, {_signed('a')} AS h, {_signed('b')} AS h_text FROM (SELECT c_custkey, {_fnv(_text('c_name'))} AS a, {_fnv(_text('c_name') + ' || [CAST(255 AS UHUGEINT)]')} AS b FROM customer)",
    "fnv_hash_u128": f"SELECT o_orderkey, {_signed('h')} AS h FROM (SELECT o_orderkey, {_fnv(_word('o_orderkey') + ' || ' + _word('o_custkey'))} AS h FROM orders)",
    "hll_cardinality": f"WITH k AS (SELECT l_returnflag, {_hash_long('l_partkey')} AS h FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)) "
    + " UNION ALL ".join(f"SELECT l_returnflag, {p} AS p, CAST(CAST(cardinality AS FLOAT) AS DOUBLE) AS cardinality FROM {_hll('k', 'l_returnflag', p)}" for p in (10, 12, 14, 16)),
    "hll_merge": f"WITH k AS (SELECT l_returnflag, {_hash_long('l_partkey')} AS h FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)) SELECT l_returnflag, CAST(CAST(cardinality AS FLOAT) AS DOUBLE) AS cardinality FROM {_hll('k', 'l_returnflag', 14)}",
    "dd_quantiles": f"SELECT l_returnflag, CAST(q AS DOUBLE) AS q, CAST(CAST(estimate AS FLOAT) AS DOUBLE) AS estimate FROM {_dd('lineitem', 'l_returnflag', 'l_extendedprice', 0.01, 2048, [0.5, 0.95, 0.99])}",
    "dd_signed": f"SELECT c_mktsegment, CAST(q AS DOUBLE) AS q, CAST(CAST(estimate AS FLOAT) AS DOUBLE) AS estimate FROM {_dd('customer', 'c_mktsegment', 'c_acctbal', 0.02, 256, [0.05, 0.5, 0.99])}",
    "dd_merge": f"""SELECT l_returnflag, count, sum, mean, min, max, 0 AS dropped, 0 AS non_finite, CAST(CAST(estimate * {gamma(0.01)!r} * {2 / (gamma(0.01) + 1)!r} AS FLOAT) AS DOUBLE) AS p90_middle
        FROM (SELECT l_returnflag, count(*) AS count, CAST(CAST(sum(l_extendedprice) AS FLOAT) AS DOUBLE) AS sum, CAST(CAST(avg(l_extendedprice) AS FLOAT) AS DOUBLE) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL)
        JOIN {_dd('lineitem', 'l_returnflag', 'l_extendedprice', 0.01, 2048, [0.9])} USING (l_returnflag)""",
    "cms_estimate": f"WITH {_cms(1024, 5)} SELECT {_signed('h')} AS h, estimate FROM (SELECT h, min(n) AS estimate FROM y JOIN s USING (row, col) GROUP BY h)",
    "cms_merge": f"WITH {_cms(2048, 7)} SELECT * FROM s",
    "cms_total": f"SELECT count(*) AS total, round(count(*) * {math.e / 2048!r}, 6) AS error_bound, {round(1 - math.exp(-7), 9)!r} AS confidence FROM orders",
    "heavy_hitters": "SELECT o_custkey, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, o_custkey LIMIT 20",
    "heavy_hitters_estimated": f"WITH {_cms(1024, 5)} SELECT {_signed('h')} AS h, estimate FROM (SELECT h, min(n) AS estimate FROM y JOIN s USING (row, col) GROUP BY h) ORDER BY estimate DESC, h LIMIT 10",
    "percentile_rank": "SELECT l_returnflag, CAST(CAST(sum(CASE WHEN abs(l_quantity - 25) < 1e-15 THEN 0.5 WHEN l_quantity < 25 THEN 1 ELSE 0 END) / count(*) * 100 AS FLOAT) AS DOUBLE) AS percentile_rank FROM lineitem GROUP BY ALL",
    "iqr": f"SELECT l_returnflag, CAST(CAST(q1 AS FLOAT) AS DOUBLE) AS q1, CAST(CAST(median AS FLOAT) AS DOUBLE) AS median, CAST(CAST(q3 AS FLOAT) AS DOUBLE) AS q3, CAST(CAST(q3 - q1 AS FLOAT) AS DOUBLE) AS iqr, CAST(CAST(q1 - 1.5 * (q3 - q1) AS FLOAT) AS DOUBLE) AS lower_fence, CAST(CAST(q3 + 1.5 * (q3 - q1) AS FLOAT) AS DOUBLE) AS upper_fence FROM (SELECT l_returnflag, {_QUARTILES} FROM lineitem GROUP BY ALL)",
    "quantile_linear": "SELECT c_nationkey, CAST(q AS DOUBLE) AS q, CAST(CAST(quantile_cont(c_acctbal, [0.0, 0.1, 0.5, 0.99, 1.0])[i] AS FLOAT) AS DOUBLE) AS value FROM customer, (VALUES (0.0, 1), (0.1, 2), (0.5, 3), (0.99, 4), (1.0, 5)) t(q, i) GROUP BY c_nationkey, q, i",
    "covariance_matrix": _PAIRS,
    "streaming_stats": """WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS a FROM lineitem GROUP BY ALL), c AS (SELECT l_returnflag, l_quantity - a AS x, l_quantity FROM lineitem JOIN m ON f = l_returnflag)
        SELECT l_returnflag, count(*) AS count, CAST(CAST(avg(l_quantity) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(var_pop(l_quantity) AS FLOAT) AS DOUBLE) AS variance, CAST(CAST(var_samp(l_quantity) AS FLOAT) AS DOUBLE) AS sample_variance, CAST(CAST(stddev_pop(l_quantity) AS FLOAT) AS DOUBLE) AS std_dev,
               CAST(CAST(avg(x * x * x) / pow(avg(x * x), 1.5) AS FLOAT) AS DOUBLE) AS skewness, CAST(CAST(avg(x * x * x * x) / pow(avg(x * x), 2) - 3 AS FLOAT) AS DOUBLE) AS kurtosis, min(l_quantity) AS min, max(l_quantity) AS max FROM c GROUP BY l_returnflag""",
    "linreg": """SELECT l_returnflag, count(*) AS count, CAST(CAST(regr_slope(l_extendedprice, l_quantity) AS FLOAT) AS DOUBLE) AS slope, CAST(CAST(regr_intercept(l_extendedprice, l_quantity) AS FLOAT) AS DOUBLE) AS intercept, CAST(CAST(regr_r2(l_extendedprice, l_quantity) AS FLOAT) AS DOUBLE) AS r_squared,
        CAST(CAST(regr_slope(l_extendedprice, l_quantity) * 30 + regr_intercept(l_extendedprice, l_quantity) AS FLOAT) AS DOUBLE) AS at_30 FROM lineitem GROUP BY ALL""",
    "change_rate": f"""WITH {_EVENTS}, p AS (SELECT event_type, ts_ms, arg_min(value, event_id) AS v FROM e GROUP BY ALL),
        q AS (SELECT *, (v - lag(v) OVER w) / (ts_ms - lag(ts_ms) OVER w) AS rate FROM p WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms))
        SELECT event_type, event_id, CAST(CAST(coalesce(rate, CASE WHEN row_number() OVER (PARTITION BY event_type, ts_ms ORDER BY event_id) > 1 THEN 0.0 END) AS FLOAT) AS DOUBLE) AS rate FROM e JOIN q USING (event_type, ts_ms)""",
    "ema_series": f"WITH RECURSIVE {_blend(0.2)} SELECT event_type, event_id, CAST(CAST(m AS FLOAT) AS DOUBLE) AS ema FROM r",
    "ema_final": f"""WITH {_EVENTS}, l AS (SELECT event_type, list(value ORDER BY ts_ms, event_id) AS v FROM e GROUP BY ALL)
        SELECT event_type, CAST(CAST(list_reduce(v, lambda a, x: a + 0.1 * (x - a)) AS FLOAT) AS DOUBLE) AS ema, len(v) AS count FROM l""",
    "sma": f"WITH {_EVENTS} SELECT event_type, event_id, CAST(CAST(avg(value) OVER ({_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS FLOAT) AS DOUBLE) AS sma FROM e",
    "tumbling": f"WITH {_EVENTS} SELECT event_type, {_RESULT} FROM {_windows('e', 'event_type', HOUR, 0.01, 2048)}",
    "tumbling_compat": f"WITH {_EVENTS}, f AS (SELECT *, min(ts_ms) FILTER (WHERE ts_ms > 0) OVER (PARTITION BY event_type) AS t0 FROM e) SELECT event_type, {_RESULT} FROM {_windows('f', 'event_type', SIX_HOURS, 0.01, 2048, start=_FIRST)}",
    "rollup_3level": f"WITH {_EVENTS} " + " UNION ALL ".join(f"SELECT event_type, {k} AS level, {_RESULT} FROM {_windows('e', 'event_type', w, 0.01, 2048)}" for k, w in enumerate((HOUR, SIX_HOURS, DAY))),
    "rollup_of_means": f"WITH {_EVENTS}, {_closed(0, 'e', HOUR)}, {_closed(1, 'n0', SIX_HOURS)}, {_closed(2, 'n1', DAY)} "
    + " UNION ALL ".join(f"SELECT event_type, {k} AS level, {_RESULT} FROM w{k} WHERE (event_type, start_ms) IN (SELECT event_type, max(closed) FROM n{k} GROUP BY event_type)" for k in range(3)),
    "sliding_stats": f"""WITH {_EVENTS} SELECT event_type, event_id, count(value) OVER w AS win_count, CAST(CAST(sum(value) OVER w AS FLOAT) AS DOUBLE) AS win_sum, CAST(CAST(avg(value) OVER w AS FLOAT) AS DOUBLE) AS win_mean, min(value) OVER w AS win_min, max(value) OVER w AS win_max,
        CAST(CAST(var_pop(value) OVER w AS FLOAT) AS DOUBLE) AS win_var, CAST(CAST(stddev_pop(value) OVER w AS FLOAT) AS DOUBLE) AS win_std FROM e WINDOW w AS ({_ORDER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "hopping": f"""WITH {_EVENTS}, h AS (SELECT event_type, value, ts_ms - ts_ms % {HOUR} - unnest(range(6)) * {HOUR} AS start_ms FROM e)
        SELECT event_type, start_ms, start_ms + {SIX_HOURS} AS end_ms, count(*) AS event_count, CAST(CAST(sum(value) AS FLOAT) AS DOUBLE) AS sum, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS mean FROM h GROUP BY ALL""",
    "session_windows": f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER ({_ORDER}) < 1800000 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS id FROM g)
        SELECT event_type, min(ts_ms) AS start_ms, max(ts_ms) + 1800000 AS end_ms, count(*) AS event_count, CAST(CAST(sum(value) AS FLOAT) AS DOUBLE) AS sum FROM s GROUP BY event_type, id""",
    "streaming_median": f"WITH {_EVENTS} SELECT event_type, event_id, CAST(CAST(median(value) OVER ({_ORDER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS FLOAT) AS DOUBLE) AS median FROM e",
    "mad_score": f"WITH {_MAD} SELECT event_type, event_id, CAST(CAST(mad_median AS FLOAT) AS DOUBLE) AS mad_median, CAST(CAST(mad AS FLOAT) AS DOUBLE) AS mad, CAST(CAST(mad_score AS FLOAT) AS DOUBLE) AS mad_score, mad_anomaly FROM mad",
    "ewma_detect": f"WITH RECURSIVE {_blend(0.1)}, {_EWMA} SELECT event_type, event_id, CAST(CAST(ewma AS FLOAT) AS DOUBLE) AS ewma, CAST(CAST(ewma_std AS FLOAT) AS DOUBLE) AS ewma_std, CAST(CAST(ewma_score AS FLOAT) AS DOUBLE) AS ewma_score, ewma_anomaly FROM ew",
    "zscore": f"WITH {_NUMBERED}, {_Z} SELECT event_type, event_id, CAST(CAST(z_mean AS FLOAT) AS DOUBLE) AS z_mean, CAST(CAST(z_std AS FLOAT) AS DOUBLE) AS z_std, CASE WHEN z_score < CAST('inf' AS DOUBLE) THEN CAST(CAST(z_score AS FLOAT) AS DOUBLE) END AS z_score, z_anomaly FROM z",
    "composite": f"{_ALL} SELECT event_type, event_id, CASE WHEN score < CAST('inf' AS DOUBLE) THEN CAST(CAST(score AS FLOAT) AS DOUBLE) END AS score, mad_anomaly OR ewma_anomaly OR z_anomaly AS anomaly FROM every_one",
    "anomaly_events": f"{_ALL} SELECT event_type AS metric_id, ts_ms AS timestamp, value, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, CAST(CAST(mad_median AS FLOAT) AS DOUBLE) AS expected FROM every_one JOIN (SELECT event_type, event_id, ts_ms, value FROM e) USING (event_type, event_id) WHERE mad_anomaly AND ewma_anomaly AND z_anomaly",
    "metric_snapshot": f"WITH {_STREAM} SELECT name_hash, {_SNAP} FROM {_snapshot('m', 'name_hash')}",
    "metric_snapshot_events": f"WITH {_DELIVERIES} SELECT name_hash, {_SNAP} FROM {_snapshot('m', 'name_hash')}",
    "pipeline_counts": "SELECT 4 * count(*) AS total_events, count(DISTINCT event_type) AS metrics FROM events",
    "slot_compat": f"""WITH {_DELIVERIES}, t AS (SELECT *, CAST(name_hash & 127 AS INTEGER) AS slot_key FROM m WHERE name_hash IS NOT NULL), w AS (SELECT slot_key, arg_min(name_hash, seq) AS name_hash FROM t GROUP BY ALL)
        SELECT slot_key, name_hash, CAST(CAST(counter AS FLOAT) AS DOUBLE) AS counter, gauge, CAST(CAST(cardinality AS FLOAT) AS DOUBLE) AS cardinality, CAST(CAST(p50 AS FLOAT) AS DOUBLE) AS p50, CAST(CAST(p99 AS FLOAT) AS DOUBLE) AS p99, event_count FROM {_snapshot('t', 'slot_key')} JOIN w USING (slot_key)""",
    "registry_lookup": f"""WITH {_DELIVERIES}, c AS (SELECT name_hash, count(*) AS n_events FROM m GROUP BY ALL), r AS (SELECT name_hash, min(name) AS registered_name, min(lower(trim(metric_type))) AS registered_type FROM metric_registry WHERE name_hash IS NOT NULL GROUP BY ALL)
        SELECT c.name_hash, registered_name, registered_type, n_events FROM c LEFT JOIN r ON r.name_hash = c.name_hash""",
    "registry_names": f"""WITH n AS (SELECT name, {_signed(_fnv(_text('name')))} AS h FROM (SELECT DISTINCT name FROM metric_registry WHERE octet_length(encode(name)) < 64)),
        r AS (SELECT name_hash, min(lower(trim(metric_type))) AS registered_type FROM metric_registry GROUP BY ALL) SELECT n.name, name_hash, registered_type FROM n LEFT JOIN r ON name_hash = h""",
    "registry_register": f"""WITH n AS (SELECT DISTINCT p_name AS full_name FROM part WHERE p_name IS NOT NULL)
        SELECT substr(full_name, 1, 64) AS name, least(64, length(full_name)) AS name_len, {_signed(_fnv(_text('full_name')))} AS name_hash, 'gauge' AS metric_type FROM n""",
    "payload_roundtrip": f"""WITH {_PAYLOADS.format(w='NOT isnan(coalesce(value, 0))')}, g AS (SELECT *, coalesce({_KNOWN} AND name_hash IS NOT NULL AND value IS NOT NULL, false) AS ok FROM m)
        SELECT seq, CASE WHEN ok THEN 17 END AS size, CASE WHEN ok THEN lower(trim(metric_type)) END AS metric_type, CASE WHEN ok THEN name_hash END AS name_hash, CASE WHEN ok THEN value END AS value, NOT ok AS is_error FROM g""",
    "queue_consume": f"""WITH {_PAYLOADS.format(w='metric_type IS NOT NULL AND name_hash IS NOT NULL AND NOT isnan(value)')},
        t AS (SELECT name_hash, lower(trim(metric_type)) AS type, value, seq, CASE WHEN lower(trim(metric_type)) = 'unique' AND value >= 0 AND value < 18446744073709551616 THEN {_signed(_hash_long(_signed('CAST(value AS UHUGEINT)')))} END AS item FROM m WHERE {_KNOWN} AND seq % 7 <> 0 AND seq % 11 <> 0)
        SELECT name_hash, CAST(CAST(counter AS FLOAT) AS DOUBLE) AS counter, gauge, CAST(CAST(cardinality AS FLOAT) AS DOUBLE) AS cardinality, event_count FROM {_snapshot('t', 'name_hash')}""",
    "queue_counts": f"""WITH {_PAYLOADS.format(w='metric_type IS NOT NULL AND name_hash IS NOT NULL AND NOT isnan(value)')}
        SELECT count(*) AS total_consumed, CAST(sum(CASE WHEN {_KNOWN} AND seq % 7 <> 0 AND seq % 11 <> 0 THEN 0 ELSE 1 END) AS BIGINT) AS total_parse_errors FROM m""",
    "json_export": f"{_SNAP_TEXT}, u AS (SELECT *, CAST({_u('name_hash')} AS VARCHAR) AS h FROM s) SELECT name_hash, {_JSON} AS json FROM u",
    "prometheus_export": f"{_SNAP_TEXT}, u AS (SELECT *, CAST({_u('name_hash')} AS VARCHAR) AS h FROM s) SELECT name_hash, {_PROMETHEUS} AS text FROM u",
    "laplace_noise": f"SELECT c_custkey, round({_laplace('c_acctbal', 'c_custkey', 20.0)}, 6) AS noisy, CAST(round({_laplace('floor(c_acctbal)', 'c_custkey', 20.0)}) AS BIGINT) AS noisy_int FROM customer",
    "private_mean": f"""SELECT c_mktsegment, count(*) AS count, CAST(CAST(sum(x) AS FLOAT) AS DOUBLE) AS estimate_sum, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS estimate_mean, CAST(CAST({20 * math.sqrt(2)!r} / sqrt(count(*)) AS FLOAT) AS DOUBLE) AS standard_error
        FROM (SELECT c_mktsegment, {_laplace('c_acctbal', 'c_custkey', 20.0)} AS x FROM customer) GROUP BY ALL""",
    "rr_debias": f"""WITH s AS (SELECT o_orderpriority, CASE WHEN {_uniform('tell', 'o_orderkey')} < {_TRUTH!r} THEN o_orderstatus = 'F' ELSE {_uniform('coin', 'o_orderkey')} < 0.5 END AS said FROM orders),
        a AS (SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN said THEN 1 ELSE 0 END) AS BIGINT) AS yes FROM s GROUP BY ALL)
        SELECT o_orderpriority, n, yes, CAST(CAST(greatest(0, least(1, (yes / n - 0.5 + {0.5 * _TRUTH!r}) / {_TRUTH!r})) AS FLOAT) AS DOUBLE) AS share FROM a""",
    "rappor_bits": f"WITH {_bits()} SELECT p_partkey, array_to_string(bits, '') AS report FROM rep",
    "rappor_decode": f"""WITH {_bits()}, o AS (SELECT unnest(range(64)) AS i), t AS (SELECT i, count(*) AS n, sum(bits[i + 1]) AS ones FROM rep, o GROUP BY i), e AS (SELECT i, (ones - n * 0.375) / 0.25 AS estimate FROM t)
        SELECT size, CAST(CAST(min(estimate) AS FLOAT) AS DOUBLE) AS estimate FROM (SELECT size, unnest(b) AS i FROM f) JOIN e USING (i) GROUP BY size""",
    "privacy_budget": """WITH RECURSIVE a AS (SELECT o_custkey, o_orderkey, o_totalprice / CAST(400000 AS DOUBLE) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
        b AS (SELECT o_custkey, o_orderkey, rn, x <= 1.0 AS accepted, CASE WHEN x <= 1.0 THEN x ELSE 0.0 END AS spent FROM a WHERE rn = 1
            UNION ALL SELECT a.o_custkey, a.o_orderkey, a.rn, b.spent + x <= 1.0, CASE WHEN b.spent + x <= 1.0 THEN b.spent + x ELSE b.spent END FROM b JOIN a ON a.o_custkey = b.o_custkey AND a.rn = b.rn + 1)
        SELECT o_custkey, o_orderkey, accepted, CAST(CAST(spent AS FLOAT) AS DOUBLE) AS spent, CAST(CAST(greatest(0, 1.0 - spent) AS FLOAT) AS DOUBLE) AS remaining FROM b""",
}
