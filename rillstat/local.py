"""In-memory counterparts of the relational operators, for small arrays, notebooks and the state of streams.

They take numpy arrays or lists a batch at a time. ``rows`` and ``from_rows``
exchange sketches with the relational form, so what a cluster has built can be
asked, or added to, in memory.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable

import numpy as np

from rillstat.functions import hashing
from rillstat.operators.anomaly import LEAST, MAD_SCALE, TINY, WINDOW
from rillstat.operators.cardinality import alpha
from rillstat.operators.frequency import cms_confidence, cms_error_bound, columns_of
from rillstat.operators.privacy import RAPPOR_BITS, RAPPOR_HASHES, truth_probability
from rillstat.operators.quantile import gamma

_MASK = 2**64 - 1


def hash_u64(values: Iterable[int]) -> np.ndarray:
    """Unsigned hashes of unsigned (or two's complement) 64-bit numbers."""
    return hashing.hash_words(np.array([v & _MASK for v in values], np.uint64))


def hash_bytes(data: bytes | str, *, as_text_value: bool = False) -> int:
    raw = data.encode() if isinstance(data, str) else bytes(data)
    tail = hashing.TEXT_END if as_text_value else None
    return int(hashing.hash_slices(np.frombuffer(raw or b"\0", np.uint8), np.array([0]), np.array([len(raw)]), tail)[0])


def hash_u128(value: int) -> int:
    return int(hashing.hash_words(np.array([value & _MASK], np.uint64), np.array([(value >> 64) & _MASK], np.uint64))[0])


class HyperLogLog:
    """Distinct counts by 2**p registers."""

    def __init__(self, p: int = 14):
        self.p = p
        self.registers = np.zeros(2**p, np.uint8)

    def insert_hashes(self, hashes: Iterable[int]) -> HyperLogLog:
        h = np.asarray(hashes, np.uint64)
        rest = h >> np.uint64(self.p)
        # the rest has at most 64 - p bits: its upper and lower half are exact as doubles
        high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
        length = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        np.maximum.at(self.registers, (h & np.uint64(2**self.p - 1)).astype(np.int64), (65 - self.p - length).astype(np.uint8))
        return self

    def insert_numbers(self, values: Iterable[int]) -> HyperLogLog:
        return self.insert_hashes(hash_u64(values))

    def insert_texts(self, texts: Iterable[str]) -> HyperLogLog:
        return self.insert_hashes([hash_bytes(t) for t in texts])

    def cardinality(self) -> float:
        m = float(2**self.p)
        raw = alpha(self.p) * m * m / float(np.sum(2.0 ** -self.registers.astype(float)))
        zeros = int(np.sum(self.registers == 0))
        return m * math.log(m / zeros) if raw <= 2.5 * m and zeros else raw

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        if other.p != self.p:
            raise ValueError("sketches of different size")
        np.maximum(self.registers, other.registers, out=self.registers)
        return self

    def clear(self) -> None:
        self.registers[:] = 0

    def rows(self) -> list[tuple[int, int]]:
        return [(int(i), int(self.registers[i])) for i in np.flatnonzero(self.registers)]

    @classmethod
    def from_rows(cls, rows: Iterable, p: int = 14) -> HyperLogLog:
        out = cls(p)
        for idx, rank in rows:
            out.registers[idx] = max(out.registers[idx], rank)
        return out

    def __repr__(self) -> str:
        return f"HyperLogLog(p={self.p}, cardinality={self.cardinality():.1f})"


class DDSketch:
    """Quantiles by logarithmic bins; semantics of ``operators.quantile``."""

    def __init__(self, a: float = 0.02, bins: int = 256):
        self.a, self.bins, self.gamma = a, bins, gamma(a)
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(2 * self.bins + 1, np.int64)  # slot s at s + bins
        self.count, self.sum, self.dropped, self.non_finite = 0, 0.0, 0, 0
        self.min, self.max = math.inf, -math.inf

    def insert(self, values: Iterable[float] | float) -> DDSketch:
        v = np.atleast_1d(np.asarray(values, float))
        ok = np.isfinite(v)
        self.non_finite += int(np.sum(~ok))
        v = v[ok]
        if not len(v):
            return self
        self.count, self.sum = self.count + len(v), self.sum + float(v.sum())
        self.min, self.max = min(self.min, float(v.min())), max(self.max, float(v.max()))
        with np.errstate(divide="ignore"):
            b = np.maximum(0, np.ceil(np.log(np.abs(v)) * (1 / math.log(self.gamma))) + self.bins // 4) + 1
        slot = np.where(v == 0, 0, np.sign(v) * b)
        inside = np.abs(slot) <= self.bins
        self.dropped += int(np.sum(~inside))
        np.add.at(self.slots, slot[inside].astype(np.int64) + self.bins, 1)
        return self

    @property
    def mean(self) -> float:
        return self.sum / self.count if self.count else 0.0

    def quantile(self, q: float) -> float:
        if not self.count:
            return 0.0
        upto = np.cumsum(self.slots)
        at = int(np.searchsorted(upto, max(1, math.ceil(q * self.count)), side="left"))
        if at == len(upto):
            return self.max
        s = at - self.bins
        return 0.0 if s == 0 else math.copysign(self.gamma ** (abs(s) - 2 - self.bins // 4), s)

    def merge(self, other: DDSketch) -> DDSketch:
        if (other.a, other.bins) != (self.a, self.bins):
            raise ValueError("sketches of different accuracy or size")
        self.slots += other.slots
        self.count, self.sum, self.dropped, self.non_finite = self.count + other.count, self.sum + other.sum, self.dropped + other.dropped, self.non_finite + other.non_finite
        self.min, self.max = min(self.min, other.min), max(self.max, other.max)
        return self

    def __repr__(self) -> str:
        return f"DDSketch(a={self.a}, bins={self.bins}, count={self.count})"


class CountMinSketch:
    """Frequencies by ``depth`` rows of ``width`` counters."""

    def __init__(self, width: int = 2048, depth: int = 7):
        self.width, self.depth = width, depth
        self.clear()

    def clear(self) -> None:
        self.counters = np.zeros((self.depth, self.width), np.int64)
        self.total = 0

    def _columns(self, hashes: Iterable[int]) -> np.ndarray:
        return columns_of(np.asarray(hashes, np.uint64), self.width, self.depth)

    def insert_hashes(self, hashes: Iterable[int], count: int = 1) -> CountMinSketch:
        cols = self._columns(hashes)
        for r in range(self.depth):
            np.add.at(self.counters[r], cols[:, r], count)
        self.total += count * len(cols)
        return self

    def insert_texts(self, texts: Iterable[str], count: int = 1) -> CountMinSketch:
        return self.insert_hashes([hash_bytes(t) for t in texts], count)

    def estimate_hash(self, h: int) -> int:
        cols = self._columns([h])[0]
        return int(min(self.counters[r, c] for r, c in enumerate(cols)))

    def estimate_text(self, text: str) -> int:
        return self.estimate_hash(hash_bytes(text))

    def error_bound(self) -> float:
        return cms_error_bound(self.width)

    def confidence(self) -> float:
        return cms_confidence(self.depth)

    def merge(self, other: CountMinSketch) -> CountMinSketch:
        if (other.width, other.depth) != (self.width, self.depth):
            raise ValueError("sketches of different size")
        self.counters += other.counters
        self.total += other.total
        return self

    def __repr__(self) -> str:
        return f"CountMinSketch({self.width}x{self.depth}, total={self.total})"


class HeavyHitters:
    """The ``k`` hashes of greatest estimate so far. A newcomer displaces the least one only with a greater estimate."""

    def __init__(self, k: int = 10, width: int = 1024, depth: int = 5):
        self.k, self.cms = k, CountMinSketch(width, depth)
        self.held: dict[int, int] = {}

    def insert_hashes(self, hashes: Iterable[int]) -> HeavyHitters:
        for h in map(int, hashes):
            n = self.cms.insert_hashes([h]).estimate_hash(h)
            if h in self.held or len(self.held) < self.k:
                self.held[h] = n
            else:
                least = min(self.held, key=self.held.__getitem__)
                if n > self.held[least]:
                    del self.held[least]
                    self.held[h] = n
        return self

    def top(self) -> list[tuple[int, int]]:
        """(hash, estimate), greatest first, ties by the lesser hash."""
        return sorted(self.held.items(), key=lambda e: (-e[1], e[0]))

    def clear(self) -> None:
        self.cms.clear()
        self.held.clear()


def _score(value: float, centre: float, scatter: float) -> float:
    if scatter < TINY:
        return math.inf if abs(value - centre) > TINY else 0.0
    return (value - centre) / scatter


class StreamingMedian:
    """Median of the last ``window`` values; 0 for none."""

    def __init__(self, window: int = WINDOW):
        self.last: deque[float] = deque(maxlen=window)
        self.ordered: list[float] = []

    def push(self, value: float) -> None:
        if len(self.last) == self.last.maxlen:
            del self.ordered[bisect_left(self.ordered, self.last[0])]
        self.last.append(value)
        insort(self.ordered, value)

    def median(self) -> float:
        n = len(self.ordered)
        return (self.ordered[(n - 1) // 2] + self.ordered[n // 2]) / 2 if n else 0.0

    def count(self) -> int:
        return len(self.ordered)

    def is_full(self) -> bool:
        return len(self.last) == self.last.maxlen

    def clear(self) -> None:
        self.last.clear()
        self.ordered.clear()


class _Detector:
    """``judge`` gives (centre, score, verdict) of a value and takes it in afterwards."""

    k: float

    def observe_batch(self, values: Iterable[float]) -> None:
        for v in values:
            self.observe(float(v))

    def is_anomaly_batch(self, values: Iterable[float]) -> np.ndarray:
        return np.array([self.is_anomaly(float(v)) for v in values], bool)

    def anomaly_score_batch(self, values: Iterable[float]) -> np.ndarray:
        return np.array([self.anomaly_score(float(v)) for v in values], float)

    def judge(self, value: float) -> tuple[float, float, bool]:
        out = self.expected(), self.anomaly_score(value), self.is_anomaly(value)
        self.observe(value)
        return out


class MadDetector(_Detector):
    def __init__(self, k: float = 3.0, window: int = WINDOW):
        self.k, self.held = k, StreamingMedian(window)

    def observe(self, value: float) -> None:
        self.held.push(value)

    def median(self) -> float:
        return self.held.median()

    expected = median

    def mad(self) -> float:
        if not self.held.ordered:
            return 0.0
        return float(np.median(np.abs(np.asarray(self.held.ordered) - self.median())))

    def anomaly_score(self, value: float) -> float:
        if self.count() < LEAST:
            return 0.0
        m = self.mad()
        return abs(_score(value, self.median(), 0.0 if m < TINY else m * MAD_SCALE))

    def is_anomaly(self, value: float) -> bool:
        score = self.anomaly_score(value)
        return score == math.inf or score > self.k

    def count(self) -> int:
        return self.held.count()

    def clear(self) -> None:
        self.held.clear()


class EwmaDetector(_Detector):
    def __init__(self, weight: float = 0.1, k: float = 3.0):
        self.weight, self.k = min(1.0, max(0.001, weight)), k
        self.reset()

    def reset(self) -> None:
        self.ewma, self.var, self.n = 0.0, 0.0, 0

    def observe(self, value: float) -> None:
        self.n += 1
        if self.n == 1:
            self.ewma = value
            return
        d = value - self.ewma
        self.ewma += self.weight * d
        self.var = (1 - self.weight) * (self.var + self.weight * d * d)

    def expected(self) -> float:
        return self.ewma

    def std_dev(self) -> float:
        return math.sqrt(self.var)

    def anomaly_score(self, value: float) -> float:
        return abs(_score(value, self.ewma, self.std_dev())) if self.n else 0.0

    def is_anomaly(self, value: float) -> bool:
        score = self.anomaly_score(value)
        return self.n >= LEAST and (score == math.inf or score > self.k)

    def count(self) -> int:
        return self.n


class ZScoreDetector(_Detector):
    def __init__(self, k: float = 3.0):
        self.k = k
        self.reset()

    def reset(self) -> None:
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def observe(self, value: float) -> None:
        self.n += 1
        d = value - self.mean
        self.mean += d / self.n
        self.m2 += d * (value - self.mean)

    def expected(self) -> float:
        return self.mean

    def variance(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0

    def std_dev(self) -> float:
        return math.sqrt(self.variance())

    def z_score(self, value: float) -> float:
        return _score(value, self.mean, self.std_dev())

    anomaly_score = z_score

    def is_anomaly(self, value: float) -> bool:
        z = abs(self.z_score(value))
        return self.n >= LEAST and (z == math.inf or z > self.k)

    def count(self) -> int:
        return self.n


class CompositeDetector(_Detector):
    """Any of the three, or all with ``consensus``."""

    def __init__(self, mad_k: float = 3.0, weight: float = 0.1, ewma_k: float = 3.0, z_k: float = 3.0, consensus: bool = False):
        self.parts = (MadDetector(mad_k), EwmaDetector(weight, ewma_k), ZScoreDetector(z_k))
        self.consensus = consensus

    def observe(self, value: float) -> None:
        for p in self.parts:
            p.observe(value)

    def expected(self) -> float:
        return self.parts[0].median()

    def anomaly_score(self, value: float) -> float:
        return max(abs(p.anomaly_score(value)) for p in self.parts)

    def is_anomaly(self, value: float) -> bool:
        return (all if self.consensus else any)(p.is_anomaly(value) for p in self.parts)

    def count(self) -> int:
        return self.parts[2].count()

    def reset(self) -> None:
        self.__init__(self.parts[0].k, self.parts[1].weight, self.parts[1].k, self.parts[2].k, self.consensus)


class ChangeRate:
    """Change per unit of time; rows of an earlier or the same time repeat the last rate and aren't taken in."""

    def __init__(self) -> None:
        self.last: tuple[float, int] | None = None
        self.rate = 0.0

    def observe(self, value: float, ts: int) -> float | None:
        if self.last is None:
            self.last = (value, ts)
            return None
        if ts > self.last[1]:
            self.rate = (value - self.last[0]) / (ts - self.last[1])
            self.last = (value, ts)
        return self.rate


class Ema:
    """Exponential moving average; the first value starts it."""

    def __init__(self, weight: float):
        if not 0 < weight <= 1:
            raise ValueError("weight must lie in (0, 1]")
        self.weight, self.value, self.n = weight, 0.0, 0

    def observe(self, value: float) -> float:
        self.n += 1
        self.value = value if self.n == 1 else self.value + self.weight * (value - self.value)
        return self.value


class XorShift64:
    """Shift-register generator of 64-bit numbers; not for secrets. Seed 0 is replaced."""

    # Fixed value: the state that stands for seed 0.
    ZERO = 0x853C49E6748FEA9B

    def __init__(self, seed: int):
        self.state = seed & _MASK or self.ZERO

    def next_u64(self) -> int:
        x = self.state
        for left, by in ((True, 13), (False, 7), (True, 17)):
            x ^= (x << by if left else x >> by) & _MASK
        self.state = x
        return x

    def next_float(self) -> float:
        """In [0, 1), from the upper 53 bits."""
        return (self.next_u64() >> 11) / 2.0**53

    def next_range(self, low: float, high: float) -> float:
        return low + self.next_float() * (high - low)

    def next_bool(self, p: float) -> bool:
        return self.next_float() < p


class LaplaceNoise:
    """Noise of scale sensitivity / epsilon from a seeded generator."""

    def __init__(self, sensitivity: float, epsilon: float, seed: int):
        self.scale, self.rng = sensitivity / epsilon, XorShift64(seed)

    def sample(self) -> float:
        u = self.rng.next_float() - 0.5
        return -math.copysign(1.0, u) * self.scale * math.log(max(1 - 2 * abs(u), 5e-324)) if u else 0.0

    def privatize(self, value: float) -> float:
        return value + self.sample()

    def privatize_batch(self, values: Iterable[float]) -> np.ndarray:
        return np.array([self.privatize(float(v)) for v in values])


class RandomizedResponse:
    """The truth with probability ``p_true``, a fair coin otherwise."""

    def __init__(self, seed: int, *, epsilon: float | None = None, p: float | None = None):
        self.p_true = truth_probability(epsilon) if epsilon is not None else min(1.0, max(0.5, p))
        self.rng = XorShift64(seed)

    def privatize(self, truth: bool) -> bool:
        return truth if self.rng.next_bool(self.p_true) else self.rng.next_bool(0.5)

    def estimate_proportion(self, n: int, yes: int) -> float:
        return min(1.0, max(0.0, (yes / n - 0.5 + 0.5 * self.p_true) / self.p_true)) if n else 0.0


class Rappor:
    """64-bit reports: lasting answers with probability ``f`` of a fair coin, then 1 told as 1 with ``p`` and 0 as 1 with ``q``."""

    def __init__(self, seed: int, f: float = 0.5, p: float = 0.75, q: float = 0.25):
        self.f, self.p, self.q = min(0.5, max(0.0, f)), min(1.0, max(0.0, p)), min(1.0, max(0.0, q))
        self.rng = XorShift64(seed)

    @staticmethod
    def bits(value: int) -> set[int]:
        return {hash_u128(value & _MASK | i << 64) % RAPPOR_BITS for i in range(RAPPOR_HASHES)}

    def privatize(self, value: int) -> list[int]:
        held = self.bits(value)
        lasting = [self.rng.next_bool(0.5) if self.rng.next_bool(self.f) else i in held for i in range(RAPPOR_BITS)]
        return [int(self.rng.next_bool(self.p if b else self.q)) for b in lasting]


class PrivateAggregator:
    """Sum and mean of reports with Laplace noise of a given scale."""

    def __init__(self, scale: float):
        self.scale = scale
        self.reset()

    def reset(self) -> None:
        self.sum, self.count = 0.0, 0

    def add(self, noisy: float) -> None:
        self.sum, self.count = self.sum + noisy, self.count + 1

    def estimate_sum(self) -> float:
        return self.sum

    def estimate_mean(self) -> float:
        return self.sum / self.count if self.count else 0.0

    def standard_error(self) -> float:
        return self.scale * math.sqrt(2 / self.count) if self.count else math.inf


class PrivacyBudget:
    """Grants requests while they fit; a refused one costs nothing."""

    def __init__(self, limit: float):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.spent, self.query_count = 0.0, 0

    def try_spend(self, epsilon: float) -> bool:
        if self.spent + epsilon > self.limit:
            return False
        self.spent, self.query_count = self.spent + epsilon, self.query_count + 1
        return True

    def remaining(self) -> float:
        return max(0.0, self.limit - self.spent)

    def is_exhausted(self) -> bool:
        return self.spent >= self.limit


class RingBuffer:
    """Queue of at most ``size - 1`` items that refuses the newest when full, and counts what it refused."""

    def __init__(self, size: int):
        self.size, self.items, self.dropped = size, deque(), 0

    def push(self, item) -> bool:
        if len(self.items) >= self.size - 1:
            self.dropped += 1
            return False
        self.items.append(item)
        return True

    def pop(self):
        return self.items.popleft() if self.items else None

    def __len__(self) -> int:
        return len(self.items)

    def is_full(self) -> bool:
        return len(self.items) >= self.size - 1
