"""Pages of repeated keywords, links and product tags.

Every text is read whole. Its words are put into stretches: links with their
captions, and runs without function words that repeat their vocabulary. Density
(the share of characters in such stretches), entropy, repetition and
function-word share give a page its robust Mahalanobis distance from the pages
of its language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than this share of the characters makes a case, from this distance on (0.975 quantile of chi-square with 4 degrees).
SHARE, CUTOFF = 0.5, math.sqrt(11.143)
FEATURES = ("density", "entropy", "repetition", "function_words")
#: The sign of each feature's deviation towards spam.
SPAM = {"density": 1, "entropy": -1, "repetition": 1, "function_words": -1}
#: A shorter run without function words is a part of a sentence, and one shorter than LIST may be a part of an advert; a caption between links is not longer.
RUN, LIST, CAPTION, STRETCH = 7, 12, 4, 24
#: A word is near its last occurrence within so many words. A page's near words are keywords if they are so many, the first two below this share of them.
NEAR, KEYWORDS, FORM_SHARE = 4, 4, 0.8
#: A scan with a lesser share of words is unreadable.
READABLE = 0.2

FUNCTION_WORDS = {
    "en": "the of a to in and by for with at on was is has had been not upon an that we his from but while as our are were be which their its this it who after before until owing".split(),
    "de": "der die das und ein eine einen einer eines zu zum zur von vom bei mit dem den des im am auf um in für vor aus nach ist sich über bis als nicht unser wird".split(),
    "fr": "le la les de du des un une et à au aux en est sur par pour dans son sa s'est vient malgré sans que qui chez ce ont fait".split(),
    "es": "el los las del al con por se que una un su ha en sin para es y de la lo".split(),
}
_LINK = re.compile(r"https?|h[it1l]{1,2}[tlj]?p\s*:|://|//|www|vvw|wvv|href|\?\s*id|\.html?\b|l[o0]c[ao]lh|\.(?:test|examp|inval)|\]\(|</?a\b|[a-z]/[a-z]+[-_/?=]*\d|^/[a-z]+|^[#@][^\W\d_]{2}", re.I)
_BROKEN = re.compile(r"[-­‐‑¬=]\s*\n\s*")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){3,}[^\W\d_](?!\S)")
_LEET = str.maketrans("@013$5", "aoless")
_MARKS = re.compile("[\u0300-\u036f]")
_NUMBER = re.compile(r"\W*[a-z]?\d")
_WORD = re.compile(r"[^\W_]+")


def _plain(s: str) -> str:
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s)).replace("ſ", "s")
    return s.lower()


_FOLDS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "n"))
_ALIKE = str.maketrans("fcjlbu", "teiihn")


def _fold(w: str) -> str:
    """Letters that the scanner takes for each other made equal."""
    for a, b in _FOLDS:
        w = w.replace(a, b)
    return w.translate(_ALIKE)


_BY_LANGUAGE = {k: frozenset(_fold(_plain(w)) for w in v) for k, v in FUNCTION_WORDS.items()}
_ALL = frozenset().union(*_BY_LANGUAGE.values())


@lru_cache(1 << 16)
def _word(token: str) -> str:
    """The word of a token, disguises undone; '' without letters, '0' for a number."""
    letters = sum(c.isalpha() for c in token)
    if not letters or (letters < 3 and "@" not in token and "$" not in token and _NUMBER.match(token)):
        return "0" if any(c.isdigit() for c in token) else ""
    if any(c.isdigit() or c in "@$" for c in token):
        token = token.translate(_LEET)
    return _fold("".join(_WORD.findall(token)))


@lru_cache(1 << 16)
def _is_link(token: str) -> bool:
    return _LINK.search(token) is not None


def _mark_sentences(words: list[str], link: list[bool], spam: np.ndarray) -> None:
    """Marks stretches of STRETCH words whose own words are mostly repeated and follow each other closely, function words or not."""
    at = [k for k, w in enumerate(words) if w and not link[k]]
    all_own = [words[k] for k in at]
    content = [len(w) > 2 and w not in _ALL for w in all_own]
    close, last = [False] * len(at), {}
    for k, w in enumerate(all_own):
        if content[k]:
            close[k] = k - last.get(w, -9) <= 5
            last[w] = k
    if sum(close) <= 0.15 * STRETCH / 2:
        return
    for a in range(0, len(at) - STRETCH // 2, STRETCH // 4):
        b = min(a + STRETCH, len(at))
        if sum(close[a:b]) <= 0.15 * (b - a) or all_own[a:b].count("0") > 0.05 * (b - a):
            continue
        count = Counter(w for w, c in zip(all_own[a:b], content[a:b]) if c)
        if sum(c for c in count.values() if c > 1) > 0.6 * sum(count.values()):
            spam[at[a] : at[b - 1] + 1] = True


def measure(text: str | None) -> tuple[str, float, float, float, float]:
    """Language (by function words) and the FEATURES of one text."""
    t = _SPACED.sub(lambda m: re.sub(r"\s", "", m.group()), _BROKEN.sub("", _plain(text or "")))
    tokens = t.split()
    if not tokens:
        return "none", 0.0, 0.0, 0.0, 0.0
    words = [_word(k) for k in tokens]
    link = [_is_link(k) for k in tokens]
    size = np.array([len(k) + 1 for k in tokens])
    seen = Counter(w for w, is_link in zip(words, link) if not is_link and len(w) > 1)
    spam = np.array(link)
    at = np.flatnonzero(link)
    for a, b in zip(at[:-1], at[1:]):
        if b - a - 1 <= CAPTION:
            spam[a:b] = True
    # the caption before the first link of a list
    if len(at) > 2 and at[0] <= CAPTION:
        spam[: at[0]] = True
    often = 2 if len(tokens) > 80 else 1
    is_function = [w in _ALL for w in words]
    i, n = 0, len(tokens)
    close_runs, close_words = [], Counter()
    while i < n:
        if link[i] or is_function[i]:
            i += 1
            continue
        j = i
        while j < n and not link[j] and not is_function[j]:
            j += 1
        run = [w for w in words[i:j] if w]
        tags = len(run) > 2 and run[0].startswith(_fold("tag"))
        if len(run) >= RUN or tags:
            numbers = run.count("0") / len(run)
            letters = [w for w in run if w != "0"]
            again = sum(seen.get(w, 0) > often for w in letters) / max(1, len(letters))
            near = [w for k, w in enumerate(run) if w != "0" and w in run[max(0, k - NEAR) : k]]
            if sum(len(w) > 2 for w in run) / (j - i) > 0.35:
                if numbers < 0.05 and again > 0.6 and (tags or len(run) >= LIST):
                    spam[i:j] = True
                elif numbers < 0.25 and len(near) > 0.12 * len(run):
                    close_runs.append((i, j, len(near) / len(run), numbers))
                    close_words.update(near)
        i = j
    # notices in one form repeat the few words of the form, in short runs or between numbers; keywords are many, or fill long runs
    many = len(close_words) >= KEYWORDS and sum(c for _, c in close_words.most_common(2)) < FORM_SHARE * sum(close_words.values())
    for i, j, share, numbers in close_runs:
        long = j - i >= STRETCH or j - i > 0.8 * n
        if many and share > 0.15 or long and share > (0.22 if numbers < 0.05 else 0.5):
            spam[i:j] = True
    _mark_sentences(words, link, spam)
    if sum(len(w) > 2 for w in words) < READABLE * n:
        spam[:] = False  # an unreadable scan
    real = [w for w in words if w]
    counts = Counter(real)
    by_language = {k: sum(counts[w] for w in v if w in counts) for k, v in _BY_LANGUAGE.items()}
    language = max(by_language, key=by_language.get)
    total = max(1, len(real))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values()) / math.log2(max(2, total))
    density = float(size[spam].sum() / size.sum())
    return language, density, entropy, 1 - len(counts) / total, by_language[language] / total


def features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``language`` and the FEATURES.

    Texts are read whole. Null, empty and blank ones have language 'none' and
    features of 0, as have texts without words; null and repeated ids are rows of
    their own; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = pd.DataFrame([measure(t) for t in p[text]], columns=["language", *FEATURES])
            out.insert(0, doc_id, p[doc_id].to_numpy())
            yield out

    return docs.select(doc_id, text).mapInPandas(rows, f"`{doc_id}` {kind}, language string, " + ", ".join(f"{f} double" for f in FEATURES))


def distances(rows: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``direction``: the robust Mahalanobis distance from the middle of the language, and how far it points towards spam.

    The middle is the medians, the scatter the covariance of deviations cut at
    three robust deviations. A deviation is never taken as smaller than 0.02,
    since most pages have no such stretch at all. Spam lies towards more density
    and repetition, less entropy and fewer function words: the direction is the
    sum of the deviations with these signs. There are five languages at most
    ('none' among them), so the tables by language are tiny.
    """
    middle = rows.groupBy("language").agg(*[F.percentile_approx(f, 0.5, 10000).alias(f"m_{f}") for f in FEATURES])
    off = rows.join(F.broadcast(middle), "language")
    spread = off.groupBy("language").agg(*[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 10000), F.lit(0.02)).alias(f"s_{f}") for f in FEATURES])
    off = off.join(F.broadcast(spread), "language")
    z = [(F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in FEATURES]
    cut = [F.greatest(F.least(c, F.lit(3.0)), F.lit(-3.0)) for c in z]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = off.groupBy("language").agg(*[F.avg(cut[i] * cut[j]).alias(f"c{i}{j}") for i, j in pairs]).collect()
    inverse = {}
    for r in sums:
        c = np.zeros((len(z), len(z)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}{j}"]
        inverse[r["language"]] = np.linalg.inv(c + 0.05 * np.eye(len(z)))
    square = F.lit(None).cast("double")
    for language, m in inverse.items():
        total = sum((F.lit(float(m[i, j])) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
        square = F.when(F.col("language") == language, total).otherwise(square)
    return off.withColumn("distance", F.sqrt(F.greatest(square, F.lit(0.0)))).withColumn("direction", sum((c * SPAM[f] for c, f in zip(z, FEATURES)), F.lit(0.0))).select(*rows.columns, "distance", "direction")
