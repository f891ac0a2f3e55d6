"""Quality rules whose cutoffs bound the share of good documents that they reject.

For each rule a fixed grid of cutoffs is tried on labelled documents, from the loosest inward up
to the first that fails (fixed-sequence testing, which needs no correction for their number). Per
stratum (language) the good documents beyond a cutoff are counted, and the exact
(Clopper-Pearson) upper bound of their share is taken at a confidence that is divided by the
number of rules and strata (Bonferroni). The last cutoff with a bound of at most ``risk`` divided
among the rules is used, so the rules together reject at most ``risk`` of the good documents of any
stratum, with the stated confidence. A stratum with fewer labels than ``labels_needed`` gets no
cutoff; ``report`` tells which.

The bound counts independent trials, so a text is one trial of its stratum, however many
documents have exactly it and however often they are labelled; it counts as good if no label of
any of them says otherwise.

Base rules are fixed: under 50 words, or over half of the words in repeated three-word windows.

Defined cases: null text counts as empty and fails the base rules; a null language is a stratum;
repeated documents and labels change no cutoff; labels that are null are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batches, tidy, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Greatest share of good documents of a stratum that the rules together may reject, and the
#: probability that this fails for any stratum.
RISK, DELTA = 0.02, 0.05
#: Bins of a rule's value, which lies between 0 and 1; cutoffs are their upper edges.
BINS = 100
#: Rules: share of symbols, of repeated lines, of repeated words, and closeness of the mean word
#: length to either end. A document is rejected if its value is above the cutoff.
RULES = ("symbols", "dup_lines", "repeats", "short_words", "long_words")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DIGEST = "_text_digest"
_ROW = T.StructType([*[T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_lines")], T.StructField(_DIGEST, T.BinaryType())])


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    data = text.encode()
    words = data.split()  # of bytes, so at ASCII white space alone
    n = len(words)
    space = len(data) - sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        m = len(number)
        pair = ids[:-1] * m + ids[1:]
        if m < 2_000_000:  # the product of three stays within 63 bits
            key = pair[:-1] * m + ids[2:]
        else:
            key = np.unique(pair, return_inverse=True)[1][:-1] * m + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            inside = np.zeros(n, dtype=bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeat = int(inside.sum())
    return n, len(text) - space, symbols, dup, repeat, len(lines)


def counts(docs: DataFrame) -> DataFrame:
    """Docs without their text, with its counts and digest; read where the texts lie, without a shuffle."""
    kept = [f.name for f in docs.schema.fields if f.name != "text"]

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            made = [pa.array(c, pa.int64()) for c in zip(*map(text_counts, texts))] + [pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())]
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(cols + made, names=kept + [f.name for f in _ROW])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + list(_ROW)))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_bins(df: DataFrame) -> DataFrame:
    """Adds bin_<rule>: the value's bin from 0 to BINS - 1."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    value = {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / n,
        "short_words": F.lit(1.0) / (F.lit(1.0) + mean),
        "long_words": mean / (mean + F.lit(20.0)),
    }
    return df.withColumns({f"bin_{r}": F.least(F.lit(BINS - 1), F.floor(value[r] * BINS)).cast("int") for r in RULES})


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 1_000_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d, c = 1 / (1 + t * d), 1 + t / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) / a * out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the share p at which k or fewer of n have probability delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_share(n - k, k + 1, 1 - mid) > delta else (lo, mid)
    return hi


def most_rejected(n: int, risk: float, delta: float) -> int:
    """The largest k whose upper bound among n is within the risk, or -1."""
    if upper_bound(0, n, delta) > risk:
        return -1
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if upper_bound(mid, n, delta) <= risk else (lo, mid)
    return lo


def labels_needed(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """Good labels of a stratum from which on a rule that rejects none of them gets a cutoff."""
    return math.ceil(math.log(delta / max(1, strata) / len(RULES)) / math.log1p(-risk / len(RULES)))


def trials(binned: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """(s, bin_<rule>): one row for each good text of a stratum that passes the base rules."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    held = binned.where(~base_failed()).join(known, F.col("doc_id") == F.col("_id"))
    texts = held.groupBy(F.col(stratum).alias("s"), _DIGEST).agg(F.min("_good").alias("_good"), *[F.min(f"bin_{r}").alias(f"bin_{r}") for r in RULES])
    return texts.where("_good = 1").drop(_DIGEST, "_good")


def cutoffs(binned: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> dict[str | None, dict[str, int]]:
    """Per stratum the highest bin that each rule lets pass, from all labelled documents.

    Good texts are counted by stratum, rule and bin on the cluster; what comes to the
    driver has strata x rules x bins rows.
    """
    held = trials(binned, labels, stratum)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES])).alias("x")
    table = held.select("s", rules).groupBy("s", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    hist: dict = {}
    for r in table.collect():
        hist.setdefault(r["s"], {}).setdefault(r["rule"], np.zeros(BINS, dtype=np.int64))[r["bin"]] += r["n"]
    tests = max(1, len(hist)) * len(RULES)
    out: dict = {}
    for s, by in hist.items():
        n = int(next(iter(by.values())).sum())
        most = most_rejected(n, risk / len(RULES), delta / tests)
        if most >= 0:
            above = {r: np.concatenate([h[::-1].cumsum()[::-1][1:], [0]]) for r, h in by.items()}
            # what lies above grows inward, so the first cutoff that passes is the last of the sequence
            out[s] = {r: int(np.argmax(a <= most)) for r, a in above.items()}
    return out


def apply_cutoffs(binned: DataFrame, cuts: dict, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept."""
    verdict = F.lit(False)
    for s, by in cuts.items():
        over = F.lit(False)
        for r, top in by.items():
            over = over | (F.col(f"bin_{r}") > top)
        verdict = verdict | (F.col(stratum).eqNullSafe(F.lit(s)) & over)
    return binned.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~verdict)


def report(binned: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per stratum its documents, good labelled texts past the base rules, the labels needed for a cutoff,
    and how many documents past the base rules each rule rejects (rejected_<rule>)."""
    cuts = cutoffs(binned, labels, stratum, risk, delta)
    rest = binned.where(~base_failed())
    n = trials(binned, labels, stratum).groupBy(F.col("s").alias("_s")).agg(F.count(F.lit(1)).alias("labels"))
    needed = labels_needed(n.count(), risk, delta)
    over = {r: F.lit(False) for r in RULES}
    for s, by in cuts.items():
        for r, top in by.items():
            over[r] = over[r] | (F.col(stratum).eqNullSafe(F.lit(s)) & (F.col(f"bin_{r}") > top))
    seen = rest.groupBy(stratum).agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(over[r]).alias(f"rejected_{r}") for r in RULES])
    told = seen.join(n, F.col(stratum).eqNullSafe(F.col("_s")), "left").drop("_s")
    return told.withColumns({"labels": F.coalesce("labels", F.lit(0)), "needed": F.lit(needed)})


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, counts, base_failed and kept for every document."""
    binned = written(rule_bins(counts(docs.select("doc_id", "lang", "text"))))
    out = apply_cutoffs(binned, cutoffs(binned, labels, risk=risk, delta=delta))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept")
