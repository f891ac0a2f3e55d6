"""Toxicity by a convolutional text classifier trained in numpy.

A word is four rows of hashed embedding tables side by side: two of the whole word, so that two
words are alike only if both hashes meet, one of its beginning and one of its ending, so that a word
never seen shares something with its family. Filters of several widths slide over the whole text,
each keeps its greatest value, and a logistic layer makes the score. Labels are learnt from a bounded
sample inside one task, so its texts never come to the driver; thresholds come per language from all
labelled documents of a fold that training leaves out.

Folds are crc32 of doc_id modulo 5: 0 is held out from everything, 4 sets the thresholds, the
others train. The score sees nothing but the text.

Defined cases: a null or empty text is one blank word; without labels every score is 0; a
language without labelled documents, null included, has the threshold 0.5; documents labelled
more than once count each time.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batches, expr_crc_fold, tidy, unused, written

HELD_FOLD, THRESHOLD_FOLD = 0, 4
#: Labelled documents of each class that training reads at most.
SAMPLE_ROWS = 2500
#: Characters of a class's sample: rows are taken by hash up to the one that reaches it, whatever its
#: length, so long texts are as likely to be learnt from as others.
SAMPLE_CHARS = 16_000_000
#: Bytes of text whose windows a task holds at a time.
SCORE_BYTES = 1 << 20
#: Embedding tables of the whole word, and lengths of its beginning and ending that have one each.
WHOLE, BEGINNING, ENDING = 2, 4, 3
TABLES, ROW_BITS, ROW_SIZE = WHOLE + 2, 16, 4
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, RATE, BATCH = 8, 0.02, 32
#: Bins of a score when thresholds are set, and the part of them that a threshold may take.
BINS = 200
LOWEST, HIGHEST = 0.2, 0.8

_WORD = re.compile(r"\w+")
_DIM = TABLES * ROW_SIZE


def word_rows(words: list[str]) -> np.ndarray:
    """Rows of each word in the embedding tables."""
    hashes = lambda texts: np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64)
    whole = hashes(words)
    rows = [whole >> np.uint64(ROW_BITS * i) for i in range(WHOLE)] + [hashes("^" + w[:BEGINNING] for w in words), hashes("$" + w[-ENDING:] for w in words)]
    return (np.stack(rows, axis=1) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)


@dataclass
class Texts:
    """Texts as numbers of distinct words; ends are padded so that no window meets the next text."""

    rows: np.ndarray  # of distinct words; the last is the pad
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        number: dict = defaultdict(count().__next__)
        pad = max(WIDTHS) - 1
        parts, starts, ends, at = [], [], [], 0
        for t in texts:
            ids = [number[w] for w in _WORD.findall((t or "").lower())] or [number[""]]
            parts.append(np.array(ids + [-1] * pad, dtype=np.int32))
            starts.append(at)
            ends.append(at + len(ids))
            at += len(ids) + pad
        return cls(word_rows(list(number)), np.concatenate(parts), np.array(starts), np.array(ends))


@dataclass
class Model:
    tables: np.ndarray  # TABLES x 2**ROW_BITS x ROW_SIZE
    filters: list[np.ndarray]  # width x _DIM x FILTERS
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float

    @classmethod
    def new(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda s, *n: rng.normal(0, s, n).astype(np.float32)
        return cls(normal(0.02, TABLES, 1 << ROW_BITS, ROW_SIZE), [normal(0.4, w, _DIM, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(normal(0.3, len(WIDTHS) * FILTERS)), -1.0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.concatenate([self.tables[i, rows[:, i]] for i in range(TABLES)], axis=1)
        return np.concatenate([v, np.zeros((1, _DIM), np.float32)])

    def features(self, x: Texts, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Greatest value of each filter over each text, and its places if asked for."""
        v = self.vectors(x.rows)
        tops, places = [], []
        bounds = np.stack([x.starts, x.ends], axis=1).reshape(-1)
        for f, b in zip(self.filters, self.biases):
            act = (v @ f[0])[x.ids] + b
            for j in range(1, len(f)):
                act[:-j] += (v @ f[j])[x.ids[j:]]
            if where:
                at = np.stack([s + act[s:e].argmax(axis=0) for s, e in zip(x.starts, x.ends)])
                places.append(at)
                tops.append(np.take_along_axis(act, at, axis=0))
            else:
                tops.append(np.maximum.reduceat(act, bounds[:-1] if bounds[-1] >= len(act) else bounds, axis=0)[::2])
        return np.concatenate(tops, axis=1), places

    def score(self, x: Texts) -> np.ndarray:
        top, _ = self.features(x)
        return 1 / (1 + np.exp(-(np.maximum(top, 0) @ self.weights + self.bias).astype(np.float64)))


def _adam(p, g, state, key, t):
    m, v = state.setdefault(key, (np.zeros_like(p), np.zeros_like(p)))
    m *= 0.9
    m += 0.1 * g
    v *= 0.999
    v += 0.001 * g * g
    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Adam on log loss. The gradient reaches only the windows that gave the greatest values."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    state: dict = {}
    sums = np.zeros_like(model.tables)  # squares of gradients of the tables, which are updated row by row
    mixed = rng.permutation(len(texts))
    packs = [mixed[i : i + BATCH] for i in range(0, len(texts), BATCH)]
    data = [(Texts.of([texts[k] for k in p]), labels[p].astype(np.float32)) for p in packs]
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            x, y = data[k]
            step += 1
            top, places = model.features(x, True)
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(hidden @ model.weights + model.bias)))
            d = (p - y) / len(y)
            g_top = d[:, None] * model.weights[None, :] * (top > 0)
            v = model.vectors(x.rows)
            g_rows = np.zeros((len(x.rows) + 1, _DIM), np.float32)
            for w, (f, at) in enumerate(zip(model.filters, places)):
                g = g_top[:, w * FILTERS : (w + 1) * FILTERS]
                g_f = np.zeros_like(f)
                for j in range(len(f)):
                    ids = x.ids[at + j]
                    g_f[j] = np.einsum("nfd,nf->df", v[ids], g)
                    np.add.at(g_rows, ids.reshape(-1), (g[:, :, None] * f[j].T[None]).reshape(-1, _DIM))
                _adam(f, g_f, state, ("f", w), step)
                _adam(model.biases[w], g.sum(axis=0), state, ("b", w), step)
            _adam(model.weights, hidden.T @ d, state, "w", step)
            bias = np.array([model.bias], np.float32)
            _adam(bias, np.array([d.sum()], np.float32), state, "o", step)
            model.bias = float(bias[0])
            hit = np.flatnonzero(np.abs(g_rows[:-1]).sum(axis=1))
            for i in range(TABLES):
                rows, part = x.rows[hit, i], g_rows[hit, i * ROW_SIZE : (i + 1) * ROW_SIZE]
                np.add.at(sums[i], rows, part * part)
                np.subtract.at(model.tables[i], rows, 0.1 * part / (np.sqrt(sums[i, rows]) + 1e-6))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic) of at most rows labelled documents of each class, chosen by hash, up to
    the one with which their texts reach chars; of a repeated doc_id one row.

    The chosen ids are bounded, so they are sent to the documents, not these to them.
    """
    fold, found = expr_crc_fold(F.col("doc_id")), docs.select("doc_id", "text")
    usable = labels.where(~fold.isin(HELD_FOLD, THRESHOLD_FOLD) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    pick = lambda k: usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("_id"), "toxic")
    of = lambda ids: found.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic")
    sizes = of(chosen).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < chars)
    return of(kept.select(F.col("doc_id").alias("_id"), "toxic")).agg(F.min("text").alias("text"))


@tidy
def _fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = sorted(((i, t or "", y) for b in it for i, y, t in zip(*(c.to_pylist() for c in b.columns))), key=str)
    y = np.array([t for *_, t in sample])
    if len(set(y.tolist())) == 2:
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(train([t for _, t, _ in sample], y))]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the sample, trained in one task, or None if the sample lacks either class."""
    made = training_rows(docs, labels, rows).select("doc_id", "toxic", "text").repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def score(docs: DataFrame, model: Model | None, columns: list[str], name: str = "score") -> DataFrame:
    """The columns with the score, made where the text is read."""
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is among the columns is not sent twice
    text = "text" if "text" in columns else unused(columns, "text")
    sent = list(columns) if text in columns else [*columns, text]
    at = sent.index(text)

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches(it, text, SCORE_BYTES):
            s = m.score(Texts.of(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(s, pa.float64())], names=[*columns, name])

    kept = docs.select(*columns).schema
    return docs.select(*[F.col(f"`{c}`") if c in docs.columns else F.col("text").alias(c) for c in sent]).mapInArrow(run, T.StructType([*kept.fields, T.StructField(name, T.DoubleType())]))


def thresholds(scored: DataFrame, labels: DataFrame, language: str = "lang") -> dict[str | None, float]:
    """Per language the threshold with the best F1 on the threshold fold, nearest to 0.5 on ties."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), "toxic")
    scored = scored.select("doc_id", language, "score")
    fold = scored.where(expr_crc_fold(F.col("doc_id")) == THRESHOLD_FOLD).join(known, F.col("doc_id") == F.col("_id"))
    table = fold.groupBy(language, F.least(F.lit(BINS - 1), F.floor(F.col("score") * BINS)).alias("bin")).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    bad: dict = defaultdict(lambda: np.zeros(BINS))
    good: dict = defaultdict(lambda: np.zeros(BINS))
    for r in table.collect():  # languages x bins
        bad[r[language]][r["bin"]] += r["bad"]
        good[r[language]][r["bin"]] += r["n"] - r["bad"]
    cuts = np.arange(int(LOWEST * BINS), int(HIGHEST * BINS) + 1)
    out = {}
    for k in bad:
        hit, wrong = (h[::-1].cumsum()[::-1][cuts] for h in (bad[k], good[k]))
        f1 = 2 * hit / np.maximum(1, hit + wrong + bad[k].sum())
        best = cuts[f1 >= f1.max() - 1e-12] if bad[k].sum() else np.array([BINS // 2])
        out[k] = float(best[np.abs(best - BINS / 2).argmin()]) / BINS
    return out


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns (doc_id and lang among them) with score, threshold and toxic, the verdict at the language's threshold."""
    columns = columns or ["doc_id", "lang"]
    scored = written(score(docs, fit(docs, labels, rows), columns))
    limit = F.lit(0.5)
    for k, v in thresholds(scored, labels).items():
        limit = F.when(F.col("lang").eqNullSafe(F.lit(k)), F.lit(v)).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Docs, in their columns, that are not judged toxic. The verdict rests on the text and its
    language alone, so one for each row is made as the texts are scored a second time, instead
    of keeping the texts beside a table of scores."""
    model = fit(docs, labels, rows)
    found = thresholds(written(score(docs.where(expr_crc_fold(F.col("doc_id")) == THRESHOLD_FOLD), model, ["doc_id", "lang"])), labels)
    limit = F.lit(0.5)
    for k, v in found.items():
        limit = F.when(F.col("lang").eqNullSafe(F.lit(k)), F.lit(v)).otherwise(limit)
    columns = list(docs.columns)
    mark = unused(columns, "_score")
    return score(docs, model, columns, mark).where(F.col(mark) < limit).select(*[F.col(f"`{c}`") for c in columns])
