"""Hard negatives by distributed radix selection of integer scores.

A row's score against an anchor is the inner product of whole-number vectors, so it is exact and
orders all rows. Each anchor and positive span a window of scores. The k best of the rows inside
are found digit by digit: tasks count rows by the leading digit of their distance from the
window's top, the counts are added up over all tasks, the digit that the kth row has is read off,
and the next round counts by the next digit among the rows that share it. In the end the kth
score is known, and one more pass gathers only rows above it and, of those at it, the ones with
the least ids. The positives of an anchor are found the same way, in a window that no score can
leave.

Rows are packed once into blocks of some thousand vectors, anchors into blocks of about a
thousand. A pass sends a few anchor blocks, of a bounded size, to all tasks, and each task
multiplies its blocks with them; no pair of rows is ever a row of a table. From the top a task
counts no further than it takes to reach k, as the kth of all rows cannot lie below the kth of
its own. So a round shuffles at most k numbers for each window and task, whatever the scores
or labels, and a value that very many rows share is one number.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component
take no part; of rows with one id that with the least label, then vector, counts; a shorter
vector has zeros for what it lacks; a window may be empty. Scores that a double cannot hold
exactly (2**53 and more) are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import written

#: Rows and anchors of a block, and bytes of anchor blocks that one pass sends to all tasks.
BLOCK_ROWS, BLOCK_ANCHORS, PASS_BYTES = 4096, 1024, 16 << 20
#: Gathered rows that a task hands over at a time.
GATHERED = 1 << 14
#: Bits of the digit by which a round counts.
DIGIT_BITS = 9
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90

_KEY = ("anchor_id", "positive_id")
_PACKED = "n int, dims int, ids binary, labels binary, data binary"
_COUNTS = "anchor_id long, positive_id long, bucket int, n long"
_FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v is each component times scale, rounded down."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    wide = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(vector).cast("array<double>").alias("v"))
    good = wide.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", usable))
    good = good.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))
    return good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_r")).select("vec_id", "_r.label", "_r.v")


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    sizes = np.diff(np.asarray(vectors.offsets))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _pack(it: Iterator[pa.RecordBatch], dims: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def put() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v = _matrix(t["v"].combine_chunks(), dims)
        ids, labels = (np.asarray(t[c], dtype=np.int64).tobytes() for c in ("vec_id", "label"))
        width = np.int16 if not v.size or np.abs(v).max() < 1 << 15 else np.int64
        # the width of a number follows from the bytes
        return pa.RecordBatch.from_pydict({"n": pa.array([t.num_rows], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": [ids], "labels": [labels], "data": [v.astype(width).tobytes()]})

    for b in it:
        while b.num_rows:
            room = block_rows - sum(x.num_rows for x in held)
            held.append(b.slice(0, room))
            b = b.slice(room)
            if sum(x.num_rows for x in held) == block_rows:
                yield put()
                held = []
    if held:
        yield put()


class _Anchors:
    """A block of anchors with their windows, flat: window w belongs to anchor owner[w]."""

    def __init__(self, anchors: pa.ListScalar, dims: int):
        a = anchors.values
        self.ids, self.labels = (np.asarray(a.field(c), dtype=np.int64) for c in ("anchor_id", "label"))
        self.v = _matrix(a.field("v"), dims)
        w = a.field("w")
        self.starts = np.concatenate([[0], np.cumsum(np.diff(np.asarray(w.offsets)))]).astype(int)
        flat = w.flatten()
        self.positive, self.lo, self.hi, self.top, self.need = (np.asarray(flat.field(c), dtype=np.int64) for c in ("positive_id", "lo", "hi", "top", "need"))
        self.owner = self.ids[np.repeat(np.arange(len(self.ids)), np.diff(self.starts))]
        self.shift = np.array([max(0, int(h - x).bit_length() - DIGIT_BITS) for x, h in zip(self.lo, self.hi)], dtype=np.int64)


def _meets(it: Iterator[pa.RecordBatch], same: bool) -> Iterator[tuple[int, _Anchors, int, np.ndarray, np.ndarray]]:
    """For each anchor of each block that meets a block of rows: number and content of the
    anchors' block, the anchor, and ids and scores of the rows that its windows are about."""
    blocks: dict[int, _Anchors] = {}
    for batch in it:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("blk", "n", "dims", "ids", "labels", "data", "anchors")}
        for i in range(batch.num_rows):
            n, dims, k = (at[c][i].as_py() for c in ("n", "dims", "blk"))
            if k not in blocks:
                blocks[k] = _Anchors(at["anchors"][i], dims)
            a = blocks[k]
            ids, labels = (np.frombuffer(at[c][i].as_buffer(), dtype=np.int64) for c in ("ids", "labels"))
            data = at["data"][i].as_buffer()
            rows = np.frombuffer(data, dtype=np.int16 if dims and data.size // (n * dims) == 2 else np.int64).reshape(n, dims)
            scores = a.v @ rows.T.astype(np.float64)  # whole numbers below 2**53: exact in any order
            by_label = {x: np.flatnonzero((labels == x) if same else (labels != x)) for x in np.unique(a.labels)}
            for j in range(len(a.ids)):
                pick = by_label[a.labels[j]]
                if same:
                    pick = pick[ids[pick] != a.ids[j]]
                yield k, a, j, ids[pick], scores[j, pick].astype(np.int64)


def _count(it: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of each window by digit, from the top as far as it takes to reach the wanted number."""
    sums: dict[int, tuple[_Anchors, np.ndarray]] = {}
    for k, a, j, _, s in _meets(it, same):
        if k not in sums:
            sums[k] = (a, np.zeros((len(a.lo), 1 << DIGIT_BITS), dtype=np.int32))
        for w in range(a.starts[j], a.starts[j + 1]):
            inside = s[(s >= a.lo[w]) & (s <= a.hi[w])]
            if len(inside):
                sums[k][1][w] += np.bincount((a.hi[w] - inside) >> a.shift[w], minlength=1 << DIGIT_BITS).astype(np.int32)
    for a, c in sums.values():
        before = c.cumsum(axis=1, dtype=np.int64) - c
        w, bucket = np.nonzero((c > 0) & (before < a.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.owner[w], a.positive[w], bucket.astype(np.int32), c[w, bucket].astype(np.int64))], names=["anchor_id", "positive_id", "bucket", "n"])


def _gather(it: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
    """Rows above each window's kth score, and of those at it as many as are needed, by least id."""
    out, held = [], 0

    def put() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["anchor_id", "positive_id", "vec_id", "score"])

    for _, a, j, ids, s in _meets(it, same):
        for w in range(a.starts[j], a.starts[j + 1]):
            above, level = np.flatnonzero((s > a.lo[w]) & (s <= a.top[w])), np.flatnonzero(s == a.lo[w])
            level = level[np.argsort(ids[level], kind="stable")[: a.need[w]]]
            if len(take := np.concatenate([above, level])):
                out.append((np.full(len(take), a.owner[w]), np.full(len(take), a.positive[w]), ids[take], s[take]))
                held += len(take)
        if held >= GATHERED:
            yield put()
            out, held = [], 0
    if out:
        yield put()


class Rows:
    """Packed rows and blocks of anchors, against which windows are asked."""

    def __init__(self, vectors: DataFrame, anchor: Column, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS, pass_bytes: int = PASS_BYTES):
        vectors = written(vectors)
        length2 = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        chosen = vectors.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v", length2(F.col("v")).alias("_l"))
        dims, most = vectors.agg(F.max(F.size("v")), F.max(length2(F.col("v")))).first()
        if (most or 0) >= 2.0**53:
            raise ValueError("scores of 2**53 and more cannot be told apart")
        self.dims, n = dims or 0, chosen.count()
        self.blocks = max(1, -(-n // block_anchors))
        reach = F.ceil(F.sqrt(F.col("_l") * F.lit(float(most or 0)))) + 1  # no score is farther from zero
        self.anchors = written(chosen.select("anchor_id", "label", "v", reach.alias("reach"), F.pmod(F.xxhash64("anchor_id"), F.lit(self.blocks)).cast("int").alias("blk")))
        self.packed = written(vectors.mapInArrow(partial(_pack, dims=self.dims, block_rows=block_rows), _PACKED))
        per_pass = max(1, pass_bytes // (block_anchors * (8 * self.dims + 400)))
        self.passes = [range(at, min(at + per_pass, self.blocks)) for at in range(0, self.blocks, per_pass)]

    def _run(self, windows: DataFrame, work, same: bool, schema: str) -> DataFrame:
        own = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "lo", "hi", "top", "need")).alias("w"))
        # blocks hold about a thousand anchors with a few windows each
        blocks = written(self.anchors.join(own, "anchor_id").groupBy("blk").agg(F.collect_list(F.struct("anchor_id", "label", "v", "w")).alias("anchors")))
        done = []
        for p in self.passes:
            asked = self.packed.withColumn("blk", F.explode(F.sequence(F.lit(p.start), F.lit(p.stop - 1))))
            pairs = asked.join(F.broadcast(blocks.where(F.col("blk").between(p.start, p.stop - 1))), "blk")
            done.append(pairs.mapInArrow(partial(work, same=same), schema))
        return reduce(DataFrame.unionAll, done)

    def best(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, positive_id, rank, vec_id, score): for each window (anchor_id, positive_id, lo,
        hi) the k first rows with lo <= score <= hi that share the anchor's label (same; the anchor
        itself is left out) or have another."""
        state = written(windows.where("lo <= hi").select(*_KEY, "lo", "hi", F.col("hi").alias("top"), F.lit(k).alias("need")))
        bits = state.agg(F.max(F.when(F.col("hi") > F.col("lo"), F.length(F.bin(F.col("hi") - F.col("lo")))).otherwise(0))).first()[0] or 0
        for _ in range(-(-bits // DIGIT_BITS)):
            counts = self._run(state, _count, same, _COUNTS).groupBy(*_KEY, "bucket").agg(F.sum("n").alias("n"))
            upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*_KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
            met = state.select(*_KEY, "need").join(upto, list(_KEY)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            met = met.select(*_KEY, F.col("bucket").cast("long").alias("b"), (F.col("upto") - F.col("n")).alias("before"))
            shift = F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - DIGIT_BITS)
            step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
            hi = F.col("hi") - F.col("b") * step
            narrowed = state.join(met, list(_KEY), "left").select(
                *_KEY,
                # too few rows: all from the lower end upwards are wanted
                F.when(F.col("b").isNull(), F.col("lo")).otherwise(F.greatest(F.col("lo"), hi - step + 1)).alias("lo"),
                F.when(F.col("b").isNull(), F.col("lo")).otherwise(hi).alias("hi"),
                "top", (F.col("need") - F.coalesce("before", F.lit(0))).cast("int").alias("need"),
            )
            state = written(narrowed)
        found = self._run(state, _gather, same, _FOUND)
        rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*_KEY, "rank", "vec_id", "score")


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **sizes: int) -> DataFrame:
    """Hard negatives of (vec_id, label, v), with whole numbers in v and an id in each row once.

    anchor tells which rows are anchors. For each anchor and each of its first positives of the
    same label: the first negatives of another label whose score lies between low and high
    hundredths of the positive's, as (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Higher scores come first, then smaller ids.
    """
    rows = Rows(vectors, anchor, **sizes)
    wide = rows.anchors.select("anchor_id", F.col("anchor_id").alias("positive_id"), (-F.col("reach")).alias("lo"), F.col("reach").alias("hi"))
    near = written(rows.best(wide, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    hundredths = lambda x: F.col("positive_score") * F.lit(x)
    lo, hi = F.call_function("div", hundredths(low) + F.pmod(-hundredths(low), F.lit(100)), F.lit(100)), F.call_function("div", hundredths(high) - F.pmod(hundredths(high), F.lit(100)), F.lit(100))
    windows = near.select(*_KEY, lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    return rows.best(windows, False, negatives).join(near, list(_KEY)).select(*_KEY, "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, **sizes: int) -> DataFrame:
    """The mined table of (vec_id, embedding, label): anchors are the rows whose id is divisible by
    100; where it is divisible by 7 the label moves on by one, modulo ten."""
    moved = embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(whole_vectors(moved), F.col("vec_id") % 100 == 0, **sizes)


ORACLE = """
with p as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(cast(x as double) * 256)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as a, r.vec_id as r, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score from p a join p r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
pos as (select a, r, score from (select *, row_number() over (partition by a order by score desc, r) as k from s where same) where k <= 5),
n as (select pos.a, pos.r as positive_id, pos.score as positive_score, s.r as negative_id, s.score as negative_score, row_number() over (partition by pos.a, pos.r order by s.score desc, s.r) as rank
  from pos join s on s.a = pos.a and not s.same and 30 * pos.score <= 100 * s.score and 100 * s.score <= 90 * pos.score)
select a as anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
