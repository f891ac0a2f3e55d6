"""Compression of vectors to short codes by product quantisation, with Exponion search.

A vector of whole numbers is cut into equal parts; each part has a codebook, and the code names
the nearest entry of each. Codebooks are improved by rounds of Lloyd's method. A part starts at
the entry it had before. With distance d to it, no entry farther than 2d from that entry can be
nearer to the part, so only the entry's neighbours within that radius are looked at, in order of
their distance from it. Squared distances are whole numbers (radius: four times the square), so
the search is exact, and of entries equally near the one with the lower index is taken.

Codebooks have a fixed number of numbers, which the driver holds and sends to all tasks; a task
answers with one sum and count for each entry. Codes of a round are written beside the vectors,
which lets the next round start from them and a lost executor cost only its tasks.

Defined cases: rows with a null vector or a null or non-finite component are dropped; shorter
vectors, and lengths that the number of parts does not divide, are filled up with zeros; with
fewer rows than entries the codebooks are as small; a null id comes after all others; repeated
rows all count. Components whose squared distances would not fit 63 bits are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import written
from waymark.operators.joins import is_small, join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that a task searches at a time.
SEARCH_ROWS = 1 << 14

_SUMS = "part int, entry int, n long, sums array<long>"


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows with usable vectors; v is each component times scale, rounded down."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    wide = rows.select("vec_id", "label", F.col(vector).cast("array<double>").alias("v"))
    good = wide.where(F.col("v").isNotNull() & F.forall("v", usable))
    return good.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))


class Codebook:
    """Entries of one part, with each one's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def search(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each row of x, from the entry that it had before."""
        far = ((x - self.entries[before]) ** 2).sum(axis=1)
        # how many neighbours lie within the radius; those with the most come first
        within = np.empty(len(x), dtype=np.int64)
        for e in np.unique(before):
            own = before == e
            within[own] = np.searchsorted(self.apart[e], 4 * far[own], side="right")
        rows = np.argsort(-within, kind="stable")
        x, start, best, dist, within = x[rows], before[rows], before[rows].copy(), far[rows], within[rows]
        for step in range(int(within[0]) if len(x) else 0):
            n = int(np.searchsorted(-within, -step, side="left"))  # rows whose radius holds this many
            entry = self.order[start[:n], step]
            d = ((x[:n] - self.entries[entry]) ** 2).sum(axis=1)
            better = (d < dist[:n]) | ((d == dist[:n]) & (entry < best[:n]))
            best[:n][better], dist[:n][better] = entry[better], d[better]
        code, error = np.empty_like(best), np.empty_like(dist)
        code[rows], error[rows] = best, dist
        return code, error


def _vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    flat, sizes = np.asarray(column.flatten(), dtype=np.int64), np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _slices(it: Iterator[pa.RecordBatch], rows: int = SEARCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _codes(b: pa.RecordBatch, parts: int) -> np.ndarray:
    data = b.column(b.schema.get_field_index("codes"))
    return np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint16).reshape(-1, parts).astype(np.int64)


def _assign(it: Iterator[pa.RecordBatch], shared, parts: int, dims: int) -> Iterator[pa.RecordBatch]:
    """Adds or renews codes and error."""
    books, width = [Codebook(e) for e in shared.value], dims // parts
    for b in _slices(it):
        x = _vectors(b.column(b.schema.get_field_index("v")), dims)
        before = _codes(b, parts) if "codes" in b.schema.names else np.zeros((len(x), parts), dtype=np.int64)
        found = [book.search(x[:, p * width : (p + 1) * width], before[:, p]) for p, book in enumerate(books)]
        codes, error = np.stack([c for c, _ in found], axis=1).astype(np.uint16), sum(e for _, e in found)
        kept = {c: b.column(b.schema.get_field_index(c)) for c in ("vec_id", "label", "v")}
        yield pa.RecordBatch.from_pydict(kept | {"codes": pa.array([r.tobytes() for r in codes], pa.binary()), "error": pa.array(error, pa.int64())})


def _sum(it: Iterator[pa.RecordBatch], parts: int, entries: int, dims: int) -> Iterator[pa.RecordBatch]:
    """Count and sum of the parts that have each entry, over all of the task's rows."""
    width = dims // parts
    n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    for b in _slices(it):
        x, codes = _vectors(b.column(b.schema.get_field_index("v")), dims), _codes(b, parts)
        for p in range(parts):
            n[p] += np.bincount(codes[:, p], minlength=entries)
            np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
    part, entry = np.nonzero(n)
    if len(part):
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, v) as (vec_id, label, v, codes, error), and the codebook of each part.

    codes holds one unsigned 16-bit number for each part; error is the squared distance of v to
    what the code stands for. The first codebooks are the parts of the rows with the least ids.
    """
    spark = vectors.sparkSession
    vectors = written(vectors)
    length, most = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    dims = max(1, -(-(length or 0) // parts)) * parts
    if 4 * dims * (most or 0) ** 2 >= 2.0**62:
        raise ValueError("components are too large for squared distances in 63 bits")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # as many as a codebook has
    start = np.zeros((len(first), dims), dtype=np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    books = [start[:, p * dims // parts : (p + 1) * dims // parts].copy() for p in range(parts)]
    coded, schema = vectors, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, v array<long>, codes binary, error long"
    if not first:
        return spark.createDataFrame([], schema), books
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        coded = written(coded.mapInArrow(partial(_assign, shared=shared, parts=parts, dims=dims), schema))
        if k < rounds:
            sums = coded.mapInArrow(partial(_sum, parts=parts, entries=len(first), dims=dims), _SUMS).select("part", "entry", "n", F.posexplode("sums"))
            sums = sums.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"))
            books = [b.copy() for b in books]
            for r in sums.collect():  # one number for each number of the codebooks
                books[r["part"]][r["entry"], r["pos"]] = r["sum"] // r["n"]
    return coded, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def decoded(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, approx): the vector that each code stands for."""
    parts, shared = len(books), coded.sparkSession.sparkContext.broadcast(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            codes = _codes(b, parts)
            v = np.concatenate([shared.value[p][codes[:, p]] for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(b.schema.get_field_index("vec_id")), "approx": pa.array(list(v), pa.list_(pa.int64()))})

    return coded.select("vec_id", "codes").mapInArrow(run, f"vec_id {coded.schema['vec_id'].dataType.simpleString()}, approx array<long>")


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels; null labels belong together.

    Sums of few labels are sent to all tasks, else rows of labels with very many are dealt to parts.
    """
    keyed = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))})
    sums = written(keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    keys = ["_none", "_label"]
    both = keyed.join(F.broadcast(sums), keys) if is_small(sums) else join_hot(keyed, sums, keys, "_n")
    return both.drop(*keys, "_n")


def code_table(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of (vec_id, embedding, label)."""
    coded, books = compress(whole_vectors(embeddings))
    # two bytes a part, the lower first; entries are fewer than 256
    text = F.lower(F.concat(*[F.hex(F.substring("codes", 2 * p + 1, 1)) for p in range(PARTS)]))
    return label_errors(coded).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    assign = lambda k: f"""
a{k} as materialized (select vec_id, label, part, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := entry)) as best
  from parts join b{k} using (part) group by vec_id, label, part, v)"""  # noqa: E731
    improve = lambda k: f"""
m{k} as materialized (select part, best.entry as entry, [{', '.join(f'cast(floor(sum(v[{i}]) / count(*)) as bigint)' for i in range(1, 5))}] as e from a{k} group by 1, 2),
b{k + 1} as materialized (select part, entry, coalesce(m{k}.e, b{k}.e) as e from b{k} left join m{k} using (part, entry))"""  # noqa: E731
    return f"""
with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as w
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, part, w[4 * part + 1 : 4 * part + 4] as v from kept, (select unnest(range(16)) as part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v as e from parts where vec_id in (select vec_id from kept order by vec_id limit 64)),
{assign(0)},{improve(0)},{assign(1)},{improve(1)},{assign(2)},
x as (select vec_id, label, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error from a2 group by 1, 2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) from b2) as codebooks_sha256 from x
"""


ORACLE = _oracle()
