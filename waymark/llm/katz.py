"""Language-model scores by Katz backoff with Good-Turing discounts, over n-grams of words.

The order is a parameter. A gram that training has seen has its discounted share of its context's
count; one that it has not seen has the context's backoff weight times the share of the gram one
word shorter, which is found the same way, down to a word. A word never seen is the unknown word, which has what the discounts of all words leave. Each context's shares sum to one:
a weight is the discounted mass over what the followers leave of the order below.

Counts are exact. Words are told apart by 64-bit hashes and then carry numbers; a longer gram is
the number of its context and that of its word, so nothing is folded together. The tables of
counts grow with the corpus and lie in parts, whose number follows it too. Texts are read once,
in blocks of about a million tokens. For each order in turn a block asks for the distinct grams
it holds, so a gram that makes up a third of all tokens is one request of each block. Requests
meet by context, are summed to the corpus counts, and the answers (counts, the gram's number,
what the context's weight is made from) go back to the blocks. A context with more tokens than a
part should hold is dealt by its followers instead; such contexts are few, and their sums are
added up in one small table. Last, the blocks score their documents.

Defined cases: a null or empty text is its end alone; a null doc_id hashes as empty text; repeated
rows are all counted and scored; without training texts every token is the unknown word, with
share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batches, expr_crc_fold, scratch, shuffle_partitions, tidy, tidy_group, written
from waymark.session import remove

#: Words of the longest gram in the query; see the README for figures of order three.
ORDER = 2
#: Counts up to this are discounted.
DISCOUNTED = 5
BLOCK_TOKENS = 1 << 20
#: Blocks for each part of a table of counts.
PART_BLOCKS = 4
#: A context with more tokens than this, and than this share of all, is dealt by its followers.
HOT_TOKENS, HOT_SHARE = 1 << 22, 50_000
#: The fold that is held out.
HELD_FOLD = 1
#: Number of the context of a text's first token.
START = -1

_BLOCK = "kind int, block long, data binary"
_REQUEST = "part int, block long, data binary"
_ANSWER = "what string, block long, part int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, whole ones in as few bytes as they fit, compressed plane by plane."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        if a.dtype == np.int64 and len(a):
            low, high = int(a.min()), int(a.max())
            a = a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty((a.itemsize, 0), dtype=np.uint8)
        data = codec.compress(planes.tobytes(), asbytes=True)
        out.append(f"{a.dtype.str} {len(a)} {len(data)}\n".encode() + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        end = data.index(b"\n", at)
        kind, n, size = data[at:end].split()
        dtype, n, stop = np.dtype(kind.decode()), int(n), end + 1 + int(size)
        raw = np.frombuffer(codec.decompress(data[end + 1 : stop], n * dtype.itemsize), dtype=np.uint8)
        a = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(-1)
        out.append(a.astype(np.int64) if dtype.kind == "i" else a)
        at = stop
    return out


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.zeros(1, dtype=sorted_keys.dtype))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of whole numbers."""
    x = x.astype(np.int64).view(np.uint64)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, none negative, in order, and the place of each; equal keys keep their order. Key and
    place go into one number where they fit, as plain numbers sort many times faster."""
    bits = max(1, len(keys) - 1).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    s = np.sort(keys << bits | np.arange(len(keys)))
    return s >> bits, s & ((1 << bits) - 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, none negative, in order; the first place of each; for each place its key there."""
    s, order = ordered(keys)
    start = runs(s)
    inverse = np.empty(len(keys), dtype=np.int64)
    inverse[order] = np.repeat(np.arange(len(start)), np.diff(start, append=len(s)))
    return s[start], order[start], inverse


def ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each of some distinct keys in their order."""
    out = np.empty(len(keys), dtype=np.int64)
    out[ordered(keys)[1]] = np.arange(len(keys))
    return out


# ---- discounts -----------------------------------------------------------------------------


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discount of the counts 0, 1, ..., k from n, the numbers of things seen so often (1 to k + 1).

    Katz's factors; where the numbers are too few for them, k is lowered, and with none left half
    a count is taken from each.
    """
    k = len(n) - 1
    for top in range(k, 0, -1):
        if (n[: top + 1] > 0).all():
            common = (top + 1) * n[top] / n[0]
            r = np.arange(1, top + 1)
            d = ((r + 1) * n[1 : top + 1] / n[:top] / r - common) / (1 - common) if common < 1 else np.zeros(top)
            if ((d > 0) & (d < 1)).all():
                return np.concatenate([[0.0], d, np.ones(k - top)])
    return np.concatenate([[0.0], 1 - 0.5 / np.arange(1, k + 1)])


def kept(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts after their discount."""
    return np.concatenate([d, [1.0]])[np.minimum(counts, DISCOUNTED + 1)] * counts


def taken(d: np.ndarray, few: np.ndarray) -> np.ndarray:
    """What the discounts take, from the numbers of things seen 1, 2, ... times (last axis)."""
    r = np.arange(1, DISCOUNTED + 1)
    return few @ (r * (1 - d[1:]))


def weights(total: np.ndarray, few: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context what its counts are divided by, and its backoff weight.

    total: its tokens; few: its followers seen r times; mass: lower-order share of its followers.
    Where no follower is discounted one more token is set aside. A context without tokens hands
    all to the order below.
    """
    left = taken(d, few)
    none = left <= 0
    whole = np.where(none, total + 1.0, total.astype(float))
    return whole, np.where(total > 0, np.where(none, 1.0, left) / whole / np.maximum(1 - mass, 1e-300), 1.0)


# ---- words ---------------------------------------------------------------------------------


@tidy
def _blocks(it: Iterator[pa.RecordBatch], tokens_each: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows (doc_id, text, held_out): their documents and places of words (kind 0),
    and their words' hashes with training counts (1)."""
    part, number = TaskContext.get().partitionId(), count()

    def flush(rows: list) -> pa.RecordBatch:
        ids, held = pa.chunked_array([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        n = np.concatenate([r[2] for r in rows]) + 1
        words = pa.chunked_array([r[3] for r in rows]).combine_chunks().dictionary_encode()
        names = words.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in [*names, b""]], dtype=np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ends = n.cumsum() - 1
        inside = np.ones(int(n.sum()), dtype=bool)
        inside[ends] = False
        seq = np.full(len(inside), place[-1], dtype=np.int32)
        seq[inside] = place[words.indices.to_numpy()]
        in_words = np.bincount(seq[np.repeat(~held, n)], minlength=len(hashes))
        data = [pack(pc.fill_null(ids, 0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), held.astype(np.uint8), n, seq, place[-1:]), pack(gaps(hashes[order]), in_words)]
        return _rows(_BLOCK, [0, 1], [part << 32 | next(number)] * 2, data)

    rows: list = []
    size = 0
    for b in (x for y in it for x in batches([y], limit=1 << 20)):
        # ASCII letters and white space alone, so bytes of other signs stay as they are
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(1), "")))
        words, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        full = np.asarray(pc.not_equal(words, ""))
        before = np.concatenate([[0], full.cumsum()])
        rows.append((b.column(0), np.asarray(b.column(2)), before[offsets[1:]] - before[offsets[:-1]], words.filter(pa.array(full))))
        size += int(before[-1]) + b.num_rows
        if size >= tokens_each:
            yield flush(rows)
            rows, size = [], 0
    if rows:
        yield flush(rows)


def _rows(names: str, *columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


@tidy
def _cut_words(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A block's words as requests, one for each part; parts are ranges of the hash."""
    for b in it:
        for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            step, n = unpack(data)
            keys = step.cumsum(dtype=np.uint64)
            ends = np.searchsorted((keys >> np.uint64(32)).astype(np.int64) * parts >> 32, np.arange(parts + 1))
            used = [p for p in range(parts) if ends[p] < ends[p + 1]]
            yield _rows(_REQUEST, used, [block] * len(used), [pack(gaps(keys[ends[p] : ends[p + 1]]), n[ends[p] : ends[p + 1]]) for p in used])


def _often(total: np.ndarray) -> np.ndarray:
    """How many things were seen 1, 2, ..., DISCOUNTED + 1 times."""
    return np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]


def _count_words(group: pa.Table, parts: int) -> pa.Table:
    """Corpus counts and numbers of the words of one part, for each block that asks. Numbers rise
    as counts fall, so those of most tokens are small and pack well."""
    part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
    asked = [unpack(d) for d in group.column("data").to_pylist()]
    own = [a.cumsum(dtype=np.uint64) for a, _ in asked]
    keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([n for _, n in asked]), minlength=len(keys)).astype(np.int64)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(keys))
    numbers, ends = rank * parts + part, np.cumsum([0] + [len(k) for k in own])
    data = [pack(total[i], numbers[i]) for i in (inverse[a:b] for a, b in zip(ends, ends[1:]))]
    data.append(pack(np.array([total.sum(), (total > 0).sum()]), _often(total)))
    return pa.Table.from_batches([_rows(_ANSWER, ["reply"] * len(blocks) + ["stats"], [*blocks, -1], [part] * (len(blocks) + 1), data)])


# ---- longer grams --------------------------------------------------------------------------


class Block:
    """The tokens of a block with what the answers so far tell of their grams.

    place is each token's gram among the block's. For each gram: number is what it is called in
    the corpus, count its count, whole what that is divided by, and share the share of its last
    word, with backoff.
    """

    def __init__(self, group: pa.Table, model: dict) -> None:
        rows = sorted(zip(group.column("what").to_pylist(), group.column("part").to_pylist(), group.column("data").to_pylist()), key=lambda r: r[:2])
        self.answers = {k: [unpack(d) for w, _, d in rows if w == k] for k in {r[0] for r in rows}}
        del rows
        self.docs, self.null, self.held, n, self.seq, end = self.answers.pop("block")[0]
        self.n = n
        self.starts = self.n.cumsum() - self.n
        self.train = np.repeat(self.held == 0, self.n)
        self.model = model
        # parts of words are ranges of their hashes, so the answers come in the words' order
        words = self.answers.pop("1")
        self.word_counts = np.concatenate([c for c, _ in words])
        self.word_numbers = np.concatenate([x for _, x in words])
        del words
        first = model[1]
        self.place, self.number, self.count = self.seq, self.word_numbers, self.word_counts
        self.share = np.where(self.count > 0, kept(first["d"], self.count) / first["whole"], first["unknown"])
        self.whole = np.full(len(self.count), first["whole"])
        self.texts = self.word_counts[end[0]]
        for k in range(2, len(self.answers) + 2):
            self.take(k)

    def grams(self) -> tuple[np.ndarray, ...]:
        """Grams one longer than those looked up, as they are sent to the parts: the part of each,
        its context's place (0 is the start of a text, others are one up), its word's and its
        shorter gram's, whether its context is hot, and the gram of each token."""
        before = np.concatenate([[0], self.place[:-1] + 1])
        before[self.starts] = 0
        n = len(self.word_numbers)
        keys, first, inverse = distinct(before * n + self.seq)
        at = keys // n
        word = keys - at * n
        numbers, total = np.concatenate([[START], self.number]), np.concatenate([[self.texts], self.count])
        mix, hot = mixed(numbers)[at], (total > self.model["hot"])[at]
        if hot.any():
            mix[hot] = mixed(mix[hot].view(np.int64) ^ self.word_numbers[word[hot]])
        part = (mix % np.uint64(self.model["parts"])).astype(np.int64)
        # by part, then by the context's number, so that these rise by small steps
        _, order = ordered(part * len(numbers) + ranks(numbers - START)[at])
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return part[order], at[order], word[order], self.place[first[order]], hot[order], back[inverse]

    def request(self, block: int) -> pa.RecordBatch:
        part, at, word, short, hot, inverse = self.grams()
        context = np.concatenate([[START], self.number])[at]
        n = np.bincount(inverse[self.train], minlength=len(word))
        # the share by the order below is made from two counts again where it is summed, for what training has
        lower, whole = np.where(n > 0, self.count[short], 0), np.where(n > 0, self.whole[short], 1).astype(np.int64)
        start = runs(part)
        ends = [*start[1:].tolist(), len(part)]
        data = [pack(gaps(context[a:b]), self.word_numbers[word[a:b]], n[a:b], lower[a:b], whole[a:b], hot[a:b].astype(np.uint8)) for a, b in zip(start.tolist(), ends)]
        return _rows(_REQUEST, part[start].tolist(), [block] * len(start), data)

    def take(self, k: int) -> None:
        """Reads the answers on grams of k words."""
        m = self.model[k]
        _, at, word, short, hot, inverse = self.grams()
        of = self.answers.pop(str(k))
        counts, number = np.concatenate([a[0] for a in of]), np.concatenate([a[1].cumsum() for a in of])
        # what is told per context comes once for each run of a context in a part
        length = np.concatenate([a[2] for a in of])
        few = np.concatenate([a[3].reshape(DISCOUNTED, -1) for a in of], axis=1).T.astype(float)
        mass = np.concatenate([_spread(a[4], a[5]) for a in of])
        del of
        total = np.concatenate([[self.texts], self.count])[at[length.cumsum() - length]]
        if hot.any():
            context = np.concatenate([[START], self.number])[at[length.cumsum() - length]]
            place = np.minimum(np.searchsorted(m["hot"], context), len(m["hot"]) - 1)
            is_hot = m["hot"][place] == context
            few[is_hot], mass[is_hot] = m["hot_few"][place[is_hot]], m["hot_mass"][place[is_hot]]
        whole, weight = (np.repeat(x, length) for x in weights(total, few, mass, m["d"]))
        share = np.where(counts > 0, kept(m["d"], counts) / whole, weight * self.share[short])
        self.place, self.number, self.count, self.share, self.whole = inverse, number, counts, share, whole

    def scores(self) -> pa.Table:
        c, m = self.word_counts, self.model[1]
        base = np.log10((c + 0.5) / (m["tokens"] + 0.5 * (m["distinct"] + 1)))
        per = lambda x: np.add.reduceat(x, self.starts)
        return pa.table({
            "doc_id": pa.array(self.docs, mask=self.null.astype(bool)), "held_out": pa.array(self.held.astype(bool)), "n_tokens": pa.array(self.n), "n_known": pa.array(per((c > 0).astype(np.int64)[self.seq])),
            "train_tokens": pa.array(np.full(len(self.n), m["tokens"], dtype=np.int64)), "base_score": pa.array(per(base[self.seq])), "score": pa.array(per(np.log10(self.share)[self.place])),
        })


def _spread(asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values at the places that asked marks, zero elsewhere."""
    out = np.zeros(len(asked))
    out[asked > 0] = values
    return out


def _request(group: pa.Table, model) -> pa.Table:
    return pa.Table.from_batches([Block(group, model.value).request(group.column("block")[0].as_py())])


def _score(group: pa.Table, model) -> pa.Table:
    return Block(group, model.value).scores()


def _count(group: pa.Table, below: np.ndarray, parts: int, last: bool) -> pa.Table:
    """Corpus counts of the grams of one part, their numbers, and per context how many followers
    were seen 1, 2, ... times and, where a block needs a weight, the share of its followers by the
    order below, whose discounts are given."""
    part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
    asked = [unpack(d) for d in group.column("data").to_pylist()]
    ends = np.cumsum([0] + [len(a[0]) for a in asked])
    every, each, n, lower, whole, hot = (np.concatenate([a.pop(0).cumsum() if j == 0 else a.pop(0) for a in asked]) for j in range(6))
    start = runs(every)
    contexts, _, of = distinct(every[start] - START)
    contexts, of = contexts + START, np.repeat(of, np.diff(start, append=len(every)))
    words, _, word = distinct(each)
    del every, each
    keys, _, inverse = distinct(of * len(words) + word)
    del word
    total = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
    context, seen = keys // len(words), total > 0
    # counts of the order below come from blocks that have the gram in training texts
    told, below_count, below_whole = n > 0, np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=np.int64)
    below_count[inverse[told]], below_whole[inverse[told]] = lower[told], whole[told]
    del n, lower, whole, told
    few = np.stack([np.bincount(context[total == r], minlength=len(contexts)) for r in range(1, DISCOUNTED + 1)])
    mass = np.bincount(context[seen], weights=kept(below, below_count[seen]) / below_whole[seen], minlength=len(contexts))
    numbers, data = np.arange(len(keys), dtype=np.int64) * parts + part, []
    for a, b in zip(ends, ends[1:]):
        i = inverse[a:b]
        start = runs(of[a:b])
        c = of[a:b][start]
        need = np.maximum.reduceat((total[i] == 0).astype(np.uint8), start)
        data.append(pack(total[i], np.zeros(0, dtype=np.int64) if last else gaps(numbers[i]), np.diff(start, append=b - a), few[:, c].reshape(-1), need, mass[c[need > 0]]))
    h = np.unique(of[hot > 0])
    data += [pack(_often(total)), pack(contexts[h], few[:, h].reshape(-1), mass[h])]
    return pa.Table.from_batches([_rows(_ANSWER, ["reply"] * len(blocks) + ["stats", "hot"], [*blocks, -1, -1], [part] * (len(blocks) + 2), data)])


@tidy
def _hot_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for d in b.column(0).to_pylist():
            context, few, mass = unpack(d)
            yield pa.RecordBatch.from_arrays([pa.array(context), *[pa.array(f) for f in few.reshape(DISCOUNTED, -1)], pa.array(mass)], names=["context", *[f"n{r}" for r in range(1, DISCOUNTED + 1)], "mass"])


def _hot_sums(answers: DataFrame) -> dict:
    """Sums over all parts of the contexts that are dealt by their followers. A context is such
    only with a share of all tokens, so there are at most HOT_SHARE of them."""
    names = [f"n{r}" for r in range(1, DISCOUNTED + 1)]
    rows = answers.where("what = 'hot'").select("data").mapInArrow(_hot_rows, f"context long, {', '.join(f'{n} long' for n in names)}, mass double")
    got = sorted(tuple(r) for r in rows.groupBy("context").agg(*[F.sum(n) for n in names], F.sum("mass")).collect())
    a = np.array([r[1:] for r in got], dtype=float).reshape(-1, DISCOUNTED + 1)
    return {"hot": np.array([r[0] for r in got], dtype=np.int64), "hot_few": a[:, :DISCOUNTED], "hot_mass": a[:, DISCOUNTED]}


def _stats(answers: DataFrame) -> list[np.ndarray]:
    """Sums of the parts' statistics, a few numbers each."""
    out = None
    for r in answers.where("what = 'stats'").select("data").toLocalIterator():
        now = unpack(r["data"])
        out = now if out is None else [a + b for a, b in zip(out, now)]
    return out


def held_out(key):
    return expr_crc_fold(key) == HELD_FOLD


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    path = scratch(spark)
    blocks = written(rows.mapInArrow(partial(_blocks, tokens_each=BLOCK_TOKENS), _BLOCK), ["kind"], path)
    n = blocks.where("kind = 0").count()
    if not n:
        return spark.createDataFrame([], _SCORES)
    parts = max(shuffle_partitions(spark), -(-n // PART_BLOCKS))
    requests = blocks.where("kind = 1").select("block", "data").mapInArrow(partial(_cut_words, parts=parts), _REQUEST)
    words = written(requests.groupBy("part").applyInArrow(tidy_group(_count_words, parts), _ANSWER), ["what"])
    remove(spark, f"{path}/kind=1")
    (tokens, distinct), often = _stats(words)
    d = good_turing(often)
    left = float(taken(d, often[:DISCOUNTED]))
    whole = int(tokens) if left > 0 else int(tokens) + 1
    model = {"parts": parts, "hot": max(HOT_TOKENS, int(tokens) // HOT_SHARE), 1: {"d": d, "whole": whole, "unknown": (left if left > 0 else 1.0) / whole, "tokens": int(tokens), "distinct": int(distinct)}}

    known = blocks.where("kind = 0").select(F.lit("block").alias("what"), "block", F.lit(-1).alias("part"), "data")
    reply = lambda t, k: t.where("what = 'reply'").select(F.lit(str(k)).alias("what"), "block", "part", "data")
    known = known.unionByName(reply(words, 1))
    for k in range(2, order + 1):
        shared, below = spark.sparkContext.broadcast(dict(model)), d
        asked = known.groupBy("block").applyInArrow(tidy_group(_request, shared), _REQUEST)
        answers = written(asked.groupBy("part").applyInArrow(tidy_group(_count, below, parts, k == order), _ANSWER), ["what"])
        d = good_turing(_stats(answers)[0])
        model[k] = {"d": d, **_hot_sums(answers)}
        known = known.unionByName(reply(answers, k))
    shared = spark.sparkContext.broadcast(model)
    return known.groupBy("block").applyInArrow(tidy_group(_score, shared), _SCORES)
