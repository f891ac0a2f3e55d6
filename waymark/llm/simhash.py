"""SimHash near-duplicates by the pigeonring principle.

Fingerprints of 64 bits stand for texts. They are cut into segments on a ring. If two differ
in at most ``bits`` places then, from some segment on, every chain of l segments differs in at
most l * bits / segments places. The first segment of that chain is therefore equal and the
second differs in one place at most; both together are the key by which fingerprints meet, with
one flipped place in the second segment on one side. What meets is pruned by the budgets of the
longer chains, and only then compared in full.

Equal fingerprints are one node from the start. Fingerprints that meet are compared in blocks
inside a task, and only stars leave it, each fingerprint with the smallest that a batch of keys
joins it to: a group of n near copies gives at most n - 1 edges per batch, not n * n, and as the
same smallest one is met under most keys, most of these are the same. Components come from alternating star steps; each is
one aggregation and one join that AQE can split at a hot node, and each result is written to
the shared folder.

Defined cases: a text without words (or null) has fingerprint zero and links like any other; a
null doc_id is never a component's name unless there is no other; repeated rows share a
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batches, shuffle_partitions, tidy, written
from waymark.operators.joins import join_hot, join_small
from waymark.session import let_go

SEED = 42
BITS, SEGMENTS = 4, 5
#: Fingerprints compared at a time; a key with more is cut into pairs of blocks.
BLOCK = 2048
#: Fingerprints under one key from which it is dealt to several parts.
HOT_ROWS = 4 * BLOCK
#: Pairs of fingerprints compared at a time where keys have few.
PAIRS = 1 << 20
#: Least shingle hashes by which a text's place in its component is judged.
SKETCH = 128
#: Texts and shingles of a block of near texts, and the shingles looked up at a time.
TEXTS, SHINGLES, COLUMNS = 1024, 1 << 19, 2048
#: Words whose hashes a worker keeps.
CACHE_WORDS = 1 << 19


def shingle_hashes(text: str, words_each: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words; of all words if they are too few."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(words_each, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    h = xxhash.xxh64_intdigest
    return np.array([h(data[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


class WordHashes(dict):
    """XXH64 of words, each worked out once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h

    def distinct(self, text: str) -> np.ndarray:
        """Hashes of a text's distinct lower-cased words."""
        words = set(text.encode().lower().split())
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as an unsigned number."""
    n, votes = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, words_each: int = 4, key: str = "doc_id", distinct: bool = False) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number, made where the text is read. With
    distinct it is that of the words, each counted once however often it occurs."""

    @tidy
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes().distinct if distinct else partial(shingle_hashes, words_each=words_each)
        for b in batches(it):
            fps = [fingerprint(hashes(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[key, "fp"])

    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fp", T.LongType())]))


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


@cache
def _masks(start: int, segments: int) -> list[np.uint64]:
    """Masks of the chains of 1, 2, ... segments from a start on the ring."""
    out, mask = [], 0
    for k in range(segments):
        at, width = ring(segments)[(start + k) % segments]
        mask |= ((1 << width) - 1) << at
        out.append(np.uint64(mask))
    return out


@tidy
def _keys(it: Iterator[pa.RecordBatch], bits: int, segments: int, probes: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (key, start, probe, fp): each fingerprint under the first two segments of each chain,
    and as a probe under each key that one flip in the second segment makes."""
    spans = ring(segments)
    flips = [[np.uint64(0)] + ([np.uint64(1 << (a + i)) for i in range(w)] if probes and 2 * bits // segments else []) for a, w in spans]
    for b in it:
        fp = np.asarray(b.column(0)).view(np.uint64)
        for s in range(segments):
            two = _masks(s, segments)[1]
            turned = flips[(s + 1) % segments]
            keys = np.concatenate([(fp ^ f) & two for f in turned])
            n = len(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), s, dtype=np.int8)), pa.array(np.repeat([False] + [True] * (len(turned) - 1), n)), pa.array(np.tile(fp, len(turned)).view(np.int64))],
                names=["key", "start", "probe", "fp"],
            )


def linked(x: np.ndarray, y: np.ndarray, start: int, bits: int, segments: int) -> np.ndarray:
    """Which pairs of x and y are within the bits, checked along the chain from a start."""
    diff = x[:, None] ^ y[None, :]
    i, j = np.nonzero(np.bitwise_count(diff & _masks(start, segments)[1]) <= 2 * bits // segments)
    d = diff[i, j]
    for k, mask in enumerate(_masks(start, segments)[2:], 3):
        keep = np.bitwise_count(d & mask) <= k * bits // segments
        i, j, d = i[keep], j[keep], d[keep]
    return np.stack([i, j], axis=1)


class Forest:
    """Trees of linked fingerprints (or names), each known by its smallest."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, a: int) -> int:
        root = self.root
        while (p := root.setdefault(a, a)) != a:
            root[a] = root.setdefault(p, p)
            a = root[a]
        return a

    def join(self, x: list[int], y: list[int], i: np.ndarray, j: np.ndarray) -> None:
        """Joins x[i] to y[j]: one pair for each y at a time; then all pairs that are joined by
        now drop out together."""
        find = self.find
        while len(i):
            one = np.full(len(y), -1)
            one[j[::-1]] = i[::-1]
            for b in np.flatnonzero(one >= 0).tolist():
                p, q = find(x[one[b]]), find(y[b])
                if p != q:
                    self.root[max(p, q)] = min(p, q)
            apart = np.array([find(a) for a in x])[i] != np.array([find(a) for a in y])[j]
            i, j = i[apart], j[apart]

    def stars(self) -> list[tuple[int, int]]:
        """Each with the smallest of its tree, unless it is that itself."""
        return [(a, root) for a in list(self.root) if (root := self.find(a)) != a]


def join_block(forest: Forest, own: np.ndarray, probes: np.ndarray, start: int, bits: int, segments: int) -> None:
    """Joins what is linked among own and between probes and own, under one key."""
    for i in range(0, len(own), BLOCK):
        x = own[i : i + BLOCK]
        for other in (own[i:], probes):
            for j in range(0, len(other), BLOCK):
                y = other[j : j + BLOCK]
                hit = linked(x, y, start, bits, segments)
                forest.join(x.view(np.int64).tolist(), y.view(np.int64).tolist(), hit[:, 0], hit[:, 1])


def join_small_keys(forest: Forest, fp: np.ndarray, at: np.ndarray, end: np.ndarray, start: int, bits: int, segments: int) -> None:
    """Joins what is linked under many keys at once: the fingerprint in each place of at is compared
    with those behind it up to the place's end, which are at most BLOCK.

    What lies under one key is within the budget of the first two segments already.
    """
    n = end - at - 1
    total = np.cumsum(n)
    i = 0
    while i < len(at):
        k = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + PAIRS, side="right")))
        x = np.repeat(at[i:k], n[i:k])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[i:k] - n[i:k] - (total[i] - n[i]), n[i:k])
        d = fp[x] ^ fp[y]
        for c, mask in enumerate(_masks(start, segments)[2:], 3):
            keep = np.bitwise_count(d & mask) <= c * bits // segments
            x, y, d = x[keep], y[keep], d[keep]
        if len(x):
            nodes, place = np.unique(np.concatenate([fp[x], fp[y]]), return_inverse=True)
            names = nodes.view(np.int64).tolist()
            forest.join(names, names, place[: len(x)], place[len(x) :])
        i = k


@tidy
def _meet(it: Iterator[pa.RecordBatch], bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Edges of rows that come sorted by part, start, key and probe; runs may span batches."""
    cols = ("part", "start", "key", "probe", "fp")
    rest: list[np.ndarray] | None = None

    def edges(c: list[np.ndarray]) -> pa.RecordBatch:
        part, start, key, probe, fp = c
        new = np.flatnonzero((part[1:] != part[:-1]) | (start[1:] != start[:-1]) | (key[1:] != key[:-1])) + 1
        a, b = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        mid = a + np.add.reduceat(~probe, a)  # probes come last
        prints = fp.view(np.uint64)
        forest = Forest()
        meets = (b - a > 1) & (mid > a)
        for s in np.unique(start[a[meets]]).tolist():
            here = meets & (start[a] == s)
            few = here & (b - a <= BLOCK)
            own = (mid - a)[few]
            at = np.repeat(a[few] - np.cumsum(own) + own, own) + np.arange(own.sum())
            join_small_keys(forest, prints, at, np.repeat(b[few], own), s, bits, segments)
            for i, m, j in zip(*[x[here & ~few].tolist() for x in (a, mid, b)]):
                join_block(forest, prints[i:m], prints[m:j], s, bits, segments)
        e = np.array(forest.stars(), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    for batch in it:
        if not batch.num_rows:
            continue
        now = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols]
        if rest is not None:
            now = [np.concatenate(p) for p in zip(rest, now)]
        change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield edges([c[:cut] for c in now])
        rest = [c[cut:] for c in now]
    if rest is not None:
        yield edges(rest)


def edges(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Edges (a, b) that connect what is linked among distinct fingerprints (fp).

    A key under which very many fingerprints lie is dealt to several parts: each part holds a
    block of the key's own fingerprints and sees all of its others as probes, so no task gathers
    more than a block against a stream.
    """
    if segments <= bits:
        raise ValueError("more segments than bits are needed for an equal first segment")
    under = lambda **k: fps.select("fp").mapInArrow(partial(_keys, bits=bits, segments=segments, **k), "key long, start byte, probe boolean, fp long")
    keyed = under()
    hot = written(under(probes=False).groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS))
    ready = keyed.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        parts = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
        home = F.pmod(F.xxhash64("fp"), parts).cast("int")
        ready = join_small(keyed, hot, ["start", "key"], "left").withColumns({"parts": parts, "home": home})
        ready = ready.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.col("probe") | (F.col("part") != F.col("home")))
    ready = ready.repartition(shuffle_partitions(fps.sparkSession), "part", "start", "key").sortWithinPartitions("part", "start", "key", "probe")
    return ready.select("part", "start", "key", "probe", "fp").mapInArrow(partial(_meet, bits=bits, segments=segments), "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in the links (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until all that is left are
    stars, each with its smallest node in the middle; one look tells, without a further round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b")
        if large:
            both = both.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether each node lies under one other, and none that others lie under does itself."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()

    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if settled(now):
            break
        # the small step reads the large one's links twice, which would make its join twice
        now = written(star(written(star(now, True)), False))
        let_go(now.sparkSession)
    else:
        if not settled(now):
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@tidy
def _shingled(it: Iterator[pa.RecordBatch], words_each: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (md5, root, text) to (md5, root, n, s, h, q): the set of shingles, its size, its least
    value under each of several hashes, and its SKETCH least values under the first."""
    turn = np.random.default_rng(SEED).integers(1, 1 << 63, size=least, dtype=np.uint64) | np.uint64(1)
    for b in batches(it):
        sets = [np.unique(shingle_hashes(t or "", words_each)) for t in b.column(2).to_pylist()]
        mins, sketch = [], []
        for s in sets:
            mixed = [s * m for m in turn] if len(s) else []
            sketch.append(np.sort(mixed[0])[:SKETCH].view(np.int64) if mixed else [])
            mins.append([int((x ^ (x >> np.uint64(29))).min().view(np.int64)) for x in mixed] or [0] * least)
        made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=["md5", "root", "n", "s", "h", "q"])


def similar(texts: DataFrame, similarity: float = 0.8, words_each: int = 5, least: int = 8) -> DataFrame:
    """Links (a, b) that connect the texts (md5, root, text) of each component whose shingle sets
    are as similar as asked.

    First, texts that share a least hash are compared with two of those they meet: the one whose
    shingles most of the component has, as the source of a group of edited copies, told from a
    sketch; and one that differs from hash to hash. So n texts make at most 2 * least * n
    comparisons. What these links leave apart is then compared exactly by ``apart``.
    """
    extra = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in "shq"]])
    run = partial(_shingled, words_each=words_each, least=least)
    sets = written(texts.select("md5", "root", "text").mapInArrow(run, T.StructType([*texts.select("md5", "root").schema.fields, *extra.fields])))
    narrow = written(sets.select("md5", "root", "n", F.posexplode("h").alias("k", "h")))
    where = ["root", "k", "h"]
    shared = narrow.groupBy(*where).agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    meets = join_hot(narrow, written(shared), where, "met").select("md5", "n", *where)
    sketch = sets.select("md5", "root", F.explode("q").alias("q"))
    fame = join_hot(sketch, written(sketch.groupBy("root", "q").agg(F.count(F.lit(1)).alias("has")).where("has > 1")), ["root", "q"], "has").groupBy("md5").agg(F.sum("has").alias("fame"))
    known = written(meets.join(fame, "md5", "left").withColumn("fame", F.coalesce("fame", F.lit(0))))
    head = F.struct("md5", "n")
    heads = known.groupBy(*where).agg(F.min_by(head, F.struct(-F.col("fame"), "md5")).alias("first"), F.min_by(head, F.struct(F.xxhash64("md5", "k"), "md5")).alias("other"), F.count(F.lit(1)).alias("met"))
    met = join_hot(known, written(heads), where, "met").select(F.col("md5").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("first", "other")).alias("head"))
    fit = (F.col("a") != F.col("head.md5")) & (F.least("n_a", "head.n") >= F.lit(similarity) * F.greatest("n_a", "head.n"))
    pairs = met.where(fit).select(F.greatest("a", "head.md5").alias("a"), F.least("a", "head.md5").alias("b")).distinct()
    side = lambda x: sets.select(F.col("md5").alias(x), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    alike = both >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - both)
    teams = written(components(pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")))
    named = sets.select("md5", "root", "n", "s").join(teams.select(F.col("node").alias("md5"), F.col("root").alias("team")), "md5", "left").withColumn("team", F.coalesce("team", "md5"))
    return teams.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(apart(named, similarity))


def apart(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between teams of the sets (md5, root, n, s, team) that hold a pair of texts of
    one component (root) as similar as asked; no such pair is missed.

    Of n shingles, in an order that all texts share, similar texts have one in common among
    the first n - similarity * n + 1. Shingles that a single team has come first and meet nothing,
    then rare ones, so a text keeps keys only if nearly all of its shingles occur in other
    teams. What keys connect is compared in full, in pairs of blocks of bounded size.
    """
    several = sets.groupBy("root").agg(F.min("team").alias("lo"), F.max("team").alias("hi")).where("lo <> hi").select("root")
    left = written(join_small(sets, written(several), "root", "left_semi").where("n > 0").withColumn("i", F.xxhash64("md5")))
    each = left.select("i", "root", "n", F.xxhash64("team").alias("t"), F.explode("s").alias("x"))
    shared = each.groupBy("root", "x").agg(F.count(F.lit(1)).alias("f"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("root", "x", "f")
    least = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-6)).cast("int")
    ranked = join_hot(each, written(shared), ["root", "x"], "f").groupBy("i", "root", "n").agg(F.collect_list(F.struct("f", "x")).alias("k")).where(F.size("k") >= least)
    keys = written(ranked.select("i", "root", F.explode(F.slice(F.array_sort("k"), F.lit(1), F.size("k") - least + 1)).alias("k")).select("i", "root", "k.x"))
    met = written(keys.groupBy("root", "x").agg(F.min("i").alias("m"), F.count(F.lit(1)).alias("has")).where("has > 1"))
    near = written(components(join_hot(keys, met, ["root", "x"], "has").select(F.col("i").alias("a"), F.col("m").alias("b"))).withColumnsRenamed({"node": "i", "root": "near"}))
    rows = left.select("i", "md5", "team", "n", "s").join(near, "i")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts")
    sizes = written(left.select("i", "n").join(near, "i").groupBy("near").agg(parts, F.count(F.lit(1)).alias("has")))
    rows = join_hot(rows, sizes, ["near"], "has").drop("has").withColumn("home", F.pmod(F.xxhash64("md5", F.lit(SEED)), F.col("parts")).cast("int"))
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("near", F.least("home", "with").alias("u"), F.greatest("home", "with").alias("v"), "home", "team", "s")
    dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), "near", "u", "v").sortWithinPartitions("near", "u", "v")
    return dealt.mapInArrow(partial(_compare, similarity=similarity), "a string, b string").distinct()


@tidy
def _compare(it: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of teams in rows (near, u, v, home, team, s) that come sorted by near and pair of
    blocks (u, v); what lies under one pair may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        where = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(where[:, start].tolist())
            if held and now != last:
                yield team_links(held, similarity)
                held = []
            held.append(b.slice(start, end - start))
            last = now
    if held:
        yield team_links(held, similarity)


def team_links(rows: list[pa.RecordBatch], similarity: float) -> pa.RecordBatch:
    """Links, as stars, of the teams that a similar pair of texts of blocks u and v connects."""
    table = pa.Table.from_batches(rows).combine_chunks()
    u, v = table.column("u")[0].as_py(), table.column("v")[0].as_py()
    home, team, sets = table.column("home").to_numpy(), table.column("team").to_pylist(), table.column("s").chunk(0)
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, col, often = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)[often[col] > 1]
    col = (np.cumsum(often > 1) - 1)[col[often[col] > 1]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    x, y = np.flatnonzero(home == u), np.flatnonzero(home == v)
    both = np.zeros((len(x), len(y)))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        has = np.zeros((len(n), COLUMNS), dtype=np.float32)
        has[row[a:b], col[a:b] - c] = 1
        both += has[x] @ has[y].T
    number = np.unique(np.array(team), return_inverse=True)[1]
    alike = (both >= similarity * (n[x][:, None] + n[y][None, :] - both)) & (number[x][:, None] != number[y][None, :])
    forest = Forest()
    forest.join([team[k] for k in x], [team[k] for k in y], *np.nonzero(alike))
    stars = forest.stars()
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in stars], pa.string()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, similarity: float = 0.8, words_each: int = 5, bits: int = 8, segments: int = 9) -> DataFrame:
    """(doc_id, md5) of the documents to drop, so that one of each group of near copies stays.

    Near copies share a similarity of their word shingles. SimHash finds the candidates: the
    fingerprint of a text's distinct words changes little with a few words, where that of its
    shingles does not (copies at 0.8 differ in ten bits of 64). Links within components of
    fingerprints are then checked exactly, and a group is what such links connect; its
    smallest doc_id stays. Equal texts are dropped beforehand, by digest.
    """
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"), "text")
    rid = F.struct("doc_id", "md5")
    prints = written(fingerprints(rows.select(rid.alias("rid"), "text"), 1, "rid", True).select("rid.*", "fp").distinct())
    first = prints.groupBy("md5").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))).alias("m"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("has")).select("md5", F.col("m.i").alias("doc_id"), "fp", "has")
    first = written(first)
    kept = first.where("has > 1").select("md5", F.col("doc_id").alias("_kept"), "has")
    equal = join_hot(prints.select("doc_id", "md5"), kept, ["md5"], "has").where(~F.col("doc_id").eqNullSafe(F.col("_kept"))).select("doc_id", "md5")
    nodes = first.select("fp").distinct()
    roots = components(edges(nodes, bits, segments))
    grouped = first.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "md5", F.coalesce("root", "fp").alias("root"))
    many = written(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("has")).where("has > 1"))
    asked = written(join_hot(grouped, many, ["root"], "has").drop("has")).withColumnRenamed("doc_id", "_id")
    texts = join_small(rows, asked.withColumnRenamed("md5", "_md5"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5")))
    let_go(docs.sparkSession)
    groups = components(similar(texts.select("md5", "root", "text").dropDuplicates(["md5"]), similarity, words_each))
    of = asked.select("md5", F.col("_id").alias("doc_id")).join(groups, F.col("md5") == F.col("node")).select("doc_id", "md5", F.col("root").alias("team"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "md5")
    stays = written(of.groupBy("team").agg(F.min_by("md5", order).alias("stays"), F.count(F.lit(1)).alias("has")))
    return equal.unionByName(join_hot(of, stays, ["team"], "has").where("md5 <> stays").select("doc_id", "md5"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """Docs, in their own columns, without their near copies; of rows that are repeated as a whole
    one stays."""
    drop = written(near_duplicates(docs, **options)).withColumnsRenamed({"doc_id": "_id", "md5": "_drop"})
    let_go(docs.sparkSession)
    marked = docs.select(F.struct("*").alias("_in"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_md5")).withColumn("_doc", F.col("_in.doc_id"))
    kept = join_small(marked, drop, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_drop")), "left_anti")
    narrow = docs.select("doc_id", F.xxhash64("text").alias("h"))
    if not narrow.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_doc", "_md5"])
    return kept.select("_in.*")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_components(docs: DataFrame, words_each: int = 4, bits: int = BITS, segments: int = SEGMENTS, key: str = "doc_id") -> DataFrame:
    """Each row's key, fingerprint (hex) and component_id, the smallest key that links reach."""
    prints = written(fingerprints(docs, words_each, key))
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("has")))
    roots = components(edges(nodes, bits, segments))
    named = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "has", F.coalesce("root", "fp").alias("root")))
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    of = written(join_hot(named, ids, ["root"], "members").select("fp", "component_id", "has"))
    return join_hot(prints, of, ["fp"], "has").select(key, hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
