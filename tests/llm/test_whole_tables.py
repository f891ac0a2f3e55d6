"""Each query against a brute-force version, over the small tables and a table of odd cases."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "a b c d e " * 4000, "de", "b", 0),
    (5, "Same text here with five words", "en", "a", 1), (6, "same TEXT here with five words", "en", "b", 1), (None, "no id", "en", None, 2),
    (7, "x" * 5000, "fr", "b", 5000), (8, " \n\t ", "es", "b", 4), (9, "é日本 😀 ñandú x", "es", "b", 9), (-5, "Z " * 70, "en", "a", 140),
]


@pytest.fixture(scope="module", params=["sf", "odd", "empty"])
def data(request, spark):
    """(docs, rows, folder): rows are (doc_id, text)."""
    if request.param == "sf":
        d = spark.read.parquet(f"{SF}/documents.parquet")
    else:
        d = spark.createDataFrame(ODD if request.param == "odd" else [], SCHEMA)
    return d, [(r["doc_id"], r["text"] or "") for r in d.select("doc_id", "text").collect()], request.param


def words(text):
    return text.encode().lower().split()


def as_counter(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def test_bpe(data):
    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm.bpe import encode

    docs, rows, _ = data
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert as_counter(encode(docs, path).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_of_every_code_point():
    """Each code point between letters, also those that newer tables call letters; and long pieces,
    whose ids come in several chunks and with the least lookahead."""
    import random
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    from waymark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    t, v = Tokenizer.from_file(path), bpe.Vocabulary(path)
    ids = lambda x: list(memoryview(b"".join(v.encode(x))).cast("I"))
    assert len(v.new) > 0
    points = sorted(v.rare)[::7] + sorted(v.rare)[:300] + [chr(c) for c in range(0x80, 0x110000, 97) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c)) == 0]
    wrong = [c for c in points if ids(f"ab{c}cd") != t.encode(f"ab{c}cd", add_special_tokens=False).ids]
    assert not wrong, wrong[:20]
    rng = random.Random(2)
    for n in (1, 177, 178, 500, 5000):
        piece = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert ids(piece) == t.encode(piece, add_special_tokens=False).ids
    long = "one two three. " * 6000
    assert ids(long) == t.encode(long, add_special_tokens=False).ids and len(list(v.encode(long))) > 1


def test_bpe_of_words():
    """Words with signs and blanks of all kinds around them, encoded more often than the cache holds
    them; and a new word of letters takes no search for pieces, as it did for each text before."""
    import random

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    from waymark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    t, v = Tokenizer.from_file(path), bpe.Vocabulary(path)
    ids = lambda x: list(memoryview(b"".join(v.encode(x))).cast("I"))
    assert all(regex.match(r"\p{L}", c) for c in map(chr, range(0x110000)) if c.isalpha())
    rng = random.Random(4)
    signs = ["'s", "'", "''", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u0301", "\u0308", "Σ", "İ", "ß", "K", "1", "²", "!", "...", "?!", "<|", "<|endoftext|>", "日本", "😀", "é", "É", "a", "The", "x" * 45, "et" * 300, "\u1100", "\u1161", "'LL", "ſ", "\u1c89"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for bpe.CACHE_PIECES in (100_000, 8):
        assert [x for x in texts if ids(x) != t.encode(x, add_special_tokens=False).ids] == []
    bpe.CACHE_PIECES = 100_000
    searched = []
    v.pieces = lambda x, real=v.pieces: searched.append(x) or real(x)
    assert ids("Ändern, the\nnewest wordsmiths...") == t.encode("Ändern, the\nnewest wordsmiths...", add_special_tokens=False).ids and not searched


def test_quality_counts(data):
    from waymark.llm.quality import counts

    docs, rows, _ = data
    want = Counter()
    for i, text in rows:
        w = text.encode().split()
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)] += 1
    assert as_counter(counts(docs).collect(), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def test_quality_keeps_base(spark):
    from waymark.llm.quality import quality_rules

    out = quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(out) == 200
    for r in out:
        bad = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == bad and not (bad and r["kept"])


def test_quality_rejects_junk_of_every_language(spark):
    """With enough labels for five rules and four languages, planted junk goes and good texts stay."""
    import random

    from waymark.llm import quality

    rng = random.Random(3)
    rows, labels = [], []
    for lang in ("en", "fr", "de", "es"):
        for k in range(1650):
            junk = k >= 1600
            words = [f"{rng.randrange(10**6):06d}" + "#" * (junk and i % 2) for i in range(60)]
            labels.append((len(rows), int(not junk)))
            rows.append((len(rows), lang, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.quality_rules(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(len(rows)) if i % 1650 < 1600}
    told = quality.report(quality.rule_bins(quality.counts(docs)), labels).collect()
    assert {(r["lang"], r["documents"], r["labels"], r["rejected_symbols"]) for r in told} == {(x, 1650, 1600, 50) for x in ("en", "fr", "de", "es")}
    need = quality.labels_needed(4)
    assert {r["needed"] for r in told} == {need}
    assert quality.most_rejected(need, quality.RISK / 5, quality.DELTA / 20) == 0 and quality.most_rejected(need - 1, quality.RISK / 5, quality.DELTA / 20) == -1


def test_quality_counts_each_text_once(spark):
    """Repeated labels and documents give the cutoffs of one each; a bad label of one copy counts for all."""
    from pyspark.sql import functions as F

    from waymark.llm import quality

    def cuts(docs, labels):
        return quality.cutoffs(quality.rule_bins(quality.counts(docs)), labels)

    docs = spark.range(60).selectExpr("id as doc_id", "'fr' as lang", "repeat(concat('mot', id, ' et un autre '), 15 + id) as text")
    docs = docs.withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('w', doc_id, 'x', i)))"))
    labels = docs.selectExpr("doc_id", "1 as quality")
    many = labels.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(128)))).drop("k")
    copies = docs.withColumn("doc_id", F.explode(F.sequence(F.col("doc_id") * 1000, F.col("doc_id") * 1000 + 127)))
    assert cuts(docs, labels) == cuts(docs, many) == cuts(copies, copies.selectExpr("doc_id", "1 as quality")) == {}
    enough = spark.range(1300).selectExpr("id as doc_id", "'fr' as lang").withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('w', doc_id, 'x', i)))"))
    good = enough.selectExpr("doc_id", "1 as quality")
    once = cuts(enough, good)
    assert set(once) == {"fr"} and once == cuts(enough.unionByName(enough.where("doc_id < 5")), good.unionByName(good))
    binned = quality.rule_bins(quality.counts(enough.unionByName(enough.withColumn("doc_id", F.col("doc_id") + 5000))))
    assert quality.trials(binned, good).count() == 1300
    mixed = good.unionByName(spark.createDataFrame([(5000, 0), (1, 0), (2, None), (None, 1)], "doc_id long, quality int"))
    assert quality.trials(binned, mixed).count() == 1298


def test_risk_holds_with_repeats(spark):
    """The same draws with each text many times: cutoffs are those of the distinct texts."""
    import random

    from waymark.llm import quality

    rng = random.Random(6)
    rows = [(i, "en", " ".join(f"w{rng.randrange(10**6)}" + "#" * (rng.random() < 0.02) for _ in range(60))) for i in range(1400)]
    again = [(10_000 * k + i, lang, t) for i, lang, t in rows for k in range(1, 1 + (40 if i % 7 == 0 else 1))]
    cut = []
    for r in (rows, again):
        docs = spark.createDataFrame(r, "doc_id long, lang string, text string")
        cut.append(quality.cutoffs(quality.rule_bins(quality.counts(docs)), docs.selectExpr("doc_id", "1 as quality")))
    assert cut[0] == cut[1] and cut[0]


def test_exact_binomial_bound():
    """The bound against sums of exact binomial terms."""
    from fractions import Fraction

    from waymark.llm.quality import most_rejected, upper_bound

    def below(k, n, p):
        return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))

    for n in (1, 2, 10, 60, 300):
        for k in sorted({0, 1, n // 10, n // 2} - {n}):
            for delta in (0.05, 0.001):
                p = upper_bound(k, n, delta)
                assert below(k, n, Fraction(p - 1e-7)) >= delta >= below(k, n, Fraction(min(1, p + 1e-7)))
    assert upper_bound(5, 5, 0.1) == upper_bound(0, 0, 0.1) == 1.0
    for n in (100, 1000, 3000):
        k = most_rejected(n, 0.02, 0.01)
        assert k < 0 and upper_bound(0, n, 0.01) > 0.02 or upper_bound(k, n, 0.01) <= 0.02 < upper_bound(k + 1, n, 0.01)


def test_fixed_sequence_keeps_the_risk():
    """Over many draws of good values a rule's cutoff rejects more than its risk of the good ones
    no oftener than the confidence allows."""
    import numpy as np

    from waymark.llm.quality import BINS, most_rejected

    rng = np.random.default_rng(5)
    share = 0.97 ** np.arange(BINS)
    share /= share.sum()
    over = 1 - share.cumsum()  # true share of good values above each bin
    risk, delta, n, tries, bad, acted = 0.02, 0.05, 2000, 400, 0, 0
    most = most_rejected(n, risk, delta)
    for _ in range(tries):
        h = rng.multinomial(n, share)
        above = np.concatenate([h[::-1].cumsum()[::-1][1:], [0]])
        cut = int(np.argmax(above <= most))
        bad += over[cut] > risk
        acted += cut < BINS - 1
    assert acted == tries and bad <= tries * delta + 3 * math.sqrt(tries * delta * (1 - delta))


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(data):
    from waymark.llm.sharding import shard_table

    docs, rows, _ = data
    out = shard_table(docs).collect()
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode()), "key", jump(i or 0, 40), jump(i or 0, 41)) for i, t in rows)
    assert as_counter(out, "doc_id", "size", "text_crc32", "law", "shard", "grown_shard") == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_hash_values(spark):
    from pyspark.sql import functions as F

    from waymark.llm.sharding import jump_hash

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, *range(2, 300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 1000):
        assert [r[0] for r in df.select(jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def components(fps):
    root = {i: i for i in range(len(fps))}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    return [find(a) for a in range(len(fps))]


def brute_fingerprint(text, k=4):
    w = words(text)
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(data):
    from waymark.llm.simhash import near_components

    docs, rows, _ = data
    fps = [brute_fingerprint(t) for _, t in rows]
    group = components(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group))
    assert as_counter(near_components(docs).collect(), "doc_id", "fingerprint", "component_id") == want


def test_simhash_planted(spark):
    """Chains of near fingerprints, a dense cloud beyond one block, and random ones."""
    import random

    import numpy as np

    from waymark.llm import simhash

    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:60]:
        for _ in range(rng.randint(1, 6)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.append(f)
    cloud = rng.getrandbits(64)
    fps += [cloud ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for block, hot in ((2048, 8192), (16, 32)):
        simhash.BLOCK, simhash.HOT_ROWS = block, hot
        got = {int(np.int64(r["node"]).view(np.uint64)): r["root"] for r in simhash.components(simhash.edges(df)).collect()}
        by = defaultdict(set)
        for f, g in zip(fps, components(fps)):
            by[g].add(f)
        mine = defaultdict(set)
        for f in fps:
            mine[got.get(f, ("alone", f))].add(f)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))
    simhash.BLOCK, simhash.HOT_ROWS = 2048, 8192


def test_near_fingerprints_leave_as_stars(spark):
    """A cloud of near fingerprints leaves few different links: under most keys its members meet the
    same smallest one."""
    import random

    import numpy as np

    from waymark.llm import simhash

    rng = random.Random(5)
    cloud = {1 << 62 | sum(1 << b for b in rng.sample(range(60), rng.randint(0, 4))) for _ in range(3000)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(cloud)], "fp long")
    links = simhash.edges(df, 8, 9).distinct().collect()
    assert all(r["b"] < r["a"] for r in links)
    assert len(links) <= 6 * len(cloud)
    assert {r["root"] for r in simhash.components(spark.createDataFrame(links)).collect()} == {min(int(np.uint64(f).view(np.int64)) for f in cloud)}


def test_warc(spark):
    from waymark.llm.warc import round_trip

    rows = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, "u\n", None), (4, None, ""), (5, "v", "é" * 200_000), (None, "v", "b"), (6, "v", "b"), (7, "v", "WARC/1.1\r\n\r\n"), (8, "v", "c"), (8, "v", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").unionByName(spark.read.parquet(f"{SF}/pages.parquet"))
    rows = [(r[0], (r[2] or "").encode()) for r in pages.collect()]
    last = {}
    for i, p in rows:
        last[p] = max(i if i is not None else -1, last.get(p, -1))
    want = Counter()
    for i, p in rows:
        again = i != last[p]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[p] if again else None] += 1
    assert as_counter(round_trip(pages).collect(), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert round_trip(pages.limit(0)).count() == 0


def test_warc_members(tmp_path):
    """A whole-file stream with odd line ends becomes members that can be read alone."""
    import gzip
    import io

    from waymark.llm.warc import normalise, record

    a, b = record(1, "u", b"x" * 300_000, None, "response"), b"WARC/1.0\nWARC-Type: metadata\nContent-Length: 3\nX:\n y\n\nabc\n\n\n"
    out = io.BytesIO()
    index = list(normalise(io.BytesIO(gzip.compress(a + b + a)), out))
    assert [k for *_, k in index] == ["response", "metadata", "response"]
    data = out.getvalue()
    assert [gzip.decompress(data[o : o + n])[:8] for o, n, *_ in index] == [b"WARC/1.1", b"WARC/1.0", b"WARC/1.1"]
    assert sum(n for _, n, *_ in index) == len(data)
    with pytest.raises(ValueError):
        list(normalise(io.BytesIO(gzip.compress(a[:-50])), io.BytesIO()))


class PlainKatz:
    """The model in plain Python: counts of word tuples and the recursion, order by order."""

    def __init__(self, texts, order):
        import numpy as np

        from waymark.llm import katz

        self.tables = []
        for k in range(1, order + 1):
            c = Counter()
            for w in texts:
                padded = ["<s>"] * (k - 1) + w
                c.update(tuple(padded[i : i + k]) for i in range(len(w)))
            d = katz.good_turing(np.array([sum(n == r for n in c.values()) for r in range(1, 7)]))
            after = defaultdict(dict)
            for g, n in c.items():
                after[g[:-1]][g[-1]] = n
            self.tables.append((after, [*d, 1.0]))
        self.cache = {}

    def kept(self, k, n):
        return self.tables[k - 1][1][min(n, 6)] * n

    def share(self, context, word):
        k = len(context) + 1
        seen = self.tables[k - 1][0].get(context)
        if not seen:
            return self.share(context[1:], word) if k > 1 else 1.0
        if context not in self.cache:
            whole = sum(seen.values())
            left = whole - sum(self.kept(k, n) for n in seen.values())
            left, whole = (left, whole) if left > 1e-12 else (1.0, whole + 1)
            below = 1 - (sum(self.share(context[1:], w) for w in seen) if k > 1 else 0)
            self.cache[context] = whole, left / whole / below
        whole, weight = self.cache[context]
        if word in seen:
            return self.kept(k, seen[word]) / whole
        return weight * (self.share(context[1:], word) if k > 1 else 1.0)


@pytest.mark.parametrize("order, block, parts, hot", [(2, 1 << 20, 4, 1 << 22), (3, 1 << 20, 4, 1 << 22), (2, 300, 1, 20), (3, 300, 1, 20), (1, 300, 1, 20)])
def test_katz(data, monkeypatch, order, block, parts, hot):
    """Scores equal the plain model's, also with many blocks and with contexts dealt by follower."""
    from waymark.llm import katz

    docs, rows, _ = data
    for name, value in (("BLOCK_TOKENS", block), ("PART_BLOCKS", parts), ("HOT_TOKENS", hot), ("HOT_SHARE", 10**9)):
        monkeypatch.setattr(katz, name, value)
    texts = [(i, words(t) + [b""], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in rows]
    train = [w for _, w, out in texts if not out]
    c = Counter(x for w in train for x in w)
    total, distinct = sum(c.values()), len(c)
    model = PlainKatz(train, order)
    got = [tuple(r) for r in katz.katz_scores(docs, order).collect()]
    want = []
    for i, w, out in texts:
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(model.share(tuple(padded[j : j + order - 1]), x)) for j, x in enumerate(w))
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        want.append((i, out, len(w), sum(c[x] > 0 for x in w), total, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5] and g[5:] == pytest.approx(x[5:], rel=1e-9, abs=1e-9)


def test_katz_hands_back_memory(monkeypatch):
    """Each task and each group of words, requests, counts and scores ends by handing back memory;
    before, workers kept what their largest groups had taken."""
    import inspect

    import pyarrow as pa

    from waymark.llm import common, katz

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    table = pa.table({"a": [1]})
    assert common.tidy_group(lambda g, n: g.slice(0, n), 0)(table).num_rows == 0 and len(given) == 1
    with pytest.raises(ValueError):
        common.tidy_group(lambda g: int("x"))(table)
    assert len(given) == 2
    for f in (katz._cut_words, katz._hot_rows):
        list(f(iter([])) if f is katz._hot_rows else f(iter([]), 1))
    assert len(given) == 4
    source = inspect.getsource(katz.katz_scores)
    assert source.count("applyInArrow(tidy_group(") == source.count("applyInArrow(") == 4


def test_katz_shares_sum_to_one(spark):
    """Over all words that training has, and the unknown one, in contexts of every kind."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    train = [words(r["text"] or "")[:60] + [b""] for r in docs][:60]
    model = PlainKatz(train, 3)
    every = {w for t in train for w in t} | {b"never seen"}
    some = [(), ("<s>",), ("<s>", "<s>"), (b"never", b"seen"), (b"", train[0][0]), *[tuple(t[:2]) for t in train[:20]], *[(t[3],) for t in train[:20] if len(t) > 3]]
    for context in some:
        assert sum(model.share(context, w) for w in every) == pytest.approx(1, abs=1e-9)


def test_mixing(data):
    from waymark.llm.mixing import TEMPERATURE, poisson_mix

    docs, _, _ = data
    rows = docs.collect()
    n = Counter(r["source"] for r in rows)
    w = {s: k**TEMPERATURE for s, k in n.items()}
    want = Counter()
    for r in rows:
        rate = w[r["source"]] / sum(w.values()) * len(rows) / n[r["source"]]
        i = "" if r["doc_id"] is None else r["doc_id"]
        u = int(hashlib.md5(f"mix|{i}|1".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-rate)
        cdf = p
        while u >= cdf:
            k += 1
            p *= rate / k
            cdf += p
        for c in range(k):
            want[r["doc_id"], r["text"], c] += 1
    out = poisson_mix(docs)
    assert as_counter(out.collect(), "doc_id", "text", "copy") == want
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys)


def test_mixing_deals_rows_without_ids(spark):
    """All rows with one null doc_id: no task has much more than its share."""
    from pyspark.sql import functions as F

    from waymark.llm.mixing import poisson_mix

    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "'a' as source", "'x' as _digest")
    out = poisson_mix(docs)
    each = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 4000 and len(each) == 8 and max(each) < 2 * 4000 / 8


def test_poisson_inverse_is_right_for_large_means(spark):
    from pyspark.sql import functions as F

    from waymark.llm.mixing import poisson_mix

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 4, "rare").otherwise("common").alias("source"))
    weights = spark.createDataFrame([("rare", 0.9), ("common", 0.1), ("absent", 1.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in poisson_mix(docs, weights, total=2.0).groupBy("source").count().collect()}
    assert n["rare"] == pytest.approx(720, rel=0.15) and n["common"] == pytest.approx(80, rel=0.4)


def test_extra_columns(spark):
    """Further columns, with names that the operators use inside or give out, do no harm."""
    from pyspark.sql import functions as F

    from waymark.llm import bpe, fingerprint, katz, mixing, quality, sharding, simhash, toxicity, warc

    names = ["fp", "root", "part", "block", "data", "kind", "n", "key", "_n", "_part", "shard", "slot", "bin", "least", "a", "b", "_in", "_id", "_drop", "_md5", "_doc", "_s", "_w", "_copies", "rate", "copy", "mix_key", "_score", "_text", "score", "threshold", "toxic", "quality", "bucket", "rid", "ghost", "k", "has", "_kept"]
    docs = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit(f"v{n}").alias(n) for n in names])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_components(docs).count() == katz.katz_scores(docs).count() == sharding.shard_table(docs).count() == len(ODD)
    assert quality.quality_rules(docs, nothing).count() == fingerprint.fingerprint(docs).count() == toxicity.classify(docs, nothing).count() == len(ODD)
    assert mixing.poisson_mix(docs).where("source = 'a' and rate > 0 and copy >= 0").count() > 0
    for out in (mixing.replicate(docs), simhash.near_dedup(docs), toxicity.keep_clean(docs, nothing)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[n] == f"v{n}" for r in rows for n in names)
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(encoded) == len(ODD) and all(r[n] == f"v{n}" for r in encoded for n in names)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *names)
    assert warc.round_trip(pages).count() == len(ODD)
    assert isinstance(docs.schema, T.StructType)


@pytest.mark.parametrize("links", [[(5, 1), (3, 1), (9, 2)], [], [(k + 1, k) for k in range(40)], [(1, 2), (2, 3), (3, 1), (7, 7), (9, 8)]])
def test_components_end_with_stars_and_no_further_round(spark, monkeypatch, links):
    """Stars take no round at all: one table is written, not two."""
    from waymark.llm import simhash

    made = []
    monkeypatch.setattr(simhash, "written", lambda df, real=simhash.written: made.append(1) or real(df))
    got = {(r["node"], r["root"]) for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least: dict = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == set(least.items())
    if all(a > b for a, b in links) and not {a for a, _ in links} & {b for _, b in links}:
        assert len(made) == 1
