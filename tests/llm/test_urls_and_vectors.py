"""Url filters, hard negatives and vector codes against brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import codes, negatives, urls

SF = "/root/testdata/sf0.01"


# ---- url filters

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path, rules=urls.RULES):
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain_shape(path):
    path = re.sub(r"(?<![0-9A-Za-z])([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{8,})(?![0-9A-Za-z])", lambda m: "{h}" if re.search("[0-9]", m[0]) and re.search("[a-fA-F]", m[0]) or "-" in m[0] else m[0], path)
    parts = [s for s in re.sub(r"[0-9]+", "{n}", path).split("/") if s]
    return tuple(parts[: urls.LEVELS] + ["**"] * (len(parts) > urls.LEVELS) + ["$"])


def plain_templates(rows):
    """(host, shape) -> (template, purity), node by node."""
    out = {}
    labelled = [g for *_, g in rows if g is not None]
    overall = (sum(labelled) + 1) / (len(labelled) + 2)
    smooth = lambda g, n, above: (g + urls.PRIOR * above) / (n + urls.PRIOR)

    def tally(members):
        known = [g for _, g in members if g is not None]
        return sum(known), len(known)

    def walk(members, depth, node, purity, host):
        for s, _ in members:
            if len(s) == depth:
                out[host, s] = (re.sub(r"/\$$", "", node), purity)
        members = [m for m in members if len(m[0]) > depth]
        n = Counter(s[depth] for s, _ in members)
        total = sum(n.values())
        name = lambda seg: seg if seg in ("$", "**") or n[seg] >= urls.MIN_ROWS and n[seg] >= urls.MIN_SHARE * total else "*"
        branches = defaultdict(list)
        for m in members:
            branches[name(m[0][depth])].append(m)
        groups = []
        for _, seg, g, k in sorted((smooth(*tally(b), purity), seg, *tally(b)) for seg, b in branches.items()):
            if groups:
                _, g0, k0 = groups[-1]
                pooled = (g + g0) / max(1, k + k0)
                if not (g0 * k - g * k0) ** 2 > urls.DIFFERENT**2 * pooled * (1 - pooled) * (k + k0) * k * k0:
                    groups[-1] = (groups[-1][0] + [seg], g0 + g, k0 + k)
                    continue
            groups.append(([seg], g, k))
        for segs, g, k in groups:
            label = "|".join(sorted(segs))
            walk([m for s in segs for m in branches[s]], depth + 1, f"{node}/{f'({label})' if len(segs) > 1 else label}", smooth(g, k, purity), host)

    by_host = defaultdict(list)
    for host, path, g in rows:
        by_host[host].append((plain_shape(path), g))
    for host, members in by_host.items():
        walk(members, 0, "", smooth(*tally(members), overall), host)
    return out


def check_urls(spark, rows):
    """rows: (page_id, url, good)."""
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in urls.judge(df).collect())
    parsed = [(*plain_parts(u), g) for _, u, g in rows]
    made = plain_templates(parsed)
    want = Counter()
    for (i, _, _), (host, path, _) in zip(rows, parsed):
        rule, verdict = plain_rule(host, path)
        template, purity = made[host, plain_shape(path)]
        want[i, host, path, rule, verdict or ("block" if purity < urls.LIMIT else "allow"), template if len(template) <= 1000 else template[:1000] + "...", round(purity, 9)] += 1
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return got


def test_url_trees(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        host, kind = rng.choice(["One.example", "two.example", "two.example", "a.example.net", "shop.example.com", "x.org"]), rng.random()
        area = rng.choice(["news", "News", "promo", "about", "de", "fr"])
        leaf = rng.choice([f"{rng.randrange(9999)}", f"{rng.randrange(99)}.html", f"page-{rng.randrange(50)}/", "".join(rng.choice("abcdefgh") for _ in range(6)), f"{rng.getrandbits(64):016x}", ""])
        url = f"http{'s' * (kind < 0.5)}://{host}/{area}/{leaf}{rng.choice(['', '?q=1', '#top', '?a#b/c'])}"
        good = None if rng.random() < 0.4 else (rng.random() < (0.1 if area == "promo" else 0.9))
        rows.append((i, url, good))
    got = check_urls(spark, rows)
    blocked = {k[5] for k in got if k[4] == "block" and k[3] is None}
    assert blocked and all("promo" in t for t in blocked)


def test_url_cases(spark):
    long = "http://long.example/" + "a-b/" * 20_000
    rows = [
        (1, None, True), (2, "", None), (3, "no scheme/en/5", False), (4, "http://net", None), (5, "http://net/", None), (6, "http://NET/x", True), (7, "ftp://A.ÉX.net?x://y/", None),
        (8, "http://xnet/", None), (9, "http://example.net/en", None), (10, "http://www.example.net/en/", None), (11, "a://b://c/d", None), (12, "://", None), (13, "http:///p", None),
        (None, "http://org/fr/1", None), (None, "http://org/fr/1", None), (14, long, None), (15, "http://org/fr/1\n2", None), (16, "http://d.example/" + "0" * 50_000, None), (17, "http://e.example/" + "-" * 50_000, None),
        (18, "http://f.example/x|y/1", True), (18, "http://" + "a." * 5000 + "net/", False), (19, "http://g.example/1/2/3/4/5/6/7/8/9/10/11/12/13/14", None),
    ]
    check_urls(spark, rows)


def test_url_query_cases(spark):
    none = urls.judged_pages(spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0 and none.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    pages = spark.createDataFrame([(1, "http://a.example/en/7"), (2, "http://a.example/en/8.html"), (3, "http://a.example/x9/"), (4, None), (5, "http://a.example/7/en")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (8, 1, 0), (9, 0, 0), (None, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int")
    assert {r["page_id"]: r["good"] for r in urls.labelled_pages(pages, labels).collect()} == {1: True, 2: False, 3: False, 4: None, 5: None}
    clash = pages.withColumn("host", pages["page_id"]).withColumn("Key", pages["page_id"]).withColumn("n", pages["page_id"]).withColumn("good", pages["page_id"] > 2).withColumn("_in", pages["page_id"])
    out = urls.judge(clash)
    assert out.count() == 5 and {r["host"] for r in out.collect()} == {"a.example", ""} and {"Key", "n", "_in"} <= set(out.columns)


def test_hot_url_host_is_dealt(spark, monkeypatch):
    """Joins on a host and template that hold nearly all rows, in parts of a few rows."""
    from waymark.operators import joins

    monkeypatch.setattr(urls, "is_small", lambda *_: False)
    monkeypatch.setattr(urls, "join_hot", lambda *a: joins.join_hot(*a, hot_rows=20))
    check_urls(spark, [(i, f"http://hot.example/s{chr(97 + i % 20)}/{'x' * (i % 30)}y/{i}", i % 3 > 0) for i in range(600)])


# ---- hard negatives

def plain_negatives(rows):
    keep = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(x * 256) for x in v])
        keep[i] = min(keep.get(i, r), r)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in keep:
        if a % 100:
            continue
        scored = sorted((-dot(keep[a][1], v), i, label) for i, (label, v) in keep.items() if i != a)
        for s, p, label in [x for x in scored if x[2] == keep[a][0]][:5]:
            fit = [x for x in scored if x[2] != keep[a][0] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return Counter(out)


def mined(df, **sizes):
    rows = negatives.hard_negatives(df, **sizes).collect()
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def vector_rows(seed, n=900, dims=6):
    """Few different values, so scores tie often; one vector makes up a third."""
    rng = random.Random(seed)
    one = [0.25, 0.5, 0.0, -0.25, 0.125, 0.5]
    return [(rng.randrange(4 * n), one if rng.random() < 0.33 else [rng.randrange(-3, 5) / 8 for _ in range(dims)], rng.choice([0, 1, 1, 1, 2, 9])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "block_anchors": 2, "pass_bytes": 1}, {"block_rows": 64, "block_anchors": 3}])
def test_hard_negatives(spark, sizes):
    odd = [(100, None, 1), (200, [0.5], None), (300, [None, 1.0], 1), (400, [math.nan], 1), (500, [math.inf], 1), (None, [0.5], 1), (600, [], 1), (700, [0.5, 0.5], -3), (800, [-1e3, 1e3], 1), (900, [0.5] * 9, 1)]
    rows = vector_rows(5) + odd + [(100, [0.5] * 6, 2), (100, [0.5] * 6, 2)]
    got = mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **sizes)
    assert got == plain_negatives(rows) and len(got) > 100


def test_hard_negatives_take_many_digits(spark):
    """Scores far wider than one digit, and windows of one score."""
    rng = random.Random(8)
    rows = [(i, [rng.randrange(-(1 << 15), 1 << 15) / 7 for _ in range(3)], rng.randrange(3)) for i in range(0, 3000, 5)]
    rows += [(3000 + i, [0.0, 0.0, 1 / 256], i % 2) for i in range(0, 300, 3)]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain_negatives(rows)


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert not mined(spark.createDataFrame([], schema))
    assert not mined(spark.createDataFrame([(100, [0.5], 1)], schema))
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(100, [3e38], 1)], schema))
    f = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in f.collect()]
    assert mined(f.withColumn("k", f["label"]).withColumn("v", f["label"]).withColumn("blk", f["label"])) == plain_negatives(rows)


def test_a_round_shuffles_few_numbers(spark):
    """From the top a task counts no further than to k, whatever the number of rows."""
    rows = spark.range(20_000).selectExpr("id as vec_id", "array(cast(id % 997 as double) / 256, 1.0D) as embedding", "cast(id % 2 as int) as label").repartition(4)
    r = negatives.Rows(negatives.whole_vectors(rows), F.col("vec_id") % 5000 == 0)
    windows = r.anchors.selectExpr("anchor_id", "anchor_id as positive_id", "0L as lo", "reach as hi", "reach as top", "7 as need")
    counts = r._run(windows, negatives._count, False, negatives._COUNTS)
    assert 0 < counts.count() <= r.anchors.count() * 7 * r.packed.rdd.getNumPartitions()


# ---- vector codes

def plain_codes(rows, parts=16, entries=64):
    kept = [(i, [math.floor(x * 256) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    width = dims // parts
    kept = sorted(((i, v, v + [0] * (dims - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[2][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, _, v, _ in kept]

    for _ in range(2):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [r[2][p * width : (p + 1) * width] for r, f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found, total = assign(), Counter()
    for r, f in zip(kept, found):
        total[r[3]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[r[3]], sha) for r, f in zip(kept, found))


def coded(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.code_table(df).collect())


@pytest.mark.parametrize("dims", [32, 7, 0])
def test_vector_codes(spark, dims):
    rng = random.Random(dims)
    rows = [(rng.randrange(300), [rng.choice([-0.5, 0.0, 0.004, 0.3, rng.random()]) for _ in range(dims)], rng.choice([None, 0, 1, 1])) for _ in range(250)]
    rows += [(1, None, 1), (2, [None] * dims, 1) if dims else (2, None, 1), (3, [math.nan] + [0.0] * dims, 1), (None, [0.5] * (dims // 2), None), (None, [0.5] * (dims // 2), None), (7, [], 5)]
    assert coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain_codes(rows)


def test_vector_codes_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert not coded(spark.createDataFrame([], schema)) and not coded(spark.createDataFrame([(1, None, 1)], schema))
    few = [(5, [0.5, -0.25], 1), (3, [0.25, 1.0], None)]
    assert coded(spark.createDataFrame(few, schema)) == plain_codes(few)
    with pytest.raises(ValueError):
        coded(spark.createDataFrame([(1, [3e38], 1)], schema))


def test_search_looks_at_all_that_can_be_nearer():
    """Against the plain minimum, from any entry, with ties and equal entries."""
    rng = np.random.default_rng(4)
    for spread in (2, 5, 1000):
        entries = rng.integers(-spread, spread, (64, 4))
        x, start = rng.integers(-spread, spread, (3000, 4)), rng.integers(0, 64, 3000)
        code, error = codes.Codebook(entries).search(x, start)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_stand_for_near_vectors(spark):
    f = spark.read.parquet(f"{SF}/embeddings.parquet")
    out, books = codes.compress(codes.whole_vectors(f))
    rows = out.join(codes.decoded(out, books), "vec_id").collect()
    assert len(rows) == f.count()
    assert all(sum((a - b) ** 2 for a, b in zip(r["v"], r["approx"])) == r["error"] for r in rows)


def test_label_errors_of_hot_labels(spark, monkeypatch):
    from waymark.operators import joins

    rows = [(i, 1 if i < 90 else None if i < 95 else i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    monkeypatch.setattr(codes, "is_small", lambda *_: False)
    monkeypatch.setattr(codes, "join_hot", lambda *a: joins.join_hot(*a, hot_rows=10))
    total = Counter()
    for _, label, e in rows:
        total[label] += e
    assert {(r["vec_id"], r["label_error"]) for r in codes.label_errors(df).collect()} == {(i, total[label]) for i, label, _ in rows}
