"""Document fingerprints by consistent weighted sampling, in column expressions alone.

A text is its words (lower case) weighted by how often they occur. For each of ``samples`` draws
a word with weight w gets, from its hash, r and c of the Gamma(2, 1) distribution and b uniform
in (0, 1); with t = floor(ln w / r + b) its value is c * exp(-r * (t - b + 1)), and the draw is
(word, t) of the least value (Ioffe 2010). Two texts agree in a draw with the probability
sum(min) / sum(max) of their weights, the generalised Jaccard similarity.

The plan shuffles each text once, into ranges of doc_id, so that the next document is at hand;
words, counts, draws and comparisons are then local to the range. A range's first document is
sent to the range before it as well.

Defined cases: a null text is empty; a text without words has one word, the empty one; null
doc_ids come first and rows with one doc_id are in order of their texts; the last row is
followed by the first, a single row by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import shuffle_partitions

SAMPLES = 40
#: Least doc_id, in whose place a null stands when rows are put in order.
_FIRST = -(2**63)
_WORDS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.array_remove(F.split(F.lower(text), _WORDS), "")


def _unit(bits: Column, width: int) -> Column:
    """A number within (0, 1) from the lowest bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) / float(1 << width)


def draw(word: Column, log_weight: Column, k: int) -> Column:
    """ln of a word's value in draw k. A value stands for its word and t: others are equal to it
    with a probability of about 2**-50, so the least value is the draw itself.

    Logarithms are what this costs; the common weight of one, for which t is 0, saves one.
    """
    h = F.xxhash64(word, F.lit(k))
    g = F.xxhash64(h)
    r = -F.ln(_unit(h, 26) * _unit(F.shiftrightunsigned(h, 26), 26))
    log_c = F.ln(-F.ln(_unit(g, 26) * _unit(F.shiftrightunsigned(g, 26), 26)))
    b = (F.shiftrightunsigned(h, 52) * 4096 + F.shiftrightunsigned(g, 52)).cast("double") / float(1 << 24) + 2.0**-25
    steps = F.when(log_weight == 0.0, F.lit(1.0) - b).otherwise(F.floor(log_weight / r + b).cast("double") - b + 1.0)
    return log_c - r * steps


def likeness(a: Column, b: Column) -> Column:
    """Share of the draws in which two fingerprints agree."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same).cast("double") / F.size(a).cast("double")


def _search(bounds: list[int], x: Column) -> Column:
    """Number of bounds below x, by halving; bounds are sorted."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("long") for b in bounds])

    def go(at: Column, i: Column) -> Column:
        jump = F.pow(F.lit(2.0), (F.lit(steps) - i).cast("double")).cast("int")
        probe = F.get(table, at + jump - 1)
        return F.when(probe < x, at + jump).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), go)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(bucket, rid, ghost, doc_id, text, next_text) in order of doc_id within buckets.

    Ghost rows are the copies of a bucket's first rows that end the bucket before it. The driver
    holds one boundary and one least doc_id for each bucket.
    """
    spark = docs.sparkSession
    partitions = partitions or 4 * shuffle_partitions(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("k"))
    cuts = rows.agg(F.percentile_approx("k", [i / partitions for i in range(1, partitions)], 10 * partitions)).first()[0]
    bounds = sorted(set(cuts or []))
    bucket = _search(bounds, F.col("k"))
    firsts = {r["bucket"]: r["k"] for r in rows.select(bucket.alias("bucket"), "k").groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    used = sorted(firsts)
    n = len(bounds) + 1
    least = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(n)])
    before = {b: used[i - 1] for i, b in enumerate(used)}
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(n)])
    place = lambda b, ghost: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"))
    own = F.col("b0")
    spots = F.when(F.col("k") == F.get(least, own), F.array(place(own, False), place(F.get(to, own), True))).otherwise(F.array(place(own, False)))
    dealt = rows.withColumn("b0", bucket).select("doc_id", "text", "k", F.explode(spots).alias("s")).select("doc_id", "text", "k", "s.bucket", "s.ghost")
    w = Window.partitionBy("bucket").orderBy("ghost", "k", "text")
    return dealt.repartition(partitions, "bucket").select("bucket", "ghost", "doc_id", "text", F.row_number().over(w).alias("rid"), F.lead("text").over(w).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last half of a text's code points replaced by as many of the next text's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature) from rows (keys, word): counts per word, then the least of each draw."""
    counted = terms.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")).withColumn("lw", F.ln(F.col("n").cast("double")))
    return counted.groupBy(*keys).agg(*[F.min(draw(F.col("word"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)]).select(*keys, F.array(*[F.col(f"s{k}") for k in range(samples)]).alias("signature"))


def hexed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = with_next(docs)
    changed = edited(F.col("text"), F.col("next_text"))
    meta = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(changed.cast("binary"), 256).alias("sha"), "ghost")
    # kind 0: the text, 1: its edited form, 2: what belongs to the row
    kind = lambda k, text: F.struct(F.lit(k).alias("kind"), text.alias("text"))
    each = base.select("bucket", "rid", meta.alias("all"), F.explode(F.array(kind(0, F.col("text")), kind(1, changed), kind(2, F.lit("")))).alias("x")).where(~((F.col("x.kind") == 1) & F.col("all.ghost")))
    each = each.select("bucket", "rid", "x.kind", F.when(F.col("x.kind") == 2, F.col("all")).alias("meta"), words(F.col("x.text")).alias("words"))
    # a text without words has one row, whose word is null
    terms = each.select("bucket", "rid", "kind", "meta", F.explode_outer("words").alias("w")).select("bucket", "rid", "kind", "meta", F.xxhash64("w").alias("word"))
    signed = signatures(terms, ["bucket", "rid", "kind", "meta"], samples)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("signature")))
    rows = signed.groupBy("bucket", "rid").agg(F.max("meta").alias("m"), of(0).alias("own"), of(1).alias("new"))
    rows = rows.withColumn("following", F.lead("own").over(Window.partitionBy("bucket").orderBy("rid"))).where(~F.col("m.ghost"))
    return rows.select(
        "m.doc_id", "m.n_chars", F.col("m.sha").alias("edited_sha256"), hexed(F.col("own")).alias("fingerprint"), hexed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
