"""Mixing of sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the
input. A document's number of copies is the inverse of the Poisson distribution function at
a number hashed from seed and document, so it depends on neither order nor partitions. The
copies are shuffled by a hash of their own.

Copies come in order of a key made from seed, document, copy and text, so rows that share a doc_id,
or have none, are as evenly dealt as others; only copies of equal rows share a key, and no order
tells these apart.

Defined cases: a null source is a source like any other; a source without a weight, or with
one that is null or not positive, is left out of the mix; repeated rows get the same number
of copies each; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import shuffle_partitions
from waymark.operators.joins import join_small

#: A larger mean is drawn as a sum of Poisson numbers with means of at most this.
MEAN_LIMIT = 64.0
#: Exponent by which shares of documents become target weights: 1 keeps them, 0 evens them out.
TEMPERATURE = 0.7
#: Hex digits of a hash that make a fraction, within the 53 bits of a double.
_DIGITS = 13


def hashed_fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) from the hash of the parts' texts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**_DIGITS))


def poisson_inverse(mean: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u for a mean of at most MEAN_LIMIT.

    The sum runs as far as the distribution function can be told from 1 in a double.
    """
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))
    steps = F.sequence(F.lit(1), (F.ceil(mean) + F.ceil(F.sqrt(mean) * 12) + 20).cast("int"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.when(u < s["cdf"], s).otherwise(F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), k.alias("k")))

    return F.aggregate(steps, start, add, lambda s: s["k"])


def temperature_weights(docs: DataFrame, source: str = "source", exponent: float = TEMPERATURE) -> DataFrame:
    """(source, weight) with weights as a power of the sources' numbers of documents."""
    return docs.select(F.col(f"`{source}`").alias(source)).groupBy(source).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(exponent)).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, source: str = "source", total: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of each document so that sources appear by weight and the
    output has total times as many documents as the sources with a weight have."""
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    usable = weights.where(F.col("weight") > 0).withColumnRenamed(source, "_w")
    both = counts.join(usable, F.col(source).eqNullSafe(F.col("_w"))).drop("_w")
    sums = both.agg(F.sum("weight").alias("_sw"), F.sum("_n").alias("_sn"))
    # one row of totals beside one row for each source
    rated = both.join(F.broadcast(sums), how="cross")
    return rated.select(F.col(source).alias("_s"), (F.col("weight") / F.col("_sw") * F.col("_sn") * F.lit(total) / F.col("_n")).alias("rate"))


def _mixed(docs: DataFrame, weights: DataFrame | None, seed: str, total: float, key: str, source: str, text: str = "text") -> DataFrame:
    """(_in, rate, copy, mix_key): each copy's row as it is, in order of mix_key."""
    rates = repetition_rates(docs, weights if weights is not None else temperature_weights(docs, source), source, total)
    rows = docs.select(F.struct("*").alias("_in"))
    rated = join_small(rows, rates, F.col(f"_in.`{source}`").eqNullSafe(F.col("_s"))).drop("_s")
    times = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_LIMIT).cast("int"))
    name = F.col(f"_in.`{key}`")
    draws = F.transform(F.sequence(F.lit(1), times), lambda i: poisson_inverse(F.col("rate") / times, hashed_fraction(seed, name, i)))
    out = rated.withColumn("_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).where(F.col("_copies") > 0)
    # once for each document, before its copies are made
    digest = F.md5(F.coalesce(F.col(f"_in.`{text}`"), F.lit("")).cast("binary")) if text in docs.columns else F.lit("")
    out = out.withColumn("_digest", digest).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed + ":order"), F.coalesce(name.cast("string"), F.lit("")), F.col("copy").cast("string"), "_digest").cast("binary")))
    # keys are uniform, so ranges of their first digits are equal parts and nothing need be sampled
    n = shuffle_partitions(docs.sparkSession)
    place = F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    return out.drop("_digest").repartitionById(n, place).sortWithinPartitions("mix_key")


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", total: float = 1.0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Docs repeated to the weights, with rate, copy (from 0) and mix_key, in order of mix_key.

    Rates meet documents by a broadcast join if the sources are few, else by one that AQE can
    split. The last step deals rows by the leading digits of a hash, which no hot source can
    unbalance. Columns of docs that are called like the three are replaced by them.
    """
    kept = [c for c in docs.columns if c.lower() not in ("rate", "copy", "mix_key")]
    return _mixed(docs, weights, seed, total, key, source).select(*[F.col(f"_in.`{c}`") for c in kept], "rate", "copy", "mix_key")


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", total: float = 1.0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Docs repeated and shuffled as by ``poisson_mix``, in their own columns whatever their names."""
    return _mixed(docs, weights, seed, total, key, source).select("_in.*")


ORACLE = """
with n as (select source, count(*) as n, pow(cast(count(*) as double), 0.7) as w from documents group by source),
r as (select source, w / (select sum(w) from n) * (select sum(n) from n) * cast(1 as double) / n as rate from n),
d as (select documents.*, rate, cast(('0x' || substr(md5('mix|' || doc_id || '|1'), 1, 13)) as bigint) / cast(4503599627370496 as double) as u
  from documents join r on documents.source is not distinct from r.source),
c as (select *, list_reduce(list_prepend({'p': exp(-rate), 'cdf': exp(-rate), 'k': 0, 'i': 0}, [{'p': cast(0 as double), 'cdf': cast(0 as double), 'k': 0, 'i': cast(i as int)} for i in range(1, 141)]),
  lambda s, x: case when u < s.cdf then s else {'p': s.p * rate / x.i, 'cdf': s.cdf + s.p * rate / x.i, 'k': x.i, 'i': x.i} end).k as copies from d),
e as (select *, unnest(range(copies)) as copy from c)
select doc_id, text, lang, source, n_chars, round(rate, 6) as rate, cast(copy as int) as copy, md5('mix:order|' || doc_id || '|' || copy || '|' || md5(coalesce(text, ''))) as mix_key from e
"""
