"""URL filters by a tree of path templates and fixed rules.

Addresses of a host are read as paths through a tree. Numbers and hexadecimal ids inside a
segment become wildcards at once; what such shapes leave is counted. Then the tree is built
from the root down, all hosts at the same time. Below a node a segment stays a branch of its own
if it has a fair share of the node's addresses, and all others are one wildcard, so a node has a
bounded number of branches however many segments are seen. Branches whose labelled purity (share
of good addresses) cannot be told apart by a test of two proportions are merged, in order of
purity, each compared with what its group has pooled so far. A node's purity is smoothed
towards that of the node above it, and the root's towards that of all hosts. A template whose
smoothed purity is below a limit is blocked.

Fixed rules come first: one fits its host and that host's subdomains if the path starts with the
rule's, and the longest that fits decides. They are a bounded parameter, looked up within the row.

Only counts by shape are shuffled; a host or node that holds a large part of them is dealt to
parts in every join. All steps are DataFrame functions.

Defined cases: the host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z
lower-cased, the path what follows up to "?", "#" or the end; of a null address, or one without
"://", both are empty, and such addresses are a host of their own. Empty segments do not count.
Segments from the LEVELS-th on are one wildcard "**". Without labels every purity is one half and
nothing is blocked. Repeated rows all count. Of a template over 1,000 characters long the result shows
the beginning. Columns that are called like a result are replaced.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import unused, written
from waymark.operators.joins import is_small, join_hot

#: (verdict, host and path of a rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules travel in the plan; more than these belong in a table.
MOST_RULES = 10_000
#: Segments of a path that are told apart.
LEVELS = 12
#: Share of a node's addresses, and number of them, from which a segment is a branch of its own.
MIN_SHARE, MIN_ROWS = 1 / 32, 4
#: Deviations from which two purities differ.
DIFFERENT = 1.96
#: Labelled addresses that the purity of the node above counts for.
PRIOR = 8.0
#: Purity below which a template is blocked.
LIMIT = 0.5

_RESULTS = ("host", "path", "template", "purity", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shape(path: Column) -> Column:
    """Segments of a path with wildcards for hexadecimal ids and numbers, and a mark of the end."""
    ids = F.regexp_replace(path, r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{8,}+)(?![0-9A-Za-z])", "{h}")
    parts = F.filter(F.split(F.regexp_replace(ids, r"[0-9]+", "{n}"), "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS), F.array(F.lit("**")))).otherwise(parts)
    return F.concat(parts, F.array(F.lit("$")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0].lower(), []).append(F.struct(F.length(F.lit(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit("/" + rule.partition("/")[2]).alias("path")))
    table = F.create_map(*chain.from_iterable((F.lit(h), F.array(*r)) for h, r in by_host.items()))
    # no more of a host's ends than the longest host of a rule has parts
    deep = max(h.count(".") for h in by_host) + 1
    domains = F.array_distinct(F.array(*[F.substring_index(host, ".", -i) for i in range(1, deep + 1)]))
    fits = F.filter(F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda r: r.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def smoothed(good: Column, labelled: Column, above: Column, prior: float = PRIOR) -> Column:
    return (good + F.lit(prior) * above) / (labelled + F.lit(prior))


def _groups(branches: Column) -> Column:
    """Groups of an array of branches (purity, seg, good, labelled): (segs, good, labelled).

    Branches come in order of purity; one joins the last group unless its share of good labels
    and the group's lie DIFFERENT deviations apart.
    """
    empty = F.array().cast("array<struct<segs:array<string>,good:bigint,labelled:bigint>>")
    alone = lambda b: F.array(F.struct(F.array(b["seg"]).alias("segs"), b["good"].alias("good"), b["labelled"].alias("labelled")))

    def add(groups: Column, b: Column) -> Column:
        last = F.element_at(groups, -1)
        n, m = last["labelled"].cast("double"), b["labelled"].cast("double")
        pooled = (last["good"] + b["good"]) / F.greatest(n + m, F.lit(1.0))
        # (difference / deviation) squared, without dividing: no labels and equal shares are alike
        apart = F.pow(last["good"] * m - b["good"] * n, 2) > F.lit(DIFFERENT**2) * pooled * (1 - pooled) * (n + m) * n * m
        both = F.struct(F.concat(last["segs"], F.array(b["seg"])).alias("segs"), (last["good"] + b["good"]).alias("good"), (last["labelled"] + b["labelled"]).alias("labelled"))
        return F.when((F.size(groups) == 0) | apart, F.concat(groups, alone(b))).otherwise(F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(both)))

    # the first is put down outside, as an array without elements has no last one
    return F.aggregate(F.slice(branches, F.lit(2), F.greatest(F.size(branches) - 1, F.lit(0))), F.concat(empty, alone(F.element_at(branches, 1))), add)


def _level(state: DataFrame, k: int) -> DataFrame:
    """The state one segment further down: node and purity of the branch that each shape takes."""
    at = ["host", "node"]
    going = state.where(F.size("shape") > k).withColumn("seg", F.element_at("shape", k + 1))
    seen = going.groupBy(*at, "seg").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "labelled")], F.min("purity").alias("above"), F.count(F.lit(1)).alias("shapes"))
    seen = written(seen)
    nodes = seen.groupBy(*at).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("_rows"), F.sum("shapes").alias("shapes"))
    own = (F.col("n") >= MIN_ROWS) & (F.col("n") >= F.lit(MIN_SHARE) * F.col("all"))
    kept = join_hot(seen.drop("shapes"), nodes, at, "_rows").withColumn("seg", F.when(own | F.col("seg").isin("$", "**"), F.col("seg")).otherwise(F.lit("*")))
    kept = kept.groupBy(*at, "seg").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"), F.min("above").alias("above"), F.min("shapes").alias("shapes"))
    # a node has at most 1 / MIN_SHARE branches and three more
    branch = F.struct(smoothed(F.col("good"), F.col("labelled"), F.col("above")).alias("purity"), "seg", "good", "labelled")
    merged = kept.groupBy(*at).agg(F.array_sort(F.collect_list(branch)).alias("branches"), F.min("above").alias("above"), F.min("shapes").alias("shapes"))
    group = F.transform(_groups(F.col("branches")), lambda g: F.struct(g["segs"].alias("segs"), smoothed(g["good"], g["labelled"], F.col("above")).alias("purity")))
    merged = merged.select(*at, group.alias("groups"), "shapes")
    moved = join_hot(going, merged, at, "shapes")
    # a segment without a branch of its own takes the wildcard's, which is there if any such is
    named = lambda s: F.get(F.filter("groups", lambda g: F.array_contains(g["segs"], s)), F.lit(0))
    taken = F.coalesce(named(F.col("seg")), named(F.lit("*")))
    label = F.array_join(F.array_sort(taken["segs"]), "|")
    label = F.when(F.size(taken["segs"]) > 1, F.concat(F.lit("("), label, F.lit(")"))).otherwise(label)
    down = moved.select("host", "key", "shape", "n", "good", "labelled", F.concat("node", F.lit("/"), label).alias("node"), taken["purity"].alias("purity"))
    return down.unionByName(state.where(F.size("shape") <= k))


def templates(addresses: DataFrame) -> DataFrame:
    """(key, n, template, purity) of each host and shape of (host, path, good), one row for each
    address; good is null where there is no label. key is a digest of host and shape."""
    shaped = addresses.select("host", shape(F.col("path")).alias("shape"), "good")
    counts = shaped.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count("good").alias("labelled"))
    counts = written(counts.withColumn("key", key_of(F.col("host"), F.col("shape"))))
    hosts = counts.groupBy("host").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l"), F.count(F.lit(1)).alias("_rows"))
    good, labelled, deep = counts.agg(F.sum("good"), F.sum("labelled"), F.max(F.size("shape"))).first()
    overall = ((good or 0) + 1) / ((labelled or 0) + 2)
    roots = hosts.select("host", smoothed(F.col("_g"), F.col("_l"), F.lit(overall)).alias("purity"), "_rows")
    state = written(join_hot(counts, roots, ["host"], "_rows").drop("_rows").withColumn("node", F.lit("")))
    for k in range(deep or 0):
        state = written(_level(state, k))
    return state.select("key", "n", F.regexp_replace("node", r"/\$$", "").alias("template"), "purity")


def key_of(host: Column, shaped: Column) -> Column:
    return F.md5(F.concat_ws("/", host, shaped).cast("binary"))


def judge(rows: DataFrame, rules=RULES, limit: float = LIMIT, url: str = "url", good: str = "good") -> DataFrame:
    """Rows with host, path, template, purity, rule and verdict of their url.

    good is true or false where the address is labelled, else null; it is left out of the result.
    """
    kept = [c for c in rows.columns if c.lower() not in (*_RESULTS, good.lower())]
    inner, host, path, label = (unused(kept, c) for c in ("_in", "_host", "_path", "_good"))
    base = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(inner), host_of(F.col(f"`{url}`")).alias(host), path_of(F.col(f"`{url}`")).alias(path), F.col(f"`{good}`").alias(label))
    found = written(templates(base.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(label).alias("good"))))
    base = base.withColumn("key", key_of(F.col(host), shape(F.col(path))))
    # digests and short rows: few of them are sent to all tasks, else hot ones are dealt to parts
    short = found.select("key", "n", "purity", F.when(F.length("template") <= 1000, F.col("template")).otherwise(F.concat(F.left("template", F.lit(1000)), F.lit("..."))).alias("template"))
    met = base.join(F.broadcast(short), "key") if is_small(short, 10_000) else join_hot(base, short, ["key"], "n")
    met = met.withColumn("_rule", rule_of(F.col(host), F.col(path), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("purity") < limit, F.lit("block")).otherwise(F.lit("allow")))
    return met.select(*[F.col(f"{inner}.`{c}`") for c in kept], F.col(host).alias("host"), F.col(path).alias("path"), "template", "purity", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, good): a page's address ends in the number of the document that it shows; it is
    good if that document is labelled as of quality and not toxic, and null without a label.

    Of a document that is labelled more than once the worst label counts.
    """
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")) > 0
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("_doc")).agg(F.min(~bad).alias("good"))
    number = F.regexp_extract(path_of(F.col("url")), r"(?:^|[^0-9])([0-9]++)[^0-9/]*+/?$", 1)
    rows = pages.select("page_id", "url", number.alias("_doc"))
    # a number that very many pages end in is one row on the other side: its pages are dealt to parts
    used = rows.groupBy("_doc").agg(F.count(F.lit(1)).alias("n")).join(known, "_doc", "left")
    return join_hot(rows, used, ["_doc"]).select("page_id", "url", "good")


def judged_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    return judge(written(labelled_pages(pages, labels))).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
