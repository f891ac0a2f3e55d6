"""Personal data: candidate spans scored by gradient-boosted trees, in column expressions.

Strict patterns find the base spans, which always stay. Loose generators of high recall propose
further spans: addresses with spelt-out signs, and within each run of digits every stretch of up
to GROUPS groups with a fitting number of digits (an ip: four groups of up to three), so that stretches overlap: of two card numbers in
a row either one, both together and parts of both are proposed, each as a phone number, a card and
an ip at once. Features of a candidate's form and surroundings go through boosted trees, one
ensemble per kind, walked down in constant arrays. A candidate is taken if it reaches its kind's
threshold, overlaps no base span and belongs to the choice of candidates that lie apart and have the
greatest sum of scores, which a dynamic programme over their ends finds exactly.

The trees are trained with numpy on sentences made up here, whose candidates and features come
from the very expressions that run on documents. The threshold of a kind is the lowest with the
wanted precision on sentences of other forms and words than those of the training.

Patterns are possessive and begin where a run begins (or where the match before ended), so
their time is linear in the text however long a run is. Offsets are code points: running sums
of the lengths of matches and of the pieces between them. A candidate is held against base spans
by halving, and against the few ends that lie within the longest candidate; so all steps grow
about in proportion to the text.

Defined cases: a null text is empty and has no spans; repeated rows are alike; overlapping base
spans of different kinds all stay, and redaction covers their union once. Further columns are
kept whatever their names; ``find`` puts base and spans in the place of columns so called.
"""

from __future__ import annotations

import json
import random
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import give_back
from waymark.session import let_go

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
#: Strict patterns; each finds the same leftmost matches as the plain form in its comment.
STRICT = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGN = r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)"
#: Generators of candidates: addresses, and runs of digits.
LOOSE = {
    "address": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_SIGN}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "digits": r"\+?+(?:[(]\x20?)?[0-9](?:[\x20().\[\]/-]{0,5}[0-9]){3,}+",
}
#: Candidate kinds of each generator.
PROPOSES = {"address": ("email",), "digits": ("ip", "card", "phone")}
#: Groups and digits of a stretch that is proposed; a stretch with more of either is none, so a number
#: written in more groups, as digit by digit, is only found by the strict patterns.
GROUPS, DIGITS = 6, (7, 19)
#: Groups of an address of bytes, which may have fewer digits than DIGITS.
BYTES = 4
#: Characters looked at on either side of a candidate.
CONTEXT = 40
FEATURES = (
    "digits", "groups", "longest", "dots", "dashes", "blanks", "brackets", "plus", "luhn", "bytes_ok", "letter_before", "letter_after", "sign_before",
    "phone_word", "card_word", "ip_word", "mail_word", "date_like", "phone_groups", "card_groups", "more_before", "more_after", "pairs", "even", "decimal",
    "zero_first", "first", "last", "shortest", "issuer", "bracket_first", "slashes", "dotted", "other_word",
    "bracketed", "gap_before", "gap_after", "inner_gap", "balanced", "group_before", "group_after",
)
_CUES = {"phone_word": "phone|tel|call|mobile|fax|cell", "card_word": "card|visa|mastercard|credit|payment", "ip_word": r"\bip\b|server|host|address|login from", "mail_word": "mail|contact|write|reach", "other_word": "order|invoice|total|sum|version|page|chapter|isbn|serial|part|key|grid|score|dated|password|ref|no[.]|[^a-z]id[^a-z]|[^a-z]on $|number of"}
ROUNDS, DEPTH, LEARNING, LEAVES_MIN = 32, 4, 0.4, 5
PRECISION = 0.99


# ---- spans ---------------------------------------------------------------------------------


_PLACE = "start:int,end:int,match:string"


def bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, add=lambda a, b: a + b) -> Column:
    """Sums (or what else add makes) of an array up to each place. An array cannot grow without
    being copied, so it is cut into pieces of about the root of its size, which are gone through
    one by one and then shifted."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    grow = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(add(s["at"], x))).alias("out"))
    sums = lambda a: F.aggregate(a, zero, grow, lambda s: s["out"])

    def shift(a: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), each - 1), lambda i: sums(F.slice(a, i * each + 1, each)))
        ends = lambda p: sums(F.transform(p, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0))))
        moved = lambda p, e: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda v: add(v, F.coalesce(F.get(e, i - 1), F.lit(0))))))
        return F.when(F.size(a) <= 16, sums(a)).otherwise(bound(pieces, lambda p: bound(ends(p), lambda e: moved(p, e))))

    return bound(numbers, shift)


def located(text: Column, pattern: str, context: bool = False) -> Column:
    """Array of (start, end, match) of a pattern's matches; with context also the characters before and after."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("p"))

    def place(f: Column) -> Column:
        h, p = f["h"], f["p"]
        lengths = F.transform(h, lambda m, i: F.length(m) + F.length(F.get(p, i)))

        def one(ends: Column):
            def at(m: Column, i: Column) -> Column:
                fields = [(F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")]
                if context:
                    fields.append(F.right(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), F.get(p, i)), F.lit(CONTEXT)).alias("before"))
                    fields.append(F.left(F.concat(F.get(p, i + 1), F.coalesce(F.get(h, i + 1), F.lit(""))), F.lit(CONTEXT)).alias("after"))
                return F.struct(*fields)

            return F.transform(h, at)

        return bound(running(lengths), one)

    return bound(found, place)


def meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether a stretch overlaps any of the spans, which are sorted and lie apart: the first that
    ends behind the start is found by halving."""
    n = F.size(spans)
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    zero = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    go = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(spans, half(s))["end"] > start, F.struct(s["lo"].alias("lo"), half(s).alias("hi"))).otherwise(F.struct((half(s) + 1).alias("lo"), s["hi"].alias("hi")))
    steps = F.sequence(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int") + 1)
    first = F.aggregate(steps, zero, go, lambda s: s["lo"])
    return F.when(n > 0, F.coalesce(F.get(spans, first)["start"] < end, F.lit(False))).otherwise(F.lit(False))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the checksum."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def valid(kind: str, match: Column) -> Column:
    """What a strict match must fulfil besides."""
    d = _digits(match)
    if kind == "ip":
        part = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]))"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def strict_spans(text: Column, kind: str) -> Column:
    """Valid base spans of a kind; patterns are only run on texts that can hold one."""
    can = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    found = F.filter(located(text, STRICT[kind]), lambda s: valid(kind, s["match"]))
    none = F.array().cast(f"array<struct<{_PLACE}>>")
    return F.when(F.regexp_like(text, F.lit(STRICT[kind])) if can is None else can, found).otherwise(none)


# ---- candidates ----------------------------------------------------------------------------


_CANDIDATE = "gen:string,start:int,end:int,match:string,before:string,after:string,more_before:boolean,more_after:boolean"


def _candidate(gen: str, start: Column, end: Column, match: Column, before: Column, after: Column, more_before: Column, more_after: Column) -> Column:
    return F.struct(
        F.lit(gen).alias("gen"), start.alias("start"), end.alias("end"), match.alias("match"), F.lower(F.right(before, F.lit(CONTEXT))).alias("before"),
        F.lower(F.left(after, F.lit(CONTEXT))).alias("after"), more_before.alias("more_before"), more_after.alias("more_after"),
    )


def stretches(run: Column, free) -> Column:
    """Candidates within a run of digits, of those (start, end) that are free."""
    groups = F.struct(F.regexp_extract_all(run["match"], F.lit("[0-9]+"), F.lit(0)).alias("g"), F.split(run["match"], "[0-9]+", -1).alias("s"))

    def cut(x: Column) -> Column:
        g, s, m = x["g"], x["s"], F.size(x["g"])
        lead = lambda i: F.regexp_extract(F.get(s, i), r"\+?[(]?$", 0)
        sums = F.struct(running(F.transform(g, lambda v, i: F.length(v) + F.length(F.get(s, i)))).alias("ends"), running(F.transform(g, lambda v: F.length(v))).alias("digits"))
        parts = lambda lo, hi: F.array_join(F.transform(F.sequence(lo, hi), lambda k: F.concat(F.get(s, k), F.get(g, k))), "")

        def spans(t: Column) -> Column:
            start = lambda i: run["start"] + F.get(t["ends"], i) - F.length(F.get(g, i)) - F.length(lead(i))
            here = lambda i, j: F.struct(i.alias("i"), j.alias("j"), start(i).alias("start"), (run["start"] + F.get(t["ends"], j)).alias("end"), (F.get(t["digits"], j) - F.coalesce(F.get(t["digits"], i - 1), F.lit(0))).alias("digits"))
            every = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.filter(F.transform(F.sequence(i, F.least(i + GROUPS - 1, m - 1)), lambda j: here(i, j)), lambda w: (w["digits"].between(*DIGITS) | (w["j"] - w["i"] == BYTES - 1) & w["digits"].between(BYTES, 3 * BYTES)) & free(w["start"], w["end"])))
            return F.flatten(every)

        def told(w: Column) -> Column:
            i, j, half = w["i"], w["j"], F.lit(CONTEXT // 2)
            # groups have a sign between them, so half as many groups as characters fill the context
            before = F.concat(F.when(i <= half, run["before"]).otherwise(F.lit("")), F.when(i > 0, parts(F.greatest(F.lit(0), i - half), i - 1)).otherwise(F.lit("")), F.regexp_replace(F.get(s, i), r"\+?[(]?$", ""))
            after = F.concat(F.when(j < m - 1, parts(j + 1, F.least(j + half, m - 1))).otherwise(F.lit("")), F.when(j + half >= m - 1, run["after"]).otherwise(F.lit("")))
            inner = F.concat(lead(i), F.get(g, i), F.when(j > i, parts(i + 1, j)).otherwise(F.lit("")))
            return _candidate("digits", w["start"], w["end"], inner, before, after, i > 0, j < m - 1)

        return F.transform(bound(sums, spans), told)

    return bound(groups, cut)


def candidates(text: Column, base: list[Column] = ()) -> Column:
    """Array of candidates from the loose generators that overlap none of the base spans."""
    none = F.array().cast(f"array<struct<{_CANDIDATE}>>")

    def free(start: Column, end: Column) -> Column:
        hit = F.lit(False)
        for b in base:
            hit = hit | meets(b, start, end)
        return ~hit

    address = F.filter(located(text, LOOSE["address"], True), lambda s: free(s["start"], s["end"]))
    address = F.transform(address, lambda s: _candidate("address", s["start"], s["end"], s["match"], s["before"], s["after"], F.lit(False), F.lit(False)))
    runs = F.flatten(F.transform(located(text, LOOSE["digits"], True), lambda r: stretches(r, free)))
    return F.concat(F.when(F.regexp_like(text, F.lit(_SIGN)), address).otherwise(none), F.when(F.regexp_like(text, F.lit(LOOSE["digits"])), runs).otherwise(none))


def features(c: Column) -> dict[str, Column]:
    """Features of a candidate with its digits, their form and its groups at hand."""
    m, before, after, d, shape, groups = (c[k] for k in ("match", "before", "after", "digits", "shape", "groups"))
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "digits": F.length(d).cast("double"), "groups": count("[0-9]+"), "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        "dots": count(r"\."), "dashes": count("-"), "blanks": count(" "), "brackets": count(r"[()\[\]]"), "plus": flag(m.startswith("+")),
        "luhn": flag(F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))), "bytes_ok": flag(m.rlike(rf"^{_BYTE}(?:[^0-9]++{_BYTE}){{3}}$")),
        "letter_before": flag(before.rlike(r"[\p{L}0-9_]$")), "letter_after": flag(after.rlike(r"^[\p{L}0-9_]")), "sign_before": flag(before.rlike(r"[=:#$€£/.,-]$")),
        **{k: flag(before.rlike(v)) for k, v in _CUES.items()},
        "date_like": flag(m.rlike(r"^(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}")),
        "phone_groups": flag(shape.rlike("^(?:d{1,3} )?ddd ddd dddd$")), "card_groups": flag(shape.rlike("^dddd dddd dddd d{1,7}$|^dddd dddddd ddddd$")),
        "more_before": flag(c["more_before"]), "more_after": flag(c["more_after"]), "pairs": flag(shape.rlike("^(?:d{1,3} )?d{1,2}(?: dd){4}$")),
        "even": flag(F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[0-9]([^0-9]+)(?=[0-9])"), F.lit(1)))) <= 1), "decimal": flag(before.rlike("[0-9][.,]$") | after.rlike("^[.,][0-9]")),
        "bracketed": flag(m.rlike(r"^\([0-9]{3}\)\x20?[0-9]{3}[-. ]?[0-9]{4}$")), "balanced": flag(F.regexp_count(m, F.lit(r"\(")) == F.regexp_count(m, F.lit(r"\)"))),
        "gap_before": F.length(F.regexp_extract(before, r"[^\p{L}0-9]*+$", 0)).cast("double"), "gap_after": F.length(F.regexp_extract(after, r"^[^\p{L}0-9]*+", 0)).cast("double"),
        "group_before": F.length(F.regexp_extract(before, r"([0-9]++)[^\p{L}0-9]{0,5}$", 1)).cast("double"), "group_after": F.length(F.regexp_extract(after, r"^[^\p{L}0-9]{0,5}([0-9]++)", 1)).cast("double"),
        "inner_gap": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]([^0-9]++)(?=[0-9])"), F.lit(1)), lambda g: F.length(g))), F.lit(0)).cast("double"),
        "zero_first": flag(d.startswith("0")), "first": F.length(F.get(groups, 0)).cast("double"), "last": F.length(F.get(groups, F.size(groups) - 1)).cast("double"),
        "shortest": F.coalesce(F.array_min(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"), "issuer": flag(d.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])")),
        "bracket_first": flag(m.rlike(r"^[+0-9]*\x20?\(")), "slashes": count("/"), "dotted": flag(m.rlike(r"^[0-9]++(?:\x20?[\[(]?\x20?\.\x20?[\])]?\x20?[0-9]++){3}$")),
    }


def scanned(items: Column, zero: Column, step) -> Column:
    """The marks (true or false) that step(state, item) -> (s, mark) leaves along an array, from the
    state zero. An array that grows is copied, so it is gone through in pieces of about its root."""
    none = F.array().cast("array<boolean>")

    def piece(p: Column, state: Column) -> Column:
        return F.aggregate(p, F.struct(state.alias("s"), none.alias("o")), lambda a, x: bound(step(a["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["mark"])).alias("o"))))

    each = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), each - 1), lambda i: F.slice(items, i * each + 1, each))
    start = F.struct(zero.alias("s"), F.array().cast("array<array<boolean>>").alias("o"))
    every = F.aggregate(pieces, start, lambda a, p: bound(piece(p, a["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o"))))
    return F.when(F.size(items) <= 16, piece(items, zero)["o"]).otherwise(F.flatten(every["o"]))


def chosen(found: Column) -> Column:
    """Of an array of (kind, start, end, score) with positive scores those that lie apart and have the
    greatest sum of scores; among equal sums that which ends first counts, then the least kind.

    Going by ends, a candidate is marked if it and the best choice before its start beat the best
    choice so far. Only the ends within its reach matter, and there are at most GROUPS of them.
    Going back, a marked candidate is taken if it ends before what was taken last begins.
    """
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["end"].alias("end"), (-c["start"]).alias("back"), c["kind"].alias("kind"), c["start"].alias("start"), c["score"].alias("score"))))
    last = lambda a: F.get(a, F.size(a) - 1)

    def forth(best: Column, c: Column) -> Column:
        """best: (end, sum) of the last ends at which the best sum rose."""
        here = F.coalesce(last(F.filter(best, lambda e: e["end"] <= c["start"]))["sum"], F.lit(0.0)) + c["score"]
        up = here > F.coalesce(last(best)["sum"], F.lit(0.0))
        other = F.filter(best, lambda e: e["end"] < c["end"])
        grown = F.concat(F.slice(other, F.greatest(F.lit(1), F.size(other) - GROUPS), F.lit(GROUPS + 1)), F.array(F.struct(c["end"].alias("end"), here.alias("sum"))))
        return F.struct(F.when(up, grown).otherwise(best).alias("s"), up.alias("mark"))

    def back(limit: Column, c: Column) -> Column:
        take = c["up"] & (c["end"] <= limit)
        return F.struct(F.when(take, c["start"]).otherwise(limit).alias("s"), take.alias("mark"))

    def pick(o: Column) -> Column:
        marks = scanned(o, F.array().cast("array<struct<end:int,sum:double>>"), forth)
        told = bound(marks, lambda m: F.reverse(F.transform(o, lambda c, i: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.get(m, i).alias("up")))))
        return bound(told, lambda t: bound(scanned(t, F.lit(2**31 - 1), back), lambda m: F.filter(t, lambda c, i: F.get(m, i))))

    return F.transform(F.when(F.size(found) > 0, bound(ordered, pick)).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,up:boolean>>")), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))


def tree_table(trees: list, depth: int = DEPTH) -> tuple[list[int], list[float], list[float]]:
    """Trees as full binary ones, one behind the other: the feature and the cut of each inner node, and
    the value of each end. A branch that ends early has the same value at all ends under it."""
    places, cuts, values = [], [], []

    def fill(node, level: int, at: int, inner: list, ends: list) -> None:
        name, cut, low, high = node if isinstance(node, tuple) else (FEATURES[0], 0.0, node, node)
        if level == depth:
            ends[at - (2**depth - 1)] = float(node)
            return
        inner[at] = (FEATURES.index(name), float(cut))
        fill(low, level + 1, 2 * at + 1, inner, ends)
        fill(high, level + 1, 2 * at + 2, inner, ends)

    for t in trees:
        inner, ends = [None] * (2**depth - 1), [None] * 2**depth
        fill(t, 0, 0, inner, ends)
        places += [f for f, _ in inner]
        cuts += [c for _, c in inner]
        values += ends
    return places, cuts, values


def trees_sql(trees: list, x: str = "c.x", depth: int = DEPTH) -> str:
    """The sum of the trees' values for an array of features. The trees are constant arrays that are
    walked down, so the plan holds their numbers and not an expression for each node. An array is
    one text of all its numbers, which the planner turns into a constant: the parser need not
    make a tree of each."""
    places, cuts, values = tree_table(trees, depth)
    inner, ends = 2**depth - 1, 2**depth
    listed = lambda v: f"cast(split('{','.join(map(repr, v))}', ',') as array<{'double' if isinstance(v[0], float) else 'int'}>)"
    step = f"2 * i + 1 + int({x}[{listed(places)}[t * {inner} + i]] > {listed(cuts)}[t * {inner} + i])"
    return f"aggregate(sequence(0, {len(trees) - 1}), 0D, (s, t) -> s + {listed(values)}[t * {ends} - {inner} + aggregate(sequence(1, {depth}), 0, (i, k) -> {step})])"


_SCORED = "array<struct<kind:int,start:int,end:int,score:double>>"


def featured(c: Column) -> Column:
    """Candidates with an array of their features, in the order of FEATURES."""

    def formed(x: Column) -> Column:
        """What many features are made of, worked out once."""
        shape = F.trim(F.regexp_replace(F.regexp_replace(x["match"], "[^0-9]+", " "), "[0-9]", "d"))
        plain = [x[k].alias(k) for k in ("gen", "start", "end", "match", "before", "after", "more_before", "more_after")]
        return F.struct(*plain, _digits(x["match"]).alias("digits"), shape.alias("shape"), F.split(shape, " ").alias("groups"))

    def row(x: Column) -> Column:
        of = features(x)
        return F.struct(x["gen"].alias("gen"), x["start"].alias("start"), x["end"].alias("end"), F.array(*[of[k] for k in FEATURES]).alias("x"))

    return F.transform(F.transform(c, formed), row)


def scored(column: str, model: dict) -> Column:
    """From a column of featured candidates those that reach their threshold, as (kind, start,
    end, score); kind is its place in KINDS. The score is the sum of the trees, in log odds."""
    out = [F.array().cast(_SCORED)]
    for gen, kinds in PROPOSES.items():
        for k in kinds:
            if k in model:
                trees, cut = model[k]
                total = trees_sql(trees)
                rated = f"transform(filter({column}, c -> c.gen = '{gen}'), c -> named_struct('kind', {KINDS.index(k)}, 'start', c.start, 'end', c.end, 'score', {total}))"
                out.append(F.expr(f"filter({rated}, c -> c.score >= {float(cut)!r}D)"))
    return F.concat(*out)


# ---- training ------------------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int) -> str:
    d = [rng.choice("3456")] + [rng.choice("0123456789") for _ in range(n - 2)]
    total = sum(sum(divmod(int(c) * (2 if (n - 1 - i) % 2 else 1), 10)) for i, c in enumerate(d))
    return "".join(d) + str(-total % 10)


#: Forms in made-up sentences; # is a digit, B a number of a byte, L a card number of 16 digits in
#: groups, X one of 15 in groups of 4, 6 and 5, W a word. The trees learn from the first of each,
#: thresholds are set on the second, and the third is for measuring alone.
FORMS = (
    {
        "phone": ["(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "+## ### ### ####", "1-###-###-####", "0# ## ## ## ##", "0## ### ####", "### ###-####", "###.### ####", "(0##) ### ####", "0#### ######", "0###/######", "0##-###-####", "+## (0)## ### ####", "# ### ### ####", "1 (###) ###-####", "0### ### ###", "(0####) ######", "0##/### ## ##", "0#-##-##-##-##", "0### ## ## ##", "### / ### / ####", "0### ### ####"],
        "card": ["L", "L/L/L/L", "L.L.L.L", "L  L  L  L", "L-L-L-L", "L L L L", "L  L L L", "L L L  L", "L - L - L - L", "L.L L.L", "L/L/L L", "X X X", "X/X/X", "X  X X", "L L/L L", "L.L-L.L"],
        "ip": ["B[.]B[.]B[.]B", "B(.)B(.)B(.)B", "B.B.B.B", "B [.] B[.]B[.]B", "B . B . B . B", "B[.]B.B.B", "B.B.B[.]B", "B ( . ) B ( . ) B ( . ) B", "B (.) B (.) B (.) B"],
        "email": ["W.W [at] W.com", "W[at]W.org", "W.W (at) W (dot) net", "W(at)W[dot]com", "W {at} W.de"],
        None: ["#######", "##########", "################", "####################", "20##-0#-1# ##", "#.##.####.#####", "####-####-####-####", "###-#-#####-###-#", "###.######", "#########ac#e", "#.###.###.###", "## ## ## ## ##", "## ### ## ###", "W (at) ##.##", "999.###.300.###", "### ### ###", "###### ######", "#,###,###", "#### ####", "####.####.####", "##.##.20## ##:##", "## #######", "#### ## ##", "####/##/##", "### ####", "#### #### ####", "########.####", "#.#.#.#.#", "#.##.###.#####", "# # # #", "##/##/####", "#### - ####", "### / ###", "####-##-## ##.##", "####  ####  ####", "###-####", "##,##,##,##", "#.#.#-##", "B . B", "300.B.B.B", "B.B.B.###", "##c##########e##a", "#a##########b####f#", "##b###########e###c##"],
    },
    {
        "phone": ["(###)###-####", "###-### ####", "###/###/####", "+# (###) ###-####", "0###-######", "+##-##-####-####", "0#.##.##.##.##"],
        "card": ["L L  L L", "L/L-L/L", "L", "L.L.L.L"],
        "ip": ["B [.] B [.] B [.] B", "B.B.B.B", "B(.)B.B.B"],
        "email": ["W (at) W.info", "W.W[at]W[dot]fr", "W-W [AT] W [DOT] com", "W(@)W.net"],
        None: ["########", "###########", "##############", "##.##.20## ##", "####.####.####", "##-#######", "### #### ###", "20##/##/## ##:##", "#.###.###,##", "##.###.###", "####-####-####", "## ## ####", "W [at] ###", "256.#.####.#", "########-####"],
    },
    {
        "phone": ["(0##) ###-####", "### - ### - ####", "0### / ######", "###.###-####", "0##-#######", "(###) ### ####", "0### ## ## ##"],
        "card": ["L /L /L /L", "L-L.L-L", "L L  L  L", "X-X/X", "L"],
        "ip": ["B (.) B[.]B (.) B", "B.B(.)B.B", "B[.]B(.)B[.]B"],
        "email": ["W.W{at}W.org", "W [at] W (dot) de", "W-W(at)W.W.com"],
        None: ["#########", "######", "#############", "##.##.20##", "20##-##-##", "####-###-####", "##:##:##", "#####-####", "###-######-#", "######.##", "##/##/20## ##", "#,###.##", "W (at) ##", "##.###", "256.B.999.#", "## ### ####"],
    },
)
CUES = (
    {"phone": ["call", "tel", "phone", "mobile", "fax:"], "card": ["card", "visa", "credit card", "payment"], "ip": ["ip", "server", "host", "login from"], "email": ["mail", "contact", "write to", "reach"], None: ["order", "id", "total", "=", "on", "version", "ref #", "password=", "isbn", "page"]},
    {"phone": ["telephone", "call me:", "cell"], "card": ["mastercard", "my card", "payment by"], "ip": ["host at", "address", "ip:"], "email": ["e-mail", "contact:", "reach me"], None: ["invoice", "no.", "key", "part", "serial", "dated", "grid", "score", "sum of", "chapter"]},
    {"phone": ["tel.", "my mobile", "call us at", "phone number"], "card": ["visa card", "card no", "credit"], "ip": ["ip address", "server at"], "email": ["mail me at", "contact"], None: ["order no", "part number", "total of", "version", "room", "size", "index", "key="]},
)
_SYLLABLES = (("an", "tion", "re", "the", "ou", "er", "le", "es", "ment", "ung"), ("ka", "lor", "mi", "den", "sta", "vo", "ri", "qu", "nes", "bel"), ("pa", "zu", "fin", "gor", "hal", "wek", "dro", "sil", "ton", "jab"))


#: What stands between things in a row.
_BETWEEN = ((" ", " ", " ", ", ", "/", " / ", " or ", "; ", "  "), (" ", " ", " - ", " and ", "/", ". ", "/ "), (" ", ", ", " & ", "; ", " / "))


def passes_luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def sentences(n: int, seed: int, forms: int = 0) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with the spans of personal data in them. Some hold several things in a row.
    What is no personal data never passes as a card number as a whole, which would make it one, and
    begins with no zero, as counted things do."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES[forms]) for _ in range(rng.randint(1, 4)))

    def make(form: str) -> str:
        number = _luhn_number(rng, 16)
        parts = iter([number] if form == "L" else [number[i : i + 4] for i in (0, 4, 8, 12)])
        short = _luhn_number(rng, 15)
        fifteen = iter([short[:4], short[4:10], short[10:]])
        made = {"#": lambda: rng.choice("0123456789"), "B": lambda: str(rng.randint(0, 255)), "L": lambda: next(parts), "X": lambda: next(fifteen), "W": word}
        return "".join(made.get(c, lambda c=c: c)() for c in form)

    out = []
    for _ in range(n):
        text, spans = f"{word()} {word()} ", []
        kind = rng.choice([*KINDS, None, None, None, None])
        cue = rng.choice(CUES[forms][kind]) if rng.random() < 0.5 else word()
        text += cue + ("" if cue.endswith("=") else " ")
        for k in range(rng.choice([1, 1, 2, 2, 3])):
            text += rng.choice(_BETWEEN[forms]) if k else ""
            what = make(rng.choice(FORMS[forms][kind]))
            while not kind and (what[0] == "0" or 13 <= len(d := "".join(c for c in what if c.isdigit())) <= 19 and passes_luhn(d)):
                what = make(rng.choice(FORMS[forms][kind]))
            if kind:
                spans.append((len(text), len(text) + len(what), kind))
            text += what
            if rng.random() < 0.3:
                kind = rng.choice([kind, None])
        out.append((f"{text} {word()} {word()}.", spans))
    return out


def _split(codes: list[np.ndarray], cuts: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree for gradients g and curvatures h as nested (feature, cut, low, high)."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    for j in range(len(codes)) if depth else ():
        c, n = codes[j][rows], len(cuts[j])
        if n:
            low_g, low_h, low_n = (np.bincount(c, weights=w, minlength=n + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
            gain[(low_n < LEAVES_MIN) | (low_n > len(rows) - LEAVES_MIN)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        return float(-LEARNING * total_g / (total_h + 1.0))
    j, k = best[1]
    low = codes[j][rows] <= k
    return (FEATURES[j], float(cuts[j][k]), _split(codes, cuts, rows[low], g, h, depth - 1), _split(codes, cuts, rows[~low], g, h, depth - 1))


def _value(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    name, cut, low, high = node
    return np.where(x[:, FEATURES.index(name)] <= cut, _value(low, x), _value(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> list:
    """Trees of gradient boosting on log loss."""
    cuts = [np.unique(c)[:-1][:: max(1, len(np.unique(c)) // 16)] for c in x.T]
    codes = [np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)]
    f, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(_split(codes, cuts, np.arange(len(x)), p - y, p * (1 - p), depth))
        f = f + _value(trees[-1], x)
    return trees


def training_table(spark: SparkSession, n: int, seed: int, forms: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind the candidates in made-up sentences that overlap no base span, as on documents:
    features, which are right, and sentence, start and end of each (bounded by n)."""
    made = sentences(n, seed, forms)
    rows = spark.sql("select posexplode(from_json(:j, 'array<string>')) as (i, text)", args={"j": json.dumps([t for t, _ in made])})
    rows = rows.withColumns({f"_{k}": strict_spans(F.col("text"), k) for k in KINDS})
    found = rows.select("i", F.explode(featured(candidates(F.col("text"), [F.col(f"_{k}") for k in KINDS]))).alias("c")).select("i", "c.gen", "c.start", "c.end", "c.x").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    gen, where = np.array(found.column("gen").to_pylist()), np.stack([found.column(c).to_numpy() for c in ("i", "start", "end")], axis=1).astype(int)
    out = {}
    for g, kinds in PROPOSES.items():
        at = np.flatnonzero(gen == g)
        for k in kinds:
            out[k] = x[at], np.array([(*where[j, 1:].tolist(), k) in made[where[j, 0]][1] for j in at], dtype=float), where[at]
    return out


def plain_choice(found: list[tuple]) -> list[tuple]:
    """What ``chosen`` makes of (start, end, score, ...), for thresholds."""
    best, ends, up = [0.0], [-1], []
    for c in (order := sorted(found, key=lambda c: (c[1], -c[0], *c[3:]))):
        here = best[bisect_right(ends, c[0]) - 1] + c[2]
        up.append(here > best[-1])
        if up[-1]:
            best.append(here)
            ends.append(c[1])
    out, limit = [], 1 << 31
    for c, u in zip(reversed(order), reversed(up)):
        if u and c[1] <= limit:
            out.append(c)
            limit = c[0]
    return out


def thresholds(tables: dict, scores: dict[str, np.ndarray]) -> dict[str, float]:
    """Per kind the lowest score at or above zero from which on the candidates that are chosen have
    the wanted precision. What is chosen depends on all thresholds, so they are raised in turns
    until each holds; a kind for which none does is left out."""
    cuts, spans = dict.fromkeys(scores, 0.0), tuple(k for k in KINDS if k in PROPOSES["digits"])
    while True:
        by_text: dict = {}
        for k in cuts:
            for j in np.flatnonzero(scores[k] >= cuts[k]):
                i, start, end = tables[k][2][j].tolist()
                by_text.setdefault((i, k not in spans), []).append((start, end, float(scores[k][j]), KINDS.index(k), tables[k][1][j]))
        taken = [c for found in by_text.values() for c in plain_choice(found)]
        raised = {}
        for k in cuts:
            own = sorted((c for c in taken if c[3] == KINDS.index(k)), key=lambda c: -c[2])
            s, good = np.array([c[2] for c in own]), np.array([c[4] for c in own])
            ends = np.append(s[1:] != s[:-1], True)[: len(s)]
            ok = np.flatnonzero((good.cumsum() / np.arange(1, len(s) + 1) >= PRECISION) & ends)
            if len(ok):
                raised[k] = float(s[ok[-1]]) if ok[-1] < len(s) - 1 else cuts[k]
        if raised == cuts:
            return cuts
        cuts = raised


#: What train has made, by its numbers.
_trained: dict[tuple[int, int], dict[str, tuple[list, float]]] = {}


def train(spark: SparkSession, n: int = 4000, seed: int = 11) -> dict[str, tuple[list, float]]:
    """Per kind its trees and threshold. The sentences do not depend on the documents, nor does
    anything else here, so a driver trains once."""
    if (n, seed) not in _trained:
        _trained[n, seed] = _train(spark, n, seed)
    return dict(_trained[n, seed])


def _train(spark: SparkSession, n: int, seed: int) -> dict[str, tuple[list, float]]:
    fit = training_table(spark, n, seed)
    trees = {k: boost(x, y) for k, (x, y, _) in fit.items() if y.any()}
    check = training_table(spark, n, seed + 1, 1)
    cuts = thresholds(check, {k: sum(_value(t, check[k][0]) for t in trees[k]) for k in trees})
    del fit, check
    give_back()
    let_go(spark)
    return {k: (trees[k], c) for k, c in cuts.items()}


def measure(spark: SparkSession, model: dict, n: int = 1600, seed: int = 97, forms: int = 2) -> dict[str, tuple[float, float]]:
    """Per kind, precision of the spans that the trees add in made-up sentences, and the share that
    they find of what the strict patterns miss."""
    made = sentences(n, seed, forms)
    rows = spark.sql("select posexplode(from_json(:j, 'array<string>')) as (doc_id, text)", args={"j": json.dumps([t for t, _ in made])})
    found = find(rows, model).select("doc_id", "base", "spans").collect()
    base, got = ({(r["doc_id"], s["start"], s["end"], KINDS[s["kind"]]) for r in found for s in r[c]} for c in ("base", "spans"))
    got, want = got - base, {(i, *s) for i, (_, spans) in enumerate(made) for s in spans} - base
    of = lambda x, k: len({s for s in x if s[3] == k})
    return {k: (of(got & want, k) / max(1, of(got, k)), of(got & want, k) / max(1, of(want, k))) for k in KINDS}


# ---- results -------------------------------------------------------------------------------


_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _span(kind: Column, s: Column) -> Column:
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _spans(docs: DataFrame, model: dict | None) -> DataFrame:
    """(_in, _base, _spans): the row as it is, and its spans.

    Everything is made in the row: nothing is exploded or shuffled.
    """
    model = model if model is not None else train(docs.sparkSession)
    text = F.coalesce(F.col("_in.text"), F.lit(""))
    out = docs.select(F.struct("*").alias("_in")).withColumns({f"_{k}": strict_spans(text, k) for k in KINDS})
    out = out.withColumn("_found", candidates(text, [F.col(f"_{k}") for k in KINDS]))
    out = out.withColumn("_featured", F.when(F.size("_found") > 0, featured(F.col("_found"))))
    out = out.withColumn("_more", F.array_sort(F.transform(F.coalesce(scored("_featured", model), F.array().cast(_SCORED)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["score"].alias("score")))))
    email = KINDS.index("email")
    # addresses lie apart and come first
    out = out.withColumn("_mail", F.filter("_more", lambda c: c["kind"] == email)).withColumn("_rest", F.filter("_more", lambda c: (c["kind"] != email) & ~meets(F.col("_mail"), c["start"], c["end"])))
    taken = chosen(F.col("_rest"))
    base = F.concat(*[F.transform(F.col(f"_{k}"), lambda s: _span(F.lit(i), s)) for i, k in enumerate(KINDS)])  # noqa: B023
    every = F.array_sort(F.concat("_base", F.transform("_mail", lambda c: _span(c["kind"], c)), taken)).cast(_SPAN)
    done = out.withColumn("_base", base).select("_in", F.struct("_base", every.alias("_spans")).alias("_r"))
    # a filter on the result must not be put into the steps above, each of which it would copy
    return done.select("_in", F.explode(F.array("_r")).alias("_r")).select("_in", "_r.*")


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Docs with base and spans, arrays of (kind, start, end) by kind, then start; kinds as in KINDS."""
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    return _spans(docs, model).select(*[F.col(f"_in.`{c}`") for c in kept], F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def spelt(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every document."""
    found = find(docs.select("doc_id", "text"), model)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(spelt(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelt(F.col("spans")).alias("spans"))


#: Characters of the blocks in which a text is cut up.
BLOCK = 4096


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] for each stretch that spans cover, named after its first span."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(x: Column) -> Column:
        b, s, n = x["b"], x["s"], F.length(text)
        # places of blocks are counted in characters; a piece is put together from the blocks that it touches
        part = lambda k, lo, hi: F.substring(F.get(b, k), F.greatest(lo - k * BLOCK, F.lit(0)) + 1, F.least(hi - k * BLOCK, F.lit(BLOCK)) - F.greatest(lo - k * BLOCK, F.lit(0)))
        piece = lambda lo, hi: F.when(hi > lo, F.array_join(F.transform(F.sequence(F.floor(lo / BLOCK).cast("int"), F.floor((hi - 1) / BLOCK).cast("int")), lambda k: part(k, lo, hi)), "")).otherwise(F.lit(""))

        def pieces(ends: Column) -> Column:
            at = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            each = F.transform(s, lambda v, i: F.when(v["start"] < at(i), F.lit("")).otherwise(F.concat(piece(at(i), v["start"]), F.get(names, v["kind"]))))
            return F.concat(F.array_join(each, ""), piece(at(F.size(s)), n))

        return bound(running(F.transform(s, lambda v: v["end"]), F.greatest), pieces)

    return bound(F.struct(blocks.alias("b"), by_start.alias("s")), joined)


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Docs whose text has [KIND] for each stretch that spans cover; n_chars, if there, follows."""
    found = _spans(docs, model)
    text = F.col("_in.text")
    out = found.withColumn("_in", F.col("_in").withField("text", F.when(F.size("_spans") > 0, redacted(text, F.col("_spans"))).otherwise(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("_in", F.col("_in").withField("n_chars", F.length("_in.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("_in.*")
