"""Secret scans over a trigram inverted index."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import durable, row_key

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    any_case: bool = False


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Well-known published shapes of keys.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

#: More strings than this at one place of a regex are not told apart.
_MOST = 64


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """Trigrams (lower case) a matching text must hold: one of the sets, whole; None if nothing is certain.

    Walks the parsed regex, keeps the strings its parts can spell while they are
    few, and closes a stretch where something open-ended stands.
    """
    clauses: list[list[frozenset[str]]] = []
    _walk(_parser.parse(rule.regex.lower() if rule.any_case else rule.regex), clauses)
    sets = [c for c in clauses if all(c)]
    if not sets:
        return None
    joined = sets[0]
    for c in sets[1:]:
        if len(joined) * len(c) <= _MOST:
            joined = [a | b for a, b in product(joined, c)]
    smallest = {a for a in joined if not any(b < a for b in joined)}
    return sorted(smallest, key=sorted)


def _walk(parts: Sequence, clauses: list) -> None:
    spelled = {""}
    for op, value in parts:
        exact = _exact(op, value)
        if exact is not None and len(exact) * len(spelled) <= _MOST:
            spelled = {a + b for a, b in product(spelled, exact)}
            continue
        _close(spelled, clauses)
        spelled = {""} if exact is None or len(exact) > _MOST else exact
        if str(op) == "SUBPATTERN":
            _walk(value[-1], clauses)
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0]:
            _walk(value[2], clauses)
    _close(spelled, clauses)


def _close(spelled: set[str], clauses: list) -> None:
    lowered = {s.lower() for s in spelled}
    clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in lowered])


def _exact(op, value) -> set[str] | None:
    """All strings a part can spell, or None if they are many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value)}
    if name == "IN":
        chars = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                chars.add(chr(v))
            elif str(kind) == "RANGE" and v[1] - v[0] < _MOST:
                chars |= {chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        found = [_sequence(p) for p in value[1]]
        return None if any(f is None for f in found) else set().union(*found)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        once = _sequence(inner)
        if once is None or high == _parser.MAXREPEAT or int(high) > 3 and len(once) > 1 or int(high) > 16:
            return None
        return {"".join(p) for n in range(low, int(high) + 1) for p in product(once, repeat=n)}
    return None


def _sequence(parts: Sequence) -> set[str] | None:
    out = {""}
    for op, value in parts:
        one = _exact(op, value)
        if one is None or len(one) * len(out) > _MOST:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def postings(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The index, (trigram, __k1, __k2): the texts that hold each trigram any rule asks for.

    Other trigrams have no reader and no postings.
    """
    asked = sorted({t for r in rules for branch in trigram_query(r) or [] for t in branch})
    low = F.lower("__text")
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]))
    return keyed.select("__k1", "__k2", low.alias("low")).select("__k1", "__k2", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(__k1, __k2, kinds): the rules whose trigram query a text satisfies.

    The postings of every branch of a query are intersected by marking, per
    text, the branch's trigrams it is posted under.
    """
    branches = [
        (f"{r.kind}/{n}", t, 1 << k, (1 << len(branch)) - 1)
        for r in rules
        for n, branch in enumerate(trigram_query(r) or [])
        for k, t in enumerate(sorted(branch))
    ]
    asked = index.sparkSession.createDataFrame(branches, "branch string, trigram string, bit bigint, all_bits bigint")
    met = index.join(F.broadcast(asked), "trigram").groupBy("__k1", "__k2", "branch", "all_bits").agg(F.bit_or("bit").alias("bits"))
    kind = F.substring_index("branch", "/", 1)
    return met.filter("bits = all_bits").groupBy("__k1", "__k2").agg(F.collect_set(kind).alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, as structs (start, end) in code points."""
    regex = F.lit(("(?i)" if rule.any_case else "") + rule.regex)
    lengths = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
    grouped = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda m: F.length(m))
    found = F.zip_with(
        F.zip_with(lengths, F.slice(gaps, 1, F.size(lengths)), lambda n, g: F.struct(n.alias("n"), g.alias("g"))),
        grouped,
        lambda x, k: F.struct(x["n"].alias("n"), x["g"].alias("g"), k.alias("k")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["g"]
        end = begin + x["n"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"] >= rule.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def scan(docs: DataFrame, base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE, text: str = "text") -> DataFrame:
    """All rows of docs with ``matches``, an array of (start, order, kind, end) by start, then by rule.

    Rules with a trigram query run over the texts the index offers for them,
    rules without one over every text. A missing text is empty. Rows equal in
    every column share one key and one result. Joins on the key only, so neither
    hot texts nor null ids gather in a task. A column named ``matches`` is replaced.
    """
    rules = [*base, *more]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "matches"]).alias("__d"),
        F.coalesce(F.col(text), F.lit("")).alias("__text"),
        *row_key(*[F.col(f"`{c}`") for c in docs.columns]),
    )
    offered = candidates(durable(postings(keyed, rules)), rules)
    # the candidates are the side that is built; texts pass through unsorted
    joined = keyed.join(offered.hint("shuffle_hash"), ["__k1", "__k2"], "left")
    found = []
    for n, rule in enumerate(rules):
        runs = F.lit(True) if trigram_query(rule) is None else F.array_contains("kinds", rule.kind)
        regex = F.lit(("(?i)" if rule.any_case else "") + rule.regex)
        named = F.transform(spans(F.col("__text"), rule), _named(n, rule.kind))
        none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
        found.append(F.when(F.coalesce(runs, F.lit(False)) & F.rlike("__text", regex), named).otherwise(none))
    return joined.withColumn("matches", F.sort_array(F.concat(*found))).select("__d.*", "matches")


def _named(order: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")
    )


def listed(matches: Column) -> Column:
    """``kind:start:end`` of the matches, joined by commas."""
    one = lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))
    return F.array_join(F.transform(matches, one), ",")


def counted(matches: Column, kind: str) -> Column:
    return F.size(F.filter(matches, lambda m: m["kind"] == F.lit(kind))).cast("bigint")


def of_kinds(matches: Column, rules: Sequence[Rule]) -> Column:
    wanted = [r.kind for r in rules]
    return F.filter(matches, lambda m: reduce(lambda a, k: a | (m["kind"] == F.lit(k)), wanted[1:], m["kind"] == F.lit(wanted[0])))
