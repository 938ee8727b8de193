"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import hash_text
from tabloom.llm.common import durable, is_empty, word_count

#: Weights given to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so often at most.
REPEATS = 3
#: Hex digits of the hash by which one histogram refines another: 4096 buckets.
DIGITS = 3
HASH_DIGITS = 15
_TOP = 16**HASH_DIGITS


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The sources share the sum of all sizes by weight; a target stops at
    ``repeats`` times its source's size and what is left is shared anew until no
    target is above. Works on one row per source, in aggregates only.
    """
    sources = durable(_weighed(sizes, weights))
    rest, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, weight, capped = rest or 0, weight or 0, -1
    limit = F.col("source_size") * repeats
    share = F.lit(0.0)
    while weight:
        share = F.lit(rest).cast("double") * F.col("weight") / F.lit(weight)
        full = share >= limit
        n, words, heavy = sources.agg(
            F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(full, F.col("weight")))
        ).first()
        if n == capped:
            break
        total, weights_all = sources.agg(F.sum("source_size"), F.sum("weight")).first()
        capped, rest, weight = n, total - (words or 0), weights_all - (heavy or 0)
        if not weight:
            share = limit.cast("double")
    return sources.select("source", "source_size", F.least(share, limit.cast("double")).alias("target"))


def _weighed(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Add the weight of a source: by its place in code-point order, nulls last, over and over.

    The place is counted from a range sort and the row counts of its parts, so
    any number of sources is ordered without one task.
    """
    placed = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = durable(placed.withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        starts[r["p"]] = before
        before += r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in (starts or {0: 0}).items() for x in kv]), part)
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    place = F.pmod(start + within, F.lit(len(weights))).cast("int")
    return placed.withColumn("weight", F.element_at(cycle, place + 1)).drop("__at")


def measured(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, hash): words of a text and the hash that orders the rows of its source.

    The order comes from the id; rows equal in id and source share one place.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), _hash(key, seed).alias("hash")
    )


def _hash(key: Column, seed: int) -> Column:
    return F.substring(hash_text(key, seed), 1, HASH_DIGITS)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: how often all rows are taken (``times``) and the hash below which once more (``until``).

    ``rows``: (source, size, hash). The words beyond whole passes over a source
    are found from a histogram of words by leading hash digits; the one bucket in
    which the budget runs out is refined by further digits until it holds one
    hash. That row is taken if this brings the source nearer to its target.
    Thresholds are nested: a larger target takes all that a smaller one takes.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    goal = goals.filter("source_size > 0").select(
        "source",
        F.least(whole, F.lit(REPEATS)).cast("bigint").alias("times"),
        (F.col("target") - F.least(whole, F.lit(REPEATS)) * F.col("source_size")).alias("left"),
    )
    state = durable(goal.withColumn("prefix", F.lit("")).withColumn("until", F.lit(None).cast("string")))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for depth in range(0, HASH_DIGITS, DIGITS):
        open_ = state.filter("until is null")
        if is_empty(open_):
            break
        # 4096 buckets per source at most
        inside = rows.join(open_.select(F.col("source").alias("__s"), "prefix"), F.col("source").eqNullSafe(F.col("__s")))
        inside = inside.filter(F.substring("hash", 1, depth) == F.col("prefix"))
        counts = inside.groupBy("source", F.substring("hash", 1, depth + DIGITS).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        ends = counts.withColumn("end", F.sum("words").over(order))
        cut = (
            ends.withColumnRenamed("source", "__s")
            .join(open_, F.col("__s").eqNullSafe(F.col("source")))
            .filter(F.col("end") > F.col("left"))
            .groupBy("source", "times")
            .agg(F.min_by(F.struct("bucket", "words", "end", "low", "high", "left"), "bucket").alias("b"))
        )
        left = F.col("b.left") - (F.col("b.end") - F.col("b.words"))
        one = F.col("b.low") == F.col("b.high")
        nearer = F.col("b.words") - left < left  # with the row rather than without it
        found = cut.select(
            "source",
            "times",
            left.alias("left"),
            F.col("b.bucket").alias("prefix"),
            F.when(one, F.when(nearer, F.concat(F.col("b.high"), F.lit("~"))).otherwise(F.col("b.low"))).alias("until"),
        )
        # a budget that takes every row of the open bucket ends behind it
        done = open_.join(cut.select(F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s")), "left_anti")
        done = done.withColumn("until", F.concat("prefix", F.lit("~")))
        state = durable(state.filter("until is not null").unionByName(found).unionByName(done))
    return state.select("source", "times", F.coalesce("until", "prefix").alias("until"))


def mix(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Add source_size, target and taken to ``docs``, which has (source, size, hash).

    ``rows`` is a stored copy of those three columns. Null sources are a source
    of their own; a source without words has target 0.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(targets(sizes))
    cuts = thresholds(rows, goals).withColumnRenamed("source", "__s")
    plan = goals.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    plan = durable(plan).withColumnRenamed("source", "__s")
    once = F.when(F.col("hash") < F.col("until"), F.lit(1)).otherwise(F.lit(0))
    times = F.least(F.coalesce(F.col("times") + once, F.lit(0)), F.lit(REPEATS))
    # a source's third of all rows meets one row: large partitions of the join are split
    return docs.join(plan, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn(
        "taken", (F.col("size") * times).cast("bigint")
    ).drop("__s", "times", "until")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken; documents without words are left out.

    A missing text has no words. Rows that share an id share the hash that decides,
    and so are taken alike; rows of null id share one hash. Sources are told apart
    by code point, null is one of them. All columns are passed on as they were.
    """
    rows = durable(measured(docs).select("source", "size", "hash"))
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__d"), *[F.col(f"`{c}`") for c in ("doc_id", "source", "text")]
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
    wide = wide.select("__d", "source", word_count(F.col("text")).alias("size"), _hash(key, 17).alias("hash"))
    taken = mix(wide, rows).filter("taken > 0")
    repeats = F.sequence(F.lit(1).cast("bigint"), F.expr("taken div size"))
    return taken.select("__d", F.explode(repeats).alias("__n")).select("__d.*")
