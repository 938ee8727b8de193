"""Sharding by balanced label propagation, with document counts at most one apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import discard, durable, is_empty, stored

#: A group is moved in units of at most this share of a shard.
UNITS_PER_SHARD = 4
#: Hash values of which a unit of a group gets its share.
UNIT_BITS = 1_024
#: Hash cells by which arrivals at a shard are admitted.
ADMISSION_CELLS = 1_024
#: Rows ranked in one task, about.
ROWS_PER_CELL = 100_000


def linked_blocks(docs: DataFrame, group: list[str], spread: str, quota: float, shards: int) -> DataFrame:
    """(group..., unit, start, n): rows of each linked group by unit and first shard.

    Rows of a group are neighbours of each other; a group of one has no links.
    A group larger than a part of a shard is cut into units by the hash in
    ``spread``, so that no unit outgrows a quota.
    """
    most = max(1, int(quota / UNITS_PER_SHARD))
    # rows of a hot group shrink to bits x shards before they meet
    fine = docs.groupBy(*group, _bits(spread).alias("bits"), first_shard(spread, shards).alias("start")).agg(F.count("*").alias("n"))
    sizes = fine.groupBy(*group).agg(F.sum("n").alias("size")).filter("size > 1")
    units = sizes.withColumn("units", F.ceil(F.col("size") / F.lit(most))).select(*group, "units")
    unit = F.pmod("bits", "units").cast("int")
    return fine.join(units, group).groupBy(*group, "units", unit.alias("unit"), "start").agg(F.sum("n").alias("n"))


def _bits(spread: str) -> Column:
    return F.pmod(F.shiftright(F.col(spread), 8), F.lit(UNIT_BITS))


def unit_of(spread: str) -> Column:
    return F.pmod(_bits(spread), F.col("units")).cast("int")


def first_shard(spread: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("start"), F.col(spread)), F.lit(shards)).cast("int")


def propagate(blocks: DataFrame, group: list[str], shards: int, quota: int) -> DataFrame:
    """Final shard of every block: units move towards the shard that holds most of their group.

    ``blocks``: (group..., unit, start, n), one row per unit and first shard. In
    each round every unit in pieces, or away from most of its group, looks at the
    documents of its group by shard and aims at the fullest that has room for it.
    Arrivals at a shard are admitted by hash cells until its quota is used by
    whole units; those turned away look again in the next round, when a full
    shard is no longer an aim. It ends when nothing can move, which it must come
    to: every round fills a shard or moves units, a move makes a unit whole or
    takes it to a shard with more of its group, and so the group's counts, from
    the largest down, only grow.
    """
    spark = blocks.sparkSession
    blocks, path = stored(blocks.withColumn("shard", F.col("start")))
    unit = [*group, "unit"]
    full: set[int] = set()
    while True:
        units, units_path = stored(
            blocks.groupBy(*unit, "shard")
            .agg(F.sum("n").alias("n"))
            .groupBy(*unit)
            .agg(F.sum("n").alias("size"), F.count("*").alias("pieces"), F.min("shard").alias("at"))
        )
        loads = {
            r["at"]: r["n"]
            for r in units.filter("pieces = 1").groupBy("at").agg(F.sum("size").alias("n")).collect()
        }
        room = [0 if s in full else max(0, quota - loads.get(s, 0)) for s in range(shards)]
        votes = blocks.groupBy(*group, "shard").agg(F.sum("n").alias("votes"))
        held = votes.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("held"))
        # equal votes are told apart by the group's hash, so all units of a group aim alike
        aim = lambda s: F.struct(_votes(s).alias("votes"), F.xxhash64(*group, s).alias("tie"), s.alias("aim"))
        with_room = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.col("size") <= _of(s, room))
        aims = (
            units.join(held, group)
            .withColumn("best", F.array_max(F.transform(with_room, aim)))
            .withColumn("now", _votes(F.col("at")))
            .filter("best is not null and (pieces > 1 or best.votes > now)")
            .select(*unit, F.col("best.aim").alias("aim"), "size")
            .withColumn("cell", F.pmod(F.xxhash64(*unit), F.lit(ADMISSION_CELLS)).cast("int"))
        )
        aims, aims_path = stored(aims)
        discard(spark, units_path)
        if is_empty(aims):
            discard(spark, aims_path)
            return blocks
        until = _admitted(aims, room)
        # a shard that nothing aimed at it fits counts as full, so every round makes progress
        full |= {s for s, cell in until.items() if cell is None}
        admitted = [(s, cell) for s, cell in until.items() if cell is not None]
        if not admitted:
            discard(spark, aims_path)
            continue
        admitted = spark.createDataFrame(admitted, "aim int, until int")
        moved = aims.join(F.broadcast(admitted), "aim").filter("cell <= until").select(*unit, "aim")
        moved_blocks, moved_path = stored(blocks.join(moved, unit, "left").withColumn("shard", F.coalesce("aim", "shard")).drop("aim"))
        discard(spark, path, aims_path)
        blocks, path = moved_blocks, moved_path


def _votes(shard: Column) -> Column:
    return F.coalesce(F.element_at("held", shard), F.lit(0))


def _admitted(aims: DataFrame, room: list[int]) -> dict[int, int | None]:
    """Per shard aimed at, the last hash cell up to which all arrivals fit its room, or None."""
    cells = aims.groupBy("aim", "cell").agg(F.sum("size").alias("size")).collect()  # shards x cells rows at most
    until, used, closed = {}, {}, set()
    for aim, cell, size in sorted((r["aim"], r["cell"], r["size"]) for r in cells):
        until.setdefault(aim, None)
        used[aim] = used.get(aim, 0) + size
        if used[aim] > room[aim]:
            closed.add(aim)
        if aim not in closed:
            until[aim] = cell
    return until


def assign(docs: DataFrame, group: list[str], spread: str, shards: int = 16, blocks_from: DataFrame | None = None) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0) to every row.

    ``group``: columns whose equal values link rows; ``spread``: a hash column of
    the row. Counts are at most one apart (the law ``rows``). Links are kept
    together by label propagation; rows without links then fill the shards, and
    only rows beyond a quota, unlinked ones first, are handed to shards below
    theirs. ``blocks_from`` may be a stored, narrower copy of the same rows.
    """
    narrow = docs if blocks_from is None else blocks_from
    total = narrow.count()
    quota = max(1, total // shards)  # whole units never exceed the smaller quota
    blocks = propagate(linked_blocks(narrow, group, spread, quota, shards), group, shards, quota)
    # one row per group: its units and the shard of each block, bounded by shards and units per shard
    places = durable(
        blocks.groupBy(*group).agg(
            F.max("units").alias("units"),
            F.map_from_entries(F.collect_list(F.struct(F.col("unit") * shards + F.col("start"), "shard"))).alias("places"),
        )
    )

    def placed(rows: DataFrame) -> DataFrame:
        found = F.element_at("places", unit_of(spread) * shards + first_shard(spread, shards))
        out = rows.join(places, group, "left").withColumn("linked", F.col("places").isNotNull())
        return out.withColumn("shard", F.coalesce(found, first_shard(spread, shards))).select(*rows.columns, "shard", "linked")

    return _even(placed(docs), placed(narrow), spread, shards, total).select(*docs.columns, "shard", "slot")


def _even(placed: DataFrame, narrow: DataFrame, spread: str, shards: int, total: int) -> DataFrame:
    """Exact quotas: rank rows within shards, linked ones first, and move those beyond the quota to free slots.

    Ranks come from counted hash cells and an order within a cell only.
    """
    spark = placed.sparkSession
    cells = max(1, min(4_096, -(-total // (shards * ROWS_PER_CELL)) * 8))
    cell = F.pmod(F.xxhash64(F.lit("cell"), F.col(spread)), F.lit(cells)).cast("int")
    cell = F.when(F.col("linked"), cell).otherwise(cell + cells).alias("cell")
    placed = placed.withColumn("cell", cell)
    # shards x cells x 2 rows at most
    counts = sorted((r["shard"], r["cell"], r["count"]) for r in narrow.groupBy("shard", cell).count().collect())
    offsets, sizes = [], [0] * shards
    for shard, c, n in counts:
        offsets.append((shard, c, sizes[shard]))
        sizes[shard] += n
    quota = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-sizes[s], s))[: total % shards]:
        quota[s] += 1  # the fullest get the rows left over by the division
    over = [max(0, n - q) for n, q in zip(sizes, quota)]
    free = [(s, n, q - n) for s, (n, q) in enumerate(zip(sizes, quota)) if n < q]
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "shard int, cell int, offset bigint")), ["shard", "cell"])
    within = Window.partitionBy("shard", "cell").orderBy(spread)
    rank = F.row_number().over(within) - 1 + F.col("offset")
    ranked = ranked.withColumn("rank", rank.cast("bigint"))
    # rows beyond the quotas, numbered through all shards, take the free slots in order
    before = [sum(over[:s]) for s in range(shards)]
    ranked = ranked.withColumn("extra", F.col("rank") - _of(F.col("shard"), quota))
    stays = F.col("extra") < 0
    number = F.col("extra") + _of(F.col("shard"), before)
    starts = [sum(k for _, _, k in free[:i]) for i in range(len(free))] or [0]
    at = F.size(F.filter(F.array(*[F.lit(v).cast("bigint") for v in starts]), lambda v: v <= number)) - 1
    to, filled = [s for s, _, _ in free] or [0], [n for _, n, _ in free] or [0]
    return ranked.withColumns(
        {
            "slot": F.when(stays, F.col("rank")).otherwise(number - _of(at, starts) + _of(at, filled)),
            "shard": F.when(stays, F.col("shard")).otherwise(_of(at, to).cast("int")),
        }
    )


def _of(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), index + 1)


def sized(docs: DataFrame) -> DataFrame:
    """Add size, checksum and the hashes used for grouping and spreading, under reserved names.

    A missing text counts as empty for its size and checksum, and is linked to other missing and empty texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "__size": (F.octet_length(text) + F.lit(1)).cast("bigint"),
            "__crc": F.crc32(text.cast("binary")),
            "__g1": F.xxhash64(text),
            "__g2": F.xxhash64(F.lit("2"), text),
            "__spread": F.xxhash64(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), text),
        }
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All rows of docs with ``shard`` and ``slot``; equal texts are the links.

    Null ids and repeated rows are rows like any other; missing and empty texts
    are linked to each other. Columns named ``shard`` or ``slot`` are replaced. An
    empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    wide = sized(docs.select(*[F.col(f"`{c}`") for c in keep]))
    narrow = durable(wide.select("__g1", "__g2", "__spread"))
    out = assign(
        wide.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__d"), "__g1", "__g2", "__spread"),
        ["__g1", "__g2"], "__spread", shards, narrow,
    )
    return out.select("__d.*", "shard", "slot")

