"""Imputing, scaling and encoding, each fitted on the whole input and applied to it."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import prepare
from tabloom.operators.prepare import (
    Block,
    FrequencyEncoding,
    HashEncoding,
    Imputing,
    OneHotEncoding,
    OrdinalEncoding,
    Preparer,
    PresenceEncoding,
    Scaling,
)
from tabloom.plans.checked import checked
from tabloom.plans.checked.inputs import (
    LINEITEM_WITH_GAPS,
    ORDERS_WITH_GAPS,
    PITCHES_FROM_ORDERS,
    lineitem_with_gaps,
    orders_with_gaps,
    pitches_from_orders,
    table,
)
from tabloom.plans.checked.profile_queries import union_over


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g)), 4) AS o_totalprice FROM g""")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    out = Imputing(inputCols=["o_totalprice"], strategy="mean").fit(g).transform(g)
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM g)), 6) AS o_totalprice,
       round(coalesce(o_rare, (SELECT quantile_cont(o_rare, 0.5) FROM g)), 6) AS o_rare FROM g""")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    columns = ["o_totalprice", "o_rare"]
    out = Imputing(inputCols=columns, strategy="median").fit(g).transform(g)
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in columns])


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, coalesce(o_orderstatus, {_mode("o_orderstatus")}) AS o_orderstatus,
       coalesce(o_custkey, {_mode("o_custkey")}) AS o_custkey FROM g""")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    out = Imputing(inputCols=["o_orderstatus", "o_custkey"], strategy="most_frequent").fit(g).transform(g)
    return out.select("o_orderkey", "o_orderstatus", "o_custkey")


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, coalesce(o_orderstatus, 'missing') AS o_orderstatus, coalesce(o_totalprice, 0) AS o_totalprice FROM g""")
def impute_constant(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    out = Imputing(inputCols=["o_orderstatus"], strategy="constant", fillValue="missing").fit(g).transform(g)
    out = Imputing(inputCols=["o_totalprice"], strategy="constant").fit(out).transform(out)
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@checked("""
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) /
                        (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    out = Scaling(inputCols=["c_acctbal"], outputCols=["z"]).fit(c).transform(c)
    return out.select("c_custkey", F.round("z", 6).alias("z"))


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS}),
q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m,
             quantile_cont(o_totalprice, 0.75) AS b FROM g)
SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS r FROM g, q""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    out = Scaling(inputCols=["o_totalprice"], outputCols=["r"], kind="robust").fit(g).transform(g)
    return out.select("o_orderkey", F.round("r", 6).alias("r"))


def _slots(df: DataFrame, key: str, vector: str, names: list[str]) -> DataFrame:
    return df.select(key, vector_to_array(vector).alias("v")).select(
        key, *[F.col("v")[i].alias(n) for i, n in enumerate(names)]
    )


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@checked(
    "SELECT p_partkey, "
    + ", ".join(f"CAST(p_type = '{t}' AS INTEGER)::DOUBLE AS t_{t.lower()}" for t in _TYPES)
    + " FROM part"
)
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    out = OneHotEncoding(inputCols=["p_type"], outputCols=["t"]).fit(part).transform(part)
    return _slots(out, "p_partkey", "t", [f"t_{t.lower()}" for t in _TYPES])


@checked("""
WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1),
k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS slot FROM c WHERE r < 8)
SELECT part.p_partkey, CAST(coalesce(k.slot, 7) AS BIGINT) AS slot FROM part LEFT JOIN k ON part.p_brand = k.p_brand""")
def one_hot_capped(spark: SparkSession, d: str) -> DataFrame:
    """Eight slots for 25 brands: seven commonest and one for the rest."""
    part = table(spark, d, "part")
    out = OneHotEncoding(inputCols=["p_brand"], outputCols=["b"], maxCategories=8).fit(part).transform(part)
    slot = F.array_position(vector_to_array("b"), 1.0) - 1
    return out.select("p_partkey", slot.alias("slot"))


@checked("SELECT l_orderkey, CAST(l_linestatus = 'O' AS INTEGER)::DOUBLE AS is_open FROM lineitem")
def one_hot_if_binary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    enc = OneHotEncoding(inputCols=["l_linestatus"], outputCols=["is_open"], dropIfBinary=True)
    return enc.fit(lines).transform(lines).select("l_orderkey", "is_open")


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, CAST(o_custkey IS NULL AS INTEGER)::DOUBLE AS absent, CAST(o_custkey IS NOT NULL AS INTEGER)::DOUBLE AS there FROM g""")
def one_hot_flags(spark: SparkSession, d: str) -> DataFrame:
    """Presence flag one-hot encoded without a drop: two complementary columns."""
    g = orders_with_gaps(spark, d)
    flagged = PresenceEncoding(inputCols=["o_custkey"], outputCols=["f"]).fit(g).transform(g)
    out = OneHotEncoding(inputCols=["f"], outputCols=["v"]).fit(flagged).transform(flagged)
    return _slots(out, "o_orderkey", "v", ["absent", "there"])


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS}), k AS (
  SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM g WHERE o_orderstatus IS NOT NULL)),
p AS (SELECT DISTINCT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM g)
SELECT o_orderkey, CAST(coalesce(k.code, -1) AS DOUBLE) AS status_code, CAST(p.code AS DOUBLE) AS priority_code
FROM g LEFT JOIN k ON g.o_orderstatus = k.o_orderstatus JOIN p ON g.o_orderpriority = p.o_orderpriority""")
def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    enc = OrdinalEncoding(
        inputCols=["o_orderstatus", "o_orderpriority"], outputCols=["status_code", "priority_code"]
    )
    return enc.fit(g).transform(g).select("o_orderkey", "status_code", "priority_code")


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS}), a AS (SELECT o_custkey, count(*) AS n FROM g WHERE o_custkey IS NOT NULL GROUP BY 1),
b AS (SELECT o_orderstatus, count(*) AS n FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(a.n, 0) AS DOUBLE) AS customer_n, CAST(coalesce(b.n, 0) AS DOUBLE) AS status_n
FROM g LEFT JOIN a ON g.o_custkey = a.o_custkey LEFT JOIN b ON g.o_orderstatus = b.o_orderstatus""")
def frequency_encode(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    enc = FrequencyEncoding(inputCols=["o_custkey", "o_orderstatus"], outputCols=["customer_n", "status_n"])
    return enc.fit(g).transform(g).select("o_orderkey", "customer_n", "status_n")


@checked(f"""
WITH g AS (SELECT *, coalesce(CAST(o_custkey AS VARCHAR), 'nan') AS cust FROM ({ORDERS_WITH_GAPS})),
c AS (SELECT cust, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM g) AS share FROM g GROUP BY 1)
SELECT o_orderkey, round(coalesce(c.share, 0), 9) AS share FROM g LEFT JOIN c ON g.cust = c.cust AND c.share >= 0.001""")
def frequency_encode_share(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    enc = FrequencyEncoding(inputCols=["o_custkey"], outputCols=["share"], share=True, minShare=0.001)
    return enc.fit(g).transform(g).select("o_orderkey", F.round("share", 9).alias("share"))


@checked(f"""
WITH g AS ({ORDERS_WITH_GAPS})
SELECT o_orderkey, CAST(o_custkey IS NOT NULL AS INTEGER)::DOUBLE AS cust, CAST(o_totalprice IS NOT NULL AS INTEGER)::DOUBLE AS price FROM g""")
def presence_encode(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    enc = PresenceEncoding(inputCols=["o_custkey", "o_totalprice"], outputCols=["cust", "price"])
    return enc.fit(g).transform(g).select("o_orderkey", "cust", "price")


_HASHED = ["o_custkey", "o_orderstatus", "o_orderpriority"]


def _bucket_sql(c: str) -> str:
    return f"(CAST('0x' || right(md5(coalesce(CAST({c} AS VARCHAR), 'nan')), 2) AS INTEGER) % 32)"


@checked(
    f"WITH g AS (SELECT o_orderkey, {', '.join(f'{_bucket_sql(c)} AS b{i}' for i, c in enumerate(_HASHED))} "
    f"FROM ({ORDERS_WITH_GAPS})) SELECT o_orderkey, "
    + ", ".join(
        "CAST(" + " + ".join(f"CAST(b{j} = {i} AS INTEGER)" for j in range(3)) + f" AS DOUBLE) AS h_{i}"
        for i in range(32)
    )
    + " FROM g"
)
def hash_encode(spark: SparkSession, d: str) -> DataFrame:
    g = orders_with_gaps(spark, d)
    out = HashEncoding(inputCols=_HASHED, outputCols=["h"], buckets=32).fit(g).transform(g)
    return _slots(out, "o_orderkey", "h", [f"h_{i}" for i in range(32)])


@checked(f"""
WITH g AS ({LINEITEM_WITH_GAPS}), f AS (SELECT coalesce(l_quantity, avg(l_quantity) OVER ()) AS q, coalesce(l_tax, 0) AS t,
  l_extendedprice AS e FROM g)
SELECT round(avg(q), 6) AS q_mean, round(stddev_pop(q), 6) AS q_std, round(avg(t), 6) AS t_mean, count(e) AS n FROM f""")
def filled_moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments after filling, read off the moments before it: scaling needs no second pass."""
    g = lineitem_with_gaps(spark, d)
    m = prepare.moments(g, ["l_quantity", "l_tax", "l_extendedprice"])
    q_mean, q_var = prepare._filled_moments(m["l_quantity"], m["l_quantity"][2])
    t_mean, _ = prepare._filled_moments(m["l_tax"], 0.0)
    return g.agg(
        F.round(F.lit(q_mean), 6).alias("q_mean"),
        F.round(F.lit(q_var**0.5), 6).alias("q_std"),
        F.round(F.lit(t_mean), 6).alias("t_mean"),
        F.count("l_extendedprice").alias("n"),
    )


PITCH_BLOCKS = [
    Block("cont", ["release_speed", "release_spin_rate", "pfx_x", "pfx_z", "plate_x", "plate_z"], "mean", scale="standard"),
    Block("disc", ["balls", "strikes", "inning", "age_pit", "age_bat"], "most_frequent", scale="standard"),
    Block("OH", ["stand"], "most_frequent", encode="onehot"),
    Block("id", ["pitcher"], encode="frequency"),
    Block("Hash", ["on_1b", "on_2b", "on_3b"], encode="hash", buckets=8),
]


@checked(f"""
WITH p AS ({PITCHES_FROM_ORDERS}), s AS (SELECT stand, count(*) AS n FROM p WHERE stand IS NOT NULL GROUP BY 1 ORDER BY n DESC, stand LIMIT 1),
i AS (SELECT pitcher, count(*) AS n FROM p GROUP BY 1)
SELECT pitch_key, round(coalesce(release_speed - (SELECT avg(release_speed) FROM p), 0) /
         (SELECT stddev_pop(coalesce(release_speed, m)) FROM p, (SELECT avg(release_speed) AS m FROM p)), 6) AS release_speed,
       CAST(coalesce(stand, (SELECT stand FROM s)) = 'F' AS INTEGER)::DOUBLE AS "stand_F",
       CAST(coalesce(stand, (SELECT stand FROM s)) = 'O' AS INTEGER)::DOUBLE AS "stand_O",
       CAST(coalesce(stand, (SELECT stand FROM s)) = 'P' AS INTEGER)::DOUBLE AS "stand_P",
       CAST(i.n AS DOUBLE) AS pitcher
FROM p JOIN i ON p.pitcher = i.pitcher""")
def prepared_vector(spark: SparkSession, d: str) -> DataFrame:
    """Five blocks side by side; named slots of the assembled vector."""
    p = pitches_from_orders(spark, d)
    out = Preparer(PITCH_BLOCKS).fit(p).transform(p)
    names = prepare.feature_names(out)
    wanted = ["release_speed", "stand_F", "stand_O", "stand_P", "pitcher"]
    unpacked = out.select("pitch_key", vector_to_array("features").alias("v"))
    got = unpacked.select("pitch_key", *[F.col("v")[names.index(w)].alias(w) for w in wanted])
    return got.withColumn("release_speed", F.round("release_speed", 6))


@checked()
def prepare_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Rows, missing values and type after every stage of every block."""
    return prepare.explain_prepare(Preparer(PITCH_BLOCKS), pitches_from_orders(spark, d))


_SCALED = [c for b in PITCH_BLOCKS[:2] for c in b.columns]
_PITCH_HASHED = PITCH_BLOCKS[-1].columns


def _vector_means_sql() -> str:
    slots = [(c, "SELECT 0.0E0") for c in _SCALED]
    slots += [(f"stand_{v}", f"SELECT avg(CAST(coalesce(stand, (SELECT stand FROM s)) = '{v}' AS INTEGER)) FROM p") for v in "FOP"]
    slots += [("pitcher", "SELECT sum(n * n) / CAST(sum(n) AS DOUBLE) FROM i")]
    bucket = lambda c: f"CAST('0x' || right(md5(coalesce(CAST({c} AS VARCHAR), 'nan')), 2) AS INTEGER) % 8"
    for k in range(8):
        hits = " + ".join(f"CAST({bucket(c)} = {k} AS INTEGER)" for c in _PITCH_HASHED)
        slots.append((f"Hash_hash_{k}", f"SELECT avg({hits}) FROM p"))
    return union_over(
        list(enumerate(slots)),
        lambda x: f"SELECT CAST({x[0]} AS INTEGER) AS slot, '{x[1][0]}' AS feature, round(CAST(({x[1][1]}) AS DOUBLE), 6) AS mean",
    )


@checked(f"""
WITH p AS ({PITCHES_FROM_ORDERS}), s AS (SELECT stand, count(*) AS n FROM p WHERE stand IS NOT NULL GROUP BY 1 ORDER BY n DESC, stand LIMIT 1),
i AS (SELECT pitcher, count(*) AS n FROM p GROUP BY 1) {_vector_means_sql()}""")
def vector_names(spark: SparkSession, d: str) -> DataFrame:
    """(slot, feature) of the prepared vector, with the slot's mean over all rows."""
    p = pitches_from_orders(spark, d)
    out = Preparer(PITCH_BLOCKS).fit(p).transform(p)
    names = prepare.feature_names(out)
    slots = out.select(F.posexplode(vector_to_array("features")).alias("slot", "x"))
    label = F.array(*[F.lit(n) for n in names])
    means = slots.groupBy("slot").agg((F.round(F.avg("x"), 6) + 0.0).alias("mean"))
    return means.select("slot", label[F.col("slot")].alias("feature"), "mean")


# ---------------------------------------------------------------- types and gaps


_BEYOND_DOUBLE = 2**53 + 1


@checked(f"""
WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN {_BEYOND_DOUBLE}
           ELSE {_BEYOND_DOUBLE} + o_orderkey END AS big FROM orders)
SELECT o_orderkey, CAST(coalesce(big, {_BEYOND_DOUBLE}) AS BIGINT) AS big FROM g""")
def impute_mode_long(spark: SparkSession, d: str) -> DataFrame:
    """The commonest id beyond the range in which doubles are exact."""
    key = F.col("o_orderkey")
    big = F.when(key % 3 == 1, F.lit(_BEYOND_DOUBLE)).when(key % 3 == 2, key + _BEYOND_DOUBLE)
    g = table(spark, d, "orders").select("o_orderkey", big.alias("big"))
    return Imputing(inputCols=["big"], strategy="most_frequent").fit(g).transform(g)


_TYPED = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 5 AS BIGINT) END AS whole,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 3 AS DOUBLE) END AS number,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 3 = 0 END AS flag FROM orders"""


def _typed_columns(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(key % 4 != 0, (cust % 5).cast("bigint")).alias("whole"),
        F.when(key % 5 != 0, (cust % 3).cast("double")).alias("number"),
        F.when(key % 7 != 0, cust % 3 == 0).alias("flag"),
    )


@checked(f"""
WITH g AS ({_TYPED}), f AS (
  SELECT o_orderkey, coalesce(whole, {_mode("whole")}) AS whole, coalesce(number, {_mode("number")}) AS number,
         coalesce(flag, {_mode("flag")}) AS flag FROM g),
w AS (SELECT whole, row_number() OVER (ORDER BY whole) - 1 AS code FROM (SELECT DISTINCT whole FROM f)),
n AS (SELECT number, row_number() OVER (ORDER BY number) - 1 AS code FROM (SELECT DISTINCT number FROM f)),
b AS (SELECT flag, row_number() OVER (ORDER BY flag) - 1 AS code FROM (SELECT DISTINCT flag FROM f))
SELECT o_orderkey, CAST(w.code AS DOUBLE) AS whole, CAST(n.code AS DOUBLE) AS number, CAST(b.code AS DOUBLE) AS flag
FROM f JOIN w USING (whole) JOIN n USING (number) JOIN b USING (flag)""")
def ordinal_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Codes of whole numbers, doubles and booleans, gaps filled by the commonest value."""
    g = _typed_columns(spark, d)
    columns = ["whole", "number", "flag"]
    out = Preparer([Block("o", columns, "most_frequent", encode="ordinal")]).fit(g).transform(g)
    return _slots(out, "o_orderkey", "features", columns)


@checked(f"""
WITH g AS ({_TYPED}), f AS (SELECT o_orderkey, coalesce(CAST(whole AS VARCHAR), 'missing') AS whole FROM g)
SELECT o_orderkey, CAST(CASE WHEN whole = 'missing' THEN 5 ELSE CAST(whole AS INTEGER) END AS DOUBLE) AS whole
FROM (SELECT o_orderkey, whole FROM f) """)
def ordinal_constant_fill(spark: SparkSession, d: str) -> DataFrame:
    """A text that fills the gaps of a number column is a label of its own, the last."""
    g = _typed_columns(spark, d)
    out = Preparer([Block("o", ["whole"], "constant", fill="missing", encode="ordinal")]).fit(g).transform(g)
    return _slots(out, "o_orderkey", "features", ["whole"])


@checked(f"""
WITH g AS ({_TYPED}), f AS (SELECT o_orderkey, coalesce(number, {_mode("number")}) AS number, coalesce(flag, {_mode("flag")}) AS flag FROM g)
SELECT o_orderkey, CAST(number = 0 AS INTEGER)::DOUBLE AS n0, CAST(number = 1 AS INTEGER)::DOUBLE AS n1,
       CAST(number = 2 AS INTEGER)::DOUBLE AS n2, CAST(NOT flag AS INTEGER)::DOUBLE AS no, CAST(flag AS INTEGER)::DOUBLE AS yes FROM f""")
def one_hot_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Slots of doubles and booleans; a filled gap falls in the slot of its value."""
    g = _typed_columns(spark, d)
    out = Preparer([Block("o", ["number", "flag"], "most_frequent", encode="onehot")]).fit(g).transform(g)
    return _slots(out, "o_orderkey", "features", ["n0", "n1", "n2", "no", "yes"])


@checked(f"""
WITH g AS ({_TYPED}) SELECT o_orderkey, round(coalesce(CAST(CAST(flag AS INTEGER) AS DOUBLE), avg(CAST(CAST(flag AS INTEGER) AS DOUBLE)) OVER ()), 9) AS flag FROM g""")
def impute_mean_boolean(spark: SparkSession, d: str) -> DataFrame:
    g = _typed_columns(spark, d)
    out = Imputing(inputCols=["flag"], strategy="mean").fit(g).transform(g)
    return out.select("o_orderkey", F.round("flag", 9).alias("flag"))


def _any_bucket_sql(c: str, buckets: int) -> str:
    digest, rest = f"md5(coalesce(CAST({c} AS VARCHAR), 'nan'))", "CAST(0 AS BIGINT)"
    for first, digits in ((1, 4), (5, 7), (12, 7), (19, 7), (26, 7)):
        rest = f"(({rest} * {16**digits} + CAST('0x' || substr({digest}, {first}, {digits}) AS BIGINT)) % {buckets})"
    return rest


@checked(
    f"WITH g AS (SELECT o_orderkey, {', '.join(f'{_any_bucket_sql(c, 48)} AS b{i}' for i, c in enumerate(_HASHED))} "
    f"FROM ({ORDERS_WITH_GAPS})) SELECT o_orderkey, "
    + ", ".join(
        "CAST(" + " + ".join(f"CAST(b{j} = {i} AS INTEGER)" for j in range(3)) + f" AS DOUBLE) AS h_{i}"
        for i in range(48)
    )
    + " FROM g"
)
def hash_encode_48(spark: SparkSession, d: str) -> DataFrame:
    """Any number of buckets."""
    g = orders_with_gaps(spark, d)
    out = HashEncoding(inputCols=_HASHED, outputCols=["h"], buckets=48).fit(g).transform(g)
    return _slots(out, "o_orderkey", "h", [f"h_{i}" for i in range(48)])
