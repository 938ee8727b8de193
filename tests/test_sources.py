import pytest
from pyspark.sql import types as T

from tabloom.sources import tables

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("t", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("empty", T.DoubleType()),
    ]
)


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "day,id,x,t,empty\n2024-03-28,660271,1.5,abc,\n2024-03-29,660271.0,nan,NA,\n,junk,NULL,\"a, \"\"b\"\"\",\n"
    )
    df = tables.read_csv(spark, str(path), SCHEMA)
    assert df.schema == SCHEMA
    rows = [tuple(r) for r in df.collect()]
    assert [r[:3] for r in rows] == [(660271, 1.5, "abc"), (660271, None, None), (None, None, 'a, "b"')]
    assert all(r[4] is None for r in rows)
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), T.StructType([T.StructField("nope", T.LongType())]))


def test_types_come_from_all_rows(spark, tmp_path):
    head = "a.b,n,late,flag,day,bad_day,blank,text,ends\n"
    lines = [f"{i},{i}.5,{i},TRUE,2024-02-{i % 28 + 1:02d},2024-02-28,,1d,inf" for i in range(2000)]
    lines += ["NA,1,x,false,NaN,2024-02-30,null,2,-Infinity"]
    (tmp_path / "in.csv").write_text(head + "\n".join(lines) + "\n")
    df = tables.read_csv(spark, str(tmp_path / "in.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("a.b", "bigint"), ("n", "double"), ("late", "string"), ("flag", "boolean"), ("day", "date"),
        ("bad_day", "string"), ("blank", "double"), ("text", "string"), ("ends", "double"),
    ]
    last = df.filter("late = 'x'").first()
    assert tuple(last) == (None, 1.0, "x", False, None, "2024-02-30", None, "2", float("-inf"))
    assert tables.infer_schema(spark, str(tmp_path / "in.csv")) == df.schema


def test_types_of_a_file_without_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n")
    df = tables.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.dtypes == [("a", "double"), ("b", "double")] and df.count() == 0


def test_csv_sink_only_with_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "q", None, None)], SCHEMA)
    assert not tables.write_csv(df.filter("id > 5"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert tables.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out"), SCHEMA).collect()] == [(1, 2.5, "q", None, None)]


def test_date_range_prunes_folders(spark, tmp_path):
    df = spark.sql("SELECT id, date_add(DATE'2024-03-25', CAST(id AS INT)) AS day FROM range(10)")
    tables.land_by_date(df, str(tmp_path / "landed"), "day")
    got = tables.date_range(spark.read.parquet(str(tmp_path / "landed")), "day", "2024-03-28", "2024-03-30")
    assert sorted(r.id for r in got.collect()) == [3, 4, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
