import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import outliers as O
from tessera.plans.cleaning import CleaningConfig, fit_cleaning
from tessera.sources.io import load_table, page, page_count, read_csv, with_row_id, write_table
from tessera.streaming.quality import clean_stream, parquet_stream, quality_counts, run_to_table
from tests.conftest import SF_SMALL


def test_read_csv_null_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as fh:
        fh.write("id,x,label,empty,mixed\n1,1.5,a,,1\n2,NA,b,NULL,2\n3,2.5,N/A,,x\n4,#N/A,none,,4\n")
    df = read_csv(spark, path)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["x"] == "double" and types["empty"] == "double"
    assert types["label"] == "string" and types["mixed"] == "string"
    rows = df.orderBy("id").collect()
    assert [r["x"] for r in rows] == [1.5, None, 2.5, None]
    assert [r["label"] for r in rows] == ["a", "b", None, "none"]  # 'none' is not a missing token


def test_write_and_reload_parquet(spark):
    d = tempfile.mkdtemp(prefix="tessera-out-")
    df = with_row_id(load_table(spark, f"{SF_SMALL}/region.parquet"), key="r_regionkey")
    write_table(df, os.path.join(d, "region"))
    back = spark.read.parquet(os.path.join(d, "region"))
    assert "_row_id" not in back.columns and back.count() == df.count()


def test_row_id_and_paging(spark):
    df = spark.range(0, 450).select((F.col("id") * 7 % 450).alias("v"))
    ided = with_row_id(df)
    assert sorted(r["_row_id"] for r in ided.collect()) == list(range(450))
    assert page_count(450, 200) == 3 and page_count(0, 200) == 1
    p3 = page(ided, 3, 200).collect()
    assert [r["_row_id"] for r in p3] == list(range(400, 450))
    assert [r["_row_id"] for r in page(ided, 2, 200, dense_ids=True).collect()] == list(range(200, 400))


def test_stream_matches_batch_transform(spark):
    ev = load_table(spark, f"{SF_SMALL}/events.parquet").select("event_id", "user_id", "event_type", "value")
    plan = fit_cleaning(ev, CleaningConfig(id_columns=("event_id",), impute=False))
    path = f"{SF_SMALL}/events.parquet"
    stream = parquet_stream(spark, path, spark.read.parquet(path).schema).select(*ev.columns)
    got = run_to_table(clean_stream(plan, stream), name="test-clean")
    want = plan.transform(ev)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_windowed_quality_counts(spark):
    path = f"{SF_SMALL}/events.parquet"
    batch = load_table(spark, path)
    bounds = O.fit_iqr_bounds(batch, ["value"])
    stream = parquet_stream(spark, path, spark.read.parquet(path).schema)
    counts = quality_counts(stream, "ts", "1 day", bounds, columns=["value", "event_type"])
    q = counts.writeStream.format("memory").queryName("qc_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    tot = spark.sql("select sum(rows) as r, sum(outlier_cells) as o from qc_test").first()
    assert tot["r"] == batch.count()
    assert tot["o"] == O.outlier_counts(batch, bounds).agg(F.sum("n_outliers")).first()[0]


def test_read_csv_booleans(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "b.csv")
    with open(path, "w") as fh:
        fh.write("id,flag\n1,True\n2,\n3,false\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes)["flag"] == "boolean"
    assert [r["flag"] for r in df.orderBy("id").collect()] == [True, None, False]


def test_csv_to_cleaning_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    path = os.path.join(d, "survey.csv")
    rows = ["id,q1,q2,q3,amount,segment"]
    flat = 0
    for i in range(1, 41):
        amount = "n/d" if i % 10 == 0 else (" 12 " if i % 7 == 0 else str(i * 1.5))
        q = [str(1 + (i * k) % 5) for k in (1, 2, 3)]
        if i % 9 == 0:
            q = ["3", "3", "3"]  # straight-liner
        flat += len(set(q)) == 1
        seg = "" if i % 8 == 0 else ("a" if i % 2 else "b")
        rows.append(",".join([str(i), *q, amount, seg]))
    with open(path, "w") as fh:
        fh.write("\n".join(rows) + "\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes)["amount"] == "string"  # mixed text stays text until coerced
    plan = fit_cleaning(df, CleaningConfig(id_columns=("id",)))
    assert plan.coerce_cols == ["amount"]
    out = plan.transform(df)
    assert dict(out.dtypes)["amount"] == "double"
    assert out.where("amount is null or segment is null").count() == 0
    assert out.count() == 40 - flat  # every straight-line row is dropped
