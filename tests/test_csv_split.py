"""Quoted CSV files read by many tasks equal the whole-file result."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import csv_split
from tessera.sources.io import read_csv


def cell(rng, letters):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("abc 123") for _ in range(rng.randrange(0, 12))).strip() or "x"
    body = "".join(rng.choice(letters) if rng.random() < 0.6 else "word " for _ in range(rng.randrange(1, 40)))
    return '"' + body.replace('"', '""') + '"'


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    held = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_split_file_equals_whole_file(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    rows = [",".join(cell(rng, 'ab,\n"x é' if end == '\r\n' else 'ab,\n"x\r é') for _ in range(3)) for _ in range(120)]
    if seed == 3:  # a record over many splits
        rows.insert(40, '1,"' + "long line\n" * 80 + '",z')
    write(tmp_path / "one.csv", "a,b,c" + end + end.join(rows) + (end if seed != 2 else ""))
    write(tmp_path / "two.csv", "a,b,c" + end + end.join(rows[:30]))
    lines = csv_split.physical_lines(spark, str(tmp_path))
    assert lines.select("path", "block").distinct().count() > 40
    whole = (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path)))
    got = read_csv(spark, str(tmp_path), infer_types=False, null_tokens=())
    plain = lambda df: sorted(tuple((v or "").replace("\r\n", "\n") for v in r) for r in df.collect())
    assert plain(got) == plain(whole)
    assert got.columns == ["a", "b", "c"]


def test_quotes_inside_plain_cells_are_characters():
    assert not csv_split.open_after('5" pipe,6" pipe', False)
    assert csv_split.open_after('a,"b', False) and not csv_split.open_after('c",d', True)
    assert not csv_split.open_after('a,"b""",c', False) and not csv_split.open_after('""",', True) and csv_split.open_after('"",', True)
    assert csv_split.open_after('x","y', True)
    assert not csv_split.open_after("", False) and csv_split.open_after("", True)


def test_split_reader_types_blank_lines_and_errors(spark, tmp_path, small_splits):
    write(tmp_path / "t.csv", 'id,name,v\n1,"a\nb",2.5\n\n2,NA,\n3,"",7\n' + "".join(f"{i},n{i},1.5\n" for i in range(4, 60)))
    got = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes) == {"id": "bigint", "name": "string", "v": "double"}
    assert got.count() == 59 and got.filter("name is null").count() == 2
    assert got.where(F.col("name") == "a\nb").first()["v"] == 2.5
    write(tmp_path / "u.csv", "a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, str(tmp_path / "u.csv"), infer_types=False).collect()
    write(tmp_path / "v.csv", "a,b\n")
    assert read_csv(spark, str(tmp_path / "v.csv")).count() == 0
