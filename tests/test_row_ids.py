"""Tables without a key column: ids from where rows are stored."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from chatterlake.operators import cleaning, enrichment
from chatterlake.sinks import files
from chatterlake.sources import row_ids


def keyless(spark, path, n=200, parts=7):
    """Rows 0 .. n in order over several files; every fifth text repeats, one is null."""
    text = F.when(F.col("id") == 3, None).when(F.col("id") % 5 == 0, "again").otherwise(F.concat(F.lit("t"), "id"))
    rows = spark.range(0, n, 1, parts).select(text.alias("text"), F.col("id").alias("was"))
    rows.write.mode("overwrite").parquet(path)


@pytest.mark.parametrize("bound", [100, 0])
def test_ids_follow_files_and_rows_however_the_scan_is_split(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(row_ids, "BROADCAST_FILES", bound)
    path = str(tmp_path / "t")
    keyless(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in (before, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            seen.append([(r.row_id, r.was) for r in row_ids.read_table_with_ids(spark, path).orderBy("row_id").collect()])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 200
    assert [was for _, was in seen[0]] == list(range(200))


def test_keep_first_back_fill_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    keyless(spark, path)
    rows = row_ids.read_table_with_ids(spark, path)
    first = cleaning.first_per_text(rows, "text", "row_id").collect()
    assert {r.text: r.was for r in first}["again"] == 0 and len(first) == 160

    calls = enrichment.each(lambda text: f"positive,0.{len(text):02d}")
    scored = enrichment.score_rows(rows, "text", calls, "row_id")
    assert {r.was: r.score for r in scored.collect()} == {
        i: 0.0 if i == 3 else 0.05 if i % 5 == 0 else (len(str(i)) + 1) / 100 for i in range(200)
    }
    out = str(tmp_path / "out")
    files.write_csv(scored, out, order="row_id")
    parts = [csv.DictReader(open(p, encoding="utf-8-sig")) for p in sorted(glob.glob(f"{out}/part-*"))]
    assert [int(row["was"]) for part in parts for row in part] == list(range(200))


def test_csv_rows(spark, tmp_path):
    for name, start in (("a", 0), ("b", 50)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            csv.writer(out).writerows([("text", "was"), *[(f'x\n"{i % 9}"', i) for i in range(start, start + 50)]])
    rows = row_ids.read_csv_with_ids(spark, str(tmp_path), split_bytes=100)
    assert rows.columns == ["row_id", "text", "was"]
    assert [r.was for r in rows.orderBy("row_id").collect()] == list(range(100))
    assert {r.was for r in cleaning.first_per_text(rows, "text", "row_id").collect()} == set(range(9))


def test_clashing_name_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0).write.parquet(path)
    assert row_ids.read_table_with_ids(spark, path).collect() == []
    with pytest.raises(ValueError, match="of its own"):
        row_ids.read_table_with_ids(spark, path, into="id")
