"""The reader that splits files, against the reader that takes each file whole."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from chatterlake.functions import fixed_values as fv
from chatterlake.sources import csv_files, csv_splits

ALPHABET = ["a", "b", " ", "é", "中文", "世", '"', ",", "\n", "\r\n", "x" * 30, "7"]


def table(seed, n, longest=12):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest)))
    return [(i, cell(), cell()) for i in range(n)]


def as_csv(rows, end="\n", header=("id", "text", "more")):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC).writerows([header, *rows])
    return out.getvalue()


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed,split_bytes", [(1, 40), (2, 150), (3, 4096), (4, 1 << 20)])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, seed, split_bytes):
    (tmp_path / "a.csv").write_bytes(as_csv(table(seed, 40)).encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(as_csv(table(seed + 10, 40)).encode("gb18030"))
    schema = "id bigint, text string, more string"
    want = collected(csv_files.read_csv(spark, str(tmp_path), schema))
    assert len(want) == 80
    marked = [(900 + i, *cells) for i, *cells in table(seed + 20, 9, 60)]  # the other reader turns line breaks within quotes into \n here
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbf" + as_csv(marked, "\r\n").encode("utf-8"))
    want = sorted([*want, *[(i, *[None if c in fv.NULL_LITERALS else c for c in cells]) for i, *cells in marked]], key=repr)
    got = csv_splits.read_large_csv(spark, str(tmp_path), schema, split_bytes=split_bytes)
    assert collected(got) == want
    if split_bytes == 150:
        found = csv_splits.read_large_csv(spark, str(tmp_path), split_bytes=split_bytes)
        assert found.columns == ["id", "text", "more"] and collected(found.selectExpr("bigint(id)", "string(text)", "string(more)")) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = table(5, 300)
    (tmp_path / "t.csv").write_text(as_csv(rows), newline="")
    size = (tmp_path / "t.csv").stat().st_size
    lines = csv_splits.lines_of(spark, str(tmp_path), 500)
    assert lines.rdd.getNumPartitions() >= size // 500
    starts = [r.start for r in csv_splits.splits_of(lines).collect()]
    assert all(s % 500 == 0 for s in starts) and len(starts) == len(set(starts))
    want = None
    for bound in (10**6, 0):  # splits sent to the tasks, or joined
        monkeypatch.setattr(csv_splits, "BROADCAST_SPLITS", bound)
        got = csv_splits.read_large_csv(spark, str(tmp_path), "id int, text string, more string", place="at", split_bytes=500)
        found = [(r.id, r.at) for r in got.orderBy("at").collect()]
        assert [i for i, _ in found] == [i for i, *_ in rows] and len({at for _, at in found}) == len(rows)
        assert want in (None, found)
        want = found


def test_a_row_over_many_splits(spark, tmp_path):
    long = "\n".join(f'line {i}, "quoted"' for i in range(400))
    (tmp_path / "t.csv").write_text(as_csv([(1, "a", "b"), (2, long, "c"), (3, "d", long), (4, "", "e")]), newline="")
    got = csv_splits.read_large_csv(spark, str(tmp_path), "id int, text string, more string", split_bytes=300)
    assert {r.id: (r.text, r.more) for r in got.collect()} == {1: ("a", "b"), 2: (long, "c"), 3: ("d", long), 4: (None, "e")}


def test_odd_files(spark, tmp_path):
    read = lambda name, **more: csv_splits.read_large_csv(spark, str(tmp_path / name), **more)
    (tmp_path / "header.csv").write_text("a,b\n")
    assert read("header.csv").columns == ["a", "b"] and read("header.csv").count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert read("empty.csv").collect() == []
    (tmp_path / "gaps.csv").write_text("a,b\n\n1,\n\n2\n3,x,y\nnull,z")
    assert collected(read("gaps.csv")) == collected(csv_files.read_csv(spark, str(tmp_path / "gaps.csv")))
    with pytest.raises(ValueError, match="missing columns"):
        read("gaps.csv", columns=["c"])
    with pytest.raises(ValueError, match="of their own"):
        read("gaps.csv", place="a")
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(PySparkException, match="do not pair up"):
        read("open.csv").collect()
