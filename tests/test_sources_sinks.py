import glob
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.operators import cleaning, segmentation, words
from chatterlake.sinks import files
from chatterlake.sources import csv_files, tables
from chatterlake.sources.words import read_words, word_table

CONTENT = '标题,n,备注\n"今天的\n足球, ""好""",1,NA\n比赛,2,x\n'


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(CONTENT.encode(encoding))
    df = csv_files.read_csv(spark, str(path), columns=["标题", "备注"])
    assert df.columns == ["标题", "n", "备注"]
    assert sorted(map(tuple, df.collect())) == [('今天的\n足球, "好"', 1, None), ("比赛", 2, "x")]


def test_csv_folder_with_both_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(CONTENT.encode("gb18030"))
    (tmp_path / "b.csv").write_bytes(CONTENT.encode("utf-8"))
    df = csv_files.read_csv(spark, str(tmp_path), schema="`标题` string, n int, `备注` string")
    assert df.count() == 4 and df.distinct().count() == 2


def test_csv_nulls_come_before_types(spark, tmp_path):
    cells = ["0.5", "NaN", "NA", "", "2"]
    (tmp_path / "n.csv").write_text("id,score,whole,text\n" + "".join(f"{i},{c},{i if c else 'null'},{c}x\n" for i, c in enumerate(cells)))
    for schema in (None, "id bigint, score double, whole bigint, text string"):
        df = csv_files.read_csv(spark, str(tmp_path), schema=schema)
        assert [k for _, k in df.dtypes] == ["bigint", "double", "bigint", "string"]
        rows = df.orderBy("id").collect()
        assert [r.score for r in rows] == [0.5, None, None, None, 2.0]
        assert [r.whole for r in rows] == [0, 1, 2, None, 4]
        assert df.agg(F.avg("score")).first()[0] == 1.25


def test_missing_columns_and_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match=r"missing columns \['z'\].*\['x', 'y'\]"):
        csv_files.read_csv(spark, str(tmp_path), columns=["x", "z"])
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_table(spark, str(tmp_path / "none"))
    assert tables.earlier_results(spark, str(tmp_path / "none")) is None


def test_null_literals(spark):
    values = [*fv.NULL_LITERALS, " NA", "na", "x", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    got = [r.c for r in tables.null_literals(df).orderBy("i").collect()]
    assert got == [None] * len(fv.NULL_LITERALS) + [" NA", "na", "x", None]


def test_guards(spark):
    df = spark.createDataFrame([], "c string")
    assert not tables.has_rows(df)
    assert words.word_counts(df, "c").count() == 0
    assert tables.require_columns(df, ["c"]) is df


def test_word_lists(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text(" 的 \n\n　和\nthe\nthe\n", "utf-8")
    assert sorted(r.word for r in read_words(spark, str(path)).collect()) == sorted(["的", "和", "the"])
    default = read_words(spark, str(tmp_path / "none.txt"), fv.TOPIC_STOP_WORDS)
    assert {r.word for r in default.collect()} == set(fv.TOPIC_STOP_WORDS)
    both = words.stop_word_union(read_words(spark, str(path)), default)
    assert both.count() == len({"的", "和", "the"} | set(fv.TOPIC_STOP_WORDS))


def test_word_counts_with_lists_and_tables(spark):
    df = spark.createDataFrame([("Goal goal 的确 12 ab abc1 ABC1",), ("goal 今天很好",), (None,)], "c string")
    counts = words.by_frequency(words.word_counts(df, "c", ["今天"])).collect()
    want = [("goal", 3), ("ABC1", 1), ("abc1", 1), ("天很", 1), ("很好", 1), ("的确", 1)]
    assert [tuple(r) for r in counts] == want
    table = word_table(spark, ["今天"])
    assert [tuple(r) for r in words.by_frequency(words.word_counts(df, "c", table)).collect()] == want
    many = [f"w{i}" for i in range(2_000)] + ["今天"]
    assert [tuple(r) for r in words.by_frequency(words.word_counts(df, "c", many)).collect()] == want
    assert [r.word for r in words.top_words(words.word_counts(df, "c", ["今天"]), 2).collect()] == ["goal", "ABC1"]


@pytest.mark.parametrize("stop", [[], ["a"], ["a", *(f"w{i}" for i in range(3_000))]])
def test_null_words_stay_for_lists_of_any_length(spark, stop):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "word string")
    want = {None, "b"} | (set() if stop else {"a"})
    assert {r.word for r in words.without_words(df, stop).collect()} == want
    assert {r.word for r in words.without_words(df, word_table(spark, stop)).collect()} == want


def test_cleaning(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "　 "), (4, None), (5, "a"), (6, "b")]
    df = spark.createDataFrame(rows, "id int, c string")
    assert sorted(map(tuple, cleaning.clean_rows(df, "c").collect())) == [(1, "a"), (5, "a"), (6, "b")]
    first = cleaning.first_per_text(df.withColumn("x", F.col("id") * 2), "c", "id")
    assert first.columns == ["id", "c", "x"]
    assert sorted(map(tuple, first.collect())) == [(1, "a", 2), (3, "　 ", 6), (6, "b", 12)]


def test_csv_sink_has_a_mark_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("今天\n好", 1), ('say "x"', None)], "text string, n int")
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    for part in glob.glob(f"{path}/part-*"):
        assert open(part, "rb").read(3) == b"\xef\xbb\xbf"
    back = csv_files.read_csv(spark, path)
    assert back.columns == ["text", "n"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        files.write_csv(df, path)


def test_empty_csv_keeps_its_header(spark, tmp_path):
    path = str(tmp_path / "empty")
    files.write_csv(spark.createDataFrame([], "a string, b int"), path)
    assert csv_files.read_csv(spark, path).columns == ["a", "b"]


def test_new_paths_never_overwrite(spark, tmp_path):
    df = spark.range(2)
    base = str(tmp_path / "comments.parquet")
    made = [files.write_new(df, base) for _ in range(3)]
    assert made == [str(tmp_path / f"comments_已翻译{n}.parquet") for n in ("", "(1)", "(2)")]


def test_writers_at_once_get_paths_of_their_own(spark, tmp_path):
    base = str(tmp_path / "new" / "comments.parquet")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: files.write_new(spark.range(i, i + 1), base), range(16)))
    assert len(set(made)) == 16
    assert sorted(spark.read.parquet(path).first().id for path in made) == list(range(16))
    assert not glob.glob(str(tmp_path / "new" / ".*.claim"))


def test_claims_go_when_a_write_fails_and_hold_while_it_runs(spark, tmp_path):
    base = str(tmp_path / "comments.parquet")
    with files.claimed_path(spark, base) as first:
        with files.claimed_path(spark, base) as second:
            assert (first, second) == tuple(str(tmp_path / f"comments_已翻译{n}.parquet") for n in ("", "(1)"))
            assert files.free_path(spark, base).endswith("(2).parquet")
    with pytest.raises(RuntimeError):
        with files.claimed_path(spark, base) as again:
            raise RuntimeError
    assert again == first == files.free_path(spark, base)


def test_split_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "positive"), (2, "negative"), (3, "unknown"), (4, None), (5, "neutral"), (6, "positive")],
        "id int, sentiment string",
    )
    path = str(tmp_path / "split")
    files.write_split(df, path)
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{path}/sentiment=*")) == ["negative", "neutral", "positive"]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/sentiment=positive").collect()) == [1, 6]
    assert spark.read.parquet(path).count() == 4


def by_hand(text, dictionary):
    import re

    out = []
    for run in re.findall("[0-9A-Za-z]+|[一-鿿]+", text):
        if run[0] < "一":
            out.append(run)
            continue
        rest, at = "", 0
        pieces = []
        while at < len(run):
            match = max((w for w in dictionary if run.startswith(w, at)), key=len, default="")
            if match:
                pieces += [rest, (match,)]
                rest, at = "", at + len(match)
            else:
                rest, at = rest + run[at], at + 1
        for piece in [*pieces, rest]:
            if isinstance(piece, tuple):
                out.append(piece[0])
            elif len(piece) == 1:
                out.append(piece)
            else:
                out += [piece[i : i + 2] for i in range(len(piece) - 1)]
    return out


def test_dictionary_segmentation_is_the_same_in_all_three_ways(spark):
    dictionary = ["世界杯", "世界", "足球", "足球比赛", "赛", "今天天气", "x1"]
    texts = [
        "今天的足球比赛很好 goal", "世界杯世界世", "足球足球比", "好", "no chinese 1", "", None, "<足球>的比赛", "天气今天天气今天天", "的的的世界的",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    table = word_table(spark, dictionary)
    repeated = df.unionByName(df.withColumn("id", F.lit(None).cast("int")))  # keys and texts repeat
    for way in ("pattern", "set", "join"):
        got = segmentation.with_tokens(repeated, "c", table, way).collect()
        assert len(got) == 2 * len(texts)
        for row in got:
            want = None if row.c is None else by_hand(row.c, [w for w in dictionary if w >= "一"])
            assert row.tokens == want, (way, row.c)
        none = segmentation.with_tokens(df, "c", word_table(spark, []), way).orderBy("id").collect()
        assert none[2].tokens == ["足球", "球足", "足球", "球比"]


def test_csv_sink_in_row_order(spark, tmp_path):
    df = spark.range(100).repartition(7).select(F.col("id"), F.lit("x").alias("c"))
    path = str(tmp_path / "ordered")
    files.write_csv(df, path, order="id")
    lines = [line for part in sorted(glob.glob(f"{path}/part-*")) for line in open(part, encoding="utf-8-sig")]
    ids = [int(line.split(",")[0]) for line in lines if not line.startswith("id")]
    assert ids == list(range(100))
