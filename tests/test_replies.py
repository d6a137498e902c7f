import json
import random

import pytest
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions import replies, times

CASES = [
    ("<think>a,\nb</think>positive,0.80", ("positive", 0.80), ("positive", 0.80)),
    ("negative,0.15", ("negative", 0.15), ("negative", 0.15)),
    (" Neutral , .50 ", ("neutral", 0.50), ("neutral", 0.50)),
    ("positive,0.8", ("positive", 0.80), ("positive", 0.80)),
    ("positive,0.875", ("positive", 0.88), ("positive", 0.88)),
    ("positive,0.155", ("positive", 0.15), ("positive", 0.15)),
    ("negative,-0.37", ("unknown", 0.0), ("negative", -0.37)),
    ("positive,1.50", ("unknown", 0.0), ("positive", 1.0)),
    ("positive,nan", ("unknown", 0.0), ("positive", 1.0)),
    ("positive,inf", ("unknown", 0.0), ("positive", 1.0)),
    ("negative,-Infinity", ("unknown", 0.0), ("negative", -1.0)),
    ("positive,0.5d", ("unknown", 0.0), ("neutral", 0.0)),
    ("positive,0x1", ("unknown", 0.0), ("neutral", 0.0)),
    ("positive,1_0e-1_0", ("positive", 0.0), ("positive", 0.0)),
    ("positive,5e-1", ("positive", 0.5), ("positive", 0.5)),
    ("positive,", ("unknown", 0.0), ("neutral", 0.0)),
    ("positive", ("unknown", 0.0), ("neutral", 0.0)),
    ("positive,0.2,0.3", ("unknown", 0.0), ("neutral", 0.0)),
    ("I think it is positive", ("unknown", 0.0), ("neutral", 0.0)),
    ("I say POSITIVE ,0.25.", ("positive", 0.25), ("neutral", 0.0)),
    ("结果positive,0.25", ("unknown", 0.0), ("neutral", 0.0)),
    (None, ("unknown", 0.0), ("neutral", 0.0)),
    ("", ("unknown", 0.0), ("neutral", 0.0)),
    ("NEGATIVE，0.20", ("unknown", 0.0), ("neutral", 0.0)),
    ("答：neutral,0.12", ("neutral", 0.12), ("neutral", 0.0)),
    ("neutral,1.00", ("neutral", 1.0), ("neutral", 1.0)),
    ("<think>x</think> y</think>positive,0.5", ("unknown", 0.0), ("neutral", 0.0)),
]


def test_parsers(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(CASES)], "i int, reply string")
    got = df.select("i", replies.parse_local("reply").alias("l"), replies.parse_remote("reply").alias("r"))
    for row in got.collect():
        reply, local, remote = CASES[row.i]
        assert (tuple(row.l), tuple(row.r)) == (local, remote), reply


def test_rounding_is_that_of_python(spark):
    random.seed(1)
    values = [n / 1000 for n in range(-1000, 1001)]
    values += [random.uniform(-1, 1) for _ in range(5000)]
    values += [round(random.uniform(-1, 1), d) for d in (3, 4, 5, 6) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", replies.round2(F.col("v")).alias("r")).collect():
        assert row.r == float(f"{row.v:.2f}"), row.v


@pytest.mark.parametrize(
    "body, text, choice",
    [
        ('{"message":{"content":" 好 "}}', "好", ""),
        ('{"message":{"content":null},"choices":[{"message":{"content":"b"}}]}', "", "b"),
        ('{"choices":[{"message":{"content":"b\\n"}},{"message":{"content":"c"}}]}', "b", "b"),
        ('{"choices":[]}', "", ""),
        ("{}", "", ""),
        ("no json", "", ""),
        (None, "", ""),
    ],
)
def test_reply_text(spark, body, text, choice):
    df = spark.createDataFrame([(body,)], "b string")
    assert tuple(df.select(replies.reply_text("b"), replies.first_choice_text("b")).first()) == (text, choice)


@pytest.mark.parametrize(
    "body, reply, choice",
    [
        ('{"message":{"content":"a"}}', None, "KeyError"),
        ('{"message":{"content":null}}', None, "KeyError"),
        ('{"message":null}', "TypeError", "KeyError"),
        ('{"message":{}}', "KeyError", "KeyError"),
        ('{"choices":[{"message":{"content":"b"}}]}', None, None),
        ('{"choices":[{"message":{"content":null}}]}', None, "AttributeError"),
        ('{"choices":[]}', "IndexError", "IndexError"),
        ('{"choices":[{}]}', "KeyError", "KeyError"),
        ('{"choices":null}', "TypeError", "TypeError"),
        ("{}", None, "KeyError"),
        ("no json", "JSONDecodeError", "JSONDecodeError"),
        (None, None, None),
    ],
)
def test_broken_replies(spark, body, reply, choice):
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(replies.broken_reply("b").alias("r"), replies.broken_choice("b").alias("c")).select("r.type", F.col("c.type").alias("c")).first()
    assert tuple(got) == (reply, choice)


def test_chat_request(spark):
    df = spark.createDataFrame([('say "hi"\n你好',), (None,)], "c string")
    request = replies.chat_request("m", "s", "c", **fv.REQUEST_OPTIONS["remote"])
    bodies = [json.loads(r[0]) for r in df.select(request).collect()]
    assert bodies[0] == {
        "model": "m",
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": 'say "hi"\n你好'}],
        "temperature": 0.0,
        "stream": False,
    }
    assert bodies[1]["messages"][1]["content"] == ""


def test_failed_marker(spark):
    df = spark.createDataFrame([("E", "x" * 500)], "e string, m string")
    marks = df.select(replies.failed_marker("e", "m"), replies.failed_marker("e", "m", "serial")).first()
    assert [len(m) for m in marks] == [len("[翻译失败:E] ") + 160, len("[翻译失败:E] ") + 120]
    assert df.select(replies.is_failed(F.lit(marks[0])), replies.is_failed(F.lit("x"))).first()[:] == (True, False)


def test_parse_time(spark):
    values = {
        "2024-06-01 10:00:00": "2024-06-01 10:00:00",
        "2024/06/01 10:00": "2024-06-01 10:00:00",
        "2024-06-01": "2024-06-01 00:00:00",
        "2024-06-01T10:00:00": "2024-06-01 10:00:00",
        "2024-06-01T10:00:00.123": "2024-06-01 10:00:00.123",
        "2024-06-01 10:00:00.123456": "2024-06-01 10:00:00.123456",
        "2024/6/1 9:05": "2024-06-01 09:05:00",
        "2024-6-1": "2024-06-01 00:00:00",
        "2024-06-01T10:00:00Z": "2024-06-01 10:00:00",
        "2024-06-01T10:00:00+08:00": "2024-06-01 02:00:00",
        "not a date": None,
        "2024-13-01": None,
        "2024-06-01 25:00": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(times.parse_time("c").cast("string")).collect()]
    assert got == list(values.values())
