import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions import text, tokens

PIECES = st.sampled_from(
    ["http://a.b/c", "https://x?y=1", "http", "www.a.com", "wwwx", "@user", "@", "#", "#世界杯#", "# #", "1️⃣",
     "*⃣", "😀", "今天", "的", "goal", "2024", "abc1", "É", "éa", " ", "\n", "　", "\xa0", "\x85", " ", "\x1c", "，", "。", "<b>"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=60)


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


CLEANED = {
    "": "",
    "plain words": "plain words",
    "  a\n\tb  ": "a b",
    "see https://x.y/z?q=1 now": "see now",
    "http:// no link": "http no link",
    "http://a,今天 好": "好",
    "mail@host.org x": "mail x",
    "@ a": "a",
    "#世界杯#精彩": "世界杯 精彩",
    "#a# #b": "a b",
    "##": "",
    "1️⃣ one *⃣ two 3": "one two 3",
    "今天，的。😀goal 2024!": "今天 的 goal 2024",
    "Éa éb": "a b",
}


def test_cleaned_texts(spark):
    assert [r[0] for r in run(spark, list(CLEANED), text.clean_text("c"))] == list(CLEANED.values())


TOPIC = {"": "", " Goal HTTP://A.b c ": "goal  c", "www.x y": " y", "wwwx y": "wwwx y", "wwwxa y": " y", "a http": "a http", "今天https://t": "今天"}


def test_topic_texts(spark):
    assert [r[0] for r in run(spark, list(TOPIC), tokens.topic_text("c"))] == list(TOPIC.values())


def is_part_in_order(part, whole):
    letters = iter(whole)
    return all(any(c == x for x in letters) for c in part)


@settings(max_examples=25, deadline=None)
@given(values=TEXTS)
def test_text_functions_agree_with_python(spark, values):
    got = run(
        spark, values, text.strip("c"), text.clean_text("c"), text.is_chinese("c"),
        tokens.topic_text("c"), text.is_blank("c"),
    )
    for value, (stripped, cleaned, chinese, topic, blank) in zip(values, got):
        assert stripped == value.strip()
        assert re.fullmatch("[0-9A-Za-z一-鿿]+( [0-9A-Za-z一-鿿]+)*|", cleaned)
        assert is_part_in_order(cleaned.replace(" ", ""), value)
        share = sum("一" <= ch <= "鿿" for ch in value) / max(1, len(value))
        assert chinese == (share > 0.2)
        assert not re.search(r"http[^\s]", topic) and is_part_in_order(topic, value.strip().lower())
        assert blank == (value.strip() == "")


@settings(max_examples=15, deadline=None)
@given(values=TEXTS)
def test_clean_text_is_idempotent(spark, values):
    once = [r[0] for r in run(spark, values, text.clean_text("c"))]
    assert [r[0] for r in run(spark, once, text.clean_text("c"))] == once


def cut(s):
    out = []
    for run_ in re.findall("[0-9A-Za-z]+|[一-鿿]+", s):
        if run_[0] >= "一" and len(run_) > 1:
            out += [run_[i : i + 2] for i in range(len(run_) - 1)]
        else:
            out.append(run_)
    return out


@settings(max_examples=25, deadline=None)
@given(values=TEXTS)
def test_tokens_and_bags_agree_with_python(spark, values):
    stop = ["goal", "今天"]
    got = run(
        spark, values, tokens.segment("c"), tokens.cloud_tokens(tokens.segment("c")),
        tokens.topic_tokens(tokens.segment("c"), stop), tokens.bag(tokens.segment("c")),
    )
    for value, (parts, words, topic, bag) in zip(values, got):
        expected = cut(value)
        assert parts == expected
        counted = [
            t.lower() if t.isascii() and t.isalpha() else t
            for t in expected
            if not t.isdigit() and len(t) >= (3 if t.isascii() and t.isalpha() else 2)
        ]
        assert words == counted
        assert topic == [t for t in expected if len(t) > 1 and t not in stop]
        assert [tuple(r) for r in bag] == sorted((t, expected.count(t)) for t in set(expected))


@pytest.mark.parametrize(
    "value, expected",
    [
        (None, ""),
        ("", ""),
        ("a#b#c", "a b c"),
        ("看@某人的球 好", "看 好"),
        ("1️⃣ 第一", "第一"),
        ("@http://x y", "y"),
        ("#世界杯#今天😀goal", "世界杯 今天 goal"),
        ("été", "t"),
    ],
)
def test_clean_text_cases(spark, value, expected):
    assert run(spark, [value], text.clean_text("c")) == [(expected,)]


def test_fixed_values():
    assert set(fv.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert len(fv.NULL_LITERALS) == 19
    assert len(set(fv.CLOUD_STOP_WORDS)) == len(fv.CLOUD_STOP_WORDS) and len(fv.TOPIC_STOP_WORDS) == 15


def test_very_long_text_without_kept_characters(spark):
    value = "é!@ " * 200_000 + "end"
    assert run(spark, [value], text.clean_text("c"), F.size(tokens.segment("c"))) == [("end", 1)]
