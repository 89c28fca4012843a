import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import numbers as N
from corpusmill.functions import text as X
from corpusmill.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()
    return row["x"]


def test_bm25_tokens_mixes_latin_and_cjk(spark):
    got = one(spark, X.bm25_tokens("t"), t="The 勞工請假 of Apple-12 甲")
    assert got == ["apple", "12", "勞工", "工請", "請假", "勞工請", "工請假", "甲"]


def test_token_estimate(spark):
    assert one(spark, X.estimate_tokens("t"), t="Don't pay 1,200.50 now!") == 5
    assert one(spark, X.estimate_tokens("t"), t="第8日，給薪。") == 7


def test_sentences_split_on_stops_and_blank_lines(spark):
    got = one(spark, X.sentence_units("t"), t="One two. Three four!\n\n五六。七八；end")
    assert got == ["One two.", "Three four!", "五六。", "七八；", "end"]


def test_unicode_white_space_collapses(spark):
    assert one(spark, X.clean_spaces(F.col("t")), t="　a 　b ") == "a b"


def test_term_counts_match_counter(spark):
    rows = [("b a b c a b",), ("",), ("x",)]
    df = spark.createDataFrame(rows, "t string").select(X.term_counts(F.filter(F.split("t", " "), lambda s: s != "")).alias("c"))
    got = [{r["term"]: r["tf"] for r in row["c"]} for row in df.collect()]
    assert got == [{"a": 2, "b": 3, "c": 1}, {}, {"x": 1}]


def test_ngrams_and_windows(spark):
    assert one(spark, X.char_ngrams(F.col("t"), 2), t="a甲b") == ["a甲", "甲b"]
    assert one(spark, X.char_windows(F.col("t"), 4, 3), t="abcdefghij") == ["abcd", "defg", "ghij"]
    assert one(spark, X.char_windows(F.col("t"), 4, 3), t="abc") == ["abc"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab 甲乙.\n!", max_size=40), st.integers(1, 6))
def test_hard_windows_are_a_partition(text, size):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = one(spark, X.char_windows(F.col("t"), size), t=text)
    assert got == [text[i : i + size] for i in range(0, len(text), size)]


def test_phrase_bonus(spark):
    df = spark.createDataFrame([("find red apple pie", "A Red apple pie here"), ("one", "one")], "q string, t string")
    # The longest run of the query is the phrase.
    assert [r[0] for r in df.select(X.phrase_bonus(F.col("q"), F.col("t"))).collect()] == [0.0, 0.0]


def test_cosine_and_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalize(F.col("a")).alias("n")).collect()
    assert rows[0]["c"] == 1.0 and rows[0]["n"] == [0.6, 0.8]
    assert rows[1]["c"] == 0.0 and rows[1]["n"] == [0.0, 0.0]


def test_numbers_and_durations(spark):
    df = spark.createDataFrame([("三",), ("十二",), ("二十",), ("百五",), ("2.5",), ("半",), ("兩",), ("x",)], "t string")
    assert [r[0] for r in df.select(N.parse_number(F.col("t"))).collect()] == [3.0, 12.0, 20.0, 105.0, 2.5, 0.5, 2.0, None]
    keys = spark.createDataFrame([(["8日", "三千二百天", "二〇二四年", "萬%"],)], "t array<string>").select(N.number_keys("t")).first()[0]
    assert keys[:3] == ["8|日", "3200|天", "2024|年"]
    d = one(spark, N.last_duration(F.col("t")), t="滿2年但未滿3個月")
    assert (d["number"], d["unit"]) == ("3", "個月")


def test_any_contains_escapes(spark):
    df = spark.createDataFrame([("a?b",), ("ab",)], "t string")
    assert [r[0] for r in df.select(X.any_contains(F.col("t"), ("?", "zz"))).collect()] == [True, False]
    assert re.escape("?") == "\\?"
