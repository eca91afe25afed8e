import random

import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["v"] for r in df.withColumn("v", expr).orderBy("i").collect()]


def test_normalisation(spark):
    odd = "　 A\x1cb \r\n\tÇ "
    assert values(spark, [(odd,), (None,), ("",)], "s string", T.norm_text("s")) == ["a b ç", "", ""]
    assert values(spark, [(" a\r\nb ",), (None,)], "s string", T.clean_text("s")) == ["a  b", ""]
    assert values(spark, [("Straße ",), ("ＡＢ",), ("Term",)], "s string", T.term_key("s")) == ["strasse", "ab", "term"]


def test_prose_and_letters(spark):
    texts = ["We ship to the client", "PlayStation, Xbox, PC, Steam", "Big Red Dog Ran.", "Steam Next Fest", "The"]
    assert values(spark, [(t,) for t in texts], "s string", T.looks_like_prose("s")) == [True, False, True, False, True]
    assert values(spark, [("12.5%",), ("→",), ("가",)], "s string", T.has_letters("s")) == [False, False, True]
    assert values(spark, [("12.5%",), ("ab",), ("가",)], "s string", T.has_cjk("s")) == [False, False, True]


def test_matching_form_is_casefolded(spark):
    got = values(spark, [("STRASSE",), (" straße ",), ("ΣΊΣΥΦΟΣ",), ("σίσυφος",), ("ſun",), ("ﬁn",)], "s string", T.norm_text("s"))
    assert got == ["strasse", "strasse", "σίσυφοσ", "σίσυφοσ", "sun", "fin"]


def test_limits(spark):
    assert values(spark, [("abcdefghij",), ("",)], "s string", T.char_limit("s", 85)) == [8, 1]
    assert values(spark, [("",), ("ab",), ("a" * 41,)], "s string", T.approx_tokens("s")) == [0, 1, 10]
    assert values(spark, [(0,), (10,), (80,)], "n int", T.output_token_budget("n")) == [1024, 1456, 8192]
    assert values(spark, [(0,), (5,), (6,), (161,)], "n int", T.length_bucket("n")) == ["1-5", "1-5", "6-10", "161+"]


def test_wrap(spark):
    rows = [
        ("brand new sentence here", [1, 1]), ("one two three four", [15, 5]), ("가나다라", [1, 1]), ("ab", [10, 1]), ("a", [1, 1, 1]),
    ]
    got = values(spark, rows, "t string, w array<int>", T.wrap_to_weights("t", "w"))
    assert got == [["brand new", "sentence here"], ["one two three", "four"], ["가나", "다라"], ["a", "b"], ["", "", "a"]]


def test_changed_phrase(spark):
    rows = [("the old plan is", "the new plan is"), ("same", "same"), ("", "new"), ("aa", "aaa"), ("abc", "abc d")]
    got = values(spark, rows, "a string, b string", T.changed_phrase("a", "b"))
    assert [tuple(g) for g in got] == [("old", "new"), ("", ""), ("", "new"), ("", "a"), ("", "d")]


def test_changed_phrase_matches_a_plain_scan(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choices("ab ", k=rnd.randint(0, 8))), "".join(rnd.choices("ab ", k=rnd.randint(0, 8)))) for _ in range(300)]

    def scan(a, b):
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        s = 0
        while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
            s += 1
        return a[p: len(a) - s].strip(), b[p: len(b) - s].strip()

    got = values(spark, rows, "a string, b string", T.changed_phrase("a", "b"))
    assert [tuple(g) for g in got] == [scan(a, b) for a, b in rows]


def test_phrases_and_dice(spark):
    words = [("활성화",), ("활성",), ("1234",), ("abc",), ("abcd",), ("AI",), ("-",)]
    assert values(spark, words, "s string", T.is_meaningful_phrase("s")) == [True, False, False, False, True, True, False]
    pairs = [("night", "nacht"), ("a", "a"), ("a", "b"), ("aaaa", "aa")]
    assert values(spark, pairs, "a string, b string", T.bigram_dice("a", "b")) == pytest.approx([0.25, 1.0, 0.0, 0.5])


def test_html_names_widths_colours(spark):
    assert values(spark, [("<a href='x'>&",)], "s string", T.sanitize_html("s")) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;"]
    assert values(spark, [("../a  b?.txt",), ("",), ("x" * 30 + ".pptx",)], "s string", T.sanitize_name("s", 20)) == [
        "..a b.txt", "file", "x" * 15 + ".pptx"]
    assert values(spark, [("가i W",), ("",)], "s string", T.text_width("s", F.lit(10.0))) == pytest.approx([24.8, 0.0])
    colours = [("default",), ("scheme:tx1",), ("scheme:accent1",), ("#0A0A16",), ("#FF0000",), ("#12",)]
    assert values(spark, colours, "s string", T.is_neutral_color("s")) == [True, True, False, True, False, False]
    assert values(spark, [("한국어", "영어"), ("독일어", "일본어")], "a string, b string", T.direction_code("a", "b")) == ["ko_to_en", "xx_to_ja"]
