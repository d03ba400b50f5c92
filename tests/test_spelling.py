"""Spelling pairs that are one word, pairs that are two, fixed keys, nulls."""

from pyspark.sql import functions as F

from siltstone.operators import spelling

APART = [("की", "of", "कि", "that"), ("जाती", "goes (f.)", "जाति", "caste"), ("माँ", "mother", "मान", "respect"), ("है", "is", "हैं", "are"), ("फन", "snake hood", "फ़न", "art, skill"), ("दिन", "day", "दान", "donation"), (None, "day", "दान", "day"), ("दिन", None, "दान", None)]
ONE = [("मंदिर", "temple", "मन्दिर", "temple"), ("हूँ", "am, I am", "हूं", "am, I am"), ("खुद", "self", "ख़ुद", "self"), ("चाहिये", "should, need", "चाहिए", "should, need"), ("बिल्कुल", "absolutely, totally", "बिलकुल", "absolutely, completely"), ("दुख", "sorrow", "दुःख", "sorrow"), ("मंदिर", None, "मन्दिर", None)]


def test_one_word_or_two(spark):
    df = spark.createDataFrame(APART + ONE, "wa string, ga string, wb string, gb string")
    got = df.select("wa", "wb", spelling.same_word(F.col("wa"), F.col("ga"), F.col("wb"), F.col("gb")).alias("same")).collect()
    assert [r.same for r in got] == [False] * len(APART) + [True] * len(ONE)


def test_keys_skeletons_and_glosses(spark):
    df = spark.createDataFrame([("ये", "come back; return"), ("अन्य", "to be (of)"), ("गये", ""), ("प्रत्येक", None), ("आम", "a, the")], "w string, g string")
    rows = df.select(spelling.spelling_key(F.col("w")).alias("k"), spelling.skeleton(F.col("w")).alias("s"), spelling.gloss_words(F.col("g")).alias("g"), spelling.lead_word(F.col("g")).alias("l")).collect()
    assert [r.k for r in rows] == ["ये", "अन्य", "गए", "प्रत्येक", "आम"]
    assert rows[4].s == "आम" and rows[1].s == "अनय"
    assert [(r.g, r.l) for r in rows] == [(["come", "back", "return"], "come"), ([], ""), ([], ""), ([], ""), ([], "")]
