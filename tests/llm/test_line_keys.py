"""What op3_line_dedup reads of lines: counts of words, sorted numbers, lines without a word."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import line_dedup


def test_numbers_are_never_null_and_blanks_part_words(spark):
    lines = ["a b\tc", " \t\r\f\x0b", "", "\x0ba", "a  a", " ", "x\r"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    keys = df.select(line_dedup._ordered(F.col("line"), [0] * line_dedup.RARITY_BUCKETS).alias("k"))
    assert not keys.schema["k"].dataType.containsNull  # else they are sorted as objects
    assert [len(r["k"]) for r in keys.collect()] == [3, 0, 0, 1, 1, 1, 1]
    assert [r[0] for r in df.select(line_dedup._worded(F.col("line"))).collect()] == [True, False, False, True, True, True, True]


def test_a_whole_text_is_parted_at_line_ends_too(spark):
    texts = ["a b\nc", "a\tb\n c\r\nd", "\n", "", "x\x0by\n\fz"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = df.select(F.array_remove(line_dedup._split(F.col("text"), whole=True), "").alias("w"))
    assert [r["w"] for r in found.collect()] == [["a", "b", "c"], ["a", "b", "c", "d"], [], [], ["x", "y", "z"]]
