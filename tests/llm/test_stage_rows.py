"""Which rows the pipeline's stages keep when null and repeated ids mix good and bad texts."""

from __future__ import annotations

from rankspark.llm import decontaminate, exact_dedup, language

from . import helpers as h

GOOD = [f"The {x} of the house went over the old river and came back with {y} in the morning." for x in ("owner", "cat", "son") for y in ("bread", "wood", "water")]


def _kept(df):
    return h.rows_of(df, "doc_id", "text")


def test_language_judges_rows_not_ids(spark):
    known = [(i, t, "en") for i, t in enumerate(GOOD)]
    mixed = [(None, None, None), (None, "12 34", "en"), (None, GOOD[0], "en"), (None, GOOD[1], None), (70, "...", "en"), (70, GOOD[2], "en"), (70, "", None)]
    got = language.keep_known(h.table(spark, known + mixed))
    assert _kept(got) == sorted([(i, t) for i, t, _ in known + mixed if t and any(c.isalpha() for c in t)], key=repr)


def test_copies_go_without_the_other_texts_of_their_id(spark):
    rows = [(1, "one text", "en"), (None, "one  text", "en"), (None, "another", "en"), (None, None, "en"), (5, "one text", "fr"), (5, "a third", "en"), (6, "", "en"), (6, "fourth", None)]
    got = exact_dedup.drop_copies(h.table(spark, rows))
    assert _kept(got) == sorted([(1, "one text"), (None, "another"), (5, "a third"), (6, ""), (6, "fourth")], key=repr)


def test_leaks_go_without_the_other_texts_of_their_id(spark):
    bench = spark.createDataFrame([(1, "what is the capital of the moon")], "item_id long, text string")
    rows = [(None, "x What is the capital of the moon y", "en"), (None, "clean", "en"), (None, None, "en"), (4, "what is the capital of the moon", "en"), (4, "clean too", "en"), (4, "clean too", "en")]
    got = decontaminate.drop_contaminated(h.table(spark, rows), bench)
    assert _kept(got) == sorted([(None, "clean"), (None, None), (4, "clean too"), (4, "clean too")], key=repr)
