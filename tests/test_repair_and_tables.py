"""Damaged text, point lookups, and tables overwritten in place."""

import pytest
from pyspark.sql import functions as F

from peerspark.functions.text import clean_text, merge_title_body, repair_encoding
from peerspark.plans.cleaning import _scratch
from peerspark.sources import sinks, tables

CLEAN = ["café – it’s naïve", "LIBERTÉ— vive", "NÃO É “isso”", "É…", "日本 привет 😀", "Français : «Ça»", "", "plain", "£5 © 2020", "Æ’"]


def damaged(text, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    return text


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_unchanged(text):
    assert repair_encoding(text) == text


@pytest.mark.parametrize("times", [1, 2, 3])
@pytest.mark.parametrize("text", ["café – naïve “x” €5", "Ünïcödé", "日本 привет 😀"])
def test_damage_is_undone_step_by_step(text, times):
    assert repair_encoding(damaged(text, times)) == text


def test_mixed_text():
    assert repair_encoding("déjà vu, " + damaged("déjà vu") + " – " + damaged("’ok’", 2)) == "déjà vu, déjà vu – ’ok’"


def test_cleaning_columns(spark):
    df = spark.createDataFrame([("<b>Itâ€™s</b> ﬁne", "<p>cafÃ©</p>"), (None, "x"), ("t", "auto text")], "t string, b string")
    assert [r[0] for r in df.select(clean_text("t")).collect()] == ["It’s fine", None, "t"]
    assert [r[0] for r in df.select(merge_title_body(F.col("t"), F.col("b"), "auto")).collect()] == ["It’s fine\ncafé", None, "t\n"]


def test_lookup_reads_one_bucket(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    sinks.write_lookup(df, "lookup_test", _scratch(spark, "lookup"), "id", 16)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not show what it prunes
    one = tables.lookup(spark, "lookup_test", "id", [77])
    assert [tuple(r) for r in one.collect()] == [(77, 154)]
    assert "SelectedBucketsCount: 1 out of 16" in one._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert sorted(r["id"] for r in tables.lookup(spark, "lookup_test", "id", [5, 900, 5000]).collect()) == [5, 900]


def test_overwrite_in_place_survives_a_crash(spark, monkeypatch):
    schema = "kind string, x long"
    rows = lambda *kinds: spark.createDataFrame([(k, x) for k, x in kinds], schema)
    table = sinks.PartTable(spark, _scratch(spark, "parts"), "kind")
    read = lambda: sorted(map(tuple, table.read(schema).collect()), key=str)
    assert read() == []
    table.overwrite(rows(("a", 1), ("b", 2), (None, 3)))
    before = [("a", 1), ("b", 2), (None, 3)]
    assert read() == sorted(before, key=str)

    def crash(parts):
        raise OSError("lost between the two steps")
    with monkeypatch.context() as m:
        m.setattr(table, "swap", crash)
        with pytest.raises(OSError):
            table.overwrite(table.read(schema).filter("kind = 'a'").withColumn("x", F.col("x") + 10), drop=["b"])
    assert read() == sorted(before, key=str)
    for _ in range(2):  # a rerun, and one more with the same rows
        table.overwrite(rows(("a", 11)), drop=["b"])
        assert read() == sorted([("a", 11), (None, 3)], key=str)
