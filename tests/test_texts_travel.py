"""Texts of a batch are not all Python strings at once."""

import pyarrow as pa

from peerspark.functions import text as TX


def test_a_batch_is_cleaned_in_small_parts(monkeypatch):
    sizes, plain = [], [None if i % 7 == 0 else f"<b>{i}</b>" for i in range(300)]

    class Seen:
        def __init__(self, a): self.a = a
        def __len__(self): return len(self.a)
        def slice(self, start, n): sizes.append(len(self.a.slice(start, n))); return self.a.slice(start, n)

    got = TX._each(TX.cleaned, Seen(pa.array(plain)))
    assert got.to_pylist() == [None if p is None else TX.cleaned(p) for p in plain] and max(sizes) <= TX.AT_ONCE
    assert TX._each(TX.cleaned, pa.array([], pa.string())).to_pylist() == []


def test_pairs_with_a_null_are_null(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a", "<i>b</i>"), (None, "c"), ("d", None), ("e", "dummy text")], "t string, b string").coalesce(1)
    assert [r[0] for r in df.select(TX.merge_title_body(F.col("t"), F.col("b"), "dummy")).collect()] == ["a\nb", None, None, "e\n"]
