"""What is needed of a vector is taken before the rows travel on."""

from pyspark.sql import functions as F

from peerspark.sources.tables import attach_vectors


def test_picked_parts_equal_those_of_whole_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, None)], "feature_id long, vec array<double>")
    t = spark.createDataFrame([(i, i % 4, (i * 3) % 4) for i in range(9)], "event_id long, a long, b long")
    refs = {"a": "av", "b": "bv"}
    whole = attach_vectors(t, v, refs).select("event_id", F.get("av", F.lit(0)).alias("av"), F.get("bv", F.lit(1)).alias("bv"))
    picked = attach_vectors(t, v, refs, {"a": F.get("vec", F.lit(0)), "b": F.get("vec", F.lit(1))})
    assert dict(picked.dtypes)["av"] == "double"
    assert sorted(map(str, picked.select("event_id", "av", "bv").collect())) == sorted(map(str, whole.collect()))
