"""Reading tables: columnar files, JSON lines, metadata logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               header: bool = True, sep: str = ",") -> DataFrame:
    """Parquet, CSV or TSV with an explicit schema (positional when there is no header)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("csv", "tsv"):
        return spark.read.csv(path, schema=schema, header=header, sep="\t" if fmt == "tsv" else sep, mode="PERMISSIVE")
    raise ValueError(f"unknown format {fmt}")


def load_json_lines(spark: SparkSession, path: str, schema: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines (also gzip): good rows, and one row with the numbers of malformed and id-less lines."""
    return split_json_lines(spark.read.text(path), schema, id_col)


def split_json_lines(lines: DataFrame, schema: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    full = f"{schema}, {CORRUPT} string"
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    bad, no_id = F.col(CORRUPT).isNotNull(), F.col(id_col).isNull()
    report = parsed.agg(F.count("*").alias("n_lines"), F.sum(bad.cast("long")).alias("n_malformed"),
                        F.sum((~bad & no_id).cast("long")).alias("n_without_id"))
    return parsed.filter(~bad & ~no_id).drop(CORRUPT), report


def context_type() -> Column:
    """Kind of a context from its three flags."""
    test, target = F.col("is_test_period") == 1, F.col("has_target") == 1
    return (F.when(F.col("is_initiation_eligible") == 0, "ineligible").when(test & target, "test")
            .when(test, "predict").when(target, "train").otherwise("other"))


def attach_vectors(rows: DataFrame, features: DataFrame, refs: dict[str, str], pick: dict[str, Column] | None = None) -> DataFrame:
    """Resolve dictionary-encoded vectors: each ref column becomes an array column. With ``pick`` (ref to an expression
    over ``vec``) the column is what is needed of the vector; whole vectors then do not travel through the later joins."""
    out = rows
    for ref, name in refs.items():
        value = (pick or {}).get(ref, F.col("vec"))
        out = out.join(features.select(F.col("feature_id").alias(ref), value.alias(name)), ref, "left")
    return out


def check_vectors(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Raise while running when a vector column is missing or has the wrong length."""
    for c, n in sizes.items():
        df = df.withColumn(c, F.when(F.size(c) == n, F.col(c)).otherwise(
            F.raise_error(F.lit(f"{c} must have {n} values")).cast(df.schema[c].dataType)))
    return df


def lookup(spark: SparkSession, name: str, key: str, ids: list) -> DataFrame:
    """Rows of a lookup table with the given ids; only the buckets that can hold them are read."""
    return spark.table(name).filter(F.col(key).isin(*ids))


def latest_wins(files: DataFrame, key: str = "metadata_id") -> DataFrame:
    """Newest line of each id over several files (later file, then later line); id-less lines drop.
    ``max_by`` keeps one row per id and map task."""
    cols = [c for c in files.columns if c not in (key, "file_seq", "line_no")]
    return files.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct("file_seq", "line_no")).alias("_r")).select(key, "_r.*")
