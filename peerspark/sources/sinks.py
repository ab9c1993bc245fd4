"""Writing feature and context tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prefix import running_number


def with_ids(df: DataFrame, order: str, id_col: str, start: int = 0, width: int = 1024) -> DataFrame:
    """Consecutive ids from ``start`` in the order of a number column, without a global sort in one task."""
    num = running_number(df, [], F.floor(F.col(order) / width).cast("long"), [order], "_rn")
    return num.withColumn(id_col, F.col("_rn") - 1 + start).drop("_rn")


def append_batch(df: DataFrame, path: str, order: str, id_col: str, batch_id: int) -> None:
    """Append a batch with continuing ids. A batch is one partition folder, written whole: running
    the same batch again replaces it instead of adding it twice."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).filter(F.col("batch_id") < batch_id).agg(F.max(id_col)).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    with_ids(df, order, id_col, 0 if done is None else done + 1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_lookup(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """A table for lookups by ``key``: bucketed and sorted by it, its files below ``path``."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)


class PartTable:
    """A table of parts by a key column's value that is overwritten in place, part by part.

    New parts are written beside the old ones, in folders of their own. The file ``current`` names the folder of
    each part; it is replaced by one rename, so a reader finds the old parts or the new ones, and a run that
    dies before the rename has changed nothing. A rerun then writes again; folders that no ``current`` names are
    never read. The list holds a line per part. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _file(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}")

    def parts(self) -> dict[str, str]:
        """Folder by part, of the current state."""
        files = self._file("current").getFileSystem(self._conf)
        if not files.exists(self._file("current")):
            return {}
        rows = self.spark.read.text(f"{self.path}/current").collect()
        return dict(r["value"].split("\t") for r in rows)

    def write(self, df: DataFrame) -> dict[str, str]:
        """Writes the parts that ``df`` has rows of, and returns their folders; nothing refers to them yet."""
        folder = f"data-{uuid.uuid4().hex}"
        df.withColumn("_part", F.hex(F.col(self.key).cast("string"))).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        found = self._file(folder).getFileSystem(self._conf).listStatus(self._file(folder))
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return {n.removeprefix("_part="): f"{folder}/{n}" for n in names}

    def swap(self, parts: dict[str, str]) -> None:
        """Makes ``parts`` the current state, by one rename."""
        draft = f"current-{uuid.uuid4().hex}"
        files = self._file(draft).getFileSystem(self._conf)
        out = files.create(self._file(draft))
        out.write("".join(f"{k}\t{v}\n" for k, v in sorted(parts.items())).encode())
        out.close()
        context = self._jvm.FileContext.getFileContext(self._file(draft).getFileSystem(self._conf).getUri(), self._conf)
        kind = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        option = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.Options, "Rename"), 1)
        option[0] = self.spark._jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
        context.rename(self._file(draft), self._file("current"), option)

    def overwrite(self, df: DataFrame, drop: list[str] | None = None) -> None:
        """Replaces the parts that ``df`` has rows of, and removes the parts in ``drop``; others stay."""
        new = self.write(df)
        gone = {v.encode().hex().upper() for v in drop or []}
        self.swap({k: v for k, v in {**self.parts(), **new}.items() if k not in gone or k in new})

    def read(self, schema) -> DataFrame:
        folders = [f"{self.path}/{v}" for v in sorted(self.parts().values())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def dedup_vectors(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Dictionary of distinct vectors with dense ids in order of first appearance, and key -> id."""
    first = vectors.groupBy(vec).agg(F.min(key).alias("_first"), F.count("*").alias("n_uses"))
    ids = with_ids(first, "_first", "feature_id")
    dictionary = ids.select("feature_id", F.col(vec), "n_uses")
    mapping = vectors.join(ids.select(vec, "feature_id"), vec).select(key, "feature_id")
    return dictionary, mapping


def new_vectors(vectors: DataFrame, dictionary: DataFrame, vec: str) -> DataFrame:
    """Vectors the dictionary does not hold yet."""
    return vectors.join(dictionary.select(vec), vec, "left_anti")


def drop_orphans(contexts: DataFrame, features: DataFrame, refs: list[str], drop_type: str) -> tuple[DataFrame, DataFrame]:
    """Remove contexts of a type, and features no surviving context refers to."""
    keep = contexts.filter(F.col("type") != drop_type)
    used = keep.select(F.explode(F.array(*refs)).alias("feature_id")).filter("feature_id IS NOT NULL").distinct()
    return keep, features.join(used, "feature_id", "left_semi")
