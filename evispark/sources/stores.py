"""Chunk and vector tables, keyed replacement, run history, request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunks_path(root: str, collection: str, strategy: str, size: int = 800) -> str:
    """Partition-style folder of a chunk table."""
    return f"{root}/chunks/collection={collection}/strategy={strategy}/size={size}"


def index_path(root: str, collection: str, strategy: str, contextual: bool = False, model: str = "default", size: int = 800) -> str:
    return f"{root}/index/collection={collection}/strategy={strategy}/ctx={str(contextual).lower()}/model={model}/size={size}"


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Parquet; sorted within files so that min and max of the sort columns prune row groups."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_strategy(spark: SparkSession, root: str, collection: str, strategy: str, fallback: str = "fixed", size: int = 800) -> tuple[str, bool]:
    """The strategy whose chunk table exists, and whether it is the fallback."""
    if exists(spark, chunks_path(root, collection, strategy, size)):
        return strategy, False
    if exists(spark, chunks_path(root, collection, fallback, size)):
        return fallback, True
    raise FileNotFoundError(f"no chunk table of {collection} for {strategy} or {fallback}")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Full replacement by key: the new rows, and the old rows whose key isn't among them. Of keys repeated in new the last by seq stays."""
    if seq:
        rest = [c for c in new.columns if c != key]
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(key, "x.*")
    return new.select(*old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def import_vectors(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Vectors with their chunks' metadata, and the chunks without a vector. A vector without a chunk is an error."""
    if not (strange := vectors.join(chunks.select(key), key, "left_anti")).isEmpty():
        raise ValueError(f"vectors of unknown chunks, such as {strange.first()[key]}")
    return vectors.join(chunks, key), chunks.join(vectors.select(key), key, "left_anti")


def export_texts(chunks: DataFrame, header: str = "header") -> DataFrame:
    """chunk_id, text to embed: the header line ahead of the stored text."""
    return chunks.select("chunk_id", F.concat_ws("\n", header, "text").alias("text"))


def mirror(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a table unless the target already holds as many rows; tells whether it copied."""
    df = spark.read.parquet(source)
    if exists(spark, target) and spark.read.parquet(target).count() == df.count():
        return False
    df.write.mode("overwrite").parquet(target)
    return True


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows still to do when a run resumes."""
    return todo.join(done.select(key), key, "left_anti")


def log_lines(requests: DataFrame) -> DataFrame:
    """value: one JSON line for each request, nulls left out."""
    return requests.select(F.to_json(F.struct(*requests.columns)).alias("value"))


class PostgresTable:
    """A table behind JDBC, if its driver is on the class path; reads are split by a bounded numeric column."""

    def __init__(self, url: str, table: str, properties: dict[str, str] | None = None) -> None:
        self.url, self.table, self.properties = url, table, properties or {}

    def read(self, spark: SparkSession, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
        if column and bounds:
            return spark.read.jdbc(self.url, self.table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=self.properties)
        return spark.read.jdbc(self.url, self.table, properties=self.properties)

    def append(self, df: DataFrame, batch: int = 500) -> None:
        df.write.option("batchsize", batch).jdbc(self.url, self.table, mode="append", properties=self.properties)


class ManagedStore:
    """A hosted vector store; none is bundled."""

    def __init__(self, *_: object, **__: object) -> None:
        raise NotImplementedError("no hosted vector store is available; use the Parquet tables")
