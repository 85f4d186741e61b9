"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests, one machine), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """Where all tables of this application stand."""
    return f"{shared_dir(spark)}/curatrix/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unique() -> str:
    return uuid.uuid4().hex


def release(spark: SparkSession) -> None:
    """Deletes all tables of this application and their names in the catalog, once no result that reads them is needed any more."""
    for path in listed(spark, own_dir(spark)):
        spark.sql(f"DROP TABLE IF EXISTS `{_table_name(path)}`")
    drop_path(spark, own_dir(spark))


def _table_name(path: str) -> str:
    """The name under which a bucketed table stands in the catalog."""
    return f"curatrix_{path[-32:].replace('-', '_')}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and where it stands."""
    path = new_path(df.sparkSession, name)
    return _stored(df, path, codec), path


def _stored(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that lost executors cost no recomputation of what came before."""
    return written(df, name, codec)[0]


def large(df: DataFrame) -> DataFrame:
    """df as one side of a join that isn't to be broadcast: Spark takes rows that are generated or exploded for as few as the file they came from."""
    return df.hint("merge")


def write_buckets(dealt: DataFrame, path: str, name: str, buckets: int, by: str, *order: str) -> DataFrame:
    """Writes rows that are dealt to `buckets` partitions by `by` already as a table of as many sorted files, and reads it back.

    It is registered under `name` in the session's catalog, which is how Spark knows that joins by `by` need no shuffle.
    """
    rows = dealt.sortWithinPartitions(by, *order)
    rows.write.format("parquet").bucketBy(buckets, by).sortBy(by, *order).option("path", path).option("compression", "zstd").saveAsTable(name)
    return dealt.sparkSession.table(name)


class Scratch:
    """Tables in the shared folder that are no longer needed once a result that was made from them is written.

    As a context it deletes them at its end, whether or not the result was reached; with `on_failure`, only if it wasn't.
    """

    def __init__(self, spark: SparkSession, on_failure: bool = False) -> None:
        self.spark = spark
        self.on_failure = on_failure
        self.paths: list[str] = []
        self.names: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, *_: object) -> None:
        if kind is not None or not self.on_failure:
            self.clear()

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)  # before it is written, so that half a table goes too
        return _stored(df, path, codec)

    def bucketed(self, df: DataFrame, name: str, by: str, *order: str, buckets: int | None = None) -> DataFrame:
        """The same, dealt to buckets by a column, once."""
        path, n = new_path(self.spark, name), buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table_name = _table_name(path)
        self.paths.append(path)
        self.names.append(table_name)
        # a task for each bucket, by the number that Spark gives it, so that each bucket is one file
        dealt = df.repartitionById(n, F.pmod(F.hash(by), F.lit(n))) if buckets else df.repartition(n, by)
        return write_buckets(dealt, path, table_name, n, by, *order)

    def clear(self) -> None:
        while self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop()}")
        while self.paths:
            drop_path(self.spark, self.paths.pop())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless one is there already, and says whether it did."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table, by whatever file system its path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """What stands directly in a folder; nothing if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f"{path}/{f.getPath().getName()}" for f in files.listStatus(p)) if files.exists(p) else []


def whole_tables(spark: SparkSession, path: str, name: str) -> list[str]:
    """The tables in a folder whose names begin with `name` and that were written to the end."""
    return [p for p in listed(spark, path) if p.rsplit("/", 1)[1].startswith(name) and exists(spark, f"{p}/_SUCCESS")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
