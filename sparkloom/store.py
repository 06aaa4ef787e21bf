"""Tables written between stages, in the folder that all executors share.

A written table cuts the lineage: a lost executor costs a re-read, not a re-run of everything before it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket of a dealt table, and Spark's own limit of their number.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 100_000

#: Rows of a part of a table that is dealt for a step in memory.
PART_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="sparkloom-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted, never sent whole to the driver and to all executors.

    Spark broadcasts what it takes for small, by the bytes of a file: those of a written table are compressed, and a row
    that a text is cut into counts as one row only. What grows with the input would so pass through the driver's memory.
    """
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` over all cores.

    A file of few bytes is read by one or two tasks, however much is made of its rows; what is heavy for each row comes
    after this.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *columns)


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df``, which has about ``rows`` rows or is joined to as many, dealt by ``columns`` into parts of PART_ROWS.

    Spark joins small partitions by the bytes that they are shuffled in, so a task's rows and the memory of its sorts and
    maps would be those bytes' worth, and more where its rows are multiplied by a join; a number that is given stays.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # with fewer a join would deal again
    return df.repartition(max(least, -(-rows // PART_ROWS)), *columns)


class Stage:
    """Writes tables under one folder and can drop those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` computed once, as a Parquet table."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._sparkloom_path = path
        return saved

    def save_dealt(self, df: DataFrame, columns: list[str], size: int = 0) -> DataFrame:
        """``df`` computed once, as a bucketed table in this folder: joins and groupings by ``columns`` need not move it.

        A bucket is read by one task, so their number goes by ``size``, the bytes of ``df``: about BUCKET_BYTES each, and
        no fewer than the shuffle's partitions. The table has a name of its own in the session's catalog; :meth:`drop`
        takes it out again.
        """
        self._n += 1
        path, name = f"{self.root}/{self._n}", f"sparkloom_{uuid.uuid4().hex}"
        n = min(MOST_BUCKETS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
        dealt = df.repartition(n, *columns)
        # whole texts are written: the better codec takes less disk
        dealt.write.bucketBy(n, *columns).sortBy(*columns).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        saved = self.spark.table(name)
        saved._sparkloom_path, saved._sparkloom_table = path, name
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Deletes a table made by :meth:`save`; only call it when no lazy plan reads it."""
        if hasattr(saved, "_sparkloom_table"):
            self.spark.sql(f"DROP TABLE IF EXISTS {saved._sparkloom_table}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(saved._sparkloom_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
