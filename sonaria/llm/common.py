"""What the operators share on Spark's side."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The engine's own bound is for each batch that goes to Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows here can have megabytes: writers look at the size of what they hold at each row, and hold little.
PACKED = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}

_own: dict[str, str] = {}
_made: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, which a cluster names. Where it
    is unset and everything runs on this machine, as in tests, a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "base" not in _own:
            _own["base"] = "file://" + tempfile.mkdtemp(prefix="shared-")
        base = _own["base"]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    _made.append(path)
    return path


def made() -> int:
    """How many folders this process has made so far: a mark for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the folders that this process has made since a mark, but for so many of the last. Results that read them
    and were not yet acted on are lost."""
    gone = _made[since : len(_made) - but]
    del _made[since : len(_made) - but]
    for path in gone:
        drop_dir(spark, path)


def _at_exit() -> None:
    """What is left goes with the process, if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the engine has gone before
            pass


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hand texts to Python in batches of bounded bytes, as 10,000 of them may be very long. What the session has set
    itself stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(size))


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new version of a small file; readers see the last whole one."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p(path))
    n = len(fs.listStatus(p(path)))
    out = fs.create(p(f"{path}/.{n:08d}"))
    out.writeBytes(text)
    out.close()
    fs.rename(p(f"{path}/.{n:08d}"), p(f"{path}/{n:08d}"))


def read_text(spark: SparkSession, path: str) -> str:
    """The last version of a file of write_text()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    return spark.read.text(f"{path}/{[n for n in names if n[0] != '.'][-1]}", wholetext=True).first()[0]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated(docs: DataFrame) -> int:
    """The bytes of what docs are read from, by the optimiser's estimate; where it has none, the bytes of the texts."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < 1 << 60:
        return size
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def buckets(docs: DataFrame, each: int = 16 << 20) -> int:
    """How many buckets of texts: the shuffle partitions, or more of them where a bucket would exceed `each` bytes of
    input. A task takes its buckets one after another, so its memory doesn't grow."""
    return max(partitions(docs.sparkSession), estimated(docs) // each)


def bucket(key: Column, n: int) -> Column:
    """A bucket of a text by its key: the same rows always meet the same bucket."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
