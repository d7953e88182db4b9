"""The catalogue of individuals and clips, as two Parquet-backed tables that DataFrame operations read and rewrite."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaria import schemas
from sonaria.functions.ordered import running_before

#: A fixed value: how an individual found in a recording is named, by its position.
ID_PREFIX = "Elephant_"


def caller_id(position: Column | str) -> Column:
    """Elephant_A for position 0, and so on."""
    p = F.col(position) if isinstance(position, str) else position
    return F.concat(F.lit(ID_PREFIX), F.char(p + 65))


def clip_name(parent: str, individual: str, kind: str, start: str) -> Column:
    """File name of a clip: the parent's name without suffix, cut to 30 characters, individual, kind and start."""
    stem = F.substring(F.replace(F.replace(F.col(parent), F.lit(".wav"), F.lit("")), F.lit(" "), F.lit("_")), 1, 30)
    return F.concat(stem, F.lit("_"), F.replace(F.col(individual), F.lit(" "), F.lit("_")), F.lit("_"), F.col(kind), F.lit("_T"), F.format_string("%.1f", F.col(start)), F.lit(".wav"))


def output_name(position: str, callers: str) -> Column:
    """Name of a cleaned track: one for a single caller, numbered from 1 otherwise."""
    return F.when(F.col(callers) == 1, F.lit("cleaned_output.wav")).otherwise(F.concat(F.lit("cleaned_caller_"), (F.col(position) + 1).cast("string"), F.lit(".wav")))


def missing_individuals(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows to add for ids of seen that known lacks, without nickname."""
    return seen.select("elephant_id").distinct().join(known, "elephant_id", "left_anti").withColumn("nickname", F.lit(""))


def numbered(clips: DataFrame, last: Column | int, *order: str) -> DataFrame:
    """clips with clip_id from last + 1 on, in the given order within parents, parents by name.

    Ids come from each parent's count and a running sum over parents, so clips don't meet in one task."""
    base = running_before(clips.groupBy("parent_wav").agg(F.count("*").alias("n")), "parent_wav", "n", "base").select("parent_wav", "base")
    k = F.row_number().over(Window.partitionBy("parent_wav").orderBy(*order))
    last = F.lit(last) if isinstance(last, int) else last
    return clips.withColumn("_k", k).join(base, "parent_wav").withColumn("clip_id", (last + F.col("base") + F.col("_k")).cast("long")).drop("_k", "base")


def renamed(individuals: DataFrame, names: DataFrame) -> DataFrame:
    """individuals with the nicknames of names (elephant_id, nickname) where it has one."""
    n = names.select("elephant_id", F.col("nickname").alias("_n"))
    return individuals.join(n, "elephant_id", "left").select("elephant_id", F.coalesce("_n", "nickname").alias("nickname"))


def by_caller(clips: DataFrame) -> DataFrame:
    """(parent_wav, elephant_id, clips): a caller's clips as an array in order of start."""
    fields = [c for c in clips.columns if c not in ("parent_wav", "elephant_id")]
    c = F.array_sort(F.collect_list(F.struct(F.col("start_time").alias("_s"), F.col("clip_id").alias("_i"), F.struct(*fields).alias("c"))))
    return clips.groupBy("parent_wav", "elephant_id").agg(F.transform(c, lambda x: x["c"]).alias("clips"))


def payload(clips: DataFrame) -> DataFrame:
    """(parent_wav, json): what the service answers for a recording."""
    nested = by_caller(clips)
    callers = F.array_sort(F.collect_list(F.struct("elephant_id", "clips")))
    return nested.groupBy("parent_wav").agg(callers.alias("callers"), F.count("*").alias("detected_callers"), F.sum(F.size("clips")).alias("clip_count")).select("parent_wav", F.to_json(F.struct("parent_wav", "detected_callers", "callers", "clip_count")).alias("json"))


def dominant_type(clips: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """(key, kind, n): the most frequent kind, of equal ones that which comes first."""
    n = clips.groupBy(key, kind).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_first")
    return n.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(key, kind, "n")


class Registry:
    """The two tables below one folder. A write adds a version with its own rows only: readers see the rows of all whole
    versions, of an individual the last. Each `COMPACT` versions one holds all rows so far, and readers begin there.
    Writers take turns by a lock that is made in one step; a writer that died leaves it, to be deleted by hand."""

    TABLES = {"individuals": schemas.INDIVIDUALS, "clips": schemas.CLIPS}
    COMPACT, WAIT = 32, 60.0

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextlib.contextmanager
    def _alone(self):
        fs, lock = self._fs(), self._path("lock")
        fs.mkdirs(self._path())
        until = time.monotonic() + self.WAIT
        while not self._made(fs, lock):
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds {lock}")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(lock, False)

    @staticmethod
    def _made(fs, lock) -> bool:
        """Whether this process has made the file; of several one has."""
        try:
            return bool(fs.createNewFile(lock))
        except Py4JJavaError:  # some file systems raise where the file is there
            return False

    def _versions(self, table: str) -> list[tuple[int, str]]:
        """(number, folder) of the whole versions that readers need, in order."""
        fs, folder = self._fs(), self._path(table)
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        whole = sorted((int(n[1:]), n) for n in names if n[:1] in "va" and fs.exists(self._path(table, n, "_SUCCESS")))
        base = max((k for k, (_, n) in enumerate(whole) if n[0] == "a"), default=0)
        return whole[base:]

    def read(self, table: str) -> DataFrame:
        v = self._versions(table)
        if not v:
            return self.spark.createDataFrame([], self.TABLES[table])
        rows = self.spark.read.schema(self.TABLES[table] + ", version int").parquet(*(f"{self.path}/{table}/{n}" for _, n in v))
        if table == "individuals":
            rows = rows.groupBy("elephant_id").agg(F.max_by("nickname", "version").alias("nickname"))
        return rows.select(*self._names(table))

    def _names(self, table: str) -> list[str]:
        return [f.split()[0] for f in self.TABLES[table].split(", ")]

    def write(self, table: str, df: DataFrame) -> None:
        """Add rows; of an individual that is there the new row counts."""
        v = self._versions(table)
        n = (v[-1][0] if v else 0) + 1
        rows = df.select(*self._names(table), F.lit(n).alias("version"))
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/v{n}")
        if len(v) + 1 >= self.COMPACT:
            self.read(table).withColumn("version", F.lit(n + 1)).write.mode("overwrite").parquet(f"{self.path}/{table}/a{n + 1}")

    def register(self, clips: DataFrame) -> DataFrame:
        """Add clips (parent_wav, elephant_id, file_path, start_time, end_time, clip_type) and the individuals that
        are new; returns the added rows with their ids."""
        with self._alone():
            old = self.read("clips")
            last = old.agg(F.coalesce(F.max("clip_id"), F.lit(0)).alias("m")).first().m
            new = numbered(clips, int(last), "elephant_id", "start_time", "end_time").withColumns({"human_label": F.lit(""), "created_at": F.current_timestamp()})
            self.write("individuals", missing_individuals(self.read("individuals"), clips))
            self.write("clips", new)
        return self.read("clips").filter(F.col("clip_id") > last)

    def dump(self) -> tuple[DataFrame, DataFrame]:
        return self.read("individuals").orderBy("elephant_id"), self.read("clips").orderBy("elephant_id", "start_time")

    def rename(self, elephant_id: str, nickname: str) -> bool:
        """Whether there is such an individual."""
        with self._alone():
            if self.read("individuals").filter(F.col("elephant_id") == elephant_id).isEmpty():
                return False
            self.write("individuals", self.spark.createDataFrame([(elephant_id, nickname)], "elephant_id string, nickname string"))
        return True

    def for_parent(self, parent: str) -> DataFrame:
        return self.read("clips").filter(F.col("parent_wav") == parent).orderBy("elephant_id", "start_time")

    def clip_path(self, clip_id: int) -> str | None:
        """The clip's path if both the row and the file are there."""
        row = self.read("clips").filter(F.col("clip_id") == clip_id).select("file_path").first()
        if row is None:
            return None
        p = self.spark._jvm.org.apache.hadoop.fs.Path(row.file_path)
        return row.file_path if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p) else None
