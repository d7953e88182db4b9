"""Readers and a writer for selection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaria import schemas
from sonaria.functions.ordered import running_before
from sonaria.functions.scalars import basename
from sonaria.sources import sheets

# The column names that annotation sheets use, the preferred one first.
ALIASES = {
    "file": ("begin file", "sound_file", "file", "file_name", "filename", "begin path"),
    "start_s": ("begin time (s)", "start_time", "start", "start_s", "begin_time"),
    "end_s": ("end time (s)", "end_time", "end", "end_s"),
    "low_hz": ("low freq (hz)", "low_freq", "low_hz", "low_frequency"),
    "high_hz": ("high freq (hz)", "high_freq", "high_hz", "high_frequency"),
}
NEEDED = ("file", "start_s", "end_s")
LOW_HZ, HIGH_HZ = 10.0, 1000.0


def resolve(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column that the first alias in order names, whatever its case and outer blanks."""
    by = {c.strip().lower(): c for c in reversed(columns)}
    return next((by[a] for a in aliases if a in by), None)


def normalise(df: DataFrame) -> DataFrame:
    """Any selection table as file (base name), id (order of the sheet), start_s, end_s, low_hz, high_hz. A missing
    mandatory column is a KeyError; missing frequencies are null."""
    found = {k: resolve(df.columns, v) for k, v in ALIASES.items()}
    lost = [k for k in NEEDED if found[k] is None]
    if lost:
        raise KeyError(f"no column for {', '.join(lost)} among {df.columns}")

    def number(k: str):
        return F.nanvl(F.expr(f"try_cast(`{found[k]}` as double)"), F.lit(None).cast("double")) if found[k] else F.lit(None).cast("double")

    out = df.select(F.monotonically_increasing_id().alias("id"), basename(F.col(f"`{found['file']}`").cast("string")).alias("file"), *(number(k).alias(k) for k in list(ALIASES)[1:]))
    return out.filter("file is not null and start_s is not null and end_s is not null").select("file", "id", "start_s", "end_s", "low_hz", "high_hz")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A sheet by its suffix: .tsv and .txt are tab-separated, .xlsx is a workbook's first sheet, .xls needs a reader
    that pandas knows, all else is comma-separated, or tab-separated if commas give no second column."""
    lower = path.lower()
    if lower.endswith(".xlsx"):
        head, *body = sheets.rows(bytes(spark.read.format("binaryFile").load(path).first().content)) or [[]]
        names = [h for h in head if h]
        cells = [[(r + [None] * len(head))[k] for k, h in enumerate(head) if h] for r in body if any(r)]
        return normalise(spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in names)))
    if lower.endswith(".xls"):
        import pandas as pd

        return normalise(spark.createDataFrame(pd.read_excel(path).astype(str)))
    tabs = lower.endswith((".tsv", ".txt"))
    df = spark.read.option("header", True).option("sep", "\t" if tabs else ",").csv(path)
    if not tabs and len(df.columns) <= 1:
        df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return normalise(df)


def with_default_band(df: DataFrame) -> DataFrame:
    return df.withColumns({"low_hz": F.coalesce("low_hz", F.lit(LOW_HZ)), "high_hz": F.coalesce("high_hz", F.lit(HIGH_HZ))})


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """A ground-truth table with its own column names and fixed types."""
    return spark.read.schema(schemas.SELECTIONS).option("header", True).csv(path)


def as_truth(selections: DataFrame) -> DataFrame:
    return selections.select(F.col("Sound_file").alias("file"), F.col("Selection").cast("long").alias("id"), F.col("Start_time").alias("start_s"), F.col("End_time").alias("end_s"), F.col("Call_type").alias("call_type"))


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".csv", ".tsv", ".xlsx", ".xls"), skip: tuple[str, ...] = ("predictions.csv",), skip_dirs: tuple[str, ...] = ("node_modules", "venv", ".git")) -> str | None:
    """The first sheet below root: by suffix in the given order, then by path; none in a skipped folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.substring_index("path", "/", -1)
    ok = found.filter(~name.isin(*skip) & (F.size(F.array_intersect(F.split("path", "/"), F.array(*map(F.lit, skip_dirs)))) == 0))
    rank = F.coalesce(*(F.when(F.lower(name).endswith(s), F.lit(i)) for i, s in enumerate(suffixes)))
    row = ok.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "path").first()
    return row.path if row else None


def dummy_annotations(files: DataFrame, n: int = 5, start: float = 2.0, end: float = 4.0) -> DataFrame:
    """A call at the same place in each of the first n files by name."""
    return files.select("file").orderBy("file").limit(n).select("file", F.lit(start).alias("start_s"), F.lit(end).alias("end_s"))


def numbered(detections: DataFrame) -> DataFrame:
    """Detections (file, start_s, end_s and more) with Selection, their number in order of file, start and end, missing
    ones last. The numbers come from each file's count, so files don't meet in one task."""
    d = detections.withColumn("_at", F.when(F.col("file").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("file"))))
    base = running_before(d.groupBy("_at").agg(F.count("*").alias("n")), "_at", "n", "_before").select("_at", "_before")
    k = F.row_number().over(Window.partitionBy("_at").orderBy(F.asc_nulls_last("start_s"), F.asc_nulls_last("end_s")))
    d = d.withColumn("_k", k).join(base, "_at")
    return d.select((F.col("_before") + F.col("_k")).cast("int").alias("Selection"), *detections.columns)


def selection_table(detections: DataFrame) -> DataFrame:
    """Detections (file, start_s, end_s, call_type, confidence, median_f0_hz) as a numbered selection table in order
    of file and start."""
    return numbered(detections).select("Selection", F.col("file").alias("Sound_file"), F.bround("start_s", 4).alias("Start_time"), F.bround("end_s", 4).alias("End_time"), F.col("call_type").alias("Call_type"), F.bround("confidence", 4).alias("Confidence"), F.bround("median_f0_hz", 2).alias("Median_F0_Hz"))


def write_selections(table: DataFrame, path: str) -> None:
    """One CSV file with a header, in order of Selection."""
    table.orderBy("Selection").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
