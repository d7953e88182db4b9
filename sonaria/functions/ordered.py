"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least number of ranges of keys; what meets in one task is a row for each range, and the rows of a range.
RANGES = 256


def running_before(df: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows of a smaller key. Keys must be distinct and not null.

    Keys are dealt into as many ranges as there are shuffle partitions, or RANGES, at bounds taken from the table: the keys that come first in hash order, a bounded
    number. Any bounds give the right sums; evenly spread ones give even ranges.
    """
    ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = df.select(key).orderBy(F.xxhash64(key), key).limit(ranges - 1).collect()
    bounds = F.array(*(F.lit(b) for b in sorted(r[0] for r in some)))
    ranged = df.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(key))) if some else F.lit(0))
    per = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # A row for each range.
    base = per.withColumn("_base", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).select("_range", "_base")
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy(key)) - F.col(value)
    return ranged.withColumn("_inner", inner).join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")
