"""Who counts: first isolates, episodes, duplicates, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(c: str) -> Column:
    """A name as it is compared; blanks are missing."""
    return F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))


def first_isolates(isolates: DataFrame) -> DataFrame:
    """The first isolate of each site, patient and organism by date, then id; those without patient or organism all stay.

    Names are compared without case and outer white space. Isolates that lack a key are parts of their own.
    """
    alone = F.when(_key("patient").isNull() | _key("organism").isNull(), F.col("isolate_id"))
    order = Window.partitionBy("_site", "_patient", "_organism", "_alone").orderBy(F.col("specimen_date").asc_nulls_last(), "isolate_id")
    keyed = isolates.withColumns({"_site": _key("site"), "_patient": _key("patient"), "_organism": _key("organism"), "_alone": alone})
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1 OR _alone IS NOT NULL").select(*isolates.columns)


def episodes(events: DataFrame, days: int = 30) -> DataFrame:
    """The events of each patient and signal that come more than `days` after the last one kept.

    The days of a patient's signal are folded in order, as whether one is kept hangs on the one kept before it. Of
    a day's events that with the smallest id stays.
    """
    first = events.groupBy("patient", "signal", "day").agg(F.min("event_id").alias("event_id"))
    listed = first.groupBy("patient", "signal").agg(F.array_sort(F.collect_list(F.struct("day", "event_id"))).alias("_all"))
    start = F.array().cast("array<struct<day: date, event_id: bigint>>")

    def fold(kept: Column, x: Column) -> Column:
        late = (F.size(kept) == 0) | (F.datediff(x["day"], F.element_at(kept, -1)["day"]) > days)
        return F.when(late, F.concat(kept, F.array(x))).otherwise(kept)

    kept = listed.select("patient", "signal", F.explode(F.aggregate("_all", start, fold)).alias("_kept"))
    return kept.select("patient", "signal", "_kept.day", "_kept.event_id")


def duplicates(isolates: DataFrame) -> DataFrame:
    """Isolates that share site, patient, organism, specimen and date with an isolate of smaller id; nulls match nothing."""
    keys = ["site", "patient", "organism", "specimen", "specimen_date"]
    order = Window.partitionBy(*keys).orderBy("isolate_id")
    whole = isolates.dropna(subset=keys)
    return whole.withColumn("_first", F.first("isolate_id").over(order)).where("_first <> isolate_id").withColumnRenamed("_first", "duplicate_of")


def repeats(isolates: DataFrame) -> DataFrame:
    """Isolates with whether the site saw the same patient's organism on an earlier day, and how long before."""
    days = isolates.withColumn("_day", F.unix_date("specimen_date"))
    last = F.max("_day").over(Window.partitionBy("site", "patient", "organism").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1))
    return days.withColumn("days_since", F.col("_day") - last).withColumn("is_repeat", F.col("days_since").isNotNull()).drop("_day")


def overlapping_stays(stays: DataFrame) -> DataFrame:
    """stays (location, begin, end) with whether each overlaps another of its location. One sort by location, no self-join."""
    order = Window.partitionBy("location").orderBy("begin", "end", "stay_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("begin")
    after = F.lead("begin").over(order) <= F.col("end")
    return stays.withColumn("overlaps", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """Runs of overlapping or adjacent intervals (organism, location, begin, end) as one, with their number."""
    order = Window.partitionBy("organism", "location").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_new", F.when(F.col("begin") <= F.date_add(reach, 1), 0).otherwise(1))
    runs = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("organism", "location", "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("merged")).drop("_run")
