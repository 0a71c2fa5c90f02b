"""What several operators of this subpackage need: words, shared folders, joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run without ASCII white space. The same text is a Java, RE2 and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A lookup table with more rows than this is not broadcast.
BROADCAST_ROWS = 100_000
#: Of a join's keys, those with more rows than this are dealt over several tasks: the MOST_HOT most frequent, PARTS tasks at most.
HOT_ROWS, MOST_HOT, PARTS = 1000, 1000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads need no executor that made it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame) -> DataFrame:
    """df (written), to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup_join(df: DataFrame, small: DataFrame, key: str, salt: Column, rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """df with the columns of small's row of the same key; nulls match nulls, rows of df without match go.

    small (written, one row per key, other column names than df's) is broadcast if it has at most `rows` rows.
    Beyond that each of its rows is copied `salts` times and df's rows are dealt by `salt`, so that no key's
    rows meet in one task.
    """
    small = small.withColumnRenamed(key, "_lookup_key")
    match = df[key].eqNullSafe(small["_lookup_key"])
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(small), match).drop("_lookup_key")
    dealt = df.withColumn("_lookup_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    copies = small.withColumn("_lookup_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, match & (dealt["_lookup_salt"] == copies["_lookup_copy"])).drop("_lookup_key", "_lookup_salt", "_lookup_copy")


def dealt_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) of big (written) and small (at most one row per key) in which no key's rows meet in one task.

    The rows of hot keys are dealt by `by`, with a copy of small's row for each part; any key that isn't among the
    MOST_HOT has less than a MOST_HOT-th of all rows. counts may give the rows of big (_n) by key.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > HOT_ROWS)
    if hot.isEmpty():
        return big.join(small, keys, how)
    hot = written(hot.orderBy(F.desc("_n")).limit(MOST_HOT).select(*keys, F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(PARTS)).cast("int").alias("_parts")), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(by, parts).cast("int")).drop("_parts")
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def narrow_join(big: DataFrame, small: DataFrame, keys: list[str], by: Column, counts: DataFrame, how: str = "inner") -> DataFrame:
    """dealt_join with a small table (written) of a few numbers a row, which is broadcast if it has at most BROADCAST_ROWS rows."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    return dealt_join(big, small, keys, by, counts, how)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' places 0, 1, ... in a global order, sorted and counted by partition.

    Only one count per partition is gathered; the sorted rows stay where they are.
    """
    ordered = written(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    start, starts = 0, []
    for p in sorted(counts):
        starts.append((p, start))
        start += counts[p]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_place")
