"""Tables in and out: projection, partitioned sinks, resumable chunks, file names, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A Parquet table, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str, drop: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True).drop(*drop)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One value for each line of a plain list, blanks left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value != ''")


def save_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) rows as files, through Spark's own file systems, one at a time by way of the
    driver: for layers and tiles, which are few and small, not for cubes. Returns their number."""
    context, n = files.sparkSession.sparkContext, 0
    hadoop = context._jvm.org.apache.hadoop.fs
    for row in files.toLocalIterator():
        at = hadoop.Path(f"{folder}/{row['path']}")
        out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(row["content"]))
        finally:
            out.close()
        n += 1
    return n


def stacked(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def number_in_name(pattern: str = r"event_(\d+)") -> Column:
    """The number that a file's name holds, as a column of the rows read from it."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int")


def first_source(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Entity columns of several files side by side, in long form: the first file that has a key wins."""
    ranked = stacked(*[f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)])
    others = [c for c in ranked.columns if c not in (*keys, "_rank")]
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*others), "_rank").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def first_known(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: for each other column its first value that isn't null, by order."""
    others = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])


def steps(spark: SparkSession, first: int, last: int, step: int) -> DataFrame:
    """value: first, first + step, ... below last, as a range over years or events."""
    return spark.range(first, last, step).select(F.col("id").alias("value"))


def set_aside(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with all of the columns, and those that lack any."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.filter(whole), df.filter(~whole)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).filter("_n = 1").drop("_n")


def pending(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that no completed partition names. Null keys are never done."""
    return chunks.join(done.select(*keys).distinct(), keys, "left_anti")


def write_chunks(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that df has rows for and leaves the others, in one atomic commit, so
    that a run that was cut short resumes with pending()."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
