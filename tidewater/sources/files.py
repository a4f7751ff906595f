"""File sources and sinks: JSON arrays, JSON lines with line numbers, resumable scans, decision logs, safe rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.ranking import row_numbers

CASES = "id string, category string, turns array<struct<speaker:string,text:string>>"


def read_json_array(spark: SparkSession, path: str, schema: str = CASES) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): numbered from 1 in the order of file names and of lines in them, blank lines counted. Splits are
    numbered where they lie and then offset by the sizes of the splits before them."""
    rows = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    return row_numbers(rows.withColumn("__all", F.lit(1)), ["__all"], ["__id"], F.col("__split"), "line_no").select("line_no", F.col("value").alias("raw"))


def read_corpus(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict raises at a broken line, otherwise broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def resume(existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows per subtype, distinct turn keys) of what a generation has already written."""
    from tidewater.operators.curation import dedup_key

    keys = existing.select(F.explode("turns.text").alias("t")).select(dedup_key(F.col("t")).alias("key")).filter("key IS NOT NULL").distinct()
    return existing.groupBy("subtype").agg(F.count("*").alias("have")), keys


def append_log(decided: DataFrame, path: str) -> None:
    """Appends decision-log records as JSON lines."""
    decided.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """Finishes or undoes a rewrite that was broken off: a missing table comes from the new one if that is complete,
    else from the old one. Does nothing to a table that is there."""
    p, fs = _fs(spark, path)
    if not fs.exists(p(path)):
        for other in ([f"{path}.new"] if fs.exists(p(f"{path}.new/_SUCCESS")) else []) + [f"{path}.old"]:
            if fs.exists(p(other)):
                fs.rename(p(other), p(path))
                return


def rewrite(df: DataFrame, path: str, backup: bool = False, source: str = "parquet") -> None:
    """Replaces a table (`source`: parquet, json or text) by a DataFrame that may read it: written beside it first, then
    swapped by renames. At every moment the old or the new data are complete; after a crash between the renames
    `recover` puts the table back. With `backup` the old data replace path.bak once the swap is done."""
    spark = df.sparkSession
    p, fs = _fs(spark, path)
    recover(spark, path)
    df.write.mode("overwrite").format(source).save(f"{path}.new")
    if fs.exists(p(path)):
        fs.delete(p(f"{path}.old"), True)
        fs.rename(p(path), p(f"{path}.old"))
    fs.rename(p(f"{path}.new"), p(path))
    if backup and fs.exists(p(f"{path}.old")):
        fs.delete(p(f"{path}.bak"), True)
        fs.rename(p(f"{path}.old"), p(f"{path}.bak"))
    fs.delete(p(f"{path}.old"), True)
