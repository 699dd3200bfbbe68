"""Joins and merges around benchmark runs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.operators.dataset import accept_headers, is_invalid_sql

GOLD_DDL = ("array<struct<db_id:string,context_url:string,question_english:string,question_hindi_1:string,question_hindi_2:string,"
            "question:string,query:string,answer:array<string>,column_names:array<string>>>")
RESULT_DDL = ("id string, language string, question string, generated_sql string, generated_answer string, "
              "generated_column_names array<string>, time_taken double")
CORRUPT = "_corrupt_record"
#: Files that are read by their paths, given by the driver.
SUSPECTS = 10_000


def gold_positions(texts: DataFrame, text: str = "value", keys: tuple = ()) -> DataFrame:
    """Entries of JSON arrays held as texts, each with its position as ``id``; an unreadable text has none."""
    return texts.select(*keys, F.posexplode(F.from_json(text, GOLD_DDL)).alias("id", "e")).select(
        *keys, F.col("id").cast("long").alias("id"), "e.*")


def read_gold_file(spark: SparkSession, path: str) -> DataFrame:
    """S4 on a file: one array, so one task reads it; the entries are dealt out after that."""
    return gold_positions(spark.read.text(path, wholetext=True))


def model_of_file(name: Column, prefix: str, suffix: str = ".json") -> Column:
    """The file name without prefix and suffix, compressed or not."""
    return F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), f"{suffix.replace('.', '[.]')}([.]gz)?$", "")


def _records(spark: SparkSession, paths: str | list[str], prefix: str) -> DataFrame:
    """The records of the files, each with its file's name and path; an unreadable file has one that is corrupt."""
    return (spark.read.schema(f"{RESULT_DDL}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.json{{,.gz}}").json(paths)
            .select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path")))


def suspect_files(spark: SparkSession, folder: str, prefix: str = "final_benchmark_") -> DataFrame:
    """(file_path): every file that Spark's reader may call unreadable, by one look at its text; others by chance.

    The text is parsed as the value of a field, beside which the parser tells whether anything in it failed. That takes about a
    third of the time of the reader of whole files.
    """
    texts = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.json{{,.gz}}").text(folder)
             .select("value", F.col("_metadata.file_path").alias("file_path")))
    entries = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    record = RESULT_DDL.replace(" string", ":string").replace(" array", ":array").replace(" double", ":double")
    parsed = F.from_json(F.concat(F.lit('{"r":'), entries, F.lit("}")), f"r array<struct<{record}>>, {CORRUPT} string",
                         {"columnNameOfCorruptRecord": CORRUPT})
    seen = texts.select("file_path", F.is_valid_utf8("value").alias("valid"), parsed.alias("p"))
    sound = F.col(f"p.{CORRUPT}").isNull() & F.col("p.r").isNotNull() & ~F.exists("p.r", lambda x: x.isNull()) & F.col("valid")
    return seen.filter(~F.coalesce(sound, F.lit(False))).select("file_path")


def readable_records(spark: SparkSession, folder: str, prefix: str = "final_benchmark_") -> DataFrame:
    """Records with their model, from all folders below ``folder``."""
    # Spark refuses a JSON scan of the corrupt column alone, as in a count, so the filters here and below name others beside it;
    # a record without id, question and SQL is none.
    return (_records(spark, folder, prefix).filter(f"{CORRUPT} IS NULL AND coalesce(id, question, generated_sql) IS NOT NULL")
            .withColumn("model", model_of_file(F.col("file_name"), prefix)).drop(CORRUPT, "file_name", "file_path"))


def unreadable_files(spark: SparkSession, folder: str, prefix: str = "final_benchmark_") -> DataFrame:
    """Name and path of files that could not be read.

    They are looked for among :func:`suspect_files`. Up to ``SUSPECTS`` are read by their paths; where there are more, all files are.
    """
    # Made distinct, so that all tasks look at files at once, not as many as the limit seems to need.
    suspects = [r[0] for r in suspect_files(spark, folder, prefix).distinct().limit(SUSPECTS + 1).collect()]
    # Given paths are patterns; Spark tells paths as URIs.
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(x)) for x in suspects] if len(suspects) <= SUSPECTS else folder
    if not paths:
        return spark.createDataFrame([], "file_name string, file_path string")
    files = _records(spark, paths, prefix).groupBy("file_name", "file_path").agg(F.count(CORRUPT).alias("bad"), F.count("id").alias("read"))
    return files.filter("bad > 0 AND read >= 0").select("file_name", "file_path")


def read_result_files(spark: SparkSession, folder: str, prefix: str = "final_benchmark_") -> tuple[DataFrame, DataFrame]:
    """Both of the above; either alone spares a listing of the files."""
    return readable_records(spark, folder, prefix), unreadable_files(spark, folder, prefix)


def coerce_ids(results: DataFrame) -> DataFrame:
    """Ids given as text or number become numbers; a text that is none matches no gold entry."""
    return results.withColumn("id", F.col("id").cast("string").try_cast("long"))


def rest_of(items: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """Items from position ``count(results)`` on, below ``limit``."""
    done = results.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    left = items.filter(F.col("idx") >= done)
    return left if limit is None else left.filter(F.col("idx") < limit)


def ungraded(items: DataFrame, graded: DataFrame) -> DataFrame:
    """Items whose index, as text, is no key of the graded ones."""
    return items.join(graded.select(F.col("idx").cast("string").alias("_k")), F.col("idx").cast("string") == F.col("_k"), "left_anti")


def translated(gold: DataFrame, translations: DataFrame, source: str, target: str) -> DataFrame:
    """``target`` from a table (question, translation); other rows pass unchanged, empty questions are not looked up."""
    t = translations.groupBy(F.col("question").alias("_q")).agg(F.min("translation").alias("_t"))
    return (gold.join(t, (F.col(source) == F.col("_q")) & (F.length(source) > 0), "left")
            .withColumn(target, F.coalesce("_t", F.col(target))).drop("_q", "_t"))


def review_records(gold: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Q11: question, SQL and the question made from the SQL, for entries with valid SQL."""
    return gold.filter(~is_invalid_sql(F.col("query"))).join(regenerated.select("id", "generated_question"), "id", "left").select(
        "id", "question_english", "query", F.coalesce("generated_question", F.lit("")).alias("generated_question"))


def log_text(question: Column, sql: Column, status: Column) -> Column:
    """K3: one entry of the text log."""
    return F.concat(F.lit("QUERY: "), question, F.lit("\nSQL: "), sql, F.lit("\nSTATUS: "), status, F.lit("\n"))


def enriched(gold: DataFrame, cleaned: str = "cleaned", raw: str = "raw") -> DataFrame:
    """``column_names``: the cleaned names if there are as many as raw ones, else the raw ones as they are; none without a header.

    ``raw`` is null where the statement failed or is missing.
    """
    none = F.array().cast("array<string>")
    return gold.withColumn("column_names", F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, accept_headers(F.col(cleaned), F.col(raw))).otherwise(none))


def enrichment_counts(enriched_gold: DataFrame) -> DataFrame:
    """Entries with and without column names."""
    return enriched_gold.agg(F.count_if(F.size("column_names") > 0).alias("enriched"), F.count_if(F.size("column_names") == 0).alias("empty"))


def repair_counts(merged: DataFrame, needed: Column) -> DataFrame:
    """Rows that needed a repair, were repaired, still fail."""
    return merged.agg(F.count(F.lit(1)).alias("total"), F.count_if(needed | F.col("repaired")).alias("selected"),
                      F.count_if("repaired").alias("repaired"), F.count_if(needed).alias("left_over"))


def write_json(df: DataFrame, path: str) -> None:
    """K2: JSON lines, UTF-8 as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(lines: DataFrame, path: str, order: list[str], text: str = "text") -> None:
    """K3/K6: the texts in order, sorted over as many files as they need; one file for a report's few lines."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, partition: dict[str, str] | None = None) -> None:
    """K1: each table anew below ``path``, partitioned by a column where one is given."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer = writer.partitionBy(partition[name]) if partition and name in partition else writer
        writer.parquet(f"{path.rstrip('/')}/{name}")
