"""Readers and writers of raw inputs: text files, JSON bundles, transcripts, and the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = {"writing": ("txt", "md"), "conversation": ("json",), "chat": ("txt",)}


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _path():
    """The file of a row, as it is named (Spark gives it percent-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def discover(spark: SparkSession, folder: str, kind: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """path, source_type, suffix, size_bytes of the files below ``folder``; no row for a folder that is missing. Markers for empty folders are left out."""
    schema = "path string, source_type string, suffix string, size_bytes long"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    wanted = "{" + ",".join(f"*.{s}" for s in suffixes or SUFFIXES[kind]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", wanted).load(folder)
    rows = found.where(~F.col("path").endswith("/.gitkeep"))
    return rows.select("path", F.lit(kind).alias("source_type"), F.concat(F.lit("."), F.substring_index("path", ".", -1)).alias("suffix"), F.col("length").alias("size_bytes"))


def manifest(files: DataFrame) -> DataFrame:
    """Per type: how many files, and the sorted list of paths."""
    return files.groupBy("source_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def read_writings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file: path and body."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{*.txt,*.md}").text(folder, wholetext=True).select(_path().alias("path"), F.col("value").alias("body"))


def writing_records(files: DataFrame) -> DataFrame:
    """``path, body`` -> the writing record: slug, label, title, date, counts."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    label = T.label_of_name(name)
    title = F.coalesce(T.first_line(F.col("body")), label)
    date = T.date_of_name(name)
    return files.select(
        F.concat(F.lit("writing:"), T.slugify(name)).alias("id"), "path", T.slugify(name).alias("slug"), label.alias("file_label"), title.alias("title"), date.alias("source_date"),
        F.size(F.split("body", "\n")).cast("long").alias("line_count"), T.count_words(F.col("body")).alias("word_count"), F.length("body").cast("long").alias("character_count"), "body",
    )


def read_bundle(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A top-level array gives one row an element; a file that holds no array gives none."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    arrays = texts.where(F.col("value").rlike(r"^\s*\["))
    return arrays.select(_path().alias("path"), F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("c")).select("path", "c.*")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """chat_id, line_no, line of every transcript file."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(_path(), "/"), -1), r"\.[^.]*$", "")
    return texts.select(F.concat(F.lit("chat:"), T.slugify(name)).alias("chat_id"), F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("line_no", "line"))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder per table, as Parquet or JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...], kind: str = "parquet") -> dict[str, DataFrame]:
    """The named tables of a folder; all must be there."""
    missing = [n for n in names if not exists(spark, f"{folder}/{n}")]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return {n: spark.read.format(kind).load(f"{folder}/{n}") for n in names}


def append_batches(df: DataFrame, folder: str) -> None:
    """Batch outputs, one folder a batch_id; what is there stays."""
    df.write.mode("append").partitionBy("batch_id").parquet(folder)


def load_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """``name, body`` rows as text, one folder per name (rendered exports)."""
    pages.select("name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def remove_outputs(spark: SparkSession, folder: str, keep: tuple[str, ...] = (".gitkeep",)) -> int:
    """Delete what generated folders hold; returns how many entries went. Inputs are never below such a folder."""
    if not exists(spark, folder):
        return 0
    fs, p = _fs(spark, folder)
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in keep]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
