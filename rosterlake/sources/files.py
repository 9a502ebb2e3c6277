"""Readers and writers. Reading pixels is a plug-in: a function from image bytes to text lines, run where the files are."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = "struct<id:string,label:string,kind:string,value:string,status:string,confidence:double,source:string,options:array<string>,raison:string,valeur_lue:string,colonne:int>"
PREDICTION = f"source string, title string, mode string, model string, threshold double, fields array<{FIELD}>"
LINES = "path string, i int, text string, score double, x0 int, y0 int, x1 int, y1 int"


def read_table_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, every column text: types are taken with try_cast, so that a bad cell is null and no file is read twice."""
    return spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def read_index(spark: SparkSession, path: str, split: str, final: bool = False, duplicates: bool = False) -> DataFrame:
    """Rows of one split of a page index; the test split only when asked for as final."""
    if split == "test" and not final:
        raise PermissionError("the test split is locked; pass final=True")
    rows = spark.read.option("header", True).csv(path).where(F.col("split") == split)
    return rows if duplicates else rows.where("duplicate_of is null or duplicate_of = ''")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Fields of prediction files in long form, with their place; values as text, whatever their JSON type."""
    docs = spark.read.option("multiLine", True).schema(PREDICTION).json(path).withColumn("path", F.input_file_name())
    return docs.select("path", "source", "title", "threshold", F.posexplode("fields").alias("ordinal", "f")).select("path", "source", "title", "threshold", "ordinal", "f.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.*")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a list without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_lines(spark: SparkSession, path: str, reader: Callable[[bytes], Iterable[tuple[str, float, int, int, int, int]]]) -> DataFrame:
    """Text lines of images: the plug-in reads one image at a time in Arrow batches of few rows."""

    def run(batches):
        for pdf in batches:
            rows = [(p, i, *line) for p, content in zip(pdf["path"], pdf["content"], strict=True) for i, line in enumerate(reader(content))]
            yield pd.DataFrame(rows, columns=["path", "i", "text", "score", "x0", "y0", "x1", "y1"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)


def recorded_sample(content_digest: Column, n: int) -> Column:
    """Which of n recorded outputs stands for a photo: its SHA-256 modulo n, by its 32-bit limbs."""
    out = F.lit(0).cast("bigint")
    for k in range(8):
        out = (out * F.lit((1 << 32) % n) + F.conv(F.substring(content_digest, 8 * k + 1, 8), 16, 10).cast("bigint")) % n
    return out.cast("int")


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, and the same rows as lines of a Markdown table; as many files as the frame has partitions, in their order."""
    df.write.mode("overwrite").json(f"{path}/json")
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def write_finals(pages: DataFrame, path: str) -> None:
    """One frozen document for each record: its pages and fields nested. pages: record_id, page_idx, ordinal, key, label, value, status."""
    by_page = pages.groupBy("record_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("ordinal", "key", "label", "value", "status"))).alias("fields"))
    by_page.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "fields"))).alias("pages")).write.mode("overwrite").json(path)


def encrypted(value: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypted(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def latest(changes: DataFrame, key: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """Current rows of an append-only change table: the last change of each key, without deleted ones."""
    cols = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False)))


# Columns of the index of photos and of an empty annotation table.
INDEX_COLUMNS = ["path", "sha256", "page_number", "patient", "position", "page_type", "split", "duplicate_of"]
TEMPLATE_COLUMNS = ["field_id", "groupe", "libelle", "type", "value", "status"]


def write_index(photos: DataFrame, path: str) -> None:
    """The index of photos as CSV, by split, page number (none counts as 0) and path: the part files follow one another."""
    order = ["split", F.coalesce(F.col("page_number").cast("int"), F.lit(0)), "path"]
    photos.select(*INDEX_COLUMNS).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_templates(fields: DataFrame, path: str) -> None:
    """An empty annotation table for each page type, as CSV in a folder of its own. fields: page_type, ordinal, field_id, groupe, libelle, type."""
    rows = fields.withColumns({"value": F.lit(""), "status": F.lit("")}).repartition("page_type").sortWithinPartitions("page_type", "ordinal")
    rows.select("page_type", *TEMPLATE_COLUMNS).write.mode("overwrite").partitionBy("page_type").option("header", True).option("emptyValue", "").csv(path)
