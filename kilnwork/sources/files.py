"""Reading and writing files: text tables, documents, folders, exports."""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.functions import text as X


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, blank for missing; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.fillna("")


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row for each JSON document of a folder, with its file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, name, length, key) of files; ``key`` orders names naturally. Contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), "length", X.natural_key(name).alias("key"))


def write_version(df: DataFrame, folder: str, expected: str | None = None) -> str:
    """Write a table as a new version and point to it; refused if another version than ``expected`` is current.

    The pointer is renamed into place, so readers see the old version or the new one.
    """
    spark = df.sparkSession
    if expected is not None and current_version(spark, folder) != expected:
        raise RuntimeError(f"{folder} has another version than {expected}")
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    fs, path = _fs(spark, folder)
    made = path(f"{folder}/.{version}")
    out = fs.create(made)
    out.write(bytearray(version.encode()))
    out.close()
    target = path(f"{folder}/CURRENT")
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(made, target, _overwrite(spark))
    return version


def _overwrite(spark: SparkSession):
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    return options


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, folder: str) -> str | None:
    fs, path = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/CURRENT")):
        return None
    return spark.read.text(f"{folder}/CURRENT").first()[0]


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{current_version(spark, folder)}")


def index_is_fresh(spark: SparkSession, folder: str, signature: str) -> bool:
    """Whether a derived table was made from inputs with this signature."""
    found = current_version(spark, folder)
    return found is not None and read_version(spark, folder).where(F.col("signature") != signature).limit(1).count() == 0


def write_export(df: DataFrame, path: str, columns: list[str]) -> None:
    """Text parts with a header, in the given column order."""
    df.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def export_bytes(rows: list[dict], columns: list[str]) -> bytes:
    """A small export as CSV with a byte order mark, quoted only where needed."""
    out = io.StringIO()
    w = csv.DictWriter(out, columns, quoting=csv.QUOTE_MINIMAL, lineterminator="\r\n", extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue().encode("utf-8-sig")


def export_zip(rows: list[dict], columns: list[str], dictionary: dict[str, str], summary: dict, images: dict[str, bytes] | None = None) -> bytes:
    """An approved, bounded export as an archive: metadata, data dictionary, summary and images."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.csv", export_bytes(rows, columns))
        z.writestr("data_dictionary.csv", export_bytes([{"column": c, "meaning": dictionary.get(c, "")} for c in columns], ["column", "meaning"]))
        z.writestr("summary.json", json.dumps(summary, sort_keys=True))
        for name, data in sorted((images or {}).items()):
            z.writestr(f"images/{name}", data)
    return out.getvalue()
