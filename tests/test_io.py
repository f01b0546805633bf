import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kilnwork.sources import files
from kilnwork.streaming import revisions


def test_csv_and_versions(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿No.,Note\n01,"a ""b"", c"\n2,\n'.encode())
    got = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["No.", "Note"] and [tuple(r) for r in got.collect()] == [("01", 'a "b", c'), ("2", "")]
    where = f"file://{tmp_path}/t"
    v = files.write_version(got, where)
    w = files.write_version(got.limit(1), where, v)
    assert files.read_version(spark, where).count() == 1 and files.current_version(spark, where) == w
    with pytest.raises(RuntimeError):
        files.write_version(got, where, v)
    index = files.write_version(spark.range(3).withColumn("signature", F.lit("s1")), f"file://{tmp_path}/i")
    assert index and files.index_is_fresh(spark, f"file://{tmp_path}/i", "s1") and not files.index_is_fresh(spark, f"file://{tmp_path}/i", "s2")


def test_folder_and_archive(spark, tmp_path):
    for n in ("p10.png", "p2.png", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert [r["name"] for r in files.list_files(spark, str(tmp_path)).orderBy("key").collect()] == ["p2.png", "p10.png"]
    z = zipfile.ZipFile(io.BytesIO(files.export_zip([{"a": "1", "b": "x,y"}], ["a", "b"], {"a": "first"}, {"n": 1}, {"i.png": b"2"})))
    assert z.namelist() == ["metadata.csv", "data_dictionary.csv", "summary.json", "images/i.png"]
    assert z.read("metadata.csv") == '﻿a,b\r\n1,"x,y"\r\n'.encode()
    assert files.read_documents(spark, str(tmp_path / "*.json"), "a int").count() == 0 if list(tmp_path.glob("*.json")) else True


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 1, "u")], "k string, rev long, v string").coalesce(1).write.parquet(str(source))
    spark.createDataFrame([("a", 2, "y"), ("b", 4, "w")], "k string, rev long, v string").coalesce(1).write.mode("append").parquet(str(source))
    where = f"file://{tmp_path}/table"
    stream = spark.readStream.schema("k string, rev long, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
    read = lambda: files.read_version(spark, where) if files.current_version(spark, where) else None
    q = revisions.newest_wins(stream, ["k"], "rev", read, lambda df: files.write_version(df, where), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, read().select("k", "rev", "v").collect())) == [("a", 3, "z"), ("b", 4, "w")]


def test_job_queue(spark, tmp_path):
    s = "queue string, id string, dedupe_key string, priority long, sequence long, kind string"
    spark.createDataFrame([("p", "bulk", "b", 100, 1, "enqueue"), ("p", "again", "b", 100, 2, "enqueue"), ("p", "reread", "r", 10, 3, "enqueue")], s).coalesce(1).write.parquet(str(tmp_path / "j"))
    stream = spark.readStream.schema(s).parquet(str(tmp_path / "j"))
    q = revisions.next_jobs(stream).writeStream.format("memory").queryName("due").outputMode("update").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    spark.createDataFrame([("p", "reread", "r", 10, 4, "done")], s).coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.table("due").collect()] == ["reread", "bulk"]
