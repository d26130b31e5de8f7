"""XLSX files through the data source: batch against the function over file contents, and a stream that is stopped and goes on."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_records import workbook
from tradeloom.sources import workbooks, xlsx


def base(df):
    return df.withColumn("document_id", F.element_at(F.split("document_id", "/"), -1))


def plain(df, like):
    return sorted((tuple(map(str, r)) for r in base(df).select(*like.columns).collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "good.xlsx").write_bytes(workbook())
    (tmp_path / "in" / "deep" / "also.XLSX").write_bytes(workbook())
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"PK no zip")
    (tmp_path / "in" / "empty.xlsx").write_bytes(b"")
    (tmp_path / "in" / "note.txt").write_text("no workbook")
    return tmp_path / "in"


@pytest.mark.parametrize("head", ["", "file://"])
def test_batch(spark, folder, head, monkeypatch):
    workbooks.register(spark)
    read = spark.read.format("xlsx")
    cells, sheets, both = (read.option("table", t).load(f"{head}{folder}") for t in ("cells", "sheets", "all"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).where("lower(path) like '%.xlsx'").select(F.col("path").alias("document_id"), "content")
    assert plain(cells, cells) == plain(xlsx.cells(files), cells) and cells.count() == 16
    assert {r.document_id for r in base(sheets.where("code = 'FILE_CORRUPTED'")).collect()} == {"bad.xlsx", "empty.xlsx"}
    some = sheets.where("document_id not like '%empty.xlsx'")  # binaryFile has no row for a file without bytes
    assert plain(some, some) == plain(xlsx.sheets(files), some)
    assert plain(both.where("cell is not null").select("document_id", "cell.*"), cells) == plain(cells, cells)
    assert plain(both.where("sheet is not null").select("document_id", "sheet.*"), sheets) == plain(sheets, sheets)


def test_dealt():
    sizes = [10, 70, 30, 30, 30, 5]
    parts = workbooks.dealt([workbooks.Found(str(i), s, 0) for i, s in enumerate(sizes)], 64)
    assert [p.paths for p in parts] == [["0"], ["1"], ["2", "3"], ["4", "5"]]


def test_odd_paths(spark, tmp_path):
    workbooks.register(spark)
    assert spark.read.format("xlsx").load(str(tmp_path)).count() == 0
    for options, path in (({"table": "x"}, str(tmp_path)), ({}, str(tmp_path / "none"))):
        with pytest.raises(Exception, match="not one of|FileNotFoundError|none"):
            spark.read.format("xlsx").options(**options).load(path).collect()


def test_stream_goes_on_after_a_stop(spark, folder, tmp_path):
    workbooks.register(spark)

    def run():
        source = spark.readStream.format("xlsx").option("settled", "0").load(str(folder))
        query = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return base(spark.read.schema(xlsx.CELLS).parquet(str(tmp_path / "out"))).groupBy("document_id").count().collect()

    once = {"good.xlsx": 8, "also.XLSX": 8}
    assert dict(map(tuple, run())) == once
    assert dict(map(tuple, run())) == once  # nothing new
    (folder / "later.xlsx").write_bytes(workbook())
    newest = max(os.stat(p).st_mtime for p in folder.rglob("*") if p.name != "later.xlsx")
    os.utime(folder / "later.xlsx", (newest + 0.5, newest + 0.5))
    assert dict(map(tuple, run())) == {**once, "later.xlsx": 8}
