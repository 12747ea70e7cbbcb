"""Archives, the run store and the inbox index: whole attempts, names from directories."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofgrain.plans.scratch import docx_table_bytes, pack, scratch, zip_bytes
from proofgrain.sources import containers, files, published, sink
from proofgrain.streaming import index


def test_archive_names_come_from_directories(spark):
    whole = zip_bytes({"a.txt": b"one" * 1000, "x/a.txt": b"deep", "b.md": b"b"})
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("a.txt", b"first")
        archive.writestr("c.txt", b"damaged")
        archive.writestr("n.zip", zip_bytes({"m.txt": b"nested"}))
        archive.writestr("bad.zip", b"no zip")
    damaged = held.getvalue().replace(b"damaged", b"DAMAGED")
    rows = [("p", "box.zip", "/1", whole), ("p", "box.zip", "/2", damaged), ("p", "box__a.txt", "/3", b"plain"), ("q", "box.zip", "/1", whole),
            ("p", "none.zip", "/4", None), ("p", "bad.zip", "/5", b"no"), (None, "a.txt", None, b"null"), ("p", "empty.txt", "/6", b""), ("p", "gone.txt", "/7", None)]
    df = spark.createDataFrame(rows, "packet string, name string, path string, content binary").withColumn("members", F.lit("clash"))
    got = sorted((r.packet or "", r.name, r.path or "", None if r.content is None else bytes(r.content)) for r in files.expand_archives(df).collect())
    assert got == sorted([
        ("p", "box__a.txt", "/1", b"one" * 1000), ("p", "box__x__a.txt", "/1", b"deep"), ("p", "box__b.md", "/1", b"b"),
        ("p", "box__a_2.txt", "/2", b"first"), ("p", "box__n__m.txt", "/2", b"nested"), ("p", "box__a_3.txt", "/3", b"plain"),
        ("q", "box__a.txt", "/1", b"one" * 1000), ("q", "box__x__a.txt", "/1", b"deep"), ("q", "box__b.md", "/1", b"b"),
        ("", "a.txt", "", b"null"), ("p", "empty.txt", "/6", b""), ("p", "gone.txt", "/7", None)])


def test_large_members_go_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(files, "HELD", 10)
    data = zip_bytes({f"{i}.txt": bytes([65 + i]) * 8 for i in range(5)})
    df = spark.createDataFrame([("p", "z.zip", "/z", data)], "packet string, name string, path string, content binary")
    assert {r.name: bytes(r.content) for r in files.expand_archives(df).collect()} == {f"z__{i}.txt": bytes([65 + i]) * 8 for i in range(5)}


def test_a_failed_attempt_is_never_seen(spark):
    out = scratch(spark, "runs")
    with pytest.raises(LookupError):
        sink.read_run(spark, out, "chunks")
    first = spark.createDataFrame([("007", 1), ("B", 2)], "form_id string, x int")
    sink.write_run({"chunks": first, "documents": first}, out, "7")
    broken = first.select("form_id", F.when(F.col("x") > 1, F.raise_error("stop")).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        sink.write_run({"chunks": first.withColumn("x", F.lit(9)), "documents": broken}, out, "7")

    def rows(name, run=None):
        return sorted((r.run_id, r.form_id, r.x) for r in sink.read_run(spark, out, name, run).collect())

    assert rows("chunks") == rows("documents") == [("7", "007", 1), ("7", "B", 2)]
    sink.write_run({"chunks": first.where("x = 1")}, out, "7")
    sink.write_run({"chunks": first.withColumn("y", F.lit(1))}, out, "run two")
    assert rows("chunks", "7") == [("7", "007", 1)] and rows("chunks", "run two")[1] == ("run two", "B", 2)
    assert [r.y for r in sink.read_run(spark, out, "chunks").orderBy("run_id").collect()] == [None, 1, 1]
    with pytest.raises(LookupError):
        sink.read_run(spark, out, "documents", "7")
    assert sink.sweep_run(spark, out, "7") in (3, 4) and rows("chunks", "7") == [("7", "007", 1)]
    sink.write_run({"chunks": first.limit(0)}, out, "7")
    assert rows("chunks", "7") == []
    with pytest.raises(ValueError):
        sink.write_run({"unknown": first}, out, "7")


def test_index_publishes_whole_batches(spark, tmp_path):
    inbox, table = tmp_path / "in", scratch(spark, "index")
    inbox.mkdir()
    assert index.current_index(spark, table).count() == 0 and index.changes(spark, table).count() == 0
    for name in "abc":
        (inbox / f"{name}.txt").write_text(name)
    index.refresh_index(spark, str(inbox), table, 0)
    (inbox / "a.txt").write_text("changed")
    (inbox / "b.txt").unlink()
    (inbox / "d.txt").write_text("d")
    index.refresh_index(spark, str(inbox), table, 1)
    want = {(0, "a.txt", "new"), (0, "b.txt", "new"), (0, "c.txt", "new"), (1, "a.txt", "changed"), (1, "b.txt", "deleted"), (1, "d.txt", "new")}

    def seen():
        return {(r.batch_id, r.name, r.change) for r in index.changes(spark, table).collect()}

    assert seen() == want and {r.name for r in index.current_index(spark, table).collect()} == {"a.txt", "c.txt", "d.txt"}
    assert {r.name for r in index.current_index(spark, table, 1).collect()} == {"a.txt", "b.txt", "c.txt"}
    # an attempt that was written and not published
    spark.createDataFrame([("z.txt", "h", None, 1)], index.INDEX_SCHEMA).write.parquet(f"{table}/index/attempt=lost")
    index.refresh_index(spark, str(inbox), table, 1)
    assert seen() == want and "z.txt" not in {r.name for r in index.current_index(spark, table).collect()}
    index.refresh_index(spark, str(inbox), table, 2)
    assert seen() == want
    # all but the last batch's index go: of batches 0 and 1 (twice), and the lost one
    assert index.sweep_index(spark, table) == 4 and index.current_index(spark, table).count() == 3
    assert published.keys(spark, table) == [f"{i:019d}" for i in range(3)]


class Read:
    """Stands for a table of files; gives the function that Spark would run in its tasks."""

    def where(self, *_):
        return self

    select = where

    def mapInPandas(self, run, _):  # noqa: N802
        return run


def test_cells_of_many_documents_leave_in_few_frames(monkeypatch):
    files = pd.DataFrame([(f"{i}.docx", docx_table_bytes([[(1, "a"), (1, str(i))]])) for i in range(50)], columns=["name", "content"])
    frames = list(containers.extract_grid(Read())(iter([files])))
    assert len(frames) == 1 and list(frames[0]["text"]) == [t for i in range(50) for t in ("a", str(i))]
    monkeypatch.setattr(containers, "CELLS", 10)
    small = list(containers.extract_grid(Read())(iter([files])))
    assert [len(f) for f in small] == [10] * 10 and pd.concat(small, ignore_index=True).equals(frames[0])


def test_packed_files_and_their_texts_leave_in_small_frames():
    rows = pd.DataFrame({"doc_id": range(700)})
    packed = list(pack(Read(), lambda r: [(f"{r.doc_id}.eml", f"Subject: {r.doc_id}\n\nbody".encode())], "name string, content binary")(iter([rows])))
    assert [len(f) for f in packed] == [200, 200, 200, 100]
    texts = list(containers.extract_container_text(Read())(iter([pd.concat(packed)])))
    assert [len(f) for f in texts] == [200, 200, 200, 100]
    assert list(pd.concat(texts)["source_file"]) == [f"{i}.eml" for i in range(700)]
