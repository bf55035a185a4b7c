import time

import pytest
from pyspark.sql import functions as F

from docflow.sources import folders, sinks
from docflow.streaming import pages


def test_folder_import(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("One.\n\nTwo.")
    (tmp_path / "sub/b.md").write_text("# T\ntext")
    (tmp_path / "c.pdf").write_bytes(b"%PDF /Type /Page /Type/Pages")
    (tmp_path / ".hidden/d.txt").write_text("x")
    (tmp_path / "e.txt").write_text(" \n ")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe\xff")
    files = folders.list_folder(spark, str(tmp_path))
    got = {r.relative_path: r for r in folders.decoded(files).collect()}
    assert set(got) == {"a.txt", "sub/b.md", "e.txt", "f.txt"}
    assert got["e.txt"].error == "blank" and got["f.txt"].error == "not UTF-8"
    blocks, segments = folders.import_documents(folders.decoded(files))
    assert blocks.count() == 4 and segments.count() == 4
    assert folders.project_format(files) == "markdown"
    pdf = folders.pdf_check(spark.read.format("binaryFile").load(str(tmp_path / "c.pdf"))).collect()[0]
    assert pdf.page_count == 1 and pdf.error is None
    with pytest.raises(ValueError):
        folders.list_folder(spark, str(tmp_path), max_files=2)


def test_publish_and_delete(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert sinks.publish(df, str(tmp_path / "t"), F.col("v").isNotNull()) == (1, 1)
    assert sinks.without_deleted(df, spark.createDataFrame([(1,)], "id int"), "id").count() == 1
    sinks.rewrite_partition(spark, str(tmp_path / "t"), "id > 5")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 0


def test_strict_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\n{"a":\n')
    with pytest.raises(Exception):
        folders.read_json(spark, str(p), "a int", lines=True).collect()
    assert folders.read_json(spark, str(p), "a int", lines=True, tolerant=True).where("a = 1").count() == 1


def test_event_demux(spark):
    got = pages.demux(spark.createDataFrame([('{"event":"page","job_id":"j","page_number":2}',), ("noise",)], "value string")).collect()
    assert [r.kind for r in got] == ["page", "other"]


def test_micro_batches_close_by_size(spark, tmp_path):
    src = spark.createDataFrame([("k", f"i{n}", n) for n in range(7)], "key string, item string, ts_ms long")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = pages.micro_batches(stream, "key", 3, 600_000).writeStream.format("memory").queryName("mb").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):  # a pending timeout keeps the stream busy, so wait for the rows and not for idleness
        if spark.sql("select * from mb").count() >= 2:
            break
        time.sleep(1)
    q.stop()
    rows = spark.sql("select items, reason from mb").collect()
    assert sorted(r["items"] for r in rows) == [["i0", "i1", "i2"], ["i3", "i4", "i5"]] and {r.reason for r in rows} == {"size"}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_windowed_timeline(spark, tmp_path, kind):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(f"cast(ts as {kind}) ts", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = pages.windowed_timeline(stream).writeStream.format("memory").queryName(f"tl_{kind}").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql(f"select sum(n) from tl_{kind}").collect()[0][0] == e.count()


def test_append_log_holds_all_events(spark):
    from docflow import queries_io

    got = queries_io.snk_07_08_src_08_append_log(spark, "/root/testdata/sf0.01").collect()
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert {(r.run_id, r.n) for r in got} == {(r.user_id, r["count"]) for r in e.groupBy("user_id").count().collect()}
    assert sum(r.n for r in got) == e.count() > e.where("user_id < 50").count()


def test_import_folder_holds_large_documents(spark, tmp_path):
    from docflow import queries_io

    docs = spark.createDataFrame([(1, "a\nb"), (51, "c\n" + "x" * (folders.MAX_TEXT_BYTES + 1)), (2, " ")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_io.src_02_03_04_import_folder(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("d=1/", 4)]


def test_rejected_files_are_listed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.")
    (tmp_path / "b.txt").write_text("Two is longer.")
    (tmp_path / "e.txt").write_text(" ")
    files = folders.decoded(folders.list_folder(spark, str(tmp_path)), max_bytes=8)
    assert sorted((r.relative_path, r.error) for r in folders.rejected(files).collect()) == [("b.txt", "too large"), ("e.txt", "blank")]
    with pytest.raises(Exception, match="b.txt: too large"):
        folders.import_documents(folders.all_accepted(files))[0].collect()


def test_remove_artifacts(spark, tmp_path):
    for name in ("pdf-pages/zh/a.pdf", ".tmp/x", "pdf_run.1.json", "pdf_run.1.txt", "exports/translated.pdf", "exports/mine.pdf", "source.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "pdf_pages.a.json").mkdir()
    assert sinks.remove_artifacts(spark, str(tmp_path)) == [".tmp", "exports/translated.pdf", "pdf-pages", "pdf_run.1.json"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["exports", "pdf_pages.a.json", "pdf_run.1.txt", "source.pdf"]


def test_rewrite_leaves_nothing_behind(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    sinks.rewrite_partition(spark, str(tmp_path / "t"), "id < 4")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_failed_profile_does_not_raise(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    df = spark.createDataFrame([("j", "r", 1)], "job_id string, run_id string, n int")
    assert sinks.write_profiles(df, str(tmp_path / "p")) and not sinks.write_profiles(df, str(tmp_path / "file"))


def test_new_ids_of_a_stream(spark, tmp_path):
    schema = "run_id string, poll int, state string, completed array<string>, failed array<string>"
    src = spark.createDataFrame([("r", 0, "running", ["a"], []), ("r", 1, "running", ["a", "b"], ["c"]), ("r", 2, "completed", ["a", "b"], ["c"]), ("r", 3, "completed", ["z"], None)], schema)
    assert sorted((r.poll, r.kind, r.id) for r in pages.new_ids(src).collect()) == [(0, "completed", "a"), (1, "completed", "b"), (1, "failed", "c")]
    src.write.parquet(str(tmp_path / "in"))
    q = pages.new_id_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select kind, id from ids").count() == 4


def test_starter_jobs_leave_existing_ones(spark):
    from docflow.operators import saves

    rows = spark.createDataFrame([("a", "a.md", "markdown", "zh-CN", "en"), ("b", "b.md", "markdown", "zh-CN", "en")], "job_id string, filename string, format string, source_lang string, target_lang string")
    got = saves.starter_jobs(rows, F.lit("1"), rows.where("job_id = 'a'")).collect()
    assert [(r.job_id, r.status, r.segment_count) for r in got] == [("b", "ready", 0)]


def test_markdown_of_many_lines(spark):
    from docflow.operators import generators as G

    text = "\n".join(["# h", "one", "two", "```", "# code", "```", ""] * 3000 + ["~~~", "open"])
    got = spark.createDataFrame([(text,)], "text string").select(G.markdown_blocks(F.col("text")).alias("b")).first().b
    assert [b.block_type for b in got[:4]] == ["heading", "paragraph", "code", "metadata"] and len(got) == 12001
    assert got[1].text == "one\ntwo" and got[2].text == "```\n# code\n```" and got[-1].text == "~~~\nopen"
