"""Artifacts kept between runs: found by a later run, pruned by run, listed without being read."""

import re
import struct

from pyspark.sql import functions as F

from lectern.operators import cache
from lectern.sources import store

KEPT = [("b1", "t1", 2000, 1.0), ("b1", "t2", 900, 1.0), ("b2", "t1", 2000, 0.01), ("b2", "t3", 5000, 2.5), ("b3", "t1", 3000, 3.0)]


def save(spark, path, rows=KEPT):
    store.save(spark.createDataFrame(rows, "book_id string, task_id string, size long, seconds double"), path)


def jobs(spark, books):
    return spark.createDataFrame([(b, t, f"text {b}") for b in books for t in ("t1", "t2", "t3")], "book_id string, task_id string, text string")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_second_run_finds_what_the_first_kept(spark, tmp_path):
    path = str(tmp_path / "kept")
    save(spark, path)
    save(spark, path, [("b1", "t3", 4000, 4.0)])  # the book saved again replaces what it kept
    found = cache.probe(jobs(spark, ["b1", "b2", "b3"]), store.stored(spark, path))
    assert {(r.book_id, r.task_id): r.seconds for r in found.filter("cached").collect()} == {("b1", "t3"): 4.0, ("b2", "t3"): 2.5, ("b3", "t1"): 3.0}
    left = cache.pending(jobs(spark, ["b2"]), store.stored(spark, path))
    assert sorted(r.task_id for r in left.collect()) == ["t1", "t2"]


def test_one_books_jobs_read_one_books_artifacts(spark, tmp_path):
    path, listed = str(tmp_path / "kept"), str(tmp_path / "jobs")
    save(spark, path)
    jobs(spark, ["b1", "b2", "b3"]).write.parquet(listed)
    mine = spark.read.parquet(listed).filter("text = 'text b2'")
    found = mine.join(cache.valid_artifacts(store.stored(spark, path)), ["book_id", "task_id"])
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan(found))
    assert [(r.book_id, r.task_id) for r in found.collect()] == [("b2", "t3")]
    assert cache.removable(store.stored(spark, path), spark.createDataFrame([("b1", True), ("b3", False)], "book_id string, keep boolean")).count() == 1


def test_audio_files_are_listed_without_being_read(spark, tmp_path):
    path = str(tmp_path / "audio")
    rows = [("b 1/ü", 1, 12_345), ("b 1/ü", 2, 30), ("x=y", 1, 20_000)]
    store.save_audio(spark.createDataFrame(rows, "book_id string, chapter_index long, duration_ms long"), path, 100)
    files = sorted((tmp_path / "audio").rglob("part-*"))
    assert len(files) == 3
    for f in files:
        data = f.read_bytes()
        n = struct.unpack("<I", data[40:44])[0]
        assert data[:4] == b"RIFF" and data[8:16] == b"WAVEfmt " and struct.unpack("<I", data[4:8])[0] == n + 36 and len(data) == 44 + n + 1
    found = store.listing(spark, path)
    assert {(r.book_id, r.chapter_index, r.length) for r in found.collect()} == {("b 1/ü", 1, 1279), ("b 1/ü", 2, 48), ("x=y", 1, 2045)}
    scan = re.search(r"ReadSchema: struct<([^>]*)>", found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert "content" not in scan[1]
    one = found.filter("chapter_index = 2").select("length")
    assert re.search(r"PartitionFilters: \[[^\]]*chapter_index", plan(one)) and one.collect()[0].length == 48
    assert {(r.book_id, r.seconds) for r in store.measured(spark, path).collect()} == {("b 1/ü", 12.34), ("x=y", 20.0)}


def test_a_file_that_is_no_audio_has_no_seconds(spark, tmp_path):
    text = spark.createDataFrame([("b", 1, "x" * 3000)], "book_id string, chapter_index long, value string")
    text.write.partitionBy("book_id", "chapter_index").text(str(tmp_path / "odd"))
    assert [r.seconds for r in store.measured(spark, str(tmp_path / "odd")).collect()] == [None]
    assert store.measured(spark, str(tmp_path / "odd")).filter(F.col("seconds") > 0).count() == 0


def test_files_of_few_bytes_of_rows_are_written_and_listed_by_all_cores(spark, tmp_path):
    path, sc = str(tmp_path / "audio"), spark.sparkContext
    chapters = spark.range(400).groupBy((F.col("id") % 2).alias("book_id"), F.floor(F.col("id") / 2).alias("chapter_index")).agg(F.lit(30).cast("long").alias("duration_ms"))
    store.save_audio(chapters, path, 100)
    made = list((tmp_path / "audio").rglob("part-*"))
    assert len(made) == 400 and len({f.name.split("-")[1] for f in made}) >= sc.defaultParallelism
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    sc.setJobGroup("listing", "listing")
    try:
        found = store.files(spark, path)
        jobs_run = sc.statusTracker().getJobIdsForGroup("listing")
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs_run for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= store.TASKS_PER_CORE * sc.defaultParallelism < 200  # folders of a book
    assert spark.conf.get(setting) == before and store.listing(spark, path, found).count() == 400
    store.save_audio(chapters.filter("book_id = 1").withColumn("duration_ms", F.lit(50).cast("long")), path, 100)
    assert sorted({(r.book_id, r.length) for r in store.listing(spark, path).collect()}) == [("0", 48), ("1", 50)]


def test_files_of_a_local_folder_are_what_sparks_writer_makes(spark, tmp_path):
    rows = [("b 1/ü", 1, 12_345), ("b 1/ü", 2, 30), ("x=y+{z}%", 1, 20_000), ("007", 4, 20_000), (None, 1, 900), ("b 1/ü", 3, 40), ("b 1/ü", 3, 40)]
    made = {}
    for how, path in (("spark", str(tmp_path / "spark")), ("tasks", f"file://{tmp_path}/a b/tasks")):
        store.save_audio(spark.createDataFrame(rows, "book_id string, chapter_index long, duration_ms long"), path, 100)
        root = tmp_path / ("spark" if how == "spark" else "a b/tasks")
        made[how] = sorted((str(f.parent.relative_to(root)), f.read_bytes()) for f in root.rglob("part-*"))
        listed, heads = store.inventory(spark, path)
        assert sorted((r.book_id or "", r.chapter_index, r.length) for r in listed.collect()) == sorted((b or "", c, 45 + ms // 10) for b, c, ms in rows)
        assert {(r.book_id, r.chapter_index, r.seconds) for r in heads.collect()} == {("b 1/ü", 1, 12.34), ("x=y+{z}%", 1, 20.0), ("007", 4, 20.0)}
    assert made["spark"] == made["tasks"] and len(made["tasks"]) == len(rows)
    again = spark.createDataFrame([("b 1/ü", 3, 50)], "book_id string, chapter_index long, duration_ms long")
    store.save_audio(again, f"file://{tmp_path}/a b/tasks", 100)  # takes the place of two files
    assert sorted(r.length for r in store.inventory(spark, f"file://{tmp_path}/a b/tasks")[0].filter("book_id = 'b 1/ü'").collect()) == [48, 50, 1279]


def test_many_files_start_no_process_each_and_few_tasks_read_them(spark, tmp_path):
    path, sc = f"file://{tmp_path}/audio", spark.sparkContext
    chapters = spark.range(400).select((F.col("id") % 2).alias("book_id"), F.floor(F.col("id") / 2).alias("chapter_index"), F.lit(30).cast("long").alias("duration_ms"))
    store.save_audio(chapters, path, 100)
    made = list((tmp_path / "audio").rglob("*"))
    assert not [f for f in made if f.name.endswith(".crc")]  # what Hadoop's local files have beside them, each with a process of its own
    assert len([f for f in made if f.is_file()]) == 400 and len({f.name.split("-")[1] for f in made if f.is_file()}) >= sc.defaultParallelism
    sc.setJobGroup("inventory", "inventory")
    try:
        listed, _ = store.inventory(spark, path)
        jobs_run = sc.statusTracker().getJobIdsForGroup("inventory")
        tasks = [sc.statusTracker().getStageInfo(i).numTasks for j in jobs_run for i in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) <= store.TASKS_PER_CORE * sc.defaultParallelism and listed.count() == 400
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304b", "4MB", "4194304")


def test_no_row_gives_no_file(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    store.save_audio(spark.createDataFrame([], "book_id string, chapter_index long, duration_ms long"), path, 100)
    listed, heads = store.inventory(spark, path)
    assert listed.collect() == heads.collect() == []
