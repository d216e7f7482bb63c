"""Operators on the small cases that define them."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import keys, markup, paths
from lectern.operators import cache, contents, engine, gates, placement, telemetry, timeline
from lectern.operators.ordered import prefix_sums
from lectern.sources import feeds


def test_toc_policy(spark):
    chapters = spark.createDataFrame([("b", 1, "One", "t/c1.xhtml"), ("b", 2, "Two", "t/c2.xhtml"), ("n", 1, "Solo", "s.xhtml")], "book_id string, chapter_index long, title string, source_href string")
    toc = spark.createDataFrame([("b", 0, "First", "t/./c1.xhtml#a"), ("n", 0, "Lost", "nothing.xhtml")], "book_id string, pos long, title string, href string")
    m = contents.map_toc(toc, chapters)
    assert {(r.book_id, r.chapter_index) for r in m.collect()} == {("b", 1), ("n", None)}
    assert {(r.book_id, r.chapter_index) for r in contents.default_selection(chapters, m).collect()} == {("b", 1), ("n", 1)}
    got = {(r.book_id, r.chapter_index, r.source, r.default_selected) for r in contents.full_contents(chapters, m).collect()}
    assert got == {("b", 1, "toc", True), ("b", 2, "spine", False), ("n", 1, "spine_no_toc", True)}


def test_selector(spark):
    cases = {"1,3-5,9": [1, 3, 4, 5, 9], " 2 , 2-3": [2, 3], "5-3": None, "": None, "0": None, "a": None, "1-2000000000": None, "5,7-100007": None, "3,,1": [1, 3]}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", contents.selector_expand(F.col("x")).alias("y"))
    assert {r.x: r.y for r in rows.collect()} == cases


def test_rollup(spark):
    nodes = [("b", [0], None, False), ("b", [0, 0], 1, True), ("b", [0, 1], 2, False), ("b", [1], 1, False), ("b", [2, 0, 0, 0, 0, 0], 3, True), ("b", [2, 0, 0], 9, False), ("c", [0], None, False)]
    got = contents.selection_rollup(spark.createDataFrame(nodes, "book_id string, path array<int>, chapter_index long, selected boolean"))
    deep = {("b", (2,) + (0,) * n): "all" for n in range(6)}
    assert {(r.book_id, tuple(r.path)): r.state for r in got.collect()} == {("b", (0,)): "some", ("b", (0, 0)): "all", ("b", (0, 1)): "none", ("b", (1,)): "all", ("c", (0,)): "none", **deep}


def test_contents_links_are_a_tree_that_rolls_up(spark):
    link = lambda n: f"<a href='c{n}.html'>{n}</a>"
    deep = "".join(f"<ol><li>{link(n)}" for n in range(3, 7)) + "</li></ol>" * 4
    page = f"<nav><ol><li>{link(1)}<ol><li>{link(2)}{deep}</li><li>{link(7)}</li></ol></li><li>{link(8)}</li></ol><ul><li>{link(9)}</li></ul></nav>"
    links = spark.createDataFrame([(page,)], "x string").select(F.posexplode(markup.nav_links(F.col("x"))).alias("pos", "l")).select("pos", "l.*")
    nodes = {r.title: (r.depth, r.node) for r in links.collect()}
    assert nodes == {"1": (1, [0]), "2": (2, [0, 0]), **{str(n): (n, [0] * n) for n in range(3, 7)}, "7": (2, [0, 1]), "8": (1, [1]), "9": (1, [2])}
    on = links.select(F.lit("b").alias("book_id"), F.col("node").alias("path"), F.col("title").cast("long").alias("chapter_index"), (F.col("title") == "7").alias("selected"))
    state = {tuple(r.path): r.state for r in contents.selection_rollup(on).collect()}
    assert state[(0,)] == "some" and state[(0, 0)] == "none" and state[(0, 1)] == "all" and state[(1,)] == state[(2,)] == "none" and len(state) == 9


def test_chunk_key_ignores_scheduling(spark):
    rows = spark.createDataFrame([({"speed": "1.0", "mode": 'o"x', "worker_count": n},) for n in ("1", "2")], "o map<string,string>")
    payload = json.dumps({"mode": 'o"x', "speed": "1.0"}, sort_keys=True, ensure_ascii=False)
    want = hashlib.sha256(f"xtts\0{payload}\0söz".encode()).hexdigest()[:24]
    assert [r.k for r in rows.select(keys.chunk_key(F.lit("xtts"), F.col("o"), F.lit("söz")).alias("k")).collect()] == [want] * 2
    seed = int.from_bytes(hashlib.sha256(b"t\0x").digest()[:4], "little") & 0x7FFFFFFF
    assert spark.range(1).select(keys.stable_seed(F.lit("t"), F.lit("x")).alias("s")).first().s == seed


def test_paths(spark):
    cases = {("a/b.opf", "../c%20d.html#x"): "c d.html#x", ("a/b", "c+d"): "a/c+d", ("a/b", ""): "a/b", ("b", "../../x"): "../../x", ("a/b", "/./r//s"): "/r/s", ("a/b", "."): "a"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "base string, href string, want string").withColumn("got", paths.resolve_href(F.col("base"), F.col("href")))
    assert all(r.got == r.want for r in rows.collect())


def test_tracker(spark):
    events = [("r", i, f"2031-05-06 07:08:{3 * i:02d}", False, 7_500, 40 + i, 2_500) for i in range(1, 11)]
    frame = spark.createDataFrame(events, "run_id string, task_id long, ts string, cached boolean, audio_ms long, chars long, wall_ms long").withColumn("ts", F.to_timestamp("ts"))
    got = {r.task_id: r for r in telemetry.running_throughput(frame).collect()}
    assert got[5].eta_seconds is None and got[5].eta_warmup
    assert got[10].eta_seconds == 0 and got[10].realtime_factor == 2.5 and got[10].worker_factor == 3.0 and not got[10].eta_warmup


def test_best_workers(spark):
    cases = {"a": {1: 1.7, 2: 3.999, 3: 4.0, 4: 7.5}, "b": {1: 0.4, 2: 1.93, 3: 1.95, 4: 2.0}, "c": {2: -0.3, 4: 0.0}, "d": {1: 1.95, 2: 2.0}}
    rows = spark.createDataFrame([(c, w, f) for c, v in cases.items() for w, f in v.items()], "config string, workers int, factor double")
    assert {r.config: (r.workers, r.target_reached) for r in telemetry.best_workers(rows).collect()} == {"a": (3, True), "b": (3, False), "c": (1, False), "d": (1, False)}
    assert {(r.config, r.workers) for r in telemetry.take_while_below(rows).filter("config = 'a'").collect()} == {("a", 1), ("a", 2), ("a", 3)}


def test_gpu_line(spark):
    rows = spark.createDataFrame([("Model 7 Y ,3 , 80.5,  1541, 8192",), ("Model 7 Y, 3, 80",)], "line string")
    assert [tuple(r) for r in feeds.parse_gpu(rows, "line").collect()] == [("Model 7 Y", 3, 80, 1.5, 8.0)]
    with pytest.raises(Exception, match="short of a field"):
        feeds.parse_gpu(rows, "line", strict=True).collect()


def test_what_is_missing_or_mismatched_is_an_error(spark):
    parts = spark.createDataFrame([("t", 100, 8000), ("t", 60, 8000), ("u", 5, 8000)], "task_id string, frames long, sample_rate int")
    assert {tuple(r) for r in timeline.merge_parts(parts).collect()} == {("t", 160, 8000, 0.02), ("u", 5, 8000, 0.000625)}
    with pytest.raises(Exception, match="different sample rates: u"):
        timeline.merge_parts(parts.unionByName(parts.limit(0).union(spark.createDataFrame([("u", 5, 9000)], parts.schema)))).collect()
    jobs, results = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, n int"), spark.createDataFrame([("a",), ("a",), ("x",)], "task_id string")
    assert gates.known_only(results.filter("task_id = 'a'"), jobs).count() == 2
    with pytest.raises(Exception, match="unknown task: x"):
        gates.known_only(results, jobs).collect()
    books = spark.createDataFrame([("b1",), ("b2",)], "book_id string")
    chapters = spark.createDataFrame([("b1", 1), ("b1", 2)], "book_id string, chapter_index int")
    assert gates.require_each(books.limit(1), chapters, "book_id", "no readable chapter").count() == 1
    with pytest.raises(Exception, match="no readable chapter: b2"):
        gates.require_each(books, chapters, "book_id", "no readable chapter").collect()


def test_names_and_fallbacks(spark):
    parts = [spark.createDataFrame(list(enumerate(x)), "pos long, name string") for x in (["A", "Z "], ["A", " ", "M"], ["M", "D"])]
    got = gates.name_union(parts).orderBy("first").collect()
    assert [r.name for r in got] == ["A", "Z", "M", "D"]


def test_entities(spark):
    cases = {"a&amp;lt;b": "a&lt;b", "&eacute;&Ccedil;": "éÇ", "&#231;&#x1F600;&#X41;": "ç😀A", "&#0;&#xD800;&nosuch;& &": "&#0;&#xD800;&nosuch;& &", "x &lt;&gt;&quot;&apos;&#39;": "x <>\"''", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string").select("x", markup.decode_entities(F.col("x")).alias("y"))
    assert {r.x: r.y for r in rows.collect()} == {**cases, None: None}


def test_no_duration_is_an_error(spark):
    jobs = spark.createDataFrame([("b", 1, 1, 5), ("b", 2, 1, None)], "book_id string, sequence long, chapter_index long, duration_ms long")
    for made in (timeline.elapsed, timeline.chapter_timeline, lambda j: timeline.timeline_total(j, F.lit("p"))):
        with pytest.raises(Exception, match="no duration"):
            made(jobs).collect()


def test_timeline_and_metadata(spark):
    jobs = spark.createDataFrame([("b", 1, 1, 777), ("b", 2, 2, 0), ("b", 3, 3, 5_000), ("b", 4, 3, 1)], "book_id string, sequence long, chapter_index long, duration_ms long")
    t = timeline.chapter_timeline(jobs)
    assert sorted((r.start_ms, r.end_ms) for r in t.collect()) == [(0, 777), (777, 778), (777, 5778)]
    doc = timeline.chapter_metadata_doc(t.withColumn("title", F.lit("x#y")), F.lit("A=B"), F.lit("C")).first().doc
    assert doc.startswith(";FFMETADATA1\ntitle=A\\=B\nartist=C\nalbum=A\\=B\nmedia_type=2\n[CHAPTER]\n") and doc.count("[CHAPTER]") == 3 and "title=x\\#y\n" in doc


def test_resume(spark):
    jobs = spark.createDataFrame([("b", f"t{i}") for i in range(4)], "book_id string, task_id string")
    files = spark.createDataFrame([("b", "t0", 2000, 0.1), ("b", "t1", 1024, 9.0), ("b", "t2", 5000, 0.05)], "book_id string, task_id string, size long, seconds double")
    assert sorted(r.task_id for r in cache.pending(jobs, files).collect()) == ["t1", "t2", "t3"]
    known, lost = cache.match_results(spark.createDataFrame([("t1",), ("x",)], "task_id string"), jobs)
    assert (known.count(), [r.task_id for r in lost.collect()]) == (1, ["x"])


def test_placement(spark):
    jobs = spark.createDataFrame([("r", i, float(c)) for i, c in enumerate([3, 10, 6, 6, 1])], "run string, task long, cost double")
    order = placement.longest_first(jobs, "run", "cost", "task").orderBy("rank").collect()
    assert [r.task for r in order] == [1, 2, 3, 0, 4]
    got = {r.task: r.slot for r in placement.greedy_slots(jobs, "run", "cost", "task", 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 0: 0, 4: 1}


def test_ranks_of_one_large_run_are_counted_in_many_parts(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("IF(id < 2500, 'big', concat('r', id % 9)) AS run", "id AS task", "CASE WHEN id % 3 = 0 THEN 7.0 WHEN id = 5 THEN NULL ELSE double(id * 37 % 101) END AS cost")
    plain = sorted(((r.run, r.task, r.cost) for r in rows.collect()), key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1]))
    want, last = {}, None
    for run, task, _ in plain:
        n, last = (n + 1 if run == last else 1), run
        want[task] = n
    monkeypatch.setattr("lectern.operators.ordered.BUCKET", 100)
    got = placement.longest_first(rows, "run", "cost", "task")
    assert got.columns == ["run", "task", "cost", "rank"] and {r.task: r["rank"] for r in got.collect()} == want
    parts = rows.filter("run = 'big'").select(placement._cost_bucket(rows, "cost", "task").alias("b")).groupBy("b").count()
    assert parts.count() > 40 and parts.agg(F.max("count")).first()[0] < 1000


def test_prefix_sums_do_not_depend_on_buckets(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, i * 7 % 5) for i in range(200)], "k string, pos long, v long")
    results = []
    for width in (1, 7, 1000):
        for parts in (1, 5):
            got = prefix_sums(rows.repartition(parts), ["k"], F.floor(F.col("pos") / width), ["pos"], {"s": F.col("v")})
            results.append(sorted((r.k, r.pos, r.s) for r in got.collect()))
    assert all(r == results[0] for r in results)


class SteadyEngine:
    """A stand-in without a model: each character takes 60 ms, and the seed adds up to 200 ms."""

    def load(self):
        self.rate = 24000

    def synthesize(self, texts, seeds):
        return pd.DataFrame({"frames": (texts.str.len() * 60 + seeds % 200) * (self.rate // 1000), "sample_rate": self.rate})


@pytest.mark.parametrize("made", [SteadyEngine(), engine.ColumnEngine(lambda text, seed: (F.length(text) * 60 + seed % 200) * 24, 24_000)])
def test_guarded_engine(spark, made):
    jobs = spark.createDataFrame([("t", "x" * 150, 0), ("u", "short", 5)], "task_id string, text string, seed long")
    got = {r.task_id: (r.frames, r.seconds) for r in engine.guarded_apply(jobs, made, 100).collect()}
    assert got == {"t": (150 * 60 * 24, 9.0), "u": ((5 * 60 + 5) * 24, 0.305)}


def test_markup(spark):
    page = "<html><title>T</title><nav>x</nav><h1> </h1><h2>He&amp;ad <b>line</b></h2><p>a<br>b<p>c <ul><li>d<p>e</p>lost</li></ul><script>1</script></html>"
    r = spark.createDataFrame([(page, "no blocks <i>here</i>")], "x string, y string").select(markup.html_blocks(F.col("x")).alias("b"), markup.heading(F.col("x")).alias("h"), markup.html_blocks(F.col("y")).alias("w")).first()
    assert (r.b, r.h, r.w) == (["He&ad line", "a b", "c", "d", "e"], "He&ad line", ["no blocks here"])


def test_markup_as_a_parser_reads_it(spark):
    cases = {
        '<p title="a>b" class=\'x>y\'>one</p><p data=5>2 < 3 &amp; 4</p>': ["one", "2 < 3 & 4"],
        "<p>kept</p><script>var t = '<p>no</p>'": ["kept"],
        "<p>kept</p><SCRIPT type='a>b'>no</SCRIPT ><p>too</p>": ["kept", "too"],
        "<nav>a<nav>b</nav>c<p>no</p></nav><p>kept</p>": ["kept"],
        "<div><nav><ul><li>no</div><p>kept</p>": ["kept"],
        "<nav><p>no</p>": [],
        "<svg/><p>kept</p></nav></p><p>too": ["kept", "too"],
        "<!-- <p>no</p> --><p>kept<!-- > --> on</p><!-- <p>no": ["kept on"],
        "a <b>lone</b> text <br/> here": ["a lone text here"],
        "<p>" + "<b>x</b> " * 1500 + "</p><noscript><p>no</p></noscript>": [" ".join("x" * 1500)],
        "": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string").select("x", markup.html_blocks(F.col("x")).alias("b"))
    assert {r.x: r.b or [] for r in rows.collect()} == {**cases, None: []}
    page = "<h1 id='a>b'></h1><h2 title='>'>Name</h2><nav><h1>no</h1></nav>"
    assert spark.createDataFrame([(page,)], "x string").select(markup.heading(F.col("x"))).first()[0] == "Name"


def test_eligibility_names_the_first_broken_rule(spark):
    columns = "request_id long, engine_id string, voice_mode string, output string, has_reference boolean, consent boolean, licence_ok boolean, n_chapters int, n_chunks int, max_chars int"
    rows = [(1, "xtts", "clone", "o.m4b", True, False, False, 1, 1, 0), (2, "mms", "builtin", "o.M4B", False, False, True, 1, 1, 0), (3, "xtts", "builtin", "o.mp3", True, True, True, 1, 1, 0), (4, "who", "builtin", "o.m4b", True, True, True, 1, 1, 0)]
    got = {r.request_id: r.reject_reason for r in gates.eligible(spark.createDataFrame(rows, columns)).collect()}
    assert got == {1: "no consent", 2: None, 3: "output suffix", 4: "unknown engine"}


def test_factors_go_by_elapsed_time_without_the_first_tasks_of_each_worker(spark):
    # two workers side by side, started a day apart: warm-up is 0 and 1 of each, whatever the day
    tasks = [(c, 2, w, i, None if i == 0 else i * 86_400_000 + w, i * 86_400_000 + 1000, 500) for c in ("a", None) for w in (0, 1) for i in range(4)]
    rows = spark.createDataFrame(tasks, "config string, workers long, worker long, task_id long, started_ms long, ended_ms long, audio_ms long")
    want = round(4 * 500 / (86_400_000 + 1000), 6)
    assert {(r.config, r.workers, r.factor) for r in telemetry.config_factor(rows).collect()} == {("a", 2, want), (None, 2, want)}
    assert telemetry.config_factor(rows, 9).collect() == []


def test_search_for_workers_ends_when_memory_does(spark):
    rows = spark.createDataFrame([(c, w, 1.0, 24.0 if c != "u" else 0.0, 6.0 * w) for c in ("m", "u") for w in (1, 2, 3, 4)], "config string, workers int, factor double, total double, used double")
    got = telemetry.take_while_below(rows, memory=(F.col("total"), F.col("used"))).collect()
    assert sorted((r.config, r.workers) for r in got) == [("m", 1), ("m", 2), ("m", 3), ("m", 4), ("u", 1), ("u", 2), ("u", 3), ("u", 4)]
    got = telemetry.take_while_below(rows.withColumn("used", F.col("used") + 4), memory=(F.col("total"), F.col("used"))).collect()
    assert sorted(r.workers for r in got if r.config == "m") == [1, 2, 3]


def test_throttle_equals_a_walk_over_all_samples(spark, monkeypatch):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(3)
    monkeypatch.setattr(telemetry, "SAMPLES_AT_ONCE", 200)
    rows, at = [], 0.0
    for i in range(4000):  # dense, sparse and empty stretches, ties
        at += rnd.choice([0, 0.1, 0.3, 0.9, 1.0, 7, 150]) if i % 1000 > 500 else rnd.choice([0, 0.05, 0.2])
        rows.append((rnd.choice([1, 1, 1, 2, None]), i, datetime(2024, 1, 1) + timedelta(seconds=at)))
    want = set()
    for device in (1, 2, None):
        last = None
        for d, i, t in rows:
            if d == device and (last is None or t - last >= timedelta(seconds=1)):
                want.add((d, i))
                last = t
    frame = spark.createDataFrame(rows, "device long, event_id long, ts timestamp_ntz").repartition(5)
    got = [(r.device, r.event_id) for r in telemetry.throttle(frame, 1.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_throttle_and_change_log_go_on_over_clock_boundaries(spark):
    rows = [(1, i, f"2024-01-01 {t}:00", k) for i, (t, k) in enumerate([("22:50", "x"), ("23:01", "x"), ("23:05", None), ("23:58", None)])]
    rows += [(1, 4, "2024-01-02 00:01:00", None), (1, 5, "2024-01-02 00:13:00", "x"), (1, 6, "2024-01-04 00:00:00", "x"), (None, 7, "2024-01-01 23:59:00", "y"), (None, 8, "2024-01-02 00:01:00", "y")]
    events = spark.createDataFrame(rows, "run_id long, task_id long, t string, kind string").withColumn("ts", F.to_timestamp_ntz("t"))
    samples = events.select(F.col("run_id").alias("device"), F.col("task_id").alias("event_id"), "ts")
    assert sorted(r.event_id for r in telemetry.throttle(samples, 900).collect()) == [0, 2, 3, 5, 6, 7]
    assert sorted(r.task_id for r in telemetry.change_log(events).collect()) == [0, 2, 5, 7]


def test_a_task_matches_no_more_results_where_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(cache, "MATCH_ROWS", 100)
    results = spark.range(2000).select((F.col("id") % 700).alias("task_id"), "id").unionByName(spark.createDataFrame([(None, -1)], "task_id long, id long"))
    jobs = spark.range(0, 1000, 2).select(F.col("id").alias("task_id"), (F.col("id") * 10).alias("run_id"))
    rows = cache.matched(results, jobs)
    assert rows.columns == ["task_id", "id", "run_id", "known"]
    assert sorted((r.id, r.run_id, r.known) for r in rows.collect()) == sorted([(-1, None, False), *((i, i % 700 * 10 if i % 700 % 2 == 0 else None, i % 700 % 2 == 0) for i in range(2000))])
    assert [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect() if r.n > 300] == []
    assert "repartition_by_num" in rows._jdf.queryExecution().toString().lower()
    known, lost = cache.match_results(results, jobs)
    assert known.columns == ["task_id", "id", "run_id"] and lost.columns == ["task_id", "id"] and known.count() + lost.count() == 2001
