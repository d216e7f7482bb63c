"""Book queries: chapters, contents, selection, jobs, timelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import keys
from lectern.operators import cache, contents, timeline
from lectern.operators.ordered import numbered, position_bucket
from lectern.plans import sql
from lectern.plans.tables import ENGINE, artifacts, chapters, jobs, requests, table, toc
from lectern.schemas import MIN_ARTIFACT_SECONDS, UNKNOWN_AUTHOR
from lectern.sources import store
from lectern.sources.sinks import settled, shared_dir

#: Samples a second of the audio that stands in for narration.
AUDIO_RATE = 100


def _chapters(spark, d):
    return chapters(spark, d).drop("doc_id")


def _mapped(spark, d):
    return contents.map_toc(toc(spark, d), chapters(spark, d))


def _contents(spark, d):
    """Chapters without their texts, and the contents mapped onto them, each worked out once."""
    slim = settled(chapters(spark, d).withColumn("chars", F.length("text").cast("long")).drop("text"), "chapters")
    return slim, settled(contents.map_toc(toc(spark, d), slim), "mapped")


def _plain(rows):
    return rows.select("book_id", "chapter_index", "title", "source_href")


def readable_docs(spark, d):
    href, media = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)), F.when(F.col("page_id") % 3 == 0, "application/xhtml+xml").otherwise("text/plain")
    kept = media.contains("html") | href.rlike(r"\.(xhtml|html|htm)$")
    return table(spark, d, "pages").filter(kept).select("page_id", href.alias("href"))


def explicit_selection(spark, d):
    picks = requests(spark, d).select(F.explode(contents.selector_expand(F.col("selector"))).alias("n")).distinct()
    books = table(spark, d, "documents").select(F.col("source").alias("book_id")).distinct()
    wanted = books.select("book_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(9))).alias("n")).join(picks, "n").select("book_id", F.col("n").cast("long").alias("chapter_index"))
    return _plain(contents.explicit_selection(_chapters(spark, d), wanted))


def nonempty_chapters(spark, d):
    return jobs(spark, d).groupBy("book_id", "chapter_index").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chapter_chunks").alias("chapter_chunks"))


def selection_summary(spark, d):
    ch, m = _contents(spark, d)
    chosen = contents.default_selection(ch, m).select("doc_id", F.lit(True).alias("on"))
    rows = ch.select("book_id", "doc_id", "chars").join(chosen, "doc_id", "left")
    on = F.col("on").isNotNull()
    return rows.groupBy("book_id").agg(F.count_if(on).alias("selected"), F.count(F.lit(1)).alias("chapters"), F.sum(F.when(on, F.col("chars")).otherwise(0)).alias("selected_chars"))


def book_profile(spark, d):
    ch = chapters(spark, d)
    return ch.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.length("text")).alias("chars"), F.bool_or(F.col("doc_id") % 100 == 0).alias("has_cover"))


def analyze_report(spark, d):
    """The analysis lines: number, title, size, where the chapter comes from, and whether it is on."""
    ch, m = _contents(spark, d)
    listed = contents.represented(ch, m).select("doc_id", F.lit(True).alias("listed"))
    rows = ch.join(listed, "doc_id", "left").join(contents.usable(ch, m), "book_id")
    is_listed = F.coalesce("listed", F.lit(False))
    origin = F.when(is_listed, "TOC").when(F.col("has_toc"), "Spine/TOC disi").otherwise("Spine (TOC yok)")
    on = F.when(is_listed | ~F.col("has_toc"), "secili").otherwise("atlanir")
    line = F.format_string("%03d. %s (%d karakter) [%s; %s]", F.col("chapter_index"), F.col("title"), F.col("chars"), origin, on)
    return rows.select("book_id", "chapter_index", line.alias("line"))


#: Levels of the contents tree, and entries below each of its nodes.
TREE_DEPTH, TREE_FAN = 6, 4


def _toc_nodes(spark, d):
    """The contents as the leaves of a tree of TREE_DEPTH levels; a node's ordinal is that of its first entry over its size."""
    m = _contents(spark, d)[1]
    path = F.array(*(F.floor(F.col("pos") / TREE_FAN**n).cast("long") for n in reversed(range(TREE_DEPTH))))
    return m.select("book_id", path.alias("path"), "chapter_index", (F.col("pos") % 3 != 0).alias("selected"))


def selection_rollup(spark, d):
    path = F.array_join(F.transform("path", lambda n: n.cast("string")), ".")
    return contents.selection_rollup(_toc_nodes(spark, d)).select("book_id", path.alias("path"), "state")


def _runs(spark, d):
    """The jobs of this run without their texts, and the table of artifacts that an earlier run over the same books kept."""
    j = settled(jobs(spark, d).select("book_id", "sequence", "task_id", "seed", "duration_ms"), "jobs")
    path = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    store.save(artifacts(j), path)
    return j, store.stored(spark, path)


def cache_probe(spark, d):
    return cache.probe(*_runs(spark, d)).select("book_id", "task_id", "cached", "seconds")


def resume_pending(spark, d):
    return cache.pending(*_runs(spark, d)).select("book_id", "sequence", "task_id")


def artifact_inventory(spark, d):
    """Files of every third chapter, published as audio and then listed: how many, their bytes, and how long those that count are."""
    chapters_ms = jobs(spark, d).groupBy("book_id", "chapter_index").agg(F.sum("duration_ms").alias("duration_ms"))
    path = f"{shared_dir(spark)}/audio-{uuid.uuid4().hex}"
    store.save_audio(chapters_ms.filter("chapter_index % 3 = 0"), path, AUDIO_RATE)
    files, heads = store.inventory(spark, path)
    found = files.groupBy("book_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    long = heads.filter(F.col("seconds") > MIN_ARTIFACT_SECONDS).groupBy("book_id").agg(F.count(F.lit(1)).alias("valid"), F.round(F.sum("seconds"), 2).alias("seconds"))
    return found.join(long, "book_id", "left").select("book_id", "files", "bytes", "largest", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def job_key_rows(spark, d):
    return jobs(spark, d).select("book_id", "sequence", "key", "task_id", keys.artifact_name(F.col("chapter_index"), F.col("chunk_index"), F.col("key")).alias("file"))


def stable_seed(spark, d):
    return table(spark, d, "benchmark").select("item_id", keys.stable_seed(F.concat(F.lit("autotune-bench-"), F.col("item_id")), F.col("text")).alias("seed"))


def canonical_options(spark, d):
    m = F.create_map(F.lit("speed"), F.round("speed", 1).cast("string"), F.lit("mode"), F.col("voice_mode"), F.lit("note"), F.concat(F.lit('say "'), F.col("selector"), F.lit('"')))
    return requests(spark, d).select("request_id", keys.canonical_options(m).alias("options"))


def run_fingerprint(spark, d):
    return table(spark, d, "pages").select("page_id", keys.run_fingerprint(F.col("url"), F.length("html"), F.col("page_id") * 7, F.lit(ENGINE)).alias("run_id"))


def metadata_doc(spark, d):
    t = timeline.chapter_timeline(jobs(spark, d)).withColumn("title", F.concat(F.lit("Bolum #"), F.col("chapter_index")))
    return timeline.chapter_metadata_doc(t, F.concat(F.col("book_id"), F.lit("; notes")), F.lit(UNKNOWN_AUTHOR))


def manifest(spark, d):
    return timeline.manifest_lines(jobs(spark, d), F.concat(F.lit("it's/"), F.col("task_id"), F.lit(".wav")))


def cleanup(spark, d):
    j, kept = _runs(spark, d)
    finished = j.select("book_id").distinct().withColumn("keep", F.length("book_id") % 2 == 0)
    return cache.removable(kept, finished).select("book_id", "task_id")


def merge_parts(spark, d):
    j = jobs(spark, d)
    rate = F.when(F.col("chapter_index") % 50 == 0, 22050).otherwise(24000)
    parts = j.select(F.concat("book_id", F.lit("/"), "chapter_index").alias("task_id"), (F.col("duration_ms") * 24).alias("frames"), rate.alias("sample_rate"))
    return timeline.merge_parts(parts)


def _numbered(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return numbered(turns, ["conv_id"], position_bucket(F.col("turn")), ["turn", "role"], "n").select("conv_id", "turn", "role", "n")


QUERIES = {
    "c1_readable_docs": readable_docs,
    "c5_explicit_selection": explicit_selection,
    "c6_default_selection": lambda s, d: _plain(contents.default_selection(*_contents(s, d))),
    "c7_nonempty_chapters": nonempty_chapters,
    "c9_valid_artifact": lambda s, d: cache.valid_artifacts(artifacts(jobs(s, d))).select("book_id", "task_id", "size"),
    "a6_artifact_inventory": artifact_inventory,
    "d3_toc_chapter_map": lambda s, d: _mapped(s, d).select("book_id", "pos", "href", "chapter_index"),
    "d4_toc_represented": lambda s, d: _plain(contents.represented(*_contents(s, d))),
    "d5_spine_only": lambda s, d: contents.fallback(*_contents(s, d)),
    "d6_toc_usable": lambda s, d: contents.usable(*_contents(s, d)),
    "d9_cache_probe": cache_probe,
    "d10_resume_pending": resume_pending,
    "e1_book_profile": book_profile,
    "e3_chapter_chunk_count": lambda s, d: jobs(s, d).select("book_id", "sequence", "chapter_index", "chapter_chunks"),
    "e4_selection_summary": selection_summary,
    "e12_timeline_total": lambda s, d: timeline.timeline_total(jobs(s, d), keys.artifact_name(F.col("chapter_index"), F.col("chunk_index"), F.col("key"))).select("book_id", "total_ms", "n_chunks", F.sha2(F.array_join("paths", "\n"), 256).alias("paths_sha256")),
    "e13_merge_parts": merge_parts,
    "f1_chapter_numbering": lambda s, d: _plain(_chapters(s, d)),
    "f2_job_sequence": lambda s, d: jobs(s, d).select("book_id", "doc_id", "sequence", "chapter_index", "chunk_index"),
    "f3_elapsed": lambda s, d: timeline.elapsed(jobs(s, d)).select("book_id", "sequence", "start_ms", "end_ms"),
    "f4_chapter_timeline": lambda s, d: timeline.chapter_timeline(jobs(s, d)),
    "g2_restore_order": _numbered,
    "h3_missing_set": lambda s, d: _plain(contents.missing(*_contents(s, d))),
    "h4_toc_append": lambda s, d: contents.full_contents(*_contents(s, d)),
    "h5_selection_rollup": selection_rollup,
    "j4_chunk_key": lambda s, d: job_key_rows(s, d).select("book_id", "sequence", "key"),
    "j5_run_fingerprint": run_fingerprint,
    "j6_stable_seed": stable_seed,
    "j7_artifact_name": job_key_rows,
    "j11_canonical_options": canonical_options,
    "b1_chapter_metadata_doc": metadata_doc,
    "b2_ordered_manifest": manifest,
    "b4_analyze_report": analyze_report,
    "b5_workspace_cleanup": cleanup,
}

_TC = f"{sql.CHAPTERS}, {sql.TOC}, by_path AS (SELECT book_id, source_href, max(chapter_index) AS chapter_index FROM chapters GROUP BY ALL), " + """
mapped AS (SELECT t.*, b.chapter_index FROM toc t LEFT JOIN by_path b ON t.book_id = b.book_id AND split_part(t.href, '#', 1) = b.source_href),
usable AS (SELECT book_id, coalesce(bool_or(m.chapter_index IS NOT NULL), false) AS has_toc FROM (SELECT DISTINCT book_id FROM chapters) LEFT JOIN mapped m USING (book_id) GROUP BY book_id),
state AS (SELECT c.*, has_toc, EXISTS (SELECT 1 FROM mapped m WHERE m.book_id = c.book_id AND m.chapter_index = c.chapter_index) AS listed FROM chapters c JOIN usable USING (book_id))"""
_SEL = "book_id, chapter_index, title, source_href"
_FALLBACK = "SELECT book_id, title, source_href AS href, chapter_index, CASE WHEN has_toc THEN 'spine' ELSE 'spine_no_toc' END AS source, NOT has_toc AS default_selected FROM state WHERE NOT listed"
_J = f"WITH {sql.JOBS}"
_TIMES = "t AS (SELECT book_id, chapter_index, chapter_ms, CAST(sum(chapter_ms) OVER (PARTITION BY book_id ORDER BY chapter_index) AS BIGINT) AS upto FROM (SELECT book_id, chapter_index, CAST(sum(duration_ms) AS BIGINT) AS chapter_ms FROM jobs GROUP BY ALL))"

ORACLES = {
    "c1_readable_docs": r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)) AS href FROM pages
      WHERE page_id % 3 = 0 OR regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)), '\.(xhtml|html|htm)$')""",
    "c5_explicit_selection": f"WITH {sql.CHAPTERS} SELECT {_SEL} FROM chapters WHERE chapter_index IN (1, 3, 9)",
    "c6_default_selection": f"WITH {_TC} SELECT {_SEL} FROM state WHERE NOT has_toc OR listed",
    "c7_nonempty_chapters": f"{_J} SELECT book_id, chapter_index, count(*) AS n_chunks, max(chapter_chunks) AS chapter_chunks FROM jobs GROUP BY ALL",
    "c9_valid_artifact": f"{_J} SELECT book_id, task_id, size FROM artifacts WHERE size > 1024 AND seconds > 0.05",
    "a6_artifact_inventory": f"""{_J}, w AS (SELECT book_id, CAST(sum(duration_ms) AS BIGINT) * {AUDIO_RATE} // 1000 AS n FROM jobs WHERE chapter_index % 3 = 0 GROUP BY book_id, chapter_index)
      SELECT book_id, count(*) AS files, CAST(sum(n + 45) AS BIGINT) AS bytes, max(n + 45) AS largest, count(*) FILTER (n + 45 > 1024 AND n / {AUDIO_RATE} > 0.05) AS valid,
      round(coalesce(sum(n / {AUDIO_RATE}) FILTER (n + 45 > 1024 AND n / {AUDIO_RATE} > 0.05), 0), 2) AS seconds FROM w GROUP BY book_id""",
    "d3_toc_chapter_map": f"WITH {_TC} SELECT book_id, pos, href, chapter_index FROM mapped",
    "d4_toc_represented": f"WITH {_TC} SELECT {_SEL} FROM state WHERE listed",
    "d5_spine_only": f"WITH {_TC} {_FALLBACK}",
    "d6_toc_usable": f"WITH {_TC} SELECT * FROM usable",
    "d9_cache_probe": f"{_J} SELECT j.book_id, j.task_id, a.task_id IS NOT NULL AS cached, a.seconds FROM jobs j LEFT JOIN (SELECT * FROM artifacts WHERE size > 1024 AND seconds > 0.05) a USING (book_id, task_id)",
    "d10_resume_pending": f"{_J} SELECT book_id, sequence, task_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.book_id = j.book_id AND a.task_id = j.task_id AND size > 1024 AND seconds > 0.05)",
    "e1_book_profile": f"WITH {sql.SPINE} SELECT book_id, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(doc_id % 100 = 0) AS has_cover FROM spine GROUP BY book_id",
    "e3_chapter_chunk_count": f"{_J} SELECT book_id, sequence, chapter_index, count(*) OVER (PARTITION BY book_id, chapter_index) AS chapter_chunks FROM jobs",
    "e4_selection_summary": f"""WITH {_TC} SELECT book_id, count(*) FILTER (NOT has_toc OR listed) AS selected, count(*) AS chapters,
      CAST(coalesce(sum(length(text)) FILTER (NOT has_toc OR listed), 0) AS BIGINT) AS selected_chars FROM state GROUP BY book_id""",
    "e12_timeline_total": f"""{_J} SELECT book_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS n_chunks,
      sha256(string_agg(printf('%04d_%04d_%s.wav', chapter_index, chunk_index, key), chr(10) ORDER BY sequence)) AS paths_sha256 FROM jobs GROUP BY book_id""",
    "e13_merge_parts": f"""{_J}, p AS (SELECT book_id || '/' || chapter_index AS task_id, duration_ms * 24 AS frames, CASE WHEN chapter_index % 50 = 0 THEN 22050 ELSE 24000 END AS r FROM jobs)
      SELECT task_id, CAST(sum(frames) AS BIGINT) AS frames, min(r) AS sample_rate, round(sum(frames) / min(r), 6) AS seconds FROM p GROUP BY task_id""",
    "f1_chapter_numbering": f"WITH {sql.CHAPTERS} SELECT {_SEL} FROM chapters",
    "f2_job_sequence": f"{_J} SELECT book_id, doc_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chunk_index) AS sequence, chapter_index, chunk_index FROM jobs",
    "f3_elapsed": f"{_J} SELECT book_id, sequence, CAST(sum(duration_ms) OVER w - duration_ms AS BIGINT) AS start_ms, CAST(sum(duration_ms) OVER w AS BIGINT) AS end_ms FROM jobs WINDOW w AS (PARTITION BY book_id ORDER BY sequence)",
    "f4_chapter_timeline": f"{_J}, {_TIMES} SELECT book_id, chapter_index, upto - chapter_ms AS start_ms, greatest(upto, upto - chapter_ms + 1) AS end_ms FROM t",
    "g2_restore_order": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations",
    "h3_missing_set": f"WITH {_TC} SELECT {_SEL} FROM state WHERE NOT listed",
    "h4_toc_append": f"WITH {_TC} SELECT book_id, title, href, chapter_index, 'toc' AS source, true AS default_selected FROM mapped WHERE book_id IN (SELECT book_id FROM usable WHERE has_toc) UNION ALL {_FALLBACK}",
    "h5_selection_rollup": f"""WITH {_TC}, leaf AS (SELECT book_id, pos, CASE WHEN chapter_index IS NULL THEN pos % 3 <> 0 ELSE bool_or(pos % 3 <> 0) OVER (PARTITION BY book_id, chapter_index) END AS on_ FROM mapped),
      each AS (SELECT book_id, on_, unnest([{", ".join("concat_ws('.', " + ", ".join(f"pos // {TREE_FAN**n}" for n in reversed(range(at, TREE_DEPTH))) + ")" for at in range(TREE_DEPTH))}]) AS path FROM leaf)
      SELECT book_id, path, CASE WHEN bool_and(on_) THEN 'all' WHEN bool_or(on_) THEN 'some' ELSE 'none' END AS state FROM each GROUP BY ALL""",
    "j4_chunk_key": f"{_J} SELECT book_id, sequence, key FROM jobs",
    "j5_run_fingerprint": "SELECT page_id, substr(sha256(url || '|' || length(html) || '|' || (page_id * 7) || '|xtts'), 1, 16) AS run_id FROM pages",
    "j6_stable_seed": """SELECT item_id, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) & 2147483647 AS seed
      FROM (SELECT item_id, sha256('autotune-bench-' || item_id || chr(0) || text) AS h FROM benchmark)""",
    "j7_artifact_name": f"{_J} SELECT book_id, sequence, key, task_id, printf('%04d_%04d_%s.wav', chapter_index, chunk_index, key) AS file FROM jobs",
    "j11_canonical_options": f"""WITH {sql.REQUESTS} SELECT request_id, '{{"mode": "' || voice_mode || '", "note": "say \\"' || selector || '\\"", "speed": "' || CAST(round(speed, 1) AS VARCHAR) || '"}}' AS options FROM requests""",
    "b1_chapter_metadata_doc": f"""{_J}, {_TIMES}, s AS (SELECT book_id, chapter_index, '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (upto - chapter_ms) || chr(10) || 'END='
      || greatest(upto, upto - chapter_ms + 1) || chr(10) || 'title=Bolum \\#' || chapter_index AS sec FROM t)
      SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=' || book_id || '\\; notes' || chr(10) || 'artist=Bilinmeyen Yazar' || chr(10) || 'album=' || book_id || '\\; notes' || chr(10) || 'media_type=2' || chr(10)
      || string_agg(sec, chr(10) ORDER BY chapter_index) || chr(10) AS doc FROM s GROUP BY book_id""",
    "b2_ordered_manifest": f"""{_J} SELECT book_id, sequence, 'file ''it''\\''''s/' || task_id || '.wav''' AS line FROM jobs""",
    "b4_analyze_report": f"""WITH {_TC} SELECT book_id, chapter_index, printf('%03d. %s (%d karakter) [%s; %s]', chapter_index, title, length(text), CASE WHEN listed THEN 'TOC' WHEN has_toc THEN 'Spine/TOC disi' ELSE 'Spine (TOC yok)' END,
      CASE WHEN listed OR NOT has_toc THEN 'secili' ELSE 'atlanir' END) AS line FROM state""",
    "b5_workspace_cleanup": f"{_J} SELECT book_id, task_id FROM artifacts WHERE length(book_id) % 2 <> 0",
}
