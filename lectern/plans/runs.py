"""Telemetry, placement, request and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators import cache, contents, gates, placement, telemetry
from lectern.plans import sql
from lectern.plans.tables import gpu_lines, measurements, messages, requests, table
from lectern.sources import feeds

SLOTS, GAP = 4, 900
_SPEAKERS = ("Ana", "Mert", "Deniz")


def _tasks(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("task"), "l_quantity").groupBy("l_orderkey", "task").agg(F.sum("l_quantity").alias("cost"))


def _factors(spark, d):
    return telemetry.config_factor(measurements(spark, d))


def _tried(spark, d):
    used = F.lit(4.0) + F.col("workers") * 3 + F.col("config") % 4
    return telemetry.take_while_below(_factors(spark, d), memory=(F.lit(24.0), used)).select("config", "workers")


def _samples(spark, d):
    return feeds.parse_gpu(gpu_lines(spark, d), "line")


def worker_messages(spark, d):
    """Event properties as message lines: every fifth is blank or not JSON."""
    line = F.when(F.col("event_id") % 10 == 0, "  ").when(F.col("event_id") % 5 == 0, F.concat(F.lit("log "), F.col("props"))).otherwise(F.concat(F.lit('{"type": "'), F.when(F.col("event_type") == "error", "task_error").when(F.col("event_type") == "view", "pong").otherwise("result"), F.lit('", '), F.expr("substr(props, 2)")))
    return feeds.parse_messages(table(spark, d, "events").select("event_id", line.alias("line")), "line").select("event_id", "route", "m.k")


def _latest(spark, d):
    return telemetry.latest_per_key(messages(spark, d))


def result_match(spark, d):
    """Finished lines against the orders still known as jobs: with their job's owner, or as results of unknown tasks."""
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("part"))
    jobs = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("run_id"))
    return cache.matched(results, jobs)


def _eligible(spark, d):
    return gates.eligible(requests(spark, d)).select("request_id", "reject_reason")


def _names(spark, d):
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("name"))
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit(" "), F.when(F.col("c_custkey") % 9 > 0, F.col("c_mktsegment")).otherwise(""), F.lit("  ")).alias("name"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").otherwise(F.col("n_name")).alias("name"))
    return gates.name_union([brands, segments, nations]).select("name", "first.source", "first.pos")


def speaker_resolve(spark, d):
    pick = F.element_at(F.array(F.lit("Ana"), F.lit("Mert"), F.lit(""), F.lit("Zeki")), (F.col("request_id") % 4 + 1).cast("int"))
    listed = F.when(F.col("request_id") % 3 == 0, F.array(*map(F.lit, _SPEAKERS))).when(F.col("request_id") % 3 == 1, F.array(F.lit("Mert"), F.lit("Deniz"))).otherwise(F.expr("cast(array() as array<string>)"))
    return requests(spark, d).select("request_id", gates.resolve_name(pick, listed, "Ana").alias("speaker"))


def _hrefs(spark, d):
    href = F.element_at(F.array(*map(F.lit, ("../a/b.html#x", "./c%20d.htm", "/abs/../z.html", "#part%201", "x+y.html", "../../../../up.html", "sub//./t.html"))), (F.col("page_id") % 7 + 1).cast("int"))
    base = F.concat(F.lit("OEBPS/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    return table(spark, d, "pages").select("page_id", base.alias("base"), href.alias("href"))


def suffix_pick(spark, d):
    href = F.element_at(F.array(*map(F.lit, ("img/a.PNG", "b.gif", "c", "d.webp", "e.v2/cover", ".jpeg"))), (F.col("page_id") % 6 + 1).cast("int"))
    media = F.element_at(F.array(F.lit("image/png"), F.lit("image/jpeg"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", paths.suffix_pick(href, media).alias("suffix"))


def first_match(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("text"))


def selectors(spark, d):
    numbers = contents.selector_expand(F.col("selector"))
    return requests(spark, d).select("request_id", F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("numbers"))


QUERIES = {
    "a7_gpu_csv": lambda s, d: _samples(s, d).drop("ts"),
    "a8_worker_messages": worker_messages,
    "c8_eligible_requests": _eligible,
    "c10_option_validation": lambda s, d: gates.validated(requests(s, d)).select("request_id", "reject_reason"),
    "d7_engine_lookup": lambda s, d: gates.engine_lookup(requests(s, d).drop("max_chars")).select("request_id", "engine_id", "max_chars", F.col("max_chars").isNotNull().alias("known")),
    "d8_preset_lookup": lambda s, d: gates.preset_lookup(requests(s, d)).select("request_id", "bitrate", "sample_rate"),
    "d11_result_match": result_match,
    "e5_run_totals": lambda s, d: telemetry.run_totals(messages(s, d)),
    "e6_worker_throughput": lambda s, d: telemetry.worker_throughput(messages(s, d)),
    "e7_worker_range": lambda s, d: telemetry.worker_range(messages(s, d)),
    "e8_vram_by_worker": lambda s, d: telemetry.vram_by_worker(messages(s, d), F.col("wall_ms") / 250),
    "e9_mode_set": lambda s, d: telemetry.mode_set(messages(s, d), F.col("kind")),
    "e10_config_factor": _factors,
    "e11_best_workers": lambda s, d: telemetry.best_workers(_factors(s, d)),
    "e14_target_percent": lambda s, d: _factors(s, d).select("config", "workers", telemetry.target_percent(F.col("factor")).alias("percent")),
    "f5_throughput_running": lambda s, d: telemetry.running_throughput(messages(s, d)).drop("eta_seconds", "eta_warmup", "ts"),
    "f6_eta": lambda s, d: telemetry.running_throughput(messages(s, d)).select("run_id", "task_id", "eta_seconds", "eta_warmup"),
    "f7_progress_points": lambda s, d: telemetry.progress_points(messages(s, d)).drop("percent"),
    "f8_take_while": _tried,
    "f9_latest_per_key": _latest,
    "f10_throttle_samples": lambda s, d: telemetry.throttle(gpu_lines(s, d), GAP),
    "f11_chapter_change_log": lambda s, d: telemetry.change_log(messages(s, d)),
    "g1_longest_first": lambda s, d: placement.longest_first(_tasks(s, d), "l_orderkey", "cost", "task"),
    "g3_balanced_placement": lambda s, d: placement.snake_slots(_tasks(s, d), "l_orderkey", "cost", "task", SLOTS).drop("cost"),
    "g3_greedy_placement": lambda s, d: placement.greedy_slots(_tasks(s, d), "l_orderkey", "cost", "task", SLOTS),
    "g4_makespan": lambda s, d: placement.makespan(placement.snake_slots(_tasks(s, d), "l_orderkey", "cost", "task", SLOTS), "l_orderkey", "cost", SLOTS),
    "g5_first_match": first_match,
    "h1_speaker_union": _names,
    "h2_selector_expand": selectors,
    "j1_resolve_href": lambda s, d: _hrefs(s, d).select("page_id", paths.resolve_href(F.col("base"), F.col("href")).alias("target")),
    "j2_strip_fragment": lambda s, d: table(s, d, "pages").select("page_id", paths.strip_fragment(F.col("url")).alias("path")),
    "j8_capacity_estimate": lambda s, d: _samples(s, d).select("event_id", telemetry.capacity(F.col("total_gb"), F.col("used_gb")).alias("workers")),
    "j12_suffix_pick": suffix_pick,
    "j13_percent_progress": lambda s, d: telemetry.progress_points(messages(s, d)).select("run_id", "task_id", "percent"),
    "j14_speaker_resolve": speaker_resolve,
    "k6_first_error_stops": lambda s, d: telemetry.first_error_stops(messages(s, d)),
}

_M = f"WITH {sql.MESSAGES}"
_WT = "wt AS (SELECT *, CASE WHEN wall_ms > 0 THEN round(audio_ms / wall_ms, 6) ELSE 0.0 END AS factor FROM (SELECT run_id, worker, CAST(sum(audio_ms) AS BIGINT) AS audio_ms, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, count(*) AS chunks FROM messages WHERE NOT cached GROUP BY ALL))"
_CF = f"""WITH {sql.MEASURED}, cf AS (SELECT config, workers, CASE WHEN max(ended_ms) > min(started_ms) THEN round(CAST(sum(audio_ms) AS BIGINT) / (max(ended_ms) - min(started_ms)), 6) ELSE 0.0 END AS factor
  FROM (SELECT *, row_number() OVER (PARTITION BY config, workers, worker ORDER BY started_ms, task_id, ended_ms, audio_ms) AS n FROM measured) WHERE n > 2 GROUP BY ALL)"""
_RUN = f"""{_M}, r AS (SELECT *, epoch_us(ts) AS now, CAST(sum(chars) OVER w AS BIGINT) AS processed, CAST(sum(audio_ms) OVER w AS BIGINT) AS audio, CAST(sum(CASE WHEN cached THEN 0 ELSE chars END) OVER w AS BIGINT) AS made_chars,
  CAST(sum(CASE WHEN cached THEN 0 ELSE audio_ms END) OVER w AS BIGINT) AS made_audio, CAST(sum(CASE WHEN cached THEN 0 ELSE wall_ms END) OVER w AS BIGINT) AS worked,
  CAST(sum(CAST(cached AS INT)) OVER w AS BIGINT) AS hits, CAST(sum(CAST(NOT cached AS INT)) OVER w AS BIGINT) AS fresh, count(*) OVER w AS done FROM messages WINDOW w AS (PARTITION BY run_id ORDER BY ts, task_id)),
g AS (SELECT run_id, CAST(sum(chars) AS BIGINT) AS total, count(*) AS total_events, min(epoch_us(ts)) AS start, min(CASE WHEN NOT cached THEN {{'now': epoch_us(ts), 'id': task_id, 'audio': audio_ms}} END) AS first FROM messages GROUP BY run_id),
x AS (SELECT r.*, total, total_events, greatest(total - processed, 0) AS rest, CASE WHEN fresh >= 10 AND now > first.now THEN (made_audio - first.audio) * 1000 / (now - first.now) ELSE 0.0 END AS f0,
  CASE WHEN worked > 0 THEN made_audio / worked ELSE 0.0 END AS wf, CASE WHEN made_audio > 0 AND now > start THEN made_audio * 1000 / (now - start) ELSE 0.0 END AS ef FROM r JOIN g USING (run_id)),
y AS (SELECT *, CASE WHEN rest = 0 AND f0 <= 0 THEN wf ELSE f0 END AS f FROM x)"""
_TASKS = "tasks AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS task, sum(l_quantity) AS cost FROM lineitem GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cost DESC, task) AS rank FROM tasks)"
_SNAKE = f"{_TASKS}, snake AS (SELECT *, CAST(CASE WHEN (rank - 1) % 8 < 4 THEN (rank - 1) % 8 ELSE 7 - (rank - 1) % 8 END AS INTEGER) AS slot FROM ranked)"
_GPU = f"""WITH {sql.GPU}, samples AS (SELECT event_id, device, trim(split_part(line, ',', 1)) AS gpu_name, CAST(trim(split_part(line, ',', 2)) AS INTEGER) AS util_percent, CAST(round_even(CAST(trim(split_part(line, ',', 3)) AS DOUBLE), 0) AS INTEGER) AS power_w,
  round(CAST(trim(split_part(line, ',', 4)) AS DOUBLE) / 1024, 2) AS used_gb, round(CAST(trim(split_part(line, ',', 5)) AS DOUBLE) / 1024, 2) AS total_gb FROM gpu_lines WHERE len(string_split(line, ',')) >= 5)"""
_WANTS = "(coalesce(needs_reference, false) OR (engine_id = 'xtts' AND voice_mode = 'clone'))"
_NORM = """list_reduce(list_prepend('', string_split({p}, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' AND a <> '' AND split_part(a, '/', -1) <> '..' THEN regexp_replace(a, '/?[^/]+$', '')
  WHEN s = '..' AND a = '' AND {p}[1] = '/' THEN a WHEN a = '' THEN s ELSE a || '/' || s END)"""

ORACLES = {
    "a7_gpu_csv": f"{_GPU} SELECT * FROM samples",
    "a8_worker_messages": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'log' WHEN event_type = 'error' THEN 'task_error' WHEN event_type = 'view' THEN 'pong' ELSE 'result' END AS route,
      CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 10 <> 0""",
    "c8_eligible_requests": f"""WITH {sql.ENGINES}, {sql.REQUESTS} SELECT request_id, CASE WHEN lower(output) NOT LIKE '%.m4b' THEN 'output suffix' WHEN n_chapters <= 0 THEN 'no chapter' WHEN e.max_chars IS NULL THEN 'unknown engine'
      WHEN {_WANTS} AND NOT has_reference THEN 'no reference' WHEN {_WANTS} AND NOT consent THEN 'no consent' WHEN needs_licence AND NOT licence_ok THEN 'licence' WHEN n_chunks <= 0 THEN 'no chunk' END AS reject_reason
      FROM requests LEFT JOIN engines e USING (engine_id)""",
    "c10_option_validation": f"""WITH {sql.REQUESTS} SELECT request_id, CASE WHEN voice_mode NOT IN ('builtin', 'clone') THEN 'voice mode' WHEN NOT round(speed, 6) BETWEEN 0.7::DOUBLE AND 1.6::DOUBLE THEN 'speed'
      WHEN performance_mode NOT IN ('optimized', 'deepspeed', 'compatibility') THEN 'performance mode' WHEN max_chars < 80 THEN 'chunk limit' END AS reject_reason FROM requests""",
    "d7_engine_lookup": f"WITH {sql.ENGINES}, {sql.REQUESTS} SELECT request_id, engine_id, e.max_chars, e.max_chars IS NOT NULL AS known FROM requests LEFT JOIN engines e USING (engine_id)",
    "d8_preset_lookup": f"WITH {sql.PRESETS}, {sql.REQUESTS} SELECT request_id, bitrate, sample_rate FROM requests JOIN presets USING (quality_key)",
    "d11_result_match": "SELECT l_orderkey AS task_id, l_linenumber AS part, o_custkey AS run_id, o_orderkey IS NOT NULL AS known FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'F'",
    "e5_run_totals": f"""{_M} SELECT run_id, CAST(sum(chars) AS BIGINT) AS processed_chars, CAST(coalesce(sum(chars) FILTER (NOT cached), 0) AS BIGINT) AS synthesized_chars, CAST(sum(audio_ms) AS BIGINT) AS audio_ms,
      CAST(coalesce(sum(wall_ms) FILTER (NOT cached), 0) AS BIGINT) AS wall_ms, count(*) FILTER (cached) AS cache_hits, count(*) FILTER (NOT cached) AS uncached FROM messages GROUP BY run_id""",
    "e6_worker_throughput": f"{_M}, {_WT} SELECT * FROM wt",
    "e7_worker_range": f"{_M}, {_WT} SELECT run_id, min(factor) AS slowest, max(factor) AS fastest FROM wt WHERE factor > 0 GROUP BY run_id",
    "e8_vram_by_worker": f"{_M} SELECT run_id, round(sum(gb), 2) AS allocated_gb FROM (SELECT run_id, worker, arg_max(wall_ms / 250, {{'t': ts, 'i': task_id}}) AS gb FROM messages GROUP BY ALL) GROUP BY run_id",
    "e9_mode_set": f"{_M} SELECT run_id, string_agg(kind, '+' ORDER BY kind) AS modes FROM (SELECT DISTINCT run_id, kind FROM messages WHERE kind IS NOT NULL) GROUP BY run_id",
    "e10_config_factor": f"{_CF} SELECT * FROM cf",
    "e11_best_workers": f"""{_CF}, v AS (SELECT *, max(CASE WHEN factor > 0 THEN factor END) OVER (PARTITION BY config) AS top FROM cf)
      SELECT config, coalesce(min(workers) FILTER (factor >= 4), min(workers) FILTER (factor > 0 AND factor >= top * (1 - 0.03::DOUBLE)), 1) AS workers, count(*) FILTER (factor >= 4) > 0 AS target_reached FROM v GROUP BY config""",
    "e14_target_percent": f"{_CF} SELECT config, workers, least(999, CAST(round_even(factor / 4.0::DOUBLE * 100, 0) AS BIGINT)) AS percent FROM cf",
    "f5_throughput_running": f"{_RUN} SELECT run_id, task_id, cached, processed, audio, made_audio, worked, hits, fresh, round(f, 6) AS realtime_factor, round(wf, 6) AS worker_factor, round(ef, 6) AS end_to_end_factor FROM y",
    "f6_eta": f"{_RUN} SELECT run_id, task_id, round(CASE WHEN rest = 0 THEN 0.0 WHEN f > 0 AND made_chars > 0 AND fresh >= 10 THEN rest * made_audio / made_chars / 1000 / f END, 4) AS eta_seconds, fresh < 10 AND rest > 0 AS eta_warmup FROM y",
    "f7_progress_points": f"{_RUN} SELECT run_id, task_id, done, total_events AS total, NOT cached AND (fresh = 10 OR fresh % 25 = 0) AS logged FROM y",
    "f8_take_while": f"{_CF} SELECT config, workers FROM cf c WHERE NOT EXISTS (SELECT 1 FROM cf p WHERE p.config = c.config AND p.workers < c.workers AND (p.factor >= 4 OR greatest(24.0 - (4.0 + p.workers * 3 + p.config % 4), 0) < 4.5))",
    "f9_latest_per_key": f"{_M} SELECT run_id, worker, kind, task_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, worker ORDER BY ts DESC, task_id DESC) AS n FROM messages) WHERE n = 1",
    "f10_throttle_samples": f"""WITH RECURSIVE {sql.GPU}, s AS (SELECT device, epoch_us(ts) AS at_, min(event_id) AS event_id FROM gpu_lines GROUP BY ALL),
      n AS (SELECT device, at_, min(at_) OVER (PARTITION BY device ORDER BY at_ RANGE BETWEEN {GAP * 1_000_000} FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s),
      k(device, at_) AS (SELECT device, min(at_) FROM s GROUP BY device UNION ALL SELECT k.device, n.next FROM k JOIN n ON k.device = n.device AND k.at_ = n.at_ WHERE n.next IS NOT NULL)
      SELECT device, s.event_id FROM k JOIN s USING (device, at_)""",
    "f11_chapter_change_log": f"{_M} SELECT run_id, task_id, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY run_id ORDER BY ts, task_id) AS b FROM messages) WHERE kind IS DISTINCT FROM b",
    "g1_longest_first": f"WITH {_TASKS} SELECT * FROM ranked",
    "g3_balanced_placement": f"WITH {_SNAKE} SELECT l_orderkey, task, rank, slot FROM snake",
    "g4_makespan": f"WITH {_SNAKE} SELECT l_orderkey, round(max(load), 6) AS longest, round(sum(load) / 4, 6) AS mean FROM (SELECT l_orderkey, slot, sum(cost) AS load FROM snake GROUP BY ALL) GROUP BY l_orderkey",
    "g5_first_match": "SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "h1_speaker_union": """WITH n AS (SELECT 0 AS source, p_partkey AS pos, trim(p_brand) AS name FROM part UNION ALL SELECT 1, c_custkey, trim(CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment ELSE '' END) FROM customer
      UNION ALL SELECT 2, CAST(n_nationkey AS BIGINT), trim(CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE n_name END) FROM nation)
      SELECT name, f.s AS source, f.p AS pos FROM (SELECT name, min({'s': source, 'p': pos}) AS f FROM n WHERE name <> '' GROUP BY name)""",
    "h2_selector_expand": f"""WITH {sql.REQUESTS}, p AS (SELECT request_id, list_filter(list_transform(string_split(selector, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM requests),
      r AS (SELECT request_id, ps, list_transform(ps, lambda x: {{'a': TRY_CAST(trim(split_part(x, '-', 1)) AS BIGINT), 'b': TRY_CAST(trim(split_part(x, '-', -1)) AS BIGINT)}}) AS rs FROM p)
      SELECT request_id, CASE WHEN len(ps) > 0 AND len(list_filter(rs, lambda x: x.a > 0 AND x.b >= x.a)) = len(ps) THEN array_to_string(list_sort(list_distinct(flatten(list_transform(rs, lambda x: range(x.a, x.b + 1))))), ',') END AS numbers FROM r""",
    "j1_resolve_href": f"""WITH h AS (SELECT page_id, 'OEBPS/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS base,
        ['../a/b.html#x', './c%20d.htm', '/abs/../z.html', '#part%201', 'x+y.html', '../../../../up.html', 'sub//./t.html'][page_id % 7 + 1] AS href FROM pages),
      u AS (SELECT page_id, base, replace(split_part(href, '#', 1), '%20', ' ') AS raw, replace(split_part(href, '#', 2), '%20', ' ') AS frag FROM h),
      j AS (SELECT page_id, frag, CASE WHEN raw = '' THEN base WHEN raw[1] = '/' THEN raw ELSE regexp_extract(base, '^(.*/)', 1) || raw END AS p FROM u),
      n AS (SELECT page_id, frag, CASE WHEN p[1] = '/' THEN '/' ELSE '' END || {_NORM.format(p='p')} AS path FROM j)
      SELECT page_id, path || CASE WHEN frag = '' THEN '' ELSE '#' || frag END AS target FROM n""",
    "j2_strip_fragment": "SELECT page_id, split_part(url, '#', 1) AS path FROM pages",
    "j8_capacity_estimate": f"{_GPU} SELECT event_id, CAST(least(4, greatest(1, floor(greatest(greatest(total_gb - used_gb, 0) - 2.0, 0) / 2.5))) AS INTEGER) AS workers FROM samples",
    "j12_suffix_pick": r"""WITH h AS (SELECT page_id, ['img/a.PNG', 'b.gif', 'c', 'd.webp', 'e.v2/cover', '.jpeg'][page_id % 6 + 1] AS href, ['image/png', 'image/jpeg', ''][page_id % 3 + 1] AS media FROM pages),
      s AS (SELECT page_id, lower(regexp_extract(href, '[^/.](\.[^./]+)$', 1)) AS named, CASE WHEN media = 'image/png' THEN '.png' WHEN media = 'image/webp' THEN '.webp' ELSE '.jpg' END AS guessed FROM h),
      c AS (SELECT page_id, CASE WHEN named = '' THEN guessed ELSE named END AS suffix FROM s)
      SELECT page_id, CASE WHEN suffix IN ('.jpg', '.jpeg', '.png', '.webp') THEN suffix ELSE '.jpg' END AS suffix FROM c""",
    "j13_percent_progress": f"{_RUN} SELECT run_id, task_id, CAST(round_even(done * 100 / total_events, 0) AS BIGINT) AS percent FROM y",
    "j14_speaker_resolve": """WITH r AS (SELECT o_orderkey AS request_id, ['Ana', 'Mert', '', 'Zeki'][o_orderkey % 4 + 1] AS want, CASE o_orderkey % 3 WHEN 0 THEN ['Ana', 'Mert', 'Deniz'] WHEN 1 THEN ['Mert', 'Deniz'] ELSE [] END AS have FROM orders)
      SELECT request_id, CASE WHEN want = '' THEN CASE WHEN list_contains(have, 'Ana') THEN 'Ana' WHEN len(have) > 0 THEN have[1] ELSE 'Ana' END WHEN len(have) = 0 OR list_contains(have, want) THEN want
        WHEN want = 'Ana' THEN have[1] WHEN list_contains(have, 'Ana') THEN 'Ana' END AS speaker FROM r""",
    "k6_first_error_stops": f"""{_M}, s AS (SELECT run_id, min({{'t': ts, 'i': task_id}}) AS stop FROM messages WHERE failed GROUP BY run_id)
      SELECT m.run_id, m.task_id, coalesce({{'t': m.ts, 'i': m.task_id}} > stop, false) AS discarded, stop IS NOT NULL AS run_failed FROM messages m LEFT JOIN s USING (run_id)""",
}
