"""DuckDB text for the same model: expressions and common table expressions."""

from __future__ import annotations

from lectern.schemas import ABBREVIATIONS


def lines(t: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(replace({t}, chr(160), ' '), '\r\n|[\n\r\x0B\f\x1c-\x1e]'), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '')"


def sentences(t: str) -> str:
    kept, back = t, "trim(s)"
    for short in ABBREVIATIONS:
        kept = f"replace({kept}, '{short}', '{short[:-1]}' || chr(1))"
        back = f"replace({back}, '{short[:-1]}' || chr(1), '{short}')"
    return rf"list_filter(list_transform(string_split(regexp_replace({kept}, '([.!?…])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: {back}), lambda s: s <> '')"


def hard_split(t: str, m: int) -> str:
    return f"list_transform(regexp_extract_all(trim({t}), '(?s)(.{{1,{m}}}$|.{{{m // 2},{m}}} |.{{{m}}})'), lambda z: trim(z))"


def pack(units: str, m: int) -> str:
    return f"string_split(list_reduce({units}, lambda a, u: CASE WHEN length(split_part(a, chr(3), -1)) + 1 + length(u) <= {m} THEN a || ' ' || u ELSE a || chr(3) || u END), chr(3))"


def paragraph_chunks(p: str, m: int) -> str:
    units = f"flatten(list_transform({sentences(p)}, lambda q: CASE WHEN length(q) > {m} THEN {hard_split('q', m)} ELSE [q] END))"
    return f"CASE WHEN length({p}) <= {m} THEN [{p}] ELSE {pack(units, m)} END"


def chunks(t: str, m: int) -> str:
    return f"flatten(list_transform({lines(t)}, lambda p: {paragraph_chunks('p', m)}))"


SPINE = "spine AS (SELECT source AS book_id, doc_id, text FROM documents WHERE length(trim(text)) >= 20)"
CHAPTERS = SPINE + """,
chapters AS (SELECT book_id, doc_id, n AS chapter_index, 'Bolum ' || n AS title, 'text/d' || doc_id || '.xhtml' AS source_href, text
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n FROM spine))"""
TOC = """toc AS (SELECT source AS book_id, l.doc_id AS pos, 'T' || l.doc_id AS title,
  CASE WHEN quality = 1 THEN 'text/d' || l.doc_id || '.xhtml#s' || toxic ELSE 'text/x' || l.doc_id || '.xhtml' END AS href FROM labels l JOIN documents d USING (doc_id))"""
CHUNKED = SPINE + f", chunked AS (SELECT * FROM (SELECT book_id, doc_id, {chunks('text', 220)} AS chunks FROM spine) WHERE len(chunks) > 0)"
_JSON = '{"performance_mode": "optimized", "speed": "1.0", "voice_mode": "builtin"}'
JOBS = CHUNKED + f""",
j0 AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS chapter_index, len(chunks) AS chapter_chunks,
  sum(len(chunks)) OVER (PARTITION BY book_id ORDER BY doc_id) - len(chunks) AS before FROM chunked),
j1 AS (SELECT book_id, doc_id, chapter_index, chapter_chunks, before, unnest(chunks) AS text, unnest(range(1, len(chunks) + 1)) AS chunk_index FROM j0),
j2 AS (SELECT *, CAST(before + chunk_index AS BIGINT) AS sequence, substr(sha256('xtts' || chr(0) || '{_JSON}' || chr(0) || text), 1, 24) AS key FROM j1),
j3 AS (SELECT *, printf('%04d-%04d-%s', chapter_index, chunk_index, key) AS task_id FROM j2),
j4 AS (SELECT *, sha256(task_id || chr(0) || text) AS h FROM j3),
j5 AS (SELECT *, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) & 2147483647 AS seed FROM j4),
jobs AS (SELECT book_id, doc_id, sequence, chapter_index, chunk_index, CAST(chapter_chunks AS BIGINT) AS chapter_chunks, text, key, task_id, seed,
  CAST(length(text) * 60 + seed % 200 AS BIGINT) AS duration_ms FROM j5),
artifacts AS (SELECT book_id, task_id, 600 + seed % 2000 AS size, duration_ms / 1000 AS seconds FROM jobs WHERE seed % 3 = 0)"""
MESSAGES = """messages AS (SELECT user_id AS run_id, ts, event_id AS task_id, event_id % 4 AS worker, event_type AS kind, event_type = 'view' AS cached, event_type = 'error' AS failed,
  CAST(round_even(value * 1000, 0) AS BIGINT) AS audio_ms, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + 1 AS chars, event_id * 37 % 900 + 100 AS wall_ms FROM events)"""
MEASURED = """measured AS (SELECT l_suppkey AS config, CAST(l_linenumber AS BIGINT) AS workers, l_orderkey % l_linenumber AS worker, l_orderkey AS task_id,
  l_orderkey * 37 % 24000 // l_linenumber AS started_ms, l_orderkey * 37 % 24000 // l_linenumber + 100 + l_orderkey % 900 AS ended_ms, CAST(round_even(l_quantity * 20, 0) AS BIGINT) AS audio_ms FROM lineitem)"""
GPU = """gpu_lines AS (SELECT event_id, user_id % 5 AS device, ts, CASE WHEN event_id % 7 = 0 THEN printf('GPU %d, %d', user_id % 5, event_id % 101)
  ELSE printf('GPU %d, %d, %d.5, %d, 24576', user_id % 5, event_id % 101, event_id % 300, event_id * 13 % 24576) END AS line FROM events)"""
ENGINES = "engines AS (SELECT * FROM (VALUES ('trendyol', 760, false, false, false), ('xtts', 220, false, true, true), ('mms', 320, false, true, false)) t(engine_id, max_chars, needs_reference, needs_licence, has_speakers))"
PRESETS = "presets AS (SELECT * FROM (VALUES ('low', '32k', 22050), ('standard', '64k', 44100), ('high', '128k', 48000)) t(quality_key, bitrate, sample_rate))"


def _pick(by: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({by}) % {len(values)} + 1]"


REQUESTS = f"""requests AS (SELECT o_orderkey AS request_id, {_pick('o_orderkey', 'trendyol', 'xtts', 'mms', 'other')} AS engine_id,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'standard' ELSE 'low' END AS quality_key,
  {_pick('o_orderkey // 3', 'builtin', 'clone', 'whisper')} AS voice_mode, {_pick('o_orderkey // 5', 'optimized', 'deepspeed', 'compatibility', 'turbo')} AS performance_mode,
  0.5::DOUBLE + (o_orderkey % 13) / 10 AS speed, o_orderkey % 7 <> 0 AS has_reference, o_orderkey % 5 <> 0 AS consent, o_orderkey % 11 <> 0 AS licence_ok,
  'out/' || o_orderkey || {_pick('o_orderkey // 2', '.m4b', '.M4B', '.mp3')} AS output, o_orderkey % 17 AS n_chapters, o_orderkey % 17 * (o_orderkey % 3) AS n_chunks,
  60 + o_orderkey % 40 AS max_chars, {_pick('o_orderkey // 7', '1,3-5,9', ' 2 , 2-4', '5-3', '', '7', '0,1')} AS selector FROM orders)"""
