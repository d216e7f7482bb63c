"""Content keys, seeds and names that make a result reusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Options that change scheduling only.
SCHEDULING = ("worker_count",)
_NUL = "\0"


def canonical_options(options: Column) -> Column:
    """A map of strings as JSON with sorted keys and blanks after separators."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    entries = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def chunk_key(engine: Column, options: Column, text: Column) -> Column:
    """24 hex digits that depend on engine, options other than scheduling ones, and text."""
    kept = F.map_filter(options, lambda k, _: ~k.isin(*SCHEDULING))
    return F.substring(F.sha2(F.concat(engine, F.lit(_NUL), canonical_options(kept), F.lit(_NUL), text), 256), 1, 24)


def run_fingerprint(path: Column, size: Column, modified: Column, engine: Column) -> Column:
    """16 hex digits that identify a file as it was and the engine it is read with."""
    return F.substring(F.sha2(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), engine), 256), 1, 16)


def stable_seed(task: Column, text: Column) -> Column:
    """The low 31 bits of the first four digest bytes, the first byte lowest."""
    digest = F.sha2(F.concat(task, F.lit(_NUL), text), 256)
    swapped = F.concat(*(F.substring(digest, i, 2) for i in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def artifact_name(chapter: Column, chunk: Column, key: Column) -> Column:
    return F.format_string("%04d_%04d_%s.wav", chapter, chunk, key)


def task_id(chapter: Column, chunk: Column, key: Column) -> Column:
    return F.format_string("%04d-%04d-%s", chapter, chunk, key)
