"""Line dedup against brute force."""

import random

from lectern.llm import linededup


def expected(rows):
    seen, out = {}, {}
    for i, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.setdefault(window, (i, at))
        out[i, text] = "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines), len(gone)
    return [(i, *(out[i, t] if t is not None else (None, 0, 0))) for i, t in rows]


def test_query_equals_brute_force(spark, write):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 2, 3, 7, 40])))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "a\nb\nc\nd"), (202, "z\n" * 500), (203, "\n\n\n\n"), (204, "end\n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string")
    got = linededup.op5_linededup(spark, write(frame, "documents")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_repeated_rows_lose_the_same_lines(spark, write):
    rows = [(2, "a\nb\nc"), (2, "a\nb\nc"), (1, "a\nb\nc\nd")]
    got = linededup.op5_linededup(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")).collect()
    assert sorted((r.doc_id, r.text) for r in got)[0] == (1, "a\nb\nc\nd") and len({r.text for r in got if r.doc_id == 2}) == 1 and len(got) == 3


def test_long_texts_and_a_block_of_lines_in_a_third_of_all_rows(spark, write):
    block = "licence one\nlicence two\nlicence three\nlicence four"
    rows = [(i, (block + "\n" if i % 3 == 0 else "") + f"own {i}\nline {i}") for i in range(600)] + [(700 + i, "\n".join(f"{i} {n % 9000}" for n in range(10_000))) for i in range(2)]
    got = linededup.op5_linededup(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_empty_table(spark, write):
    assert linededup.op5_linededup(spark, write(spark.createDataFrame([], "doc_id long, text string"), "documents")).collect() == []
