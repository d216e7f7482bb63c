"""Chunking: the bound, abbreviations, hard splits, maximal packing."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.schemas import ABBREVIATIONS


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").select("i", expr(F.col("x")).alias("y"))
    return [r.y for r in sorted(rows.collect(), key=lambda r: r.i)]


def paragraphs(text):
    """The lines of a text that are not blank, with single blanks."""
    return [p for p in (" ".join(line.replace("\u00a0", " ").split(" ")) for line in text.splitlines()) if p.strip()]


def check_chunks(text, chunks, limit):
    """What holds for the chunks of any text: nothing is lost or moved, and each cut is one that the rules allow."""
    letters = lambda x: "".join(x.split())
    assert all(c and c == c.strip() and len(c) <= limit for c in chunks)
    at = 0
    for p in paragraphs(text):
        own, rest = [], letters(p)
        while rest:  # a chunk lies in one paragraph
            piece = letters(chunks[at])
            assert piece and rest.startswith(piece)
            own, rest, at = [*own, chunks[at]], rest[len(piece) :], at + 1
        plain = " ".join(re.split(r"[ \t\r\f\v]+", p)).strip()
        if len(plain) <= limit:
            assert own == [plain]
        done = ""
        for left, right in zip(own, own[1:]):
            done += letters(left)
            assert len(left) + 1 + len(right) > limit  # else they would be one
            ended = left[-1] in ".!?…" and not any(left.endswith(a) for a in ABBREVIATIONS)
            n, pos = 0, 0
            while n < len(done):  # where the cut is in the paragraph
                n, pos = n + (not plain[pos].isspace()), pos + 1
            if not plain[pos].isspace():
                assert len(left) == limit  # only a full chunk ends inside a word
            elif not ended:
                assert len(left) >= limit // 2  # or a long sentence is cut at a blank
    assert at == len(chunks)


def test_abbreviations_do_not_end_sentences(spark):
    assert column(spark, ["Dr. Ali geldi. Sonra gitti! Bkz. vb. şey?  Son…  Ok"], T.split_sentences) == [["Dr. Ali geldi.", "Sonra gitti!", "Bkz.", "vb. şey?", "Son…", "Ok"]]


def test_lines_become_paragraphs(spark):
    assert column(spark, [" a \t b \r\n\n c\x0bd e ", "", None], T.normalize_text) == ["a b\n\nc\n\nd\n\ne", "", None]


def test_random_texts_follow_the_rules(spark):
    rnd = random.Random(1)
    pieces = ["söz", "Dr.", "vb.", "uzun" * 30, "a", "b,", "c;", ".", "!", "…", "\n", "\t", " ", "😀" * 7, "No. 5"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice([" ", " ", "", "  "]) for _ in range(rnd.choice([0, 3, 60, 250]))) for _ in range(300)]
    got = column(spark, texts, lambda x: T.chunk_text(x, 80))
    for t, g in zip(texts, got):
        check_chunks(t, g, 80)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n,é", max_size=400), min_size=1, max_size=20))
def test_any_text_follows_the_rules(spark, texts):
    for t, g in zip(texts, column(spark, texts, lambda x: T.chunk_text(x, 80))):
        check_chunks(t, g, 80)


def test_cuts_are_at_the_last_place_that_fits(spark):
    sentence = "Bu cümle otuz harften uzundur ve. "
    words = "abcdefg " * 30
    cases = {sentence * 5: [(sentence * 2).strip()] * 2 + [sentence.strip()], "x" * 200: ["x" * 80, "x" * 80, "x" * 40], words: [("abcdefg " * 10).strip()] * 3, "y" * 30 + " " + "z" * 70: ["y" * 30 + " " + "z" * 49, "z" * 21]}
    assert column(spark, list(cases), lambda x: T.chunk_text(x, 80)) == list(cases.values())


def test_oversize_chunks_are_cut_again(spark):
    rows = spark.createDataFrame([(["k" * 131, "\t", "bir iki", "m" * 90],)], "x array<string>").select(T.enforce_limit(F.col("x"), 90).alias("y"))
    assert rows.first().y == ["k" * 90, "k" * 41, "bir iki", "m" * 90]


def test_small_limits_are_refused():
    for make in (T.chunk_text, T.enforce_limit):
        with pytest.raises(ValueError):
            make(F.lit("x"), 79)


def test_metadata_values_and_durations(spark):
    assert column(spark, ["a=b;c#d\\e\nf\rg"], T.escape_metadata) == ["a\\=b\\;c\\#d\\\\e f g"]
    rows = spark.createDataFrame([(0, 3725.4), (1, 65.5), (2, 0.5), (3, -4.0), (4, 2.5)], "i int, s double").select("i", T.format_duration(F.col("s")).alias("y"))
    assert [r.y for r in rows.orderBy("i").collect()] == ["1 sa 02 dk", "1 dk 06 sn", "0 sn", "0 sn", "2 sn"]
