"""Token files: blocks and planes, whole round trips, the library's own ids of every text."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import tokens, vocab

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [None, "", " ", "  two  spaces ", "<|endoftext|> special<|endoftext|>s", "it's John's  don't 'sup", "\n\n\nlines\n \n\ttabs\r\n", "Ωmega straßeβ 漢字 🙂 é", "a,b;c--d  12 345x", "x\x1cy \x85z w　v", "it's a 'sad'story, l'été’s"]


def want(rows):
    at, out = 0, []
    for key, text in rows:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype("<u4")
        found = tokens.planes_of(ids, planes)
        assert len(found) == planes and (tokens.ids_of(found, n) == ids).all()


def test_a_slice_opens_only_its_blocks(monkeypatch):
    ids = np.arange(1000, dtype="<u4")
    content = tokens.pack([(1, ids[:300].tobytes()), (None, b""), (2, ids[300:].tobytes())], 0, 0, block=64) + tokens.END.encode()
    f, opened = tokens.File(content), []
    chunk = f.chunk
    monkeypatch.setattr(f, "chunk", lambda i: opened.append(i) or chunk(i))
    assert (f.slice(100, 200) == ids[100:200]).all() and opened == [1, 2, 3]
    assert len(f.slice(5, 5)) == 0 and (f.slice(990, 2000) == ids[990:]).all()
    assert f.null.tolist() == [False, True, False] and f.lengths.tolist() == [300, 0, 700]
    with pytest.raises(ValueError):
        tokens.File(content[:-1])


@settings(max_examples=300, deadline=None)
@example(" a")
@example("a  b")
@example("a b ")
@given(st.text(st.sampled_from("ab'sé β漢1, .\n\t\x1c |<>endoftx🙂"), max_size=60))
def test_units_are_as_the_whole(text):
    assert vocab.byte_level("byte_bpe_50k.json", plain=False)([text])[0] == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_query(spark, write):
    rows = [(i, t) for i, t in enumerate(TEXTS * 30)] + [(5000, "long text, " * 150_000)]
    frame = spark.createDataFrame([(k, t, "clash", {"a": 1}) for k, t in rows][::-1], "doc_id long, text string, start string, more map<string,int>")
    got = tokens.op11_token_ids(spark, write(frame, "documents"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want(rows)


def test_many_small_files_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "no id")] * 2 + [(3, "same id")] * 4 + [(k, f"text {k} " * k) for k in range(10, 60)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(5)
    tokens.write_ids(frame, f"{tmp_path}/ids", "k", "t", planes=32, file_ids=100)
    assert len(list((tmp_path / "ids").glob("part-*"))) > 20
    got = tokens.read_ids(spark, f"{tmp_path}/ids", with_ids=True).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want(rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)


def test_one_repeated_row_is_dealt_to_many_tasks(spark, tmp_path):
    frame = spark.range(4000).selectExpr("7L AS k", "'the same text' AS t").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_ids(frame, f"{tmp_path}/ids", "k", "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "ids").glob("part-*"))) > 1
    got = sorted(tuple(r) for r in tokens.read_ids(spark, f"{tmp_path}/ids").collect())
    assert got == want([(7, "the same text")] * 4000)


def test_empty_table(spark, write):
    assert tokens.op11_token_ids(spark, write(spark.createDataFrame([], "doc_id long, text string"), "documents")).collect() == []


def test_bytes_that_are_not_text(spark, tmp_path):
    frame = spark.sql("SELECT 1L AS k, cast(x'61FF62' AS string) AS t UNION ALL SELECT 2L, 'fine'")
    tokens.write_ids(frame, f"{tmp_path}/ids", "k", "t")
    assert sorted(tuple(r) for r in tokens.read_ids(spark, f"{tmp_path}/ids").collect()) == want([(1, "a�b"), (2, "fine")])


def test_a_file_being_made_holds_one_open_block_and_frames():
    made, ids = tokens.Packer(3, 1, block=1000), np.arange(700, dtype="<u4").tobytes()
    docs = [(None if i == 5 else i, ids[: 4 * (i % 701)]) for i in range(2000)]
    for key, d in docs:
        made.add(key, d)
        assert len(made.open) < 4 * 1000 and made.n_ids == sum(made.lengths)
    file = tokens.File(made.finish() + tokens.END.encode())
    assert [b"".join(p) for p in file.documents()] == [d for _, d in docs] and file.null.nonzero()[0].tolist() == [5]
    assert (file.task, file.number, file.n_ids) == (3, 1, made.n_ids)
