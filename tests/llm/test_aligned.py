"""Alignment against tokens held next to each other one by one, and the laws of the monoid."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import aligned, vocab

A = Tokenizer.from_file(public_tokenizers.path(aligned.A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(aligned.B))
ODD = ["<|endoftext|> <s> x", "  two  spaces ", " lead", "a\n\nb\n c\td", "Ωβ漢字🙂 naïve", "▁under", "it's the 'others', the others'", "\x00nul", " x", "1234567 8.9e10", "x" * 300]


def parts(text):
    """(A tokens, B tokens) as (start, end, id), or None."""
    want, out = (" " + text).encode(), []
    byte = {c: b for b, c in _byte_chars().items()}
    for ids, of in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in A.id_to_token(i))), (B.encode(text), _piece)):
        at, row = 0, []
        for i in ids:
            row.append((at, at + len(of(i)), i))
            at = row[-1][1]
        if b"".join(map(of, ids)) != want:
            return None
        out.append(row)
    return out if text else None


def _byte_chars():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _piece(i):
    p = B.id_to_piece(i)
    m = re.fullmatch("<0x(..)>", p)
    return bytes.fromhex(m[1]) if m else p.replace("▁", " ").encode()


def want(rows):
    corpus, docs = Counter(), []
    for key, text in rows:
        found = parts(text or "")
        if not found:
            docs.append((key, 0, 0, 0, [], ""))
            continue
        a, b = found
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [([], []) for _ in ends]
        for n, side in enumerate(found):
            for _, e, i in side:
                groups[bisect_left(ends, e)][n].append(str(i))
        listed = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        links, j0 = [], 0
        for s, e, i in a:
            while b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][0] < e:
                links.append((i, b[j][2]))
                j += 1
        corpus.update(links)
        docs.append((key, len(a), len(b), len(ends), links, hashlib.sha256(listed.encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in corpus.items():
        best[y] = max(best[y], n)
    return sorted(((k, x, y, g, len(l), sum(corpus[p] == best[p[1]] for p in l), sum(corpus[p] for p in l), d) for k, x, y, g, l, d in docs), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def some_texts():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]


def test_query(spark, write, some_texts):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", *some_texts])] + [(None, "no id"), (None, None), (4, "again"), (4, "again")]
    frame = spark.createDataFrame([(k, t, "clash", {"a": 1}) for k, t in rows], "doc_id long, text string, groups string, more map<string,int>")
    got = aligned.op13_alignment(spark, write(frame.repartition(5), "documents"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == want(rows)


def test_long_texts_in_ranges_and_rare_pairs_by_join(spark, write, some_texts, monkeypatch):
    rows = [(i, t) for i, t in enumerate(some_texts[:20])] + [(100, " ".join(t or "" for t in some_texts)[:9000]), (101, "x" * 3000 + " tail"), (102, "漢字🙂" * 400)]
    path = write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")
    query, score = aligned.aligned, aligned.scored
    monkeypatch.setattr(aligned, "aligned", lambda docs: query(docs, size=64))
    monkeypatch.setattr(aligned, "scored", lambda links, counts: score(links, counts, 40))
    assert rows_of(aligned.op13_alignment(spark, path)) == want(rows)


def test_texts_of_many_runs(spark, monkeypatch):
    text = "some words, and others. " * 500
    whole = (vocab.byte_level(aligned.A, plain=True, spaced=True)([text])[0], vocab.pieces(aligned.B)([text])[0])
    monkeypatch.setattr(vocab, "RUN", 50)
    monkeypatch.setattr(vocab.runs, "__defaults__", (50,))
    assert whole == (vocab.byte_level(aligned.A, plain=True, spaced=True)([text])[0], vocab.pieces(aligned.B)([text])[0])
    assert vocab.numbers(whole[1]).tolist() == B.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sé β漢1, .\n\t\x1c |<>▁🙂"), max_size=60))
def test_units_are_as_the_whole(text):
    assert vocab.numbers(vocab.pieces(aligned.B)([text])[0]).tolist() == B.encode(text)
    assert vocab.numbers(vocab.byte_level(aligned.A, plain=True, spaced=True)([text])[0]).tolist() == A.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("the quick brown Ωβ漢🙂-é"), min_size=1, max_size=80), st.lists(st.integers(0, 120), min_size=2, max_size=2))
def test_composition_is_associative(text, bounds):
    v = aligned.vocabularies(aligned.A, aligned.B)
    found = v.tokens([text])[0]
    ends = [aligned.np.cumsum(n[i]) for n, i in zip((v.long_a, v.long_b), found)]
    fragments, inner = [], []
    for lo, hi in zip([0, *sorted(bounds)], [*sorted(bounds), 10_000]):
        i = [aligned.np.searchsorted(e, [lo, hi], "right") for e in ends]
        f, g = aligned.fragment(v, *(ids[x:y] for ids, (x, y) in zip(found, i)), *(int(e[x - 1]) if x else 0 for e, (x, _) in zip(ends, i)))
        fragments.append(f)
        inner.append(g)
    x, y, z = fragments
    (xy, g1), (yz, h1) = aligned.composed(v, x, y), aligned.composed(v, y, z)
    (left, g2), (right, h2) = aligned.composed(v, xy, z), aligned.composed(v, x, yz)
    shown = lambda f: (f.cut, *(ids.tolist() for ids in (*f.prefix, *f.suffix)))
    assert shown(left) == shown(right)
    assert sorted(g.text for g in (g1, g2) if g) == sorted(g.text for g in (h1, h2) if g)
    texts = Counter(";".join(g.text.rstrip(";") for g in (aligned.closed(v, *left.prefix), g1, g2, *inner) if g).split(";"))
    assert texts == Counter(aligned.closed(v, *found).text.rstrip(";").split(";")) and not len(left.suffix[0])


def test_empty_table(spark, write):
    assert aligned.op13_alignment(spark, write(spark.createDataFrame([], "doc_id long, text string"), "documents")).collect() == []
