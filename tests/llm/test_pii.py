"""Personal data against a brute-force reading of the rules, on awkward texts and on sample documents."""

import hashlib
import random
import re

from lectern.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "", re.ASCII) if fits(kind, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def answers(spark, write, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r.doc_id: r for r in pii.op2_pii(spark, write(rows, "documents")).collect()}


def test_base_spans_equal_brute_force(spark, write):
    rnd = random.Random(5)
    pieces = ["4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "a@b.c", "x.y@z-1.de.", "_x@y.z", "10.0.0.256", "010.1.2.3", "1.2.3.4.5.6.7.8", "é😀", "@", ".", "+", " ", "\n", "-", "9", "00", "a", "@b.c@d.e"]
    texts = [None, "", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 30_000, "1." * 30_000]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(800)]
    got = answers(spark, write, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base(text)
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:200]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds.count(k) for k in pii.BASE]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_the_method_adds_checked_spans(spark, write):
    texts = ["pay to IBAN GB82 WEST 1234 5698 7654 32 now", "pay to IBAN GB83 WEST 1234 5698 7654 32 now", "call 12 4111111111111111 77", "her SSN is 078-05-1120.", "part 078-05-1120"]
    got = answers(spark, write, texts)
    assert [got[i].spans for i in range(5)] == ["iban:12:39", "", "card:8:24", "ssn:11:22", ""]
    assert all(got[i].n_card == 0 for i in range(5))


def test_words_near_a_number_decide(spark, write):
    card = "12 4111111111111111 77"
    texts = [f"call {card}", f"order {card}", f"order of the visa card {card}", "discard " + "x" * 3 + f" {card}", f"reorder {card}", f"{'far ' * 20}order{' far' * 20} {card}", "taxi 078-05-1120", "tax 078-05-1120"]
    got = answers(spark, write, texts)
    assert [got[i].spans != "" for i in range(len(texts))] == [True, False, True, True, True, True, False, True]
    assert (got[0].scores, got[2].scores, got[3].scores) == ("0.7", "0.6", "0.7")


def test_ibans_end_by_country_and_extras_do_not_overlap(spark, write):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 PLEASE PAY", "GB82WEST12345698765432X", "DE89370400440532013000 AND MORE", "NO9386011117947", "ZZ82 WEST 1234 5698 7654 32", "bank NL91 ABNA 0417 1643 00, BE68539007547034"]
    got = answers(spark, write, texts)
    assert [got[i].spans for i in range(6)] == ["iban:5:32", "", "iban:0:22", "iban:0:15", "", "iban:5:27,iban:29:45"]
    inside = "MT31 MALT 0110 0001 2345 MTLC AST0 01S FR14 2004 1010 0505 0001 3M02 606 4111111111111111"
    ends = [tuple(map(int, s.split(":")[1:])) for s in answers(spark, write, [inside, inside * 3])[1].spans.split(",") if s]
    assert ends == sorted(ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_empty_table_and_repeated_rows(spark, write):
    assert answers(spark, write, []) == {}
    rows = spark.createDataFrame([(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")], "doc_id long, text string")
    assert [r.spans for r in pii.op2_pii(spark, write(rows, "documents")).collect()] == ["email:0:5"] * 3
