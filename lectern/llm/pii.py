"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

DataFrame functions only.  Each kind's pattern is matched over the whole text, leftmost first and without
overlaps; the pieces between matches give their offsets, in code points, with the end exclusive.  The base
patterns (email, ip, card, phone) are written so that they match in linear time and keep only what their
rule can accept; what a rule rejects is not tried again.  Base spans always stay.  Further proposals - a card
number in a longer run of digits, an IBAN, a US social security number - need a score of ``ENOUGH`` and must
not overlap a base span: a kind's prior, plus ``CHECKED`` if a checksum confirms it (those with a checksum
must pass it), plus ``NEAR`` if one of the kind's words stands within ``REACH`` characters, less ``AWAY`` if
a word stands there that says the number is another thing.  So a card number or an IBAN goes by its checksum unless
such a word speaks against it, and a social security number needs a word for it.  Of further proposals that overlap, the one with the better score stays, of equal ones the longer, then the first.
An IBAN ends where its country's length ends it, whatever follows.

A null or empty text has no spans.  Repeated rows are answered each by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import settle, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ENOUGH, CHECKED, NEAR, AWAY, REACH = 0.6, 0.3, 0.2, 0.3, 40

#: (kind, base, text must match this to be searched, pattern)
PATTERNS = (
    ("email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, "[0-9][.][0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "[0-9]{2}|[0-9][ -][0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"),
    ("phone", True, "[+][0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("card", False, "[0-9]{4}", r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{15,16})(?![0-9])"),
    ("iban", False, "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    ("ssn", False, "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)

PRIORS = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.5, "ssn": 0.4}
WORDS = {
    "email": "mail|e-?mail|contact|write to",
    "ip": "address|host|server|login|ip",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|telephone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax",
}
#: Words of numbers that are no personal data.
OTHER = "order|invoice|tracking|serial|isbn|version|part|sku|ticket"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(code: Column) -> Column:
    """Whether a code without blanks passes the mod-97 check of ISO 13616."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.pmod(acc * F.when(c < "A", 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _passes(kind: Column, match: Column) -> Column:
    """Whether a match keeps to its kind's rule and checksum."""
    n = F.length(_digits(match))
    octet = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
    return (
        F.when(kind == "ip", F.forall(F.split(match, r"\."), octet))
        .when(kind == "card", n.between(12, 19) & F.call_function("luhn_check", _digits(match)))
        .when(kind == "phone", n.between(9, 15))
        .when(kind == "iban", mod97(F.regexp_replace(match, " ", "")))
        .otherwise(True)
    )


def _iban_part(match: Column) -> Column:
    """The part of a match that is as long as its country's IBANs; empty if that would end inside a word, or the country is unknown."""
    size = F.try_element_at(F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv)), F.left(match, F.lit(2)))
    part = F.call_function("regexp_extract", match, F.concat(F.lit("^(?:[A-Z0-9] ?){"), (size - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Z0-9])")), F.lit(0))
    return F.coalesce(part, F.lit(""))


def _apart(extras: Column) -> Column:
    """Spans by start, of which overlapping ones leave the best."""
    none = F.filter(extras, lambda x: F.lit(False))
    worth = lambda x: F.struct(x["score"], x["end"] - x["start"], -x["start"], -x["rank"])
    start = F.struct(none.alias("done"), F.get(extras, F.lit(0)).alias("last"))

    def step(a: Column, x: Column) -> Column:
        clear, better = x["start"] >= a["last"]["end"], worth(x) > worth(a["last"])
        done = F.when(clear, F.array_append(a["done"], a["last"])).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(clear | better, x).otherwise(a["last"]).alias("last"))

    rest = F.slice(extras, F.lit(2), F.greatest(F.size(extras) - 1, F.lit(0)))
    return F.when(F.size(extras) > 1, F.aggregate(rest, start, step, lambda a: F.array_append(a["done"], a["last"]))).otherwise(extras)


def _by_kind(kind: Column, values: dict) -> Column:
    return reduce(lambda c, k: c.when(kind == k, F.lit(values[k])), list(values)[1:], F.when(kind == next(iter(values)), F.lit(values[next(iter(values))])))


def spans(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, spans) of every row; spans are (start, kind, end, base, score), by start and then kind."""
    body = F.col(text)
    searched = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            F.when(body.rlike(hint), F.split(body, pattern, -1)).alias("pieces"),
            F.when(body.rlike(hint), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("found"),
        )
        for kind, base, hint, pattern in PATTERNS
    ]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("id"), F.array(*searched).alias("all"))
    rows = rows.select("row", "id", F.explode_outer(F.filter("all", lambda s: F.size(s["found"]) > 0)).alias("s")).select("row", "id", "s.*")
    place = lambda m, i: F.struct(
        F.length(F.element_at("pieces", i + 1)).alias("gap"),
        m.alias("match"),
        F.lower(F.concat(F.right(F.element_at("pieces", i + 1), F.lit(REACH)), F.lit(" "), F.left(F.element_at("pieces", i + 2), F.lit(REACH)))).alias("around"),
    )
    rows = settle(rows.select("row", "id", "kind", "base", F.transform("found", place).alias("found")), "pii-proposals")

    each = rows.filter(F.col("kind").isNotNull()).select("row", "kind", "base", F.posexplode("found").alias("n", "m")).select("row", "kind", "base", "n", "m.*")
    so_far = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "kind", "base").orderBy("n"))
    kind = F.col("kind")
    checked = F.when(kind.isin("card", "iban"), CHECKED).otherwise(0.0)
    said = lambda words: F.col("around").rlike(rf"(?<![a-z])(?:{words})s?(?![a-z])")
    near = F.when(reduce(lambda c, k: c | ((kind == k) & said(WORDS[k])), WORDS, F.lit(False)), NEAR).otherwise(0.0)
    away = F.when(~F.col("base") & said(OTHER), AWAY).otherwise(0.0)
    each = each.withColumn("end", so_far.cast("int")).withColumn("start", F.col("end") - F.length("match"))
    each = each.withColumn("match", F.when(kind == "iban", _iban_part(F.col("match"))).otherwise(F.col("match"))).withColumn("end", F.col("start") + F.length("match"))
    each = each.filter((F.col("end") > F.col("start")) & _passes(kind, F.col("match")))
    each = each.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _by_kind(kind, PRIORS) + checked + near - away)), 2))
    each = each.filter(F.col("base") | (F.col("score") >= ENOUGH))

    order = Window.partitionBy("row").orderBy("start", "end", F.col("base").desc())
    before = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    each = each.withColumn("clear", clear).filter(F.col("base") | F.col("clear"))
    rank = _by_kind(kind, {k: i for i, k in enumerate(KINDS)})
    ordered = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base", "score")))
    kept = each.groupBy("row").agg(ordered.alias("spans"))
    extras = _apart(F.filter("spans", lambda s: ~s["base"]))
    kept = kept.withColumn("spans", F.array_sort(F.concat(F.filter("spans", lambda s: s["base"]), extras)))
    everyone = rows.select("row", F.col("id").alias(doc)).distinct()
    return everyone.join(kept, "row", "left").select(doc, F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,base:boolean,score:double>>)")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
