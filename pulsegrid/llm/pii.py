"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score. Native: DataFrame functions only.

Base kinds (email, ip, card, phone) always stay when their check passes. The method adds iban (confirmed by mod 97) and national_id (a digit
pattern that counts only if the words before it lift its score to ACCEPT).

The patterns are forms of the fixed ones that match the same spans in linear time and without deep recursion: a run starts only where the last
match ended or no character of the run stands before, and card digits are matched in pieces of at most 200, of which only a whole run can pass. An iban has the
length of its country and ends at a word's end, so that words and digits behind it don't count.

Defined results: a null text counts as empty; a text without spans gives zero counts, an empty span list and the SHA-256 of the empty string.
Each row gives one row, repeated rows included. Input columns beside doc_id and text are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_spans, let, spans

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,199}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an iban by country. Fixed values of the public registry.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "TL GI IQ IL AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG",
    25: "PT ST LY", 26: "IS TR", 27: "FR GR IT MR MC SM BI", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA EG", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + r")(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Score of a confirmed span; a context word before it adds LIFT; added kinds need ACCEPT.
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.8, "national_id": 0.3}
CONTEXT_WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte|pay",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "national_id": "ssn|social|security|national|ident|tax",
}
LIFT, ACCEPT, CONTEXT = 0.3, 0.6, 40
KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national_id": NATIONAL_ID}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The number made of the account, country and check digits leaves 1 on division by 97 (letters count as 10 to 35)."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":  # not a piece of a longer run
        return let(_digits(x["m"]), lambda d: (F.length(d) <= 19) & ~x["c"].isin("", " ", "-") & luhn(d))
    if kind == "phone":
        return F.length(_digits(x["m"])).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(x["m"], F.lit(" "), F.lit("")))
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """array<struct<s,k,e,name,score>> of one kind's confirmed spans."""
    number = KINDS.index(kind)
    if kind == "card":
        # one character more in front: a piece right behind another one has '' or a separator as context, the first one never
        hits = F.transform(spans(F.concat(F.lit("\n\n"), text), CARD, CONTEXT), lambda x: F.struct((x["s"] - 2).alias("s"), (x["e"] - 2).alias("e"), x["m"].alias("m"), x["c"].alias("c")))
    else:
        hits = spans(text, PATTERNS[kind], CONTEXT)
    lift = lambda x: F.when(F.lower(x["c"]).rlike(CONTEXT_WORDS[kind]), F.lit(LIFT)).otherwise(F.lit(0.0))
    scored = F.transform(
        F.filter(hits, lambda x: _confirmed(kind, x)),
        lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), F.lit(kind).alias("name"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + lift(x)).alias("score")),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int,name:string,score:double>>")
    probe = {"email": "@", "phone": "+"}.get(kind)
    if probe:
        return F.when(F.contains(text, F.lit(probe)), scored).otherwise(none)
    return scored


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, n_spans (how many), and scores ('kind:start:score')."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = rows.select("doc_id", *[_found(F.col("text"), k).alias(k) for k in KINDS])
    kept = lambda k: F.filter(k, lambda x: x["score"] >= ACCEPT)
    base = F.concat(*BASE)
    return each.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.concat(base, *[kept(k) for k in KINDS[4:]])).alias("spans"),
        F.size(F.concat(base, *[kept(k) for k in KINDS[4:]])).cast("long").alias("n_spans"),
        F.array_join(F.transform(F.sort_array(F.concat(base, *[kept(k) for k in KINDS[4:]])), lambda x: F.concat_ws(":", x["name"], x["s"], F.format_number(x["score"], 1))), ",").alias("scores"),
    )
