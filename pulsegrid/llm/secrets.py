"""Secret scans with corpus-wide ownership. Native: DataFrame functions only.

Patterns propose candidates in every text. The hash of each candidate's value is counted over the corpus by distinct repositories and owners
(distinct rows first, so a value copied a billion times shuffles as one row per task). A value seen at EXAMPLE_OWNERS owners or more is a copied
example; one that fewer owners hold looks live. Base kinds (assign, access, hex) stay in the spans either way; added kinds only while they look live.

Defined results: a null text counts as empty; a text without candidates gives zero counts, an empty span list and the SHA-256 of the empty
string; a null repository or owner counts as one of its own. Each row gives one row, repeated rows included. Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_spans, let, materialise, spans

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "private_key": r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "service_token": r"(?:ghp|gho|ghs|ghu|xoxb|xoxp|sk)[_-][A-Za-z0-9_-]{24,}",
}
BASE = ("assign", "access", "hex")
#: A quick test for texts that can hold a kind.
PROBES = {"access": "AKIA", "private_key": "PRIVATE KEY", "web_token": "eyJ"}
EXAMPLE_OWNERS = 3
_KIND = "array<struct<s:int,k:int,e:int,name:string,value:bigint>>"


def _found(text: Column, kind: str, number: int) -> Column:
    hits = spans(text, KINDS[kind])
    value = lambda x: x["m"]
    if kind == "assign":
        value = lambda x: F.regexp_extract(x["m"], ASSIGN, 1)
        hits = F.filter(hits, lambda x: F.length(value(x)) >= 6)
    each = F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"), F.lit(kind).alias("name"), F.xxhash64(value(x)).alias("value")))
    none = F.array().cast(_KIND)
    return F.when(F.contains(text, F.lit(PROBES[kind])), each).otherwise(none) if kind in PROBES else each


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_repos, n_owners of candidates(value, repo, owner)."""
    once = candidates.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))
    owners = once.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _scanned(docs: DataFrame, keep: list[Column], repo: Column | None, owner: Column | None) -> DataFrame:
    """keep, repo, owner, row, base, added of every row, written once: texts are scanned once, and row numbers stay the same for all uses."""
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit("?"))
    repo = F.coalesce(repo if repo is not None else F.concat_ws("/", "source", "lang"), F.lit("?"))
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.struct(*keep).alias("__row"), repo.alias("repo"), owner.alias("owner"), F.monotonically_increasing_id().alias("row"), *[_found(text, k, n).alias(f"__{k}") for n, k in enumerate(KINDS)])
    base, added = F.concat(*[f"__{k}" for k in BASE]), F.concat(*[f"__{k}" for k in KINDS if k not in BASE])
    return materialise(each.select("__row", "repo", "owner", "row", base.alias("base"), added.alias("added")), "scanned")


def _verdicts(scanned: DataFrame, example_owners: int) -> DataFrame:
    """row, live (spans that look live: s, k, e, name), n_live, n_example, of every row with candidates."""
    candidates = scanned.select("row", "repo", "owner", F.explode(F.concat("base", "added")).alias("x")).select("row", "repo", "owner", F.col("x.value").alias("value"), F.struct("x.s", "x.k", "x.e", "x.name").alias("at"))
    freq = materialise(ownership(candidates), "ownership")
    verdicts = candidates.join(freq, "value").select("row", F.when(F.col("n_owners") < example_owners, F.col("at")).alias("live"))
    return verdicts.groupBy("row").agg(F.collect_set("live").alias("live"), F.count("live").alias("n_live"), F.count_if(F.col("live").isNull()).alias("n_example"))


def secret_scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_spans (how many), n_live and n_example, for every row of docs.

    repo and owner tell whose a document is; by default its source is the owner, and its source and language the repository.
    """
    scanned = _scanned(docs, [F.col("doc_id")], repo, owner)
    out = scanned.select(F.col("__row.doc_id").alias("doc_id"), "row", "base", "added").join(_verdicts(scanned, example_owners), "row", "left")
    places = F.transform(F.coalesce("live", F.array().cast("array<struct<s:int,k:int,e:int,name:string>>")), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k")))
    kept = let(places, lambda p: F.filter("added", lambda x: F.array_contains(p, F.struct(x["s"].alias("s"), x["k"].alias("k")))))
    count = lambda k: F.size(F.filter("base", lambda x: x["name"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", kept)).alias("spans"),
        F.size(F.concat("base", kept)).cast("long").alias("n_spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with a mark in place of each span that looks live (of overlapping ones, the first); n_chars, if there, follows the text.

    Only rows with candidates are shuffled.
    """
    scanned = _scanned(docs, [F.col(c) for c in docs.columns], repo, owner)
    has = F.size("base") + F.size("added") > 0
    clean = scanned.where(~has).select("__row.*")
    found = scanned.where(has).select("__row", "row").join(_verdicts(scanned.where(has), example_owners), "row")
    kind = "struct<end:int,out:array<struct<from:int,s:int,name:string>>>"
    apart = F.aggregate(
        F.sort_array("live"),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,s:int,name:string>>").alias("out")).cast(kind),
        lambda a, x: F.when(x["s"] < a["end"], a).otherwise(F.struct(x["e"].alias("end"), F.concat(a["out"], F.array(F.struct(a["end"].alias("from"), x["s"].alias("s"), x["name"].alias("name")))).alias("out")).cast(kind)),
    )
    text = F.col("__row.text")
    cut = let(apart, lambda a: F.concat(F.array_join(F.transform(a["out"], lambda x: F.concat(F.substring(text, x["from"] + 1, x["s"] - x["from"]), F.lit("["), x["name"], F.lit("]"))), ""), F.substring(text, a["end"] + 1, F.length(text))))
    new = F.when(F.col("n_live") == 0, text).otherwise(cut)
    values = {c: F.col("__row").getField(c) for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("n_live") == 0, F.col("__row.n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return clean.unionByName(found.select(*[values[c].alias(c) for c in docs.columns]))
