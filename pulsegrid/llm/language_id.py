"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined in log space for each language: the likelihood of the text under hashed byte trigrams (tempered, since the
trigrams of a text aren't independent), the declared markup language (through the rate at which declarations and texts disagree in this corpus), the
address suffix and the host. The last two are priors computed by grouped aggregation of first guesses, smoothed hierarchically: the corpus prior
smooths each suffix, and the suffix prior each host.

Beside the languages stands an unknown class: letters drawn one by one, as often as the fit texts have them, or any trigram alike. Every language's
table gives the same share UNSEEN to trigrams it hasn't met, whatever its sample. So text that no fitted language explains better than loose letters (other
languages, gibberish) goes to the unknown class and is rejected; lang_posterior is the best language's share among all languages and the unknown class.

Every declared language is a candidate; tags with a script or region (en-US, pt_BR, zh-Hant) count as their language. A language's trigram table is
fitted on all its documents, or beyond FIT_DOCS of them on about FIT_DOCS, taken by hash of doc_id; all other counts cover every row. A language with
too little text to tell is rejected, not renamed. Tables take half a MB a language on each worker.

Each text is scored once: the columns to pass on are written with their scores, and counts and verdicts are made from that table. The priors of hosts are
broadcast up to BROADCAST_CELLS hosts x languages; with more hosts, those with most rows are broadcast and only the rows of the others move, once, to
their hosts. So no host's rows come together, however many it has.

Only trigrams with two letters or more count: digits and punctuation speak for no language.

Defined results: null text and text without letters have no text evidence and are rejected (lang still names the best guess from the other evidence); a null or unknown declaration is no evidence; null
hosts share one prior. A corpus without declarations gives lang null and rejects nothing. Input columns are passed on, except lang_id, lang_posterior
and lang_kept, which are replaced. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import materialise, scratch

#: Documents of each language that its trigram table is fitted on.
FIT_DOCS = 4000
BITS = 17
#: Share of each language's table that is spread over all buckets, met or not: equal for every language.
UNSEEN = 0.1
#: Prior of the unknown class.
UNKNOWN = 0.01
#: A text counts as at most so many independent trigrams.
EFFECTIVE = 80
#: Pseudo-counts that a suffix takes from the corpus, and a host from its suffix.
SMOOTHING = 25.0
MIN_POSTERIOR = 0.5
BROADCAST_CELLS = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)]).astype(np.int8)


def _hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _lettered(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a lower-cased text, and whether a trigram of two letters or more begins at each."""
    b = np.frombuffer(text.translate(_LOWER), dtype=np.uint8)
    if len(b) < 3:
        return b, np.zeros(0, dtype=bool)
    letter = _LETTER[b]
    return b, letter[:-2] + letter[1:-1] + letter[2:] >= 2


def trigrams(text: bytes) -> np.ndarray:
    """Hash bucket of each byte trigram with two letters or more of a lower-cased text."""
    b, at = _lettered(text)
    if not len(at):
        return np.zeros(0, dtype=np.uint32)
    b = b.astype(np.uint32)
    return _hashed(b[:-2], b[1:-1], b[2:])[at]


def _unknown(letters: np.ndarray) -> np.ndarray:
    """p(bucket | unknown) from the counts of 256 bytes: half of independent bytes, half of any bucket alike."""
    out = np.full(1 << BITS, 1.0)
    met = np.flatnonzero(letters).astype(np.uint32)
    if len(met):
        share = letters[met] / letters.sum()
        pairs = _LETTER[met][:, None] + _LETTER[met][None, :]
        drawn = np.zeros(1 << BITS)
        for first, p in zip(met, share, strict=True):
            b, c = np.nonzero(_LETTER[first] + pairs >= 2)
            drawn += np.bincount(_hashed(first, met[b], met[c]), weights=p * share[b] * share[c], minlength=1 << BITS)
        if drawn.any():
            out = out / (1 << BITS) + drawn / drawn.sum()
    return out / out.sum()


def _has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, declared: Column, limit: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, and log p(bucket | language) as (languages + 1, buckets), the unknown class last, from a bounded sample of declared documents."""
    rows = docs.select("doc_id", declared.alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    number = {x: k for k, x in enumerate(langs)}
    spark = docs.sparkSession
    shares = F.broadcast(spark.createDataFrame([(x, min(1.0, limit / sizes[x])) for x in langs], "lang string, share double"))
    drawn = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(shares, "lang").where(drawn < F.col("share")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                keys, letters = [], np.zeros(256, dtype=np.int64)
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    keys.append(trigrams(text).astype(np.int64) + (number[lang] << BITS))
                    b, at = _lettered(text)
                    for shift in range(3 if len(at) else 0):
                        letters += np.bincount(b[shift : len(at) + shift][at], minlength=256)
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": (key >> BITS).astype(np.int32), "b": (key & ((1 << BITS) - 1)).astype(np.int32), "n": n.astype(np.int64)})
                b = np.flatnonzero(letters)
                yield pa.RecordBatch.from_pydict({"k": np.full(len(b), -1, dtype=np.int32), "b": b.astype(np.int32), "n": letters[b]})

    found = sample.mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()  # the buckets met by each language
    k, b, n = (found.column(x).to_numpy() for x in ("k", "b", "n"))
    letters = np.zeros(256)
    letters[b[k < 0]] = n[k < 0]
    k, b, n = k[k >= 0], b[k >= 0], n[k >= 0]
    totals = np.bincount(k, weights=n, minlength=len(langs))
    table = np.full((len(langs) + 1, 1 << BITS), math.log(UNSEEN / (1 << BITS)), dtype=np.float32)
    table[k, b] = np.log((1 - UNSEEN) * n / totals[k] + UNSEEN / (1 << BITS))
    table[-1] = np.log(_unknown(letters))
    return langs, table


def _scored(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows, with the array of its tempered log likelihoods, less the largest, in place of each text (column __text)."""
    flat = np.ascontiguousarray(table.T.astype(np.float32))
    width = flat.shape[1]
    fields = [f for f in rows.schema if f.name != "__text"]
    schema = StructType([*fields, StructField("__text", ArrayType(DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                out = np.zeros((some.num_rows, width))
                for i, text in enumerate(some.column(some.num_columns - 1).cast(pa.binary())):
                    grams = trigrams(text.as_py() or b"")
                    if len(grams):
                        for at in range(0, len(grams), 1 << 16):
                            out[i] += flat[grams[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                        out[i] *= min(1.0, EFFECTIVE / len(grams))
                        out[i] = (out[i] - out[i].max()).round(6)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], scores], names=[*[f.name for f in fields], "__text"])

    return rows.select(*[f.name for f in fields], "__text").mapInArrow(score, schema)


def _best(scores: Column) -> Column:
    """Position (from 1) of the largest; the first of equal ones, so a language before the unknown class."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _language(tag: Column) -> Column:
    """A declaration in lower case, without script and region; null if blank."""
    tag = F.lower(F.btrim(tag))
    return F.nullif(F.regexp_replace(tag, r"^([a-z]{2,3})[-_](?:[a-z]{2}|[a-z]{4}|[0-9]{3})(?:[-_].*)?$", "$1"), F.lit(""))


def identify(docs: DataFrame, declared: Column | None = None, host: Column | None = None, min_posterior: float = MIN_POSTERIOR, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_id, lang_posterior and lang_kept. By default lang is the declaration, source the host, and all columns are kept."""
    declared = _language(declared if declared is not None else F.col("lang"))
    host = F.coalesce(host if host is not None else F.col("source"), F.lit(""))
    keep = [c for c in keep or docs.columns if c not in ("lang_id", "lang_posterior", "lang_kept")]
    spark = docs.sparkSession
    langs, table = fit(docs, declared)
    if not langs:
        return docs.select(*keep, F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("lang_posterior"), F.lit(True).alias("lang_kept"))
    n = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    suffix = F.lower(F.regexp_extract(host, r"\.([A-Za-z]{2,})(?::[0-9]+)?$", 1))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("__row"), F.array_position(names, F.coalesce(declared, F.lit(""))).alias("__said"), host.alias("__host"), suffix.alias("__suffix"), _has_letters(F.col("text")).alias("__letters"), F.col("text").alias("__text"))
    evidence = materialise(_scored(rows, table), "evidence")

    with scratch(spark):
        # how often declarations agree with texts, and first guesses by host: both in one pass over the corpus; what goes to the unknown class has no guess
        best = _best(F.col("__text"))
        guess = F.when(F.col("__letters") & (best <= n), best)
        counted = evidence.groupBy("__host", "__suffix", guess.alias("guess"), (F.col("__said") == guess).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__said") > 0).alias("told"))
        counted = materialise(counted, "guesses")
        sums = counted.where("guess is not null").groupBy("guess").agg(F.sum("n").alias("n"), F.sum("told").alias("told"), F.sum(F.when(F.col("same"), F.col("told")).otherwise(0)).alias("agree"))
        sums = {r["guess"]: (r["n"], r["told"], r["agree"]) for r in sums.collect()}  # one row a language
        told, agree = sum(v[1] for v in sums.values()), sum(v[2] for v in sums.values())
        differ = min(0.4, max(1e-3, (told - agree + 1) / (told + 2)))
        all_n = sum(v[0] for v in sums.values())
        corpus = [(sums.get(k + 1, (0,))[0] + 1) / (all_n + n) for k in range(n)]
        prior = F.array(*[F.lit(p) for p in corpus])

        def guesses(*keys):
            each = counted.groupBy(*keys, "guess").agg(F.sum("n").alias("n"))
            found = F.filter(F.collect_list(F.struct("guess", "n")), lambda x: x["guess"].isNotNull())  # an entry a language at most
            return each.groupBy(*keys).agg(F.map_from_entries(found).alias("__n"), F.coalesce(F.sum(F.when(F.col("guess").isNotNull(), F.col("n"))), F.lit(0)).alias("__all"), F.sum("n").alias("__rows"))

        def shares(smooth: Column) -> Column:
            return F.transform(smooth, lambda p, k: (F.coalesce(F.try_element_at("__n", k + 1), F.lit(0)) + F.lit(SMOOTHING) * p) / (F.col("__all") + F.lit(SMOOTHING)))

        suffixes = guesses("__suffix").select("__suffix", shares(prior).alias("__suffix_prior"))
        hosts = guesses("__host", "__suffix").join(suffixes, "__suffix")
        hosts = hosts.select(F.col("__host").alias("__h"), F.transform(shares(F.col("__suffix_prior")), lambda p: F.log(p)).alias("__prior"), "__rows")
        hosts = materialise(hosts, "hosts", outer=True)
        room = max(1, BROADCAST_CELLS // n)
        many = hosts.count() > room
        heavy = materialise(hosts.orderBy(F.desc("__rows"), "__h").limit(room), "heavy", outer=True) if many else hosts

    joined = evidence.join(F.broadcast(heavy.drop("__rows")), F.col("__host") == F.col("__h"), "left")
    if many:
        light = hosts.join(F.broadcast(heavy.select("__h")), "__h", "left_anti").select("__h", "__prior")
        rest = joined.where("__prior is null").drop("__h", "__prior").join(light, F.col("__host") == F.col("__h"))
        joined = joined.where("__prior is not null").unionByName(rest)
    declares = F.col("__said") > 0
    said = F.transform(names, lambda x, k: F.when(~declares, F.lit(0.0)).when(k + 1 == F.col("__said"), F.lit(math.log(1 - differ))).otherwise(F.lit(math.log(differ / max(1, n - 1)))))
    logs = F.zip_with(F.zip_with(F.slice("__text", 1, n), said, lambda a, b: a + b), F.col("__prior"), lambda a, b: a + b)
    unknown = F.get("__text", F.lit(n)) + F.when(declares, F.lit(-math.log(n))).otherwise(F.lit(0.0)) + F.lit(math.log(UNKNOWN))
    fused = joined.select("__row", "__letters", logs.alias("__logs"), unknown.alias("__unknown"))
    top = F.array_max("__logs")
    posterior = 1 / F.aggregate(F.transform("__logs", lambda x: F.exp(x - F.array_max("__logs"))), F.exp(F.col("__unknown") - top), lambda a, x: a + x)
    judged = fused.select("__row", F.element_at(names, F.array_position("__logs", top).cast("int")).alias("lang_id"), F.round(posterior, 6).alias("lang_posterior"), "__letters")
    return judged.select(*[F.col("__row").getField(c).alias(c) for c in keep], "lang_id", "lang_posterior", (F.col("__letters") & (F.col("lang_posterior") >= min_posterior)).alias("lang_kept"))
