"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text. Native: DataFrame functions only.

Corpus pass: the n-grams of all documents' words are counted in BUCKETS hash buckets, once for the raw corpus and once for the trusted
documents; only BUCKETS sums leave the executors. The trusted multinomial is smoothed towards the raw one (PRIOR n-grams of it), so that a bucket, or a corpus,
without trusted evidence has a ratio of 1, however large the corpus is. The two give one log ratio a bucket, a table of fixed size that is part of the
scoring expression. Document pass: the mean ratio over a document's n-grams, written once to the shared folder; then its comparison with a threshold.

The threshold is where labelled documents that don't fail the base rules are told apart with the fewest errors, each kind counting alike: the middle of the
widest such stretch between their scores. Every labelled document has its part: of the good ones a quarter (by hash of doc_id) in the threshold and the others in the
trusted multinomial, all poor ones in the threshold. Without both kinds nothing is rejected but by the base rules.

Defined results: a null text counts as empty; a text without words has zero counts and fails the base rules; a document without n-grams,
or a corpus without trusted documents, scores 0. Repeated rows are scored alike. Input columns beside doc_id and text are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, words

BUCKETS = 1 << 17
#: Orders of the n-grams: words and pairs of neighbours.
ORDERS = (1, 2)
#: Trusted ids are broadcast as words of 64 bits while there are so many words at most (32 million ids without gaps); beyond that the join shuffles.
BROADCAST_WORDS = 500_000
#: N-grams of the raw corpus that the trusted ones are mixed with.
PRIOR = 2_000.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def _pairs(hashes: Column) -> Column:
    return F.zip_with(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _part(doc_id: Column) -> Column:
    """0 to 3, by hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(4))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids labelled quality 1 but for the quarter kept for the threshold."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (_part(F.col("doc_id")) > 0)).select("doc_id").distinct()


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """t (1 for a trusted document) and text of every row of docs. 64 neighbouring ids are one word of bits, so that all trusted ids can be broadcast; where they have too many gaps for that, texts move."""
    place = lambda: F.col("doc_id").bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place())
    trusted = materialise(trusted_ids(labels).groupBy(F.shiftright("doc_id", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits")), "trusted")
    if trusted.count() <= BROADCAST_WORDS:
        trusted = F.broadcast(trusted)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.shiftright("doc_id", 6).alias("__word")).join(trusted, "__word", "left")
    return rows.select(F.coalesce(F.getbit("__bits", place()).cast("int"), F.lit(0)).alias("t"), "text")


def fit_log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, prior: float = PRIOR) -> list[float]:
    """log(p_trusted / p_raw) for each bucket. Each text is split once; its words and their pairs become buckets in generated code."""
    flagged = _flagged(docs, labels).select("t", words(F.col("text")).alias("w"))
    each = flagged.select("t", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("a", "b"))
    hashes = each.select("t", F.xxhash64("a").alias("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b"))
    grams = ([F.col("a")] if 1 in orders else []) + ([F.when(F.col("b").isNotNull(), F.xxhash64("a", "b"))] if 2 in orders else [])
    found = hashes.select("t", F.explode(F.array(*[_bucket(g, buckets) for g in grams])).alias("b")).where("b is not null")
    counts = found.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted")).collect()  # at most `buckets` rows
    raw, target = [0] * buckets, [0] * buckets
    for b, r, t in counts:
        raw[b], target[b] = r, t
    all_raw, all_target = sum(raw), sum(target)
    if not all_target:
        return [0.0] * buckets
    # p_target = (t + prior * r / R) / (T + prior); a bucket that the corpus doesn't have is never asked for
    scale = math.log(all_raw) - math.log(all_target + prior)
    return [math.log(t + prior * r / all_raw) - math.log(r) + scale if r else 0.0 for r, t in zip(raw, target, strict=True)]


def threshold_between(good: list[float], poor: list[float]) -> float:
    """The least error, each kind counting alike: the middle of the widest stretch between scores that has it. Minus infinity without both kinds. best_cut is the same for tables."""
    if not good or not poor:
        return float("-inf")
    scored = sorted([(x, 1 / len(good), 0.0) for x in good] + [(x, 0.0, 1 / len(poor)) for x in poor])
    best, found, lost, kept = (2.0, 0.0), scored[0][0], 0.0, 1.0
    for (x, g, p), (y, _, _) in zip(scored, scored[1:], strict=False):
        lost, kept = lost + g, kept - p  # a threshold between x and y rejects all up to x
        if y > x and (key := (round(lost + kept, 9), x - y)) < best:
            best, found = key, (x + y) / 2
    return found


def _n_repeat_words(h: Column) -> Column:
    """Words in 3-word windows found twice or more, from the words' hashes (bound to a lambda variable)."""
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    def repeated(by_hash: Column) -> Column:
        same = F.zip_with(by_hash, F.slice(by_hash, F.lit(2), F.size(by_hash)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        either = let(same, lambda s: F.zip_with(s, F.concat(F.array(F.lit(False)), F.slice(s, F.lit(1), F.size(s) - 1)), lambda x, y: x | y))
        at = F.filter(F.zip_with(by_hash, either, lambda x, hit: F.when(hit, x["i"])), lambda i: i.isNotNull())
        return let(F.sort_array(at), covered)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)))


def _scored(docs: DataFrame, ratios: list[float], orders: tuple[int, ...]) -> DataFrame:
    """doc_id, the counts, base_failed and score of every row of docs.

    All of a document's figures are one expression over its words and their hashes, bound to lambda variables: whatever a filter above makes of it, a text is
    never split or hashed again for each word.
    """
    buckets = len(ratios)
    # a literal array of fixed size: folded by the optimiser
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, _bucket(x, buckets)))

    def figures(text: Column, w: Column, h: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        sums, n = [], F.lit(0)
        if 1 in orders:
            sums, n = [total(h)], n + F.size(h)
        if 2 in orders:
            sums, n = [*sums, total(_pairs(h))], n + F.greatest(F.size(h) - 1, F.lit(0))
        score = F.when(n == 0, F.lit(0.0)).otherwise(sum(sums[1:], sums[0]) / n)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _n_repeat_words(h).cast("long").alias("n_repeat_words"),
            F.round(score, 6).alias("score"),
        )

    def of(text: Column) -> Column:
        return let(words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: figures(text, w, h)))

    counted = docs.select("doc_id", let(F.coalesce(F.col("text"), F.lit("")), of).alias("f")).select("doc_id", "f.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def best_cut(scores: DataFrame) -> float:
    """threshold_between of the scores of rows (score, good: 1 or 0), any number of them.

    Errors are whole numbers: good ones up to the cut times all poor ones, and poor ones beyond it times all good ones. Equal scores are one row; a score has six
    places, so a bin of a thousandth has 1,000 such rows at most and is summed by itself, from the sums of the bins before it (some ten thousand at most: log ratios are short).
    """
    counts = materialise(scores.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("poor")).withColumn("bin", F.floor(F.col("score") * 1000)), "cuts")
    good, poor, lowest = counts.agg(F.sum("good"), F.sum("poor"), F.min("score")).first()
    if not good or not poor:
        return float("-inf")
    order, inside = Window.orderBy("bin"), Window.partitionBy("bin").orderBy("score")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = counts.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("poor").alias("p"), F.min("score").alias("first"))
    bins = F.broadcast(bins.select("bin", before("g").alias("g"), before("p").alias("p"), F.lead("first").over(order).alias("first")))
    so_far = lambda c: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    each = counts.select("bin", "score", so_far("good").alias("lost"), so_far("poor").alias("caught"), F.lead("score").over(inside).alias("next")).join(bins, "bin")
    error = (F.col("g") + F.col("lost")) * poor + (poor - F.col("p") - F.col("caught")) * good
    cuts = each.withColumn("next", F.coalesce("next", "first")).where("next IS NOT NULL")
    best = cuts.agg(F.min(F.struct(error.alias("error"), (F.col("score") - F.col("next")).alias("stretch"), "score", "next"))).first()[0]
    return lowest if best is None else (best["score"] + best["next"]) / 2


def _threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold between the scores of all labelled documents; of the good ones, the quarter that is not trusted."""
    known = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 0) | ((F.col("quality") == 1) & (_part(F.col("doc_id")) == 0))))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("good"), F.min("quality").alias("__least")).where("good = __least").drop("__least")
    each = scored.select("doc_id", "score", "base_failed").join(known, "doc_id").groupBy("doc_id", "good").agg(F.min("score").alias("score"), F.min("base_failed").alias("base_failed"))
    return best_cut(each.where(~F.col("base_failed")).select("score", "good"))


def fit_threshold(docs: DataFrame, labels: DataFrame, ratios: list[float], orders: tuple[int, ...] = ORDERS) -> float:
    """The threshold between the scores of the labelled documents of docs."""
    return _threshold(_scored(docs, ratios, orders), labels)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float | None = None, orders: tuple[int, ...] = ORDERS, prior: float = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed, score (mean log ratio) and kept, for every row of docs. threshold: by default from the labels."""
    out = _scored(docs, fit_log_ratios(docs, labels, buckets, orders, prior), orders)
    if threshold is None:
        out = materialise(out, "scores")
        threshold = _threshold(out, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
