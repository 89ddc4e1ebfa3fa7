"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Texts are cut into lower-cased runs of word characters and of symbols; their unigrams and bigrams are hashed into a
fixed number of buckets.  Two smoothed multinomials over the buckets are estimated, one from all trusted documents and one
from every document; the target is smoothed towards the raw one, so that little evidence says little.  A text's score is
the mean over its n-grams of log p_target - log p_raw.  Every document is
held against one fixed threshold; nothing is drawn at random.

Everything runs as DataFrame expressions.  The tables of the two multinomials have ``buckets`` rows whatever the input's
size, and reach the scoring expression as a scalar subquery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Runs of letters, digits and underscores, or of other visible characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\x09-\x0D]+"
SYMBOL = "[#*$%&|<>]"
#: Ids of trusted documents that are broadcast; more meet the documents by a shuffle.
BROADCAST_IDS = 1 << 21


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 16384
    #: N-grams added to each bucket of the raw model.
    smoothing: float = 1.0
    #: N-grams, spread as the raw model has them, that are added to those of the trusted documents.
    prior: float = 16384.0
    #: Documents whose mean log ratio is lower go.
    threshold: float = -0.4
    min_words: int = 10
    max_repeat_percent: int = 20


def _ngram_buckets(text: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams, repeats included."""

    def grams(hashes: Column) -> Column:
        pairs = F.zip_with(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
            F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )
        return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))

    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), grams)


def log_ratio_table(docs: DataFrame, trusted: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row with ``table``: the log ratio of each bucket, by bucket number; all zero without trusted documents.

    docs: doc_id, text.  trusted: doc_id of documents known to be good, all of which count; nulls do not, repeats once.
    """
    chosen = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    grams = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(chosen, F.col("doc_id") == F.col("trusted_id"), "left")
        .select(
            F.when(F.col("trusted_id").isNotNull(), 1).otherwise(0).alias("target"),
            F.explode(_ngram_buckets(F.col("text"), params.buckets)).alias("bucket"),
        )
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    b = params.buckets
    # every bucket has a row, seen or not, so that a bucket's number is its place in the array
    every = docs.sparkSession.range(b).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("raw"), F.lit(0).alias("target"))
    rows = counts.unionByName(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return rows.agg(
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
    ).select(F.transform("cells", lambda c: _log_ratio(c["target"], c["raw"], params)).alias("table"))


def _log_ratio(target: Column, raw: Column, params: QualityParams) -> Column:
    p_raw = (raw + F.lit(params.smoothing)) / (F.col("n_raw") + F.lit(params.smoothing * params.buckets))
    prior = F.lit(params.prior)
    return F.log((target + prior * p_raw) / (F.col("n_target") + prior)) - F.log(p_raw)


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text holds twice or more, the first such window included."""

    def covered(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("at"))
        total = F.aggregate(
            let(keyed, starts),
            zero,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["at"])).alias("n"), i.alias("at")),
        )["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), covered)


def quality_rules(docs: DataFrame, trusted: DataFrame, params: QualityParams = QualityParams(), carry: bool = False) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    log_ratio, kept; a row for each row of docs.

    Null text counts as empty: no words, base_failed.  A text without n-grams has log_ratio 0.  Repeated doc_ids each
    keep their row.  An empty table gives an empty result.  Other columns of docs are ignored; with carry, a struct
    ``row`` has all of the document's columns.
    """
    text = F.coalesce("text", F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    words = docs.select("doc_id", text.alias("text"), *carried).select(
        "*",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        log_ratio_table(docs, trusted, params).scalar().alias("table"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    ratio = let(
        _ngram_buckets(F.col("text"), params.buckets),
        lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
            F.aggregate(g, F.lit(0.0), lambda acc, x: acc + F.get("table", x)) / F.size(g)
        ),
    )
    long = lambda c: c.cast("long")
    out = words.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOL))).alias("n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        ratio.alias("log_ratio"),
        *(["row"] if carry else []),
    )
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= params.threshold))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that the labels call good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
