"""Mixing sources to target weights.

Tokens (words) are summed per source, each source gets a target, and rate = target / size says how often each of its
documents is emitted: floor(rate) times, and once more when a number drawn from the document's hash is below the
fraction.  Sources are few against documents: per source there is one row of sums, made by partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources, sorted by code point, null last; repeated as often as needed.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: Tokens of the mix, as a share of all tokens.
    total: float = 1.5
    #: No source is taken more often than this.
    most: float = 2.0
    seed: str = "mix-1"


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """sizes: source, source_size (one row each).  Adds target.

    Targets are min(most * size, level * weight) with the one level at which they sum to the total: what repeated
    resharing of the excess by weight comes to.  Sorted by most * size / weight, the first sources are the capped ones,
    so the level follows from running sums.  These windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    s = sizes.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(params.weights)))))
    s = s.withColumn("cap", F.col("source_size") * F.lit(params.most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("mix", F.sum("source_size").over(every) * F.lit(params.total))
    level = (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the level of the first source that it leaves under its cap holds for all after it
    s = s.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("first_level", F.max(F.when(F.col("under"), F.col("level"))).over(every))
    target = F.when(F.col("first_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first_level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key's MD5."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, params: MixParams = MixParams(), carry: bool = False) -> DataFrame:
    """docs: doc_id, text, source.  Returns doc_id, source, size, source_size, target, copies, taken; a row per row.

    copies says how often the document is emitted, taken is copies * size.  Null text has size 0; a null source is a
    source; a source without words has target 0 and no copies.  Rows that share a doc_id share the draw.  Other columns
    are ignored; with carry, a struct ``row`` has all of the document's columns.  An empty table gives an empty result.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", *carried, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), params)
    targets = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").withColumn("rate", rate)
    extra = (uniform(F.col("doc_id"), params.seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *(["row"] if carry else []),
    )


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of docs, each as often as mix says."""
    taken = mix(docs, params, carry=True).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


#: The same in DuckDB SQL, for the default parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    ([3.0::DOUBLE, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sums
), targets AS (
  SELECT source, source_size, coalesce(least(cap, max(level) FILTER (level * weight <= cap) OVER () * weight), cap) AS target
  FROM levels
), rated AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken
FROM (SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM rated)
"""
