"""Mixing sources to target weights by hash-threshold histograms; nothing is sorted.

Every document has a 60-bit hash. A source's take is every document whose hash lies below the source's threshold, plus
whole rounds of all its documents where the target exceeds the source. Thresholds are found from histograms: words are
summed by source and hash bucket, the bucket in which the running sum crosses the budget becomes the range of the next
histogram, and only that bucket's rows are counted again, until it holds one document. Budgets are nested: a larger
budget keeps all that a smaller one takes.

Targets: sources get shares of the total by weight; none gets more than `most` times its words, and what it can't take
is reshared by weight among the rest until none is above.

Defined results: size counts runs of characters other than space and U+0009..U+000D; a null text has size 0. A null
source is a source of its own, last in order. Rows equal in doc_id and text have one hash and are taken together.
The boundary document is taken if that brings the sum nearer to the target. Input columns stay; what is added starts
with the prefix "mix_" and replaces input columns of those names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, global_rank, load, packed, saved

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Bits of hash by which each histogram splits a range.
BITS, ALL_BITS = 10, 60
#: Up to so many sources (one row each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.withColumn("mix_size", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).withColumn("mix_hash", F.conv(F.substring(digest, 1, ALL_BITS // 4), 16, 10).cast("long"))


def _with(df: DataFrame, by_source: DataFrame, small: bool) -> DataFrame:
    s = by_source.withColumnRenamed("source", "mix_source")
    return df.join(F.broadcast(s) if small else s, df["source"].eqNullSafe(s["mix_source"])).drop("mix_source")


def targets(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, mix_source_size, mix_target; sources in code point order, null last, weigh weights in turn."""
    sums = global_rank(slim.groupBy("source").agg(F.sum("mix_size").alias("mix_source_size")), [F.col("source").asc_nulls_last()], "mix_rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("mix_rank") % len(weights) + 1).cast("int"))
    sums = sums.withColumn("mix_weight", w).withColumn("mix_cap", most * F.col("mix_source_size"))
    budget = share * float(sums.agg(F.sum("mix_source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises; each turn caps at least one more source or ends
        over = F.col("mix_cap") < level * F.col("mix_weight")
        taken, open_ = sums.agg(F.sum(F.when(over, F.col("mix_cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("mix_weight")))).first()
        if not open_:
            break
        now = (budget - taken) / open_
        if now <= level:
            break
        level = now
    return sums.select("source", "mix_source_size", F.least("mix_cap", level * F.col("mix_weight")).alias("mix_target"))


def thresholds(slim: DataFrame, by_source: DataFrame, small: bool) -> DataFrame:
    """by_source (with mix_rest, the words wanted) with mix_below: the hash below which documents are taken.

    One histogram pass for all sources at once; the rows counted shrink by 2^BITS from pass to pass. A source's state: the
    range [_lo, _end) in which its budget is crossed, the words below it (_under) and in it (_in), and whether the range
    holds several documents (_open).
    """
    zero, all_ = F.lit(0).cast("long"), F.lit(1 << ALL_BITS).cast("long")
    cols = by_source.columns
    state = saved(by_source.select(*cols, zero.alias("_lo"), all_.alias("_end"), zero.alias("_under"), zero.alias("_in"), F.lit(True).alias("_open")), "mix")
    for width in range(ALL_BITS, 0, -BITS):
        shift = width - BITS
        want = state.where("_open").select("source", "mix_rest", "_lo", "_end", "_under")
        rows = _with(slim, want, small).where((F.col("mix_hash") >= F.col("_lo")) & (F.col("mix_hash") < F.col("_end")))
        bins = rows.groupBy("source", "mix_rest", "_lo", "_under", F.shiftright(F.col("mix_hash") - F.col("_lo"), shift).alias("_bin"))
        bins = bins.agg(F.sum("mix_size").alias("_s"), F.count("*").alias("_n"))
        w = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2^BITS rows
        bins = bins.withColumn("_upto", F.col("_under") + F.sum("_s").over(w))
        cross = bins.where((F.col("_upto") > F.col("mix_rest")) & (F.col("_upto") - F.col("_s") <= F.col("mix_rest")))
        lo = F.col("_lo") + F.shiftleft(F.col("_bin"), shift)
        cross = cross.select(F.col("source").alias("_src"), F.struct(lo.alias("lo"), (lo + F.lit(1 << shift)).alias("end"), (F.col("_upto") - F.col("_s")).alias("under"), F.col("_s").alias("words"), (F.col("_n") > 1).alias("open")).alias("_c"))
        # No crossing: the budget covers all there is, so everything lies below the threshold.
        whole = F.struct(all_.alias("lo"), all_.alias("end"), F.col("_under").alias("under"), zero.alias("words"), F.lit(False).alias("open"))
        kept = F.struct(F.col("_lo").alias("lo"), F.col("_end").alias("end"), F.col("_under").alias("under"), F.col("_in").alias("words"), F.col("_open").alias("open"))
        after = state.join(F.broadcast(cross) if small else cross, F.col("_open") & state["source"].eqNullSafe(F.col("_src")), "left")
        now = F.when(F.col("_open"), F.coalesce("_c", whole)).otherwise(kept)
        after = after.withColumn("_x", now).select(*cols, F.col("_x.lo").alias("_lo"), F.col("_x.end").alias("_end"), F.col("_x.under").alias("_under"), F.col("_x.words").alias("_in"), F.col("_x.open").alias("_open"))
        after = saved(after, "mix")
        forget(state)
        state = after
        if state.where("_open").isEmpty():
            break
    nearer = F.col("_under") + F.col("_in") - F.col("mix_rest") < F.col("mix_rest") - F.col("_under")
    return state.select(*cols, F.when(nearer, F.col("_end")).otherwise(F.col("_lo")).alias("mix_below"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row)."""
    slim = saved(with_keys(docs).select("source", "mix_size", "mix_hash"), "mix")
    t = targets(slim, weights, share, most)
    # Whole rounds of the source first, then the part below the threshold.
    t = t.withColumn("mix_rounds", F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0))
    t = t.withColumn("mix_rest", F.col("mix_target") - F.col("mix_rounds") * F.col("mix_source_size"))
    small = t.count() <= BROADCAST_SOURCES
    t = thresholds(slim, t, small)
    out = _with(with_keys(docs), t, small)
    out = out.withColumn("mix_copies", (F.col("mix_rounds") + (F.col("mix_hash") < F.col("mix_below")).cast("int")).cast("int"))
    return out.drop("mix_hash", "mix_rest", "mix_rounds", "mix_below")


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    out = mix(packed(docs, "doc_id", "text", "source"), **how).where("mix_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, ss, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * ss / w AS ratio FROM w),
l AS (SELECT a.ratio, (1.5::DOUBLE * (SELECT sum(ss) FROM w) - coalesce((SELECT sum(2.0::DOUBLE * b.ss) FROM r b WHERE b.ratio < a.ratio), 0)) / (SELECT sum(b.w) FROM r b WHERE b.ratio >= a.ratio) AS level FROM r a),
t AS (SELECT source, ss, least(2.0::DOUBLE * ss, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1) * w) AS target FROM r),
c AS (SELECT doc_id, size, ss AS source_size, target, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS rounds, target - (CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END) * ss AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (rounds + CASE WHEN upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
