"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a 60-bit hash of its id. Words are summed by source and by the upper 12 bits of that
place; the bucket in which a source's budget is used up is its boundary bucket, and only the rows of that bucket are
summed again by the next 12 bits, down to one place. Documents below the threshold are taken once more than the
others of their source. Nothing is sorted but the at most 4,096 sums of a source, and rows move only as sums.

Sources are ranked by code point and given their targets without gathering them in one task. Ranks come from ranges of
names, of which only the counts meet. Targets stop at caps; the level that the other sources reach follows from sums by the
ratio of cap and weight, a whole number of 64 bits: its upper 16 bits first, then only the bucket in which the
level lies by the next 16, so that at most 65,536 sums meet.

Only DataFrame functions are used. Word counts are written once to the shared scratch folder, as a table of a few
dozen bytes per document; the rows of boundary buckets are written again, about one in 4,096.

Defined cases: a null text has no words and is taken zero words; a null source is a source of its own, ranked last; a null id is
placed like an empty id. Rows with one id have one place and are taken alike. Of a source at its cap every document is taken the whole number of
times that the cap allows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblattice.sources.scratch import cut, drop

#: Bits of the sources' ratios that are summed at once.
RATIO_STEP = 16
PLACE_BITS, STEP_BITS = 60, 12
BUCKETS = 1 << STEP_BITS
#: The white space between words, beside the blank itself.
BLANKS = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with ``rank``, from 0, by code point and null last; written, as ranges are numbered by partition."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(parts, order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    starts = ranges.groupBy("range").agg(F.count("*").alias("k")).select(F.col("range").alias("r"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.join(starts, F.col("range") == F.col("r")).withColumn("rank", F.col("start") + within - 1).drop("range", "r", "start")


def _level(per: DataFrame, total: int, common: int, weights: int, largest: int) -> float:
    """What a source of weight 1 gets where no cap holds it: (total - a) / w, with a the caps of the sources below some ratio and w the weights of all others.

    That ratio is the least at whose height (ratio / common) all sources together, each up to its cap, take the total; what they take only grows with the height.
    """
    capped, low = 0, None
    for shift in range(max(largest.bit_length() - 1, 0) // RATIO_STEP * RATIO_STEP, -1, -RATIO_STEP):
        rows = per if low is None else per.where(F.shiftright("ratio", shift + RATIO_STEP) == low)
        sums = rows.groupBy(F.shiftright("ratio", shift).alias("bucket")).agg(F.sum("caps").alias("caps"), F.sum("w").alias("weights"), F.max("ratio").alias("most"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most 2 ** RATIO_STEP rows
        a = F.lit(capped) + F.coalesce(F.sum("caps").over(before), F.lit(0))
        w = F.lit(weights) - F.coalesce(F.sum("weights").over(before), F.lit(0))
        exact = lambda c: c.cast("decimal(38,0)")
        taken = F.lit(common) * exact(F.col("a") + F.col("caps")) + exact(F.col("most")) * exact(F.col("w") - F.col("weights"))
        at = sums.withColumns({"a": a, "w": w}).where(taken >= exact(F.lit(common * total))).orderBy("bucket").first()
        capped, weights, low = at["a"], at["w"], at["bucket"]
    return (total - capped) / weights


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target, whole (copies of every document) and budget (words beyond those).

    Sources take the weights in turn, by code point and null last. Targets share all words by weight but stop at
    ``most`` times the source.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    common = math.lcm(*weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    per = cut(per.withColumn("caps", F.lit(most) * F.col("source_size")).withColumn("ratio", F.expr(f"caps * {common} DIV w")), "sources")
    total, weight, largest = per.agg(F.sum("source_size"), F.sum("w"), F.max("ratio")).first()
    level = _level(per, total, common, weight, largest) if total else 0.0
    target = F.least(F.col("caps").cast("double"), F.lit(level) * F.col("w"))
    per = per.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return per.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))


def _crossed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The state of each source after one more histogram, of ``rows`` (source, size, place, bucket): its boundary bucket with its least and last place, the words before it and those in it."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.min("place").alias("least"), F.max("place").alias("last"))
    known = state.select(F.col("source").alias("s"), "budget", F.col("before").alias("start"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(running), F.lit(0)))
    crossing = sums.join(known, F.col("source").eqNullSafe(F.col("s"))).where((F.col("start") + F.col("earlier") <= F.col("budget")) & (F.col("start") + F.col("earlier") + F.col("n") > F.col("budget")))
    found = crossing.select(F.col("source").alias("c"), "bucket", (F.col("start") + F.col("earlier")).alias("before"), "n", "least", "last")
    return state.drop("bucket", "before", "n", "least", "last").join(found, F.col("source").eqNullSafe(F.col("c")), "left").drop("c").withColumn("before", F.coalesce("before", F.lit(0)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sizes table (doc_id, source, size, place) and the plan (one row per source, with its threshold).

    A document is taken ``whole`` times, and once more if its place is below ``threshold``.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("place")), "sizes")
    state = cut(targets(sizes, weights, most).withColumns({"bucket": F.lit(None).cast("long"), "before": F.lit(0).cast("long"), **{c: F.lit(None).cast("long") for c in ("n", "least", "last")}}), "targets")
    rows = sizes
    for level in range(1, PLACE_BITS // STEP_BITS + 1):
        shift = PLACE_BITS - STEP_BITS * level
        if level > 1:  # of the rows before, only those of boundary buckets
            upper = state.where("bucket IS NOT NULL").select(F.col("source").alias("s"), F.col("bucket").alias("b"))
            inside = rows.join(upper, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + STEP_BITS) == F.col("b"))).select("source", "size", "place")
            old, rows = rows, cut(inside, f"level{level}")
            if old is not sizes:
                drop(old)
        old, state = state, cut(_crossed(rows.select("source", "size", "place", F.shiftright("place", shift).alias("bucket")), state), f"state{level}")
        drop(old)
        if state.where("least < last").isEmpty():  # every boundary bucket is down to one place
            break
    if rows is not sizes:
        drop(rows)
    nearer = (F.col("budget") - F.col("before")) * 2 >= F.col("n")
    threshold = F.when(F.col("bucket").isNull() | (F.col("whole") >= most), F.lit(0)).when(nearer, F.col("least") + 1).otherwise(F.col("least"))
    return sizes, state.select("source", "source_size", "target", "whole", threshold.cast("long").alias("threshold"))


def _planned(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_plan_source")
    return rows.join(plan, F.col(source).eqNullSafe(F.col("_plan_source")), "left").drop("_plan_source")


def copies(place: Column) -> Column:
    """How often a document at that place is taken."""
    return F.col("whole") + (place < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, **columns: str) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of every document."""
    sizes, plan = plan_mix(docs, weights, most, **columns)
    return _planned(sizes, plan, "source").select("doc_id", "size", "source", "source_size", "target", copies(F.col("place")).alias("copies"), (F.col("size") * copies(F.col("place"))).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with the columns of ``docs``."""
    sizes, plan = plan_mix(docs, weights, most)
    drop(sizes)
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    source, doc_id = (f"c{names.index(x)}" for x in ("source", "doc_id"))
    picked = _planned(rows, plan, source).withColumn("_copies", copies(place(F.col(doc_id))).cast("int")).where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return picked.select(*[F.col(f"c{k}").alias(x) for k, x in enumerate(names)])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS remaining, sum(source_size) OVER ()::BIGINT AS total
      FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w ASC, source ASC NULLS LAST)),
l AS (SELECT *, (total - capped)::DOUBLE / remaining AS level FROM c),
g AS (SELECT source, source_size, w, (SELECT level FROM l AS x WHERE level * w <= 3 * source_size ORDER BY (3 * source_size)::DOUBLE / w ASC, source ASC NULLS LAST LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, level * w) AS target FROM g),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             sum(size) OVER (PARTITION BY d.source, place)::BIGINT AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= budget OR (upto - here <= budget AND (budget - (upto - here)) * 2 >= here AND here > 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""
