"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share a number of words by their weights, no source more than some times its own. A document's expected number
of copies is its source's share divided by its source's size: the whole part is certain, the rest is its probability
to be included once more. Documents are ranked by the odds of a random number over the odds of that probability, and
taken in this order as long as they fit, so that the size of a sample, in words, is fixed.

The last document that fits is found without sorting a source: a histogram of ranks says in which of 4,096 parts it
lies, a second in which 4,096th of that, and only the ranks there are put in order. So a source of any size is
counted where its rows are, and what is decided for a source is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.batches import written
from quillstone.llm.common import column

SPACE = " \t\n\x0b\x0c\r"
WORD = "[ \\t-\\r]*+[^ \\t-\\r]++"
#: Parts of a histogram.
PARTS = 4096
#: After the first, each pass fills what is left with documents that fit into it.
PASSES = 4


def n_words(text: Column) -> Column:
    """Words of a text, which are runs of other characters than ASCII white space; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(text, F.lit(SPACE)), WORD, "w")), F.lit(0)).cast("long")


def random_number(*of: Column) -> Column:
    """A number between 0 and 1, neither of them, by the hash of the columns: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in of))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (source, source_size), and nr, weight and target: shares of all sizes by weight, at most `most` times a source's own.

    Weights go round the sources in order of code point, null last. What is above the bound is shared by weight among
    the others until none is above; each round is one sum over the sources.
    """
    nr = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source, not a document
    named = written(sources.withColumn("nr", nr).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1).cast("long")))
    bound = F.col("source_size") * F.lit(most)
    level, stopped = 0.0, None
    while True:
        above = bound < F.lit(level) * F.col("weight")
        s = named.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, bound).otherwise(0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if s["n"] == stopped or not s["weight"]:
            return named.withColumn("target", F.when(above, bound.cast("double")).otherwise(F.lit(level) * F.col("weight")))
        level, stopped = (s["all"] - s["full"]) / s["weight"], s["n"]


def first_too_much(rows: DataFrame) -> DataFrame:
    """Of rows (nr, gap, rank, size) per nr: the least rank that no longer fits into the gap, in order of rank, and what all before it hold.

    Rows of equal rank fit together or not at all. An nr whose rows all fit has no row here.
    """

    def crossing(sums: DataFrame, place: str, before: Column) -> DataFrame:
        upto = before + F.sum("size").over(Window.partitionBy("nr").orderBy(place))
        return sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size")).where((F.col("before") <= F.col("gap")) & (F.col("upto") > F.col("gap"))).select("nr", place, "before")

    rows = rows.withColumns({"part": F.floor(F.col("rank") * PARTS), "fine": F.floor(F.col("rank") * PARTS * PARTS)})
    sums = lambda df, place: df.groupBy("nr", place, "gap", *(["start"] if "start" in df.columns else [])).agg(F.sum("size").alias("size"))
    part = crossing(sums(rows, "part"), "part", F.lit(0)).withColumnRenamed("before", "start")
    fine = crossing(sums(rows.join(part, ["nr", "part"]), "fine"), "fine", F.col("start")).withColumnRenamed("before", "start")
    return crossing(sums(rows.join(fine, ["nr", "fine"]), "rank"), "rank", F.col("start")).withColumnRenamed("rank", "stop").withColumnRenamed("before", "held")


def pareto_rank(random: Column, inclusion: Column) -> Column:
    """The odds of a random number over those of an inclusion probability, brought between 0 and 1: q / (1 + q)."""
    q = (random / (F.lit(1.0) - random)) / (inclusion / (F.lit(1.0) - inclusion))
    return q / (F.lit(1.0) + q)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: how many words of each document the mix takes, in whole copies.

    Each source's copies hold its target but for what no document fits into; a document's copies are the target over
    the source's size, rounded down or up. A null text is empty; a document without words is taken 0 times; a null
    source is one of its own. Rows that repeat key and text have one random number and are taken alike; rows that
    repeat a key alone are documents of their own, and so are those without. Other columns are dropped; an empty table gives no rows.
    """
    whole_text = F.coalesce(column(text), F.lit(""))
    rows = docs.select(column(key).alias("doc_id"), column(source).cast("string").alias("source"), n_words(whole_text).alias("size"), random_number(column(key), whole_text).alias("random"))
    rows = written(rows)
    share = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("share", share).withColumn("whole", F.floor("share")).withColumn("inclusion", F.col("share") - F.col("whole"))
    # steps: where each pass ended, and what it had to fill
    sources = sources.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("steps", F.array().cast("array<struct<stop:double,gap:double>>"))

    def placed(sources: DataFrame) -> DataFrame:
        named = sources.withColumnRenamed("source", "source_")
        return rows.join(named, F.col("source").eqNullSafe(F.col("source_"))).withColumn("rank", F.when(F.col("inclusion") > 0, pareto_rank(F.col("random"), F.col("inclusion"))))

    last = F.coalesce(F.try_element_at("steps", F.lit(-1))["stop"], F.lit(0.0))
    for _ in range(PASSES):
        open_ = placed(sources).where((F.col("rank") >= last) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))).select("nr", "gap", "rank", "size")
        found = sources.join(first_too_much(open_), "nr", "left")
        step = F.struct(F.coalesce("stop", F.lit(2.0)).alias("stop"), F.col("gap"))  # all fitted: beyond any rank
        sources = written(found.withColumn("steps", F.concat("steps", F.array(step))).withColumn("gap", F.when(F.col("stop").isNull(), 0.0).otherwise(F.col("gap") - F.col("held"))).drop("stop", "held"))
    once_more = F.lit(False)
    for i in range(PASSES):
        least = F.lit(0.0) if i == 0 else F.col("steps")[i - 1]["stop"]
        once_more |= (F.col("rank") >= least) & (F.col("rank") < F.col("steps")[i]["stop"]) & (F.col("size") <= F.col("steps")[i]["gap"])
    copies = (F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("int")) * (F.col("size") > 0).cast("int")
    return placed(sources).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def op12(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _passes() -> str:
    """The passes in SQL: open rows, their sums in order of rank, and the sources after the pass."""
    out = []
    for i in range(PASSES):
        out.append(f"""
open{i} AS (SELECT r.nr, r.rank, r.size, s.gap FROM ranked r JOIN s{i} s USING (nr) WHERE r.rank >= s.stop AND r.size > 0 AND r.size <= s.gap),
sums{i} AS (SELECT nr, rank, gap, sum(size) OVER (PARTITION BY nr ORDER BY rank) AS upto FROM open{i}),
ends{i} AS (SELECT nr, min(rank) FILTER (upto > gap) AS stop, coalesce(max(upto) FILTER (upto <= gap), 0) AS held FROM sums{i} GROUP BY nr),
s{i + 1} AS (SELECT s.nr, coalesce(e.stop, 2.0) AS stop, CASE WHEN e.stop IS NULL THEN 0.0 ELSE s.gap - e.held END AS gap, s.stop AS since, s.gap AS room FROM s{i} s LEFT JOIN ends{i} e USING (nr))""")
    return ",".join(out)


_TAKEN = " OR ".join(f"(r.rank >= s{i}.since AND r.rank < s{i}.stop AND r.size <= s{i}.room)" for i in range(1, PASSES + 1))
OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS random
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM docs GROUP BY source
), weighed AS (SELECT *, ((nr - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS bound FROM sizes),
filled AS (  -- sources in the order in which they reach their bounds
  SELECT *, coalesce(sum(bound) OVER before, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left, sum(source_size) OVER () AS total
  FROM weighed WINDOW before AS (ORDER BY bound::DOUBLE / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by((total - full_before)::DOUBLE / weight_left::DOUBLE, (bound::DOUBLE / weight, nr)) AS level FROM filled
  WHERE bound >= (total - full_before)::DOUBLE / weight_left::DOUBLE * weight
), targets AS (
  SELECT source, nr, source_size, CASE WHEN bound < level * weight THEN bound::DOUBLE ELSE level * weight END AS target FROM weighed, level
), shares AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS share FROM targets
), parts AS (SELECT *, floor(share) AS whole, share - floor(share) AS inclusion FROM shares),
ranked AS (
  SELECT d.doc_id, d.size, p.nr, p.source_size, p.target, p.whole,
    CASE WHEN inclusion > 0 THEN ((random / (1 - random)) / (inclusion / (1 - inclusion))) / (1 + (random / (1 - random)) / (inclusion / (1 - inclusion))) END AS rank
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), s0 AS (SELECT nr, 0.0::DOUBLE AS stop, target - whole * source_size AS gap FROM parts),{_passes()}
SELECT r.doc_id, r.size, r.source_size, r.target, (copies * r.size)::BIGINT AS taken, copies::INTEGER AS copies
FROM (SELECT r.*, CASE WHEN r.size = 0 THEN 0 ELSE whole + coalesce({_TAKEN}, false)::INTEGER END AS copies FROM ranked r {' '.join(f'JOIN s{i} ON r.nr = s{i}.nr' for i in range(1, PASSES + 1))}) r
"""
