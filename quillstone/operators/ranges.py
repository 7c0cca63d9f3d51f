"""Ranges of pages that are converted by an unreliable service: those with missing pages are halved and asked for again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.pages import halves, missing_pages
from quillstone.sources.shared import fresh

#: The error that a smaller range may help against, and the pages of a range that isn't halved for it.
DEADLINE, LEAST_PAGES = "DEADLINE_EXCEEDED", 5


def _written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: a round's answers are asked for once, whatever is lost later."""
    path = fresh(df.sparkSession, "ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def converted(ranges: DataFrame, ask: Callable[[DataFrame], DataFrame], key: str, least: int = LEAST_PAGES) -> DataFrame:
    """key, first, last, text, error: parts that cover each of the ranges (key, first, last), in place of one another's halves.

    ask gives text and error for a frontier of ranges. An answer that lacks a page of its range, or a range of more
    than `least` pages for which the time ran out, is dropped and the range's halves are asked for; a single page
    without its tag gets it; any other error stays in the row, without text. All ranges of a round are asked for
    together, and a range of n pages takes at most as many rounds as n has binary digits, and one.
    """
    frontier, done = ranges.select(key, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")), []
    n = F.col("last") - F.col("first") + 1
    while True:
        lacking = F.size(missing_pages(F.coalesce("text", F.lit("")), F.col("first"), F.col("last"))) > 0
        late = F.coalesce(F.contains("error", F.lit(DEADLINE)), F.lit(False)) & (n > least)
        judged = ask(frontier).select(key, "first", "last", "text", "error", lacking.alias("lacking")).withColumn("again", late | (F.col("error").isNull() & F.col("lacking") & (n > 1)))
        tagged = F.when(F.col("lacking") & (n == 1), F.concat(F.lit("[Page: "), F.col("first").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
        # the text of an answer that is dropped isn't written
        answers = _written(judged.select(key, "first", "last", F.when(F.col("error").isNull() & ~F.col("again"), tagged).alias("text"), "error", "again"))
        done.append(answers.where("not again").drop("again"))
        frontier = answers.where("again").select(key, F.explode(halves(F.col("first"), F.col("last"))).alias("h")).select(key, "h.first", "h.last")
        if frontier.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def joined(parts: DataFrame, key: str) -> DataFrame:
    """key, text, error: the parts in order, a blank line between; a key with an error has the first one and no text."""
    held = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "text"))).alias("x"), F.min(F.when(F.col("error").isNotNull(), F.struct("first", "error"))).alias("bad"))
    text: Column = F.array_join(F.transform("x", lambda p: p["text"]), "\n\n")
    return held.select(key, F.when(F.col("bad").isNull(), text).alias("text"), F.col("bad.error").alias("error"))
