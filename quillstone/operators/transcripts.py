"""Transcripts as tables of lines: (document, position, text). Windows over a document's lines, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import STAMP, TAG, line_seconds, merge_tables, seconds, stamp

#: Seconds that a mark may lie beyond a range; the beginning of a mark of what is heard.
TOLERANCE = 15
HEARD = r"\[(?:Audio|Sound):"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line, sec for each line of a text."""
    out = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return out.withColumn("sec", line_seconds(F.col("line")))


def clip(rows: DataFrame, key: str, start: int, end: int, tolerance: int = TOLERANCE) -> DataFrame:
    """Without the initial run of lines before start - tolerance, and from the first line after end + 15 s on.

    Lines without a mark go with the run before them.
    """
    whole, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("at")
    early = F.col("sec") < start - tolerance
    first = F.min(F.when(F.col("sec").isNotNull() & ~early, F.col("at"))).over(whole)
    last_early = F.max(F.when(early & (F.col("at") < F.coalesce(F.col("first_"), F.lit(1 << 30))), F.col("at"))).over(whole)
    late = F.max((F.col("sec") > end + TOLERANCE).cast("int")).over(before)
    out = rows.withColumn("first_", first).withColumn("last_", last_early).withColumn("late_", F.coalesce(late, F.lit(0)))
    return out.where((F.col("at") > F.coalesce("last_", F.lit(-1))) & (F.col("late_") == 0)).drop("first_", "last_", "late_")


def monotonic(rows: DataFrame, key: str) -> DataFrame:
    """Without lines whose mark lies before one above. A line that goes has a lower mark than one that stayed, so the greatest above is that of all lines."""
    above = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("most_", F.max("sec").over(above)).where(F.col("sec").isNull() | F.col("most_").isNull() | (F.col("sec") >= F.col("most_"))).drop("most_")


def offset(rows: DataFrame, by: int | Column) -> DataFrame:
    """Every mark of a line moved by so many seconds, not below zero; ranges stay ranges. Lines that are moved by nothing stay as they are."""
    by = F.lit(by) if isinstance(by, int) else by
    one = r"(\[(?:Audio|Sound|Video):\s*)(\d{1,2}:\d{2}(?::\d{2})?)(?:(\s*-\s*)(\d{1,2}:\d{2}(?::\d{2})?))?(\])"
    parts = [F.regexp_extract_all("line", F.lit(one), F.lit(k)) for k in range(1, 6)]
    moved = F.transform(F.arrays_zip(*(p.alias(f"p{k}") for k, p in enumerate(parts))), lambda m: F.concat(m["p0"], stamp(seconds(m["p1"]) + by), m["p2"], F.when(m["p3"] != "", stamp(seconds(m["p3"]) + by)).otherwise(""), m["p4"]))
    rest = F.split("line", STAMP)
    joined = F.array_join(F.flatten(F.zip_with(rest, F.concat(moved, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return rows.withColumn("line", F.when(by == 0, F.col("line")).otherwise(joined)).withColumn("sec", line_seconds(F.col("line")))


def clamp(rows: DataFrame, duration: int) -> DataFrame:
    """Audio and sound marks over the duration: dropped if by more than five seconds, else set to it."""
    heard = F.col("line").rlike(HEARD)
    over = heard & (F.col("sec") > duration)
    rows = rows.where(F.coalesce(~(over & (F.col("sec") > duration + 5)), F.lit(True)))
    last = stamp(F.lit(duration))
    return rows.withColumn("line", F.when(over, F.regexp_replace("line", F.lit(rf"({HEARD}\s*)\d{{1,2}}:\d{{2}}(?::\d{{2}})?"), F.concat(F.lit("$1"), last))).otherwise(F.col("line"))).withColumn("sec", line_seconds(F.col("line")))


def entries(rows: DataFrame, key: str) -> DataFrame:
    """key, block, sec, entry: a line with a mark and those without that follow; lines before the first mark go."""
    block = F.count("sec").over(Window.partitionBy(key).orderBy("at"))
    held = rows.withColumn("block", block).where("block > 0").groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("at", "line", "sec"))).alias("x"))
    return held.select(key, "block", F.col("x")[0]["sec"].alias("sec"), F.array_join(F.col("x.line"), "\n").alias("entry"))


def merge_sides(audio: DataFrame, visual: DataFrame, key: str) -> DataFrame:
    """key, text: entries of both by time, heard before seen at the same second; heard marks among the seen lines go first."""
    seen = visual.where(~F.col("line").rlike(HEARD))
    both = entries(audio, key).withColumn("side", F.lit(0)).unionByName(entries(seen, key).withColumn("side", F.lit(1)))
    return both.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec", "side", "block", "entry"))), lambda e: e["entry"]), "\n").alias("text"))


def rejoined(rows: DataFrame, key: str) -> DataFrame:
    """key, text: a document's lines in order."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("x"))
    return held.select(key, F.array_join(F.col("x.line"), "\n").alias("text"))


def assembled(df: DataFrame, key: str, parts: str) -> DataFrame:
    """key, text: a document's converted parts as one text; tables that go on are joined, of equal page tags the last stays."""
    return rejoined(dedup_tags(lines(df.select(key, merge_tables(F.col(parts)).alias("text_")), key, "text_"), key), key)


def dedup_tags(rows: DataFrame, key: str) -> DataFrame:
    """Of equal page or sheet tags in a document the last line stays."""
    kind, value = (F.regexp_extract("line", TAG, k) for k in (1, 2))
    out = rows.withColumn("tag_", F.when(kind != "", F.concat(kind, F.lit(":"), value)))
    after = Window.partitionBy(key, "tag_").orderBy(F.col("at").desc())
    return out.withColumn("n_", F.row_number().over(after)).where(F.col("tag_").isNull() | (F.col("n_") == 1)).drop("tag_", "n_")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def assembled_media(parts: DataFrame, key: str) -> DataFrame:
    """key, text, length, dropped: a recording's converted parts as one text whose marks never go back.

    parts: key, part (their order), text, and of the chunk that a part is from: by, the seconds at which it begins in
    the recording, and overlap, the seconds that it shares with the chunk before. Marks become those of the recording;
    lines of the shared seconds that the chunk before has told are cut off; parts are joined by blank lines, page tags
    removed, and lines whose mark lies before one above are dropped, across parts and chunks. A null text is empty.
    """
    of = F.struct(F.col(key).alias("key"), "part").alias("of")
    told = parts.select(of, F.coalesce("text", F.lit("")).alias("text"), F.col("by").cast("long").alias("by"), F.col("overlap").cast("long").alias("overlap"))
    each = told.select("of", "by", "overlap", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    moved = offset(each, F.col("by"))
    # the initial run of lines of the overlap
    whole = Window.partitionBy("of")
    early = (F.col("overlap") > 0) & (F.col("sec") < F.col("by") + F.col("overlap") - TOLERANCE)
    first = F.min(F.when(F.col("sec").isNotNull() & ~early, F.col("at"))).over(whole)
    moved = moved.withColumn("first_", first)
    last = F.max(F.when(early & (F.col("first_").isNull() | (F.col("at") < F.col("first_"))), F.col("at"))).over(whole)
    cut = moved.withColumn("last_", F.coalesce(last, F.lit(-1)))
    held = cut.groupBy("of").agg(F.max("last_").alias("cut"), F.sort_array(F.collect_list(F.when(F.col("at") > F.col("last_"), F.struct("at", "line")))).alias("x"))
    one = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    texts = held.select("of.key", "of.part", F.when(F.col("cut") >= 0, trimmed(one)).otherwise(one).alias("text"))
    joined = texts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("x"))
    whole_text = trimmed(F.regexp_replace(F.array_join(F.transform("x", lambda r: r["text"]), "\n\n"), TAG, ""))
    rows = lines(joined.select("key", whole_text.alias("text")), "key", "text")
    rows = rows.withColumn("most_", F.max("sec").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    back = F.coalesce(F.col("sec") < F.col("most_"), F.lit(False))
    done = rows.groupBy("key").agg(F.count_if(back).alias("dropped"), F.sort_array(F.collect_list(F.when(~back, F.struct("at", "line")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    out = done.select(F.col("key").alias(key), F.when(F.col("dropped") > 0, trimmed(text)).otherwise(text).alias("text"), "dropped")
    return out.select(key, "text", F.length("text").cast("long").alias("length"), "dropped")
