"""A trie of the prefixes that conversations share.

A prefix of turns is told by a digest, and the conversation of the smallest id among those that begin with it owns it.
What a conversation owns is a chain: from the first depth at which no smaller one agrees with it to its end. That
depth is found by binary search, all conversations at once: each step joins one digest of each with the minima of the
digests that several conversations have. Chains hang off the prefixes where they leave another's; what a chain sums
up from its end is added to every prefix above it, in one aggregation for the whole tree.

Long conversations are cut into segments, each searched by itself, so that no row grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.batches import written
from quillstone.llm.common import column, shuffle_partitions
from quillstone.llm.mixing import n_words

#: Turns of a segment at most.
SEGMENT = 512
#: Ids of an owner's range that are joined to one string before they are hashed.
RANGE = 4096
#: A prefix with more than this share of all prefixes is hot: there are fewer than so many of them.
HOT = 4096
#: A digest has so many parts of so many bits, whose sums over a segment fit a long.
PARTS, BITS = 3, 50
DIGEST = [f"d{i}" for i in range(PARTS)]
NONE = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """rows with n, a turn's number in its conversation (from 1), in order of at, role and content.

    A conversation of any length: ranges of rows are numbered by themselves, and each adds what ranges before it hold
    of the conversation.
    """
    parts = shuffle_partitions(rows.sparkSession)
    ranges = written(rows.repartitionByRange(parts, F.col("conv_id"), F.col("at").asc_nulls_first(), F.col("role"), F.col("content")).withColumn("range", F.spark_partition_id()))
    pieces = ranges.groupBy("conv_id", "range").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("held")
    later = pieces.withColumn("before", before).where(F.col("before") > 0).select("conv_id", "range", "before")  # at most one a range
    place = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("at").asc_nulls_first(), "role", "content"))
    return ranges.join(later, ["conv_id", "range"], "left").withColumn("n", place + F.coalesce("before", F.lit(0))).drop("range", "before")


def shared_heads(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, content, words) of rebuilt conversations, and their lengths (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % every, h being crc32 of its id modulo
    most + 1, and goes on with its own turns after the first h.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    lengths = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    first = turns.where((F.col("n") <= most) & (F.col("conv_id") % every == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "content", "words"))).alias("turns"))
    named = lengths.join(first.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("lead", F.slice(F.coalesce("turns", F.array()), 1, F.col("head").cast("int")))
    named = written(named.withColumn("shift", F.size("lead") - F.col("head")).withColumn("length", F.size("lead") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).drop("turns"))
    led = named.select("conv_id", F.explode("lead").alias("t")).select("conv_id", F.col("t.n").cast("long").alias("depth"), "t.content", "t.words")
    rest = turns.join(named.select("conv_id", "head", "shift"), "conv_id").where(F.col("n") > F.col("head")).select("conv_id", (F.col("n") + F.col("shift")).cast("long").alias("depth"), "content", "words")
    return led.unionByName(rest), named.select("conv_id", F.col("length").cast("long"))


def segments(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, start, digests and words by depth from start on: of each conversation's prefixes, the empty one first.

    A prefix's digest is the sum of hashes of its turns with their depths, so that segments are summed apart.
    """
    mark = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "content", "depth"), 64 - BITS) for i in range(PARTS)]
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(d) for d in DIGEST), F.lit(0).cast("long").alias("words"))
    marked = turns.select("conv_id", "depth", *(m.alias(d) for m, d in zip(mark, DIGEST, strict=True)), "words").unionByName(roots)
    own = Window.partitionBy("conv_id", "segment").orderBy("depth")
    summed = marked.withColumn("segment", F.floor(F.col("depth") / SEGMENT)).withColumns({d: F.sum(d).over(own) for d in DIGEST})
    held = summed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("depth", F.struct(*DIGEST).alias("d"), "words"))).alias("held"))
    held = written(held)
    # what the segments before one hold, a row a segment, for conversations of several
    last = F.element_at("held", -1)["d"]
    ends = held.select("conv_id", "segment", *(last[d].alias(d) for d in DIGEST))
    upto = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    wrap = lambda x: x.bitwiseAND((1 << 60) - 1)
    several = ends.withColumns({f"b{i}": F.sum(F.col(d).cast("decimal(38,0)")).over(upto) for i, d in enumerate(DIGEST)}).where(F.col("segment") > 0)
    before = several.select("conv_id", "segment", *(F.pmod(F.col(f"b{i}"), F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias(f"b{i}") for i in range(PARTS)))
    added = lambda x: F.struct(*(wrap(x["d"][d] + F.coalesce(f"b{i}", F.lit(0))).alias(d) for i, d in enumerate(DIGEST)))
    return held.join(before, ["conv_id", "segment"], "left").select("conv_id", (F.col("segment") * SEGMENT).cast("long").alias("start"), F.transform("held", added).alias("digests"), F.transform("held", lambda x: x["words"]).alias("words"))


def prefixes(parts: DataFrame, *keep: str) -> DataFrame:
    """A row for each depth of each segment: conv_id, depth, the digest's columns, words and columns to keep."""
    each = parts.select("conv_id", "start", *keep, F.posexplode(F.arrays_zip("digests", "words")).alias("at", "p"))
    return each.select("conv_id", (F.col("start") + F.col("at")).alias("depth"), *(F.col(f"p.digests.{d}").alias(d) for d in DIGEST), F.col("p.words").alias("words"), *keep)


def minima(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes that several conversations have: depth, digest, owner, n_convs; the hot ones apart, fewer than HOT."""
    found = written(prefixes(parts).groupBy("depth", *DIGEST).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 1))
    most = found.agg(F.sum("n_convs")).first()[0] or 0
    return found.where(F.col("n_convs") * HOT <= most), found.where(F.col("n_convs") * HOT > most)


def owners(asked: DataFrame, common: DataFrame, hot: DataFrame) -> DataFrame:
    """asked (depth, digest) with owner, null where no other conversation has the prefix.

    A hot prefix is found in a broadcast table of fewer than HOT rows, any other by a shuffle: no key of that holds
    more than a share of 1 / HOT of all prefixes.
    """
    key = ["depth", *DIGEST]
    known = asked.join(F.broadcast(hot.select(*key, F.col("owner").alias("hot_owner"))), key, "left")
    is_hot = F.col("hot_owner").isNotNull()
    rest = known.where(~is_hot).join(common.select(*key, "owner"), key, "left").drop("hot_owner")
    return rest.unionByName(known.where(is_hot).withColumnRenamed("hot_owner", "owner"))


def chains(parts: DataFrame, lengths: DataFrame, common: DataFrame, hot: DataFrame) -> DataFrame:
    """conv_id, length, first (the first owned depth; length + 1: none) and parent (the owner of the prefix before it; null: none)."""
    state = parts.select("conv_id", "start", "digests", (F.col("start") - 1).alias("low"), (F.col("start") + F.size("digests")).alias("high"), F.lit(None).cast("long").alias("parent"))
    done = []
    for _ in range(SEGMENT.bit_length()):  # halves a segment to nothing
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        asked = state.withColumn("depth", middle).withColumns({d: F.element_at("digests", (F.col("depth") - F.col("start") + 1).cast("int"))[d] for d in DIGEST})
        known = owners(asked, common, hot)
        ours = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        step = known.select("conv_id", "start", "digests", F.when(ours, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(ours, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(ours, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        step = written(step)
        over = F.col("high") - F.col("low") <= 1
        done.append(step.where(over).select("conv_id", "low", "parent"))
        state = step.where(~over)
        if state.isEmpty():
            break
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    # of a conversation's segments, the last with a prefix of another's
    top = ended.where(F.col("parent").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("low", "parent")).alias("top"))
    return lengths.join(top, "conv_id", "left").select("conv_id", "length", F.coalesce(F.col("top.low") + 1, F.lit(0)).cast("long").alias("first"), F.col("top.parent").alias("parent"))


def hashed_ids(ends: DataFrame, parts: int) -> DataFrame:
    """Of (node, depth, conv_id): the SHA-256 of each (node, depth)'s ids in order, joined by commas.

    Ids of a range are joined where they meet, and the strings of a node go through one running hash in order, a row
    at a time, so that a node's ids are never held together.
    """
    joined = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sorted_ = joined.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "range").select("node", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for b in batches:
            out = []
            for node, depth, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (node, depth) == now:
                    running.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, running.hexdigest()))
                    now, running = (node, depth), hashlib.sha256(ids.encode())
            yield rows(out)
        if now:
            yield rows([(*now, running.hexdigest())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends_sha256"])

    return sorted_.mapInArrow(run, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix.

    turns: conv_id, depth (from 1 on), content (what tells a turn from another), words; lengths: conv_id, length.
    """
    spark = turns.sparkSession
    parts = written(segments(turns, lengths))
    common, hot = minima(parts)
    tops = written(chains(parts, lengths, common, hot))
    own = F.col("first") <= F.col("length")
    owned_parts = parts.join(tops.where(own), "conv_id")
    # a chain's part of each segment that it reaches
    nodes = written(prefixes(owned_parts, "first", "length", "parent").where(F.col("depth") >= F.col("first")))
    shared = common.unionByName(hot)
    hangs = tops.where(own & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hanging"))
    # bottom-up: what a chain saves from each depth on; unshared prefixes save nothing
    gain = shared.select(F.col("owner").alias("conv_id"), "depth", "n_convs").join(nodes.select("conv_id", "depth", "words"), ["conv_id", "depth"]).withColumn("gain", (F.col("n_convs") - 1) * F.col("words"))
    from_here = F.sum("gain").over(Window.partitionBy("conv_id").orderBy(F.col("depth").desc()))
    suffixes = written(gain.withColumn("saved", from_here).select("conv_id", "depth", "saved"))
    totals = suffixes.groupBy("conv_id").agg(F.max_by("saved", -F.col("depth")).alias("saved"))
    leaves = tops.where(own).select("conv_id", F.col("length").alias("depth")).join(hangs, ["conv_id", "depth"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    # a chain counts for all prefixes above it, which others own: those before its first depth
    adds = tops.where(own & (F.col("first") > 0)).join(totals, "conv_id", "left").join(leaves, "conv_id", "left").select("conv_id", "first", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf")).where("saved > 0 or leaf > 0")
    above = prefixes(parts.join(adds, "conv_id").where(F.col("start") < F.col("first")), "first", "saved", "leaf").where(F.col("depth") < F.col("first"))
    above = above.groupBy("depth", *DIGEST).agg(F.sum("saved").alias("saved_below"), F.sum("leaf").alias("leaves_below"))
    sums = shared.join(above, ["depth", *DIGEST], "left").select(F.col("owner").alias("conv_id"), "depth", "n_convs", "saved_below", "leaves_below")
    where_ends = tops.select(F.when(own, F.col("conv_id")).otherwise(F.col("parent")).alias("node"), F.col("length").alias("depth"), "conv_id")
    ends = hashed_ids(where_ends, shuffle_partitions(spark)).withColumnRenamed("node", "conv_id")
    key = ["conv_id", "depth"]
    all_ = nodes.join(leaves, "conv_id", "left").join(sums, key, "left").join(suffixes, key, "left").join(hangs, key, "left").join(ends, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.coalesce("n_convs", F.lit(1)).cast("long").alias("n_convs"),
        (zero(F.col("hanging")) + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        (zero(F.col("leaf")) + zero(F.col("leaves_below"))).alias("n_leaves"),
        (zero(F.col("saved")) + zero(F.col("saved_below"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


def turns_of(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n, content and words of the rows; only a hash of role and text goes on."""
    said = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (role, text)]
    content: Column = F.unhex(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), said[0], said[1]), 256))
    return numbered(rows.where(column(key).isNotNull()).select(column(key).cast("long").alias("conv_id"), column(order).alias("at"), said[0].alias("role"), content.alias("content"), n_words(said[1]).alias("words")))


def conversation_trie(rows: DataFrame, every: int = 20, most: int = 3, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefixes (see prefix_trie) of conversations that begin with the head of another (see shared_heads).

    A null turn comes first, a null role or text is empty; turns of equal number go by role, then by the SHA-256 of
    role and text; equal rows are turns of their own. Rows without a conversation's id are left out. A conversation
    that is left without turns is a member of the root. Other columns are dropped; an empty table gives no rows.
    """
    turns = written(turns_of(rows, key, order, role, text))
    return prefix_trie(*shared_heads(turns, every, most))


def op11(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""
OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, ({_CRC} % 4)::BIGINT AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, o.n AS k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL SELECT c.conv_id, 100000 + o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h
), placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, sha256(length(role)::VARCHAR || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p.path, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.length = p.depth), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY p.path
), family AS (SELECT n.*, up.path AS up_path, up.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.path = left(n.path, 64 * (n.depth - 1)::INTEGER)),
children AS (SELECT up_path AS path, count(*) AS n_children FROM family WHERE up_path IS NOT NULL GROUP BY up_path),
below AS (
  SELECT left(n.path, (64 * d.d)::INTEGER) AS path, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (c.path IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c USING (path), LATERAL (SELECT unnest(range(n.depth + 1)) AS d) d GROUP BY 1
)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM family f LEFT JOIN children c USING (path) JOIN below b USING (path)
"""
