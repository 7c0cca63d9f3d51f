"""Queries over blobs, and over documents that are converted in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.text import let
from quillstone.operators import ranges as G
from quillstone.operators import transcripts as R
from quillstone.plans.adapters import table
from quillstone.plans.registry import query
from quillstone.plans.texts import HMS
from quillstone.sources import blobs as B
from quillstone.sources.shared import dealt, once


def page_blobs(spark, sf_dir) -> str:
    """A store in which every fifth page is missing."""
    rows = table(spark, sf_dir, "pages").where("page_id % 5 <> 4").select(F.format_string("pages/%d/%d.html", F.col("page_id") % 7, F.col("page_id")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return once(spark, "blobs", sf_dir, lambda root: B.write(rows, root))


NAMED = "named AS (SELECT page_id, 'pages/' || (page_id % 7) || '/' || page_id || '.html' AS path, page_id % 5 <> 4 AS there, html FROM pages)"


@query(f"WITH {NAMED} SELECT path, octet_length(encode(html))::BIGINT AS length FROM named WHERE there AND (path LIKE 'pages/3/%' OR path LIKE 'pages/5/1%')")
def blob_listing(spark, sf_dir):
    """Blobs under two prefixes, listed side by side without reading them."""
    return B.listing(spark, page_blobs(spark, sf_dir), ("pages/3/", "pages/5/1", "pages/5/12", "none/")).select("path", "length")


@query(f"WITH {NAMED} SELECT page_id, CASE WHEN there THEN octet_length(encode(html)) END::BIGINT AS length, CASE WHEN NOT there THEN 'no blob at ' || path END AS error FROM named")
def blob_stat(spark, sf_dir):
    wanted = table(spark, sf_dir, "pages").select("page_id", F.format_string("pages/%d/%d.html", F.col("page_id") % 7, F.col("page_id")).alias("path"))
    return B.stat(wanted, page_blobs(spark, sf_dir)).select("page_id", "length", "error")


@query(f"WITH {NAMED} SELECT page_id, CASE WHEN there THEN md5(html) END AS body, CASE WHEN NOT there THEN 'no blob at ' || path END AS error FROM named")
def blob_batch_read(spark, sf_dir):
    """All pages are asked for; the missing ones are error rows."""
    wanted = table(spark, sf_dir, "pages").select("page_id", F.format_string("pages/%d/%d.html", F.col("page_id") % 7, F.col("page_id")).alias("path"))
    return B.fetch_all(wanted, page_blobs(spark, sf_dir)).select("page_id", F.md5("content").alias("body"), "error")


RANGES = """p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
r AS (
  SELECT doc_id, 1::BIGINT AS first, max(page)::BIGINT AS last FROM p GROUP BY 1
  UNION ALL
  SELECT doc_id, h.first, h.last FROM (
    SELECT doc_id, unnest([{'first': first, 'last': (first + last) // 2}, {'first': (first + last) // 2 + 1, 'last': last}]) AS h
    FROM r WHERE last - first + 1 > 16 OR (last > first AND last - first + 1 > 2 AND last // 5 > (first - 1) // 5))
),
leaf AS (SELECT * FROM r WHERE NOT (last - first + 1 > 16 OR (last > first AND last - first + 1 > 2 AND last // 5 > (first - 1) // 5))),
said AS (SELECT l.doc_id, l.first, string_agg('[Page: ' || page || ']' || chr(10) || line, chr(10) ORDER BY page) AS t FROM leaf l JOIN p ON p.doc_id = l.doc_id AND p.page BETWEEN l.first AND l.last GROUP BY ALL)"""


@query(f"WITH RECURSIVE {RANGES} SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) || chr(10) ORDER BY first)) AS text FROM said GROUP BY 1")
def missing_page_bisection(spark, sf_dir):
    """Lines as pages, of a service that takes too long for over 16 pages, forgets the tag of every fifth page but in pairs, and that of every tenth also alone."""
    # rows that share a doc_id are one document, whose pages hold a line of each
    texts = dealt(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").groupBy("doc_id").agg(F.collect_list("text").alias("texts")), "doc_id")
    page = lambda x, i: F.struct((i + 1).cast("long").alias("page"), x.alias("line"))
    lines = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, "\n"), page)))

    def said(p, n):
        forgotten = ((p["page"] % 5 == 0) & (n > 2)) | ((p["page"] % 10 == 0) & (n == 1))
        return F.when(forgotten, p["line"]).otherwise(F.concat(F.lit("[Page: "), p["page"].cast("string"), F.lit("]\n"), p["line"]))

    def answers(x):
        def one(r):
            n = r["last"] - r["first"] + 1
            own = F.when(F.size("texts") == 1, F.slice(x, r["first"].cast("int"), n.cast("int"))).otherwise(F.sort_array(F.filter(x, lambda p: p["page"].between(r["first"], r["last"]))))
            return F.struct(r["first"].alias("first"), r["last"].alias("last"), F.array_join(F.transform(own, lambda p: said(p, n)), "\n").alias("text"))

        return F.transform("ranges", one)

    def ask(frontier):
        late = F.col("last") - F.col("first") + 1 > 16
        refused = frontier.where(late).select("doc_id", "first", "last", F.lit(None).cast("string").alias("text"), F.lit("http 504: DEADLINE_EXCEEDED").alias("error"))
        asked = frontier.where(~late).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
        told = asked.join(texts, "doc_id").select("doc_id", F.explode(let(lines, answers)).alias("a"))
        return refused.unionByName(told.select("doc_id", "a.first", "a.last", "a.text", F.lit(None).cast("string").alias("error")))

    size = F.array_max(F.transform("texts", lambda t: F.size(F.split(t, "\n"))))
    parts = G.converted(texts.select("doc_id", F.lit(1).alias("first"), size.alias("last")), ask, "doc_id")
    counts = parts.groupBy("doc_id").agg(F.count("*").alias("n"))
    return G.joined(parts, "doc_id").join(counts, "doc_id").select("doc_id", "n", F.md5("text").alias("text"))


PARTS = f"""l AS (SELECT conv_id, turn, turn // 2 AS c, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM conversations),
m AS (SELECT *, CASE WHEN i % 2 = 0 THEN (i * 25 + (turn % 2) * 35 + c * 60)::BIGINT END AS sec, c > 0 AND i = 0 AND turn % 2 = 0 AS early FROM l),
t AS (SELECT conv_id, turn, bool_or(early) AS cut, string_agg(CASE WHEN sec IS NULL THEN body ELSE '[Audio: ' || {HMS.format('sec')} || '] ' || body END || CASE WHEN i = 0 AND turn % 4 = 1 THEN chr(10) || '[Page: 2]' ELSE '' END, chr(10) ORDER BY i) FILTER (NOT early) AS x FROM m GROUP BY 1, 2),
j AS (SELECT conv_id, regexp_replace(regexp_replace(string_agg(CASE WHEN cut THEN regexp_replace(coalesce(x, ''), '^\\s+|\\s+$', '', 'g') ELSE x END, chr(10) || chr(10) ORDER BY turn), '(?m)^\\[(Page|Sheet):\\s*([^\\]]+?)\\]\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM t GROUP BY 1),
r AS (SELECT conv_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM j),
s AS (SELECT *, regexp_extract(line, '\\[(?:Audio|Sound|Video):\\s*(\\d+):(\\d+):(\\d+)', ['h', 'm', 's']) AS p FROM r),
u AS (SELECT conv_id, line, i, try_cast(p.h AS BIGINT) * 3600 + try_cast(p.m AS BIGINT) * 60 + try_cast(p.s AS BIGINT) AS sec FROM s),
v AS (SELECT *, coalesce(sec < max(sec) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM u),
y AS (SELECT conv_id, count(*) FILTER (back) AS dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT back), '') AS x FROM v GROUP BY 1)"""


@query(f"WITH {PARTS} SELECT conv_id, dropped, length(z)::BIGINT AS length, md5(z) AS text FROM (SELECT *, CASE WHEN dropped > 0 THEN regexp_replace(x, '^\\s+|\\s+$', '', 'g') ELSE x END AS z FROM y)")
def media_assembly(spark, sf_dir):
    """Turns as converted parts of a recording, two of each chunk of a minute; chunks share twenty seconds, and some parts have a page tag."""
    t = table(spark, sf_dir, "conversations")
    chunk = F.floor(F.col("turn") / 2)
    mark = lambda i: F.when(i % 2 == 0, F.concat(F.lit("[Audio: "), X.stamp(i * 25 + F.col("turn") % 2 * 35), F.lit("] "))).otherwise("")
    tag = lambda i: F.when((i == 0) & (F.col("turn") % 4 == 1), "\n[Page: 2]").otherwise("")
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(mark(i), x, tag(i))), "\n")
    parts = t.select("conv_id", F.col("turn").alias("part"), text.alias("text"), (chunk * 60).alias("by"), F.when(chunk > 0, 20).otherwise(0).alias("overlap"))
    return R.assembled_media(parts, "conv_id").select("conv_id", "dropped", "length", F.md5("text").alias("text"))
