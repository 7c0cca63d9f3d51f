"""Queries over pages, chunks and edit windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import pages as P
from quillstone.functions import text as X
from quillstone.operators import transcripts as R
from quillstone.plans.registry import query
from quillstone.plans.texts import CUTS, documents, marked, paged

#: Lines of the documents by number, and where the tag of each stands if every line is a page of its own.
TAGGED = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
t AS (SELECT *, coalesce(sum(length(line) + length('[Page: ' || i || ']') + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tag FROM l)"""


@query(f"WITH {TAGGED} SELECT doc_id, count(*) AS n, md5(string_agg(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY i)) AS pages, string_agg((tag + length(line) + length('[Page: ' || i || ']') + CASE WHEN i = n THEN 1 ELSE 2 END)::VARCHAR, ',' ORDER BY i) AS ends FROM t WHERE NOT regexp_full_match(line, '\\s*') GROUP BY 1")
def parse_pages(spark, sf_dir):
    """Texts with a tag before every line: their pages and where each ends."""
    found = paged(spark, sf_dir).select("doc_id", P.parse_pages(F.col("text")).alias("p")).where(F.size("p") > 0)
    return found.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p.page", "\n")).alias("pages"), F.array_join(F.transform("p.end", lambda e: e.cast("string")), ",").alias("ends"))


@query("SELECT doc_id, string_agg(CASE WHEN i <= 2 * (n // 3) AND i % 2 = 1 AND i + 1 <= 2 * (n // 3) THEN line ELSE '[Page: ' || CASE WHEN i <= 2 * (n // 3) THEN (i + 1) // 2 ELSE i END || ']' || chr(10) || line END, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1")
def dedup_page_tags(spark, sf_dir):
    """Two lines to a page, each under the page's tag, in the first two thirds of a text: the last tag of a page stays."""
    n = F.size(F.split("text", "\n"))
    until = 2 * F.floor(n / 3)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[Page: "), F.when(i + 1 <= until, F.floor((i + 2) / 2)).otherwise(i + 1).cast("string"), F.lit("]\n"), x))
    rows = R.lines(documents(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id", "text")
    return R.rejoined(R.dedup_tags(rows, "doc_id"), "doc_id").withColumnRenamed("text", "t")


@query("SELECT doc_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (i % 3 = 0), '') AS missing, max(n) // 2 AS middle FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1 HAVING max(n) > 1")
def missing_pages(spark, sf_dir):
    """Texts whose every third page has no tag: the pages that are asked for again, and the middle that a range of all is halved at."""
    n = F.size(F.split("text", "\n"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 != 0, F.concat(F.lit("[Page: "), (i + 1).cast("string"), F.lit("]\n"), x)).otherwise(x))
    rows = documents(spark, sf_dir).select("doc_id", n.alias("n"), F.array_join(lines, "\n").alias("text")).where("n > 1")
    # halves of 1 to n; the middle of 0 to n is checked
    return rows.select("doc_id", F.array_join(F.transform(P.missing_pages(F.col("text"), F.lit(1), F.col("n")), lambda i: i.cast("string")), ",").alias("missing"), F.get(P.halves(F.lit(0), F.col("n")), F.lit(0))["last"].alias("middle"))


@query("SELECT doc_id, (CASE WHEN preface <> '' THEN 1 ELSE 0 END + n)::BIGINT AS n, md5(CASE WHEN preface <> '' THEN preface || '|' ELSE '' END || pages) AS bodies FROM (SELECT doc_id, count(*) FILTER (i > 1) AS n, regexp_replace(max(line) FILTER (i = 1), '\\n+$', '') AS preface, string_agg('[Page: ' || i || ']' || CASE WHEN line <> '' THEN chr(10) || line ELSE '' END, '|' ORDER BY i) FILTER (i > 1) AS pages FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1 HAVING count(*) > 1)")
def content_segments(spark, sf_dir):
    """The first line of a text is a preface, every other a page."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("[Page: "), (i + 1).cast("string"), F.lit("]\n"), x)))
    rows = documents(spark, sf_dir).where(F.size(F.split("text", "\n")) > 1).select("doc_id", P.content_segments(F.array_join(lines, "\n")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s.body", "|")).alias("bodies"))


SAID = "Please fix the wrong name tion: there is Ding, ding and the hest instead"


@query("""WITH s AS (SELECT doc_id, i - 1 AS i, lower('[Page: ' || i || ']' || chr(10) || line) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
w AS (SELECT unnest(['please', 'tion', 'there', 'ding', 'ding', 'hest']) AS w), c AS (SELECT doc_id, i, sum((len(b) - len(replace(b, w, ''))) // len(w)) AS n FROM s, w GROUP BY ALL),
k AS (SELECT doc_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (n > 0 AND n = m), '') AS found, count(*) AS size FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM c) GROUP BY 1)
SELECT doc_id, found, size <= 5 OR found = '' AS whole FROM k""")
def locate_by_keywords(spark, sf_dir):
    """The pages that an instruction means by its words, and whether the edit takes the whole document."""
    rows = paged(spark, sf_dir).select("doc_id", P.content_segments(F.col("text")).alias("s"))
    found = rows.select("doc_id", "s", P.located(X.page_targets(F.lit(SAID)), F.lit(SAID), F.col("s")).alias("f"))
    return found.select("doc_id", F.array_join(F.transform("f", lambda i: i.cast("string")), ",").alias("found"), P.whole_document(F.col("f"), F.col("s")).alias("whole"))


@query(f"WITH {TAGGED} SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY i)) AS lines FROM t WHERE line <> '' GROUP BY 1")
def assemble_pages(spark, sf_dir):
    """Batches of a text's pages, put together again and parsed; the pages are the lines."""
    shown = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda r: r["x"] != "")
    parts = F.transform(shown, lambda r: F.concat(F.lit("[Page: "), (r["i"] + 1).cast("string"), F.lit("]\n"), r["x"]))
    rows = documents(spark, sf_dir).select("doc_id", parts.alias("parts")).where(F.size("parts") > 0)
    whole = R.assembled(rows, "doc_id", "parts")
    found = whole.select("doc_id", P.parse_pages(F.col("text")).alias("p"))
    return found.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p.page", "\n")).alias("lines"))


BY_MARKDOWN = CUTS.split("SELECT doc_id, k +")[0].format(bound="trim(line, ' ') = '' AND trim(prev, ' ') <> '' OR regexp_matches(trim(line, ' '), '^#{1,4} ')", least=4000)


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), {BY_MARKDOWN},
p AS (SELECT doc_id, cut AS p FROM c WHERE n > 0 AND cut IS NOT NULL UNION SELECT doc_id, length(text) FROM src),
q AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, lag(p, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS page FROM p),
r AS (SELECT doc_id, page::INT AS page, a AS start, substr(text, (a + 1)::BIGINT, (p - a)::BIGINT) AS t FROM q JOIN src USING (doc_id) WHERE k >= 2 AND length(text) > 4000
  UNION ALL SELECT doc_id, 1, 0, text FROM src WHERE length(text) <= 4000 OR doc_id NOT IN (SELECT doc_id FROM q WHERE k >= 2))
SELECT doc_id, page, start::BIGINT AS start, (start + octet_length(encode(t)))::BIGINT AS end_, octet_length(encode(t)) // 4 AS tokens, md5(t) AS text FROM r
WHERE NOT regexp_full_match(t, '\\s*') OR length(t) <= 4000 AND doc_id NOT IN (SELECT doc_id FROM q WHERE k >= 2)""")
def chunk_documents(spark, sf_dir):
    """Chunks of texts without pages or marks, with their places, numbers and bytes; the SQL has no split of pages over 60,000 bytes, which unit tests check."""
    doubled = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = doubled.select("doc_id", F.explode(P.chunk_content(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.page", "c.start", F.col("c.end").alias("end_"), "c.tokens", F.md5("c.text").alias("text"))


@query(f"WITH {TAGGED} SELECT doc_id, i::INT AS page, md5(text) AS text FROM (SELECT doc_id, i, CASE WHEN i = 1 THEN '' ELSE '' END || '[Page: ' || i || ']' || chr(10) || line || CASE WHEN i = n THEN '' ELSE chr(10) END AS text FROM t)")
def chunk_pages(spark, sf_dir):
    """Chunks of texts with a tag before each line, by given delimiters: where each next tag begins."""
    n = F.transform(F.split("text", "\n"), lambda x, i: F.length(x) + F.length(F.concat(F.lit("[Page: "), (i + 1).cast("string"), F.lit("]"))) + 2)
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("ends"))
    ends = F.aggregate(n, none, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["ends"], F.array(a["at"] + x)).alias("ends")), lambda a: a["ends"])
    rows = documents(spark, sf_dir).select("doc_id", ends.alias("ends")).join(paged(spark, sf_dir).select("doc_id", "text"), "doc_id")
    found = rows.select("doc_id", F.explode(P.chunk_content(F.col("text"), F.col("ends"))).alias("c"))
    return found.select("doc_id", "c.page", F.md5("c.text").alias("text"))


@query("SELECT doc_id, md5(string_agg(t, '|' ORDER BY page)) AS texts, count(*) AS n, 0::BIGINT AS first, (max(n) - 1) * 20000 AS last FROM (SELECT doc_id, 1 AS page, len(string_split(text, chr(10))) AS n, '' AS t FROM documents) GROUP BY 1")
def chunk_times(spark, sf_dir):
    """Transcripts in chunks: the first chunk's first mark and the last one's last; put together the chunks are the text."""
    found = marked(spark, sf_dir).select("doc_id", "text", P.chunk_content(F.col("text")).alias("c"))
    whole = F.array_join(F.col("c.text"), "") == F.col("text")
    return found.select("doc_id", F.md5(F.when(whole, "").otherwise("differs")).alias("texts"), F.lit(1).cast("long").alias("n"), F.get("c", F.lit(0))["from_ms"].alias("first"), F.element_at("c", -1)["to_ms"].alias("last"))
