"""Queries over text functions and transcripts. The test texts have no page tags or marks, so they are put in first."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import transcripts as R
from quillstone.plans.adapters import table
from quillstone.plans.registry import query


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def paged(spark, sf_dir):
    """Every line of a text on a page of its own."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[Page: "), (i + 1).cast("string"), F.lit("]\n"), x))
    return documents(spark, sf_dir).withColumn("text", F.array_join(lines, "\n"))


PAGED = "paged AS (SELECT doc_id, string_split(text, chr(10)) AS body FROM documents)"


@query(f"WITH {PAGED} SELECT doc_id, len(body)::BIGINT AS n_tags, len(body)::BIGINT AS present FROM paged")
def page_tags(spark, sf_dir):
    return paged(spark, sf_dir).select("doc_id", F.size(X.tags(F.col("text"))).cast("long").alias("n_tags"), X.pages_present(F.col("text"), F.lit(1), F.lit(10**9)).cast("long").alias("present"))


@query("SELECT doc_id, s.i AS slot, 3 * s.i + 1 AS first, least(3 * s.i + 3, n) AS last FROM (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents), LATERAL (SELECT unnest(generate_series(0, (n - 1) // 3)) AS i) s")
def page_slots(spark, sf_dir):
    n = F.size(F.split("text", "\n")).cast("long")
    slots = documents(spark, sf_dir).select("doc_id", F.posexplode(X.page_slots(n)).alias("slot", "s"))
    return slots.select("doc_id", F.col("slot").cast("long").alias("slot"), "s.first", "s.last")


@query("SELECT doc_id, s.i AS slot, 120 * s.i AS start, least(120 * (s.i + 1), n_chars) AS end_ FROM documents, LATERAL (SELECT unnest(generate_series(0, (n_chars + 119) // 120 - 1)) AS i) s WHERE n_chars > 0")
def time_slots(spark, sf_dir):
    slots = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.time_slots(F.col("n_chars"))).alias("slot", "s"))
    return slots.select("doc_id", F.col("slot").cast("long").alias("slot"), F.col("s.start").alias("start"), F.col("s.end").alias("end_"))


@query("SELECT doc_id, count(*) AS n, sum(e - b)::BIGINT AS seconds FROM (SELECT doc_id, 1800 * s.i AS b, least(1800 * (s.i + 1) + CASE WHEN s.i < k - 1 THEN 60 ELSE 0 END, n_chars) AS e FROM (SELECT doc_id, n_chars, greatest((n_chars + 1799) // 1800, 1) AS k FROM documents), LATERAL (SELECT unnest(generate_series(0, k - 1)) AS i) s) GROUP BY 1")
def media_splits(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.media_splits(F.col("n_chars"))).alias("s"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("seconds"))


CUTS = """l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l),
b AS (SELECT doc_id, pos FROM o WHERE pos > 0 AND ({bound})),
c AS (SELECT doc_id, 0::BIGINT AS cut, 0 AS n FROM src UNION ALL SELECT c.doc_id, (SELECT min(pos) FROM b WHERE b.doc_id = c.doc_id AND b.pos >= c.cut + 4000), c.n + 1 FROM c WHERE c.cut IS NOT NULL),
e AS (SELECT src.doc_id, length(src.text)::BIGINT AS len, count(cut) FILTER (c.n > 0) AS k, max(cut) FILTER (c.n > 0) AS last FROM src JOIN c USING (doc_id) GROUP BY ALL)
SELECT doc_id, k + CASE WHEN coalesce(last, -1) = len THEN 0 ELSE 1 END AS n_cuts, (SELECT string_agg(p::VARCHAR, ',' ORDER BY p) FROM (SELECT cut AS p FROM c WHERE c.doc_id = e.doc_id AND n > 0 AND cut IS NOT NULL UNION SELECT len)) AS cuts
FROM e WHERE len > {least} AND k + CASE WHEN coalesce(last, -1) = len THEN 0 ELSE 1 END >= 2"""


def places(cuts):
    return F.array_join(F.transform(cuts, lambda p: p.cast("string")), ",").alias("cuts")


@query("WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), " + CUTS.format(bound="trim(line, ' ') = '' AND trim(prev, ' ') <> '' OR regexp_matches(trim(line, ' '), '^#{1,4} ')", least=4000))
def markdown_delimiters(spark, sf_dir):
    cuts = X.markdown_delimiters(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return documents(spark, sf_dir).select("doc_id", F.size(cuts).cast("long").alias("n_cuts"), places(cuts)).where("n_cuts >= 2")


def marked(spark, sf_dir):
    """Every line with a mark of its place."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[Audio: "), X.stamp(i * 20), F.lit("] "), x))
    return documents(spark, sf_dir).withColumn("text", F.array_join(lines, "\n"))


@query("WITH RECURSIVE src AS (SELECT doc_id, string_agg('[Audio: 00:00:00] ' || line, chr(10) ORDER BY i) AS text, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1 HAVING count(*) >= 2), " + CUTS.format(bound="true", least=0))
def media_delimiters(spark, sf_dir):
    cuts = X.media_delimiters(F.col("text"))
    return marked(spark, sf_dir).select("doc_id", F.size(cuts).cast("long").alias("n_cuts"), places(cuts)).where("n_cuts >= 2")


@query("SELECT doc_id, 0::BIGINT AS first, (len(string_split(text, chr(10))) - 1) * 20000 AS last FROM documents")
def time_ranges(spark, sf_dir):
    found = marked(spark, sf_dir).select("doc_id", X.time_range(F.col("text")).alias("r"))
    return found.select("doc_id", F.col("r")[0].alias("first"), F.col("r")[1].alias("last"))


def transcript(spark, sf_dir):
    """conv_id, role and lines at, line, sec: the first line of each turn has a mark; a turn's second goes back at every third one."""
    t = table(spark, sf_dir, "conversations")
    sec = F.col("turn") * 50 - F.when(F.col("turn") % 3 == 2, 70).otherwise(0)
    mark = F.concat(F.when(F.col("role") == "assistant", "[Video: ").otherwise("[Audio: "), X.stamp(sec), F.lit("] "))
    lines = t.select("conv_id", "role", "turn", mark.alias("mark"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    out = lines.select("conv_id", "role", (F.col("turn") * 10_000 + F.col("i")).alias("at"), F.when(F.col("i") == 0, F.concat("mark", "line")).otherwise(F.col("line")).alias("line"))
    return out.withColumn("sec", X.line_seconds(F.col("line")))


def digest(rows):
    """Each conversation's number of lines and a hash of them in order."""
    return R.rejoined(rows, "conv_id").join(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id").select("conv_id", "n", F.md5("text").alias("lines"))


HMS = "format('{{:02d}}:{{:02d}}:{{:02d}}', ({0}) // 3600, ({0}) % 3600 // 60, ({0}) % 60)"
LINES = f"""turns AS (SELECT *, greatest(turn * 50 - CASE WHEN turn % 3 = 2 THEN 70 ELSE 0 END, 0)::BIGINT AS s FROM conversations),
cut AS (SELECT conv_id, turn, role, s, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM turns),
lines AS (SELECT conv_id, turn, role, turn * 10000 + i AS pos, CASE WHEN i = 0 THEN s END AS sec, body, CASE WHEN role = 'assistant' THEN '[Video: ' ELSE '[Audio: ' END AS tag FROM cut)"""
MARKED = f"CASE WHEN sec IS NULL THEN body ELSE tag || {HMS.format('sec')} || '] ' || body END"
DIGEST = "SELECT conv_id, count(*) AS n, md5(string_agg({0}, chr(10) ORDER BY pos)) AS lines FROM {1} GROUP BY 1"


@query(f"WITH {LINES}, f AS (SELECT *, min(pos) FILTER (sec >= 100) OVER w AS first_ok FROM lines WINDOW w AS (PARTITION BY conv_id)), g AS (SELECT *, max(pos) FILTER (sec < 100 AND pos < coalesce(first_ok, 1000000000)) OVER (PARTITION BY conv_id) AS last_early, max((sec > 215)::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS late FROM f) " + DIGEST.format(MARKED, "(SELECT * FROM g WHERE pos > coalesce(last_early, -1) AND coalesce(late, 0) = 0)"))
def timestamps_clip(spark, sf_dir):
    return digest(R.clip(transcript(spark, sf_dir), "conv_id", 115, 200))


@query(f"WITH {LINES}, m AS (SELECT *, max(sec) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM lines) " + DIGEST.format(MARKED, "(SELECT * FROM m WHERE sec IS NULL OR most IS NULL OR sec >= most)"))
def timestamps_monotonic(spark, sf_dir):
    return digest(R.monotonic(transcript(spark, sf_dir), "conv_id"))


@query(f"WITH {LINES} " + DIGEST.format(MARKED.replace("WHEN sec IS NULL", "WHEN t IS NULL").replace("(sec)", "(sec + 1800)"), "(SELECT *, sec AS t FROM lines)"))
def timestamps_offset(spark, sf_dir):
    return digest(R.offset(transcript(spark, sf_dir), 1800))


@query(f"WITH {LINES} " + DIGEST.format(MARKED, "(SELECT * REPLACE (CASE WHEN tag = '[Audio: ' AND sec > 97 THEN 97 ELSE sec END AS sec) FROM lines WHERE NOT (tag = '[Audio: ' AND coalesce(sec, 0) > 102))"))
def timestamps_clamp(spark, sf_dir):
    return digest(R.clamp(transcript(spark, sf_dir), 97))


@query(f"WITH {LINES}, e AS (SELECT conv_id, turn, tag, max(sec) AS sec, string_agg({MARKED}, chr(10) ORDER BY pos) AS entry FROM lines GROUP BY ALL) SELECT conv_id, md5(string_agg(entry, chr(10) ORDER BY sec, tag, turn)) AS lines FROM e GROUP BY 1")
def audio_visual_merge(spark, sf_dir):
    rows = transcript(spark, sf_dir)
    heard = F.coalesce(F.col("role"), F.lit("user")) != "assistant"
    return R.merge_sides(rows.where(heard), rows.where(~heard), "conv_id").select("conv_id", F.md5("text").alias("lines"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')) AS slug, 'kb-' || substr(sha256(url), 1, 8) AS short_id, octet_length(encode(html)) // 4 AS tokens FROM pages")
def slug_hash_estimate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.short_id("kb", F.col("url")).alias("short_id"), X.token_estimate(F.col("html")).alias("tokens"))


@query("SELECT user_id, substr(sha256(string_agg(DISTINCT event_type, '|' ORDER BY event_type)), 1, 16) AS key FROM events GROUP BY 1")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(X.set_key(F.collect_set("event_type")).alias("key"))


#: Every ending that has a media type of its own, and some that have none; media type, modality, unit.
ENDINGS = (
    ("pdf", "application/pdf", "document", "PAGE"), ("md", "text/markdown", "document", "CHARACTER"), ("txt", "text/plain", "document", "CHARACTER"),
    ("doc", "application/msword", "document", "PAGE"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", "PAGE"),
    ("html", "text/html", "document", "CHARACTER"), ("ppt", "application/vnd.ms-powerpoint", "document", "PAGE"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "document", "PAGE"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "document", "PAGE"), ("xls", "application/vnd.ms-excel", "document", "PAGE"),
    ("csv", "text/csv", "document", "CHARACTER"), ("json", "application/json", "document", "CHARACTER"), ("xml", "application/xml", "document", "UNSPECIFIED"),
    ("zip", "application/zip", "document", "UNSPECIFIED"), ("tar", "application/x-tar", "document", "UNSPECIFIED"), ("gz", "application/gzip", "document", "UNSPECIFIED"),
    ("jpg", "image/jpeg", "image", "UNSPECIFIED"), ("JPEG", "image/jpeg", "image", "UNSPECIFIED"), ("Png", "image/png", "image", "UNSPECIFIED"),
    ("gif", "image/gif", "image", "UNSPECIFIED"), ("svg", "image/svg+xml", "image", "UNSPECIFIED"), ("MP3", "audio/mpeg", "audio", "TIME_MS"),
    ("mp4", "video/mp4", "video", "TIME_MS"), ("wav", "audio/wav", "audio", "TIME_MS"), ("avi", "video/x-msvideo", "video", "TIME_MS"),
    ("mpg", "video/mpeg", "video", "TIME_MS"), ("mpeg", "video/mpeg", "video", "TIME_MS"), ("ogg", "audio/ogg", "audio", "TIME_MS"),
    ("css", "text/css", "document", "UNSPECIFIED"), ("js", "application/javascript", "document", "UNSPECIFIED"),
    ("mov", "application/octet-stream", "document", "TIME_MS"), ("webp", "application/octet-stream", "document", "UNSPECIFIED"), ("zzz", "application/octet-stream", "document", "UNSPECIFIED"),
)


@query(f"SELECT doc_id, e[1] AS mime, e[2] AS kind, e[3] AS unit FROM (SELECT doc_id, [{', '.join(str(list(x[1:])) for x in ENDINGS)}][doc_id % {len(ENDINGS)} + 1] AS e FROM documents)")
def mime_lookup(spark, sf_dir):
    ending = F.element_at(F.array(*(F.lit(x[0]) for x in ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    named = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("a.b/file."), ending).alias("name"))
    return named.select("doc_id", X.mime_type(F.col("name")).alias("mime"), X.modality(X.mime_type(F.col("name"))).alias("kind"), X.position_unit(X.file_type(F.col("name"))).alias("unit"))


#: Messages and what kind of error each is.
MESSAGES = (
    ("rpc error: DEADLINE_EXCEEDED", "DEADLINE"), ("http 504", "DEADLINE"), ("context deadline exceeded", "DEADLINE"), ("deadline exceeded", "PERMANENT"),
    ("Cache content 7 is expired.", "EXPIRED"), ("RESOURCE_EXHAUSTED", "RATE"), ("http 429", "RATE"), ("rate limit", "PERMANENT"), ("CANCELLED", "TRANSIENT"),
    ("http 499", "TRANSIENT"), ("UNAVAILABLE", "TRANSIENT"), ("http 503", "TRANSIENT"), ("the document has no pages", "TRANSIENT"), ("http 500", "PERMANENT"), ("bad input", "PERMANENT"),
)


@query(f"SELECT doc_id, [{', '.join(repr(x[1]) for x in MESSAGES)}][doc_id % {len(MESSAGES)} + 1] AS kind, least(greatest(120 + n_chars * 1000 // 524288, 300), 1800)::BIGINT AS seconds FROM documents")
def error_classes(spark, sf_dir):
    """Kinds of error messages, and the time that is given to standardise a file of a thousand times a document's length."""
    message = F.concat(F.lit("step: "), F.element_at(F.array(*(F.lit(x[0]) for x in MESSAGES)), (F.col("doc_id") % len(MESSAGES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", X.error_class(message).alias("kind"), X.standardisation_timeout(F.col("n_chars") * 1000).alias("seconds"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'TYPE_WEBM_VIDEO' WHEN 1 THEN CASE WHEN regexp_matches(substr(html, 1, 8192), 'V_(VP8|VP9|AV1|MPEG4)') THEN 'TYPE_WEBM_VIDEO' ELSE 'TYPE_WEBM_AUDIO' END ELSE 'TYPE_WEBM_VIDEO' END AS kind FROM pages")
def webm_sniff(spark, sf_dir):
    """Whole pages as containers: with a codec's name within the first 8 KB, without one, and undecodable."""
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("xx V_VP9 "), "html")).otherwise(F.col("html"))
    coded = F.when(F.col("page_id") % 3 == 2, F.lit("%%%")).otherwise(F.base64(F.encode(body, "utf-8")))
    return table(spark, sf_dir, "pages").select("page_id", X.webm_type(coded).alias("kind"))


@query("SELECT page_id, replace(replace(replace(html, '|', '\\|'), chr(10), ' '), chr(13), '') AS cell FROM pages")
def escape_cell(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_cell(F.col("html")).alias("cell"))


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents")
def clean_markdown(spark, sf_dir):
    fenced = F.concat(F.lit("\n```markdown\n"), F.col("text"), F.lit("\n```\n"))
    return documents(spark, sf_dir).select("doc_id", X.clean_markdown(fenced).alias("t"))


@query("SELECT p_brand AS kb_uid, string_agg(p_name || ' (' || p_type || ')', '; ' ORDER BY p_partkey) AS t FROM part GROUP BY 1")
def parse_and_format_entities(spark, sf_dir):
    """A summary's entity list is read and written again; each summary lists the parts of a brand."""
    part = table(spark, sf_dir, "part")
    line = F.concat(F.lit("- "), F.col("p_name"), F.lit(" [part] ("), F.col("p_type"), F.lit(", "), F.upper("p_type"), F.lit(", , "), F.col("p_name"), F.lit(")"))
    held = part.groupBy(F.col("p_brand").alias("kb_uid")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("x"))
    summary = F.concat(F.lit("About parts.\n\n## Entities\n"), F.array_join(F.col("x.line"), "\n"))
    return held.select("kb_uid", X.augmented(X.entity_lines(summary), None).alias("t"))


@query(f"WITH {PAGED} SELECT doc_id, greatest(len(body) // 2 - 1 - 2, 0)::BIGINT AS lo, least(len(body) // 2 + 2, len(body) - 1)::BIGINT AS hi FROM paged WHERE len(body) >= 3")
def edit_window(spark, sf_dir):
    """An instruction that names two pages in the middle of each document."""
    n = F.size(F.split("text", "\n"))
    rows = documents(spark, sf_dir).select("doc_id", n.cast("long").alias("n")).where("n >= 3")
    said = F.format_string("On pages %d-%d the name is wrong.", F.floor(F.col("n") / 2), F.floor(F.col("n") / 2) + 1)
    window = X.edit_window(F.transform(X.page_targets(said), lambda p: p - 1), F.col("n"))
    return rows.select("doc_id", window.alias("w")).select("doc_id", "w.lo", "w.hi")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(html) - len(replace(html, '<p', '')) AS p_chars FROM pages")
def html_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), (F.length("html") - F.length(F.replace("html", F.lit("<p"), F.lit("")))).cast("long").alias("p_chars"))
