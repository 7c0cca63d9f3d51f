"""Text and identifier functions as Columns; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by extension; any other is application/octet-stream.
MIME = {
    "pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "csv": "text/csv",
    "json": "application/json", "xml": "application/xml", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "wav": "audio/wav", "avi": "video/x-msvideo", "mpg": "video/mpeg", "mpeg": "video/mpeg", "ogg": "audio/ogg",
    "css": "text/css", "js": "application/javascript",
}
#: Types of files by what their positions are counted in; of any other it isn't specified.
BY_CHARACTER = ("TEXT", "MARKDOWN", "HTML", "CSV", "JSON")
BY_PAGE = ("PDF", "DOCX", "DOC", "PPT", "PPTX", "XLSX", "XLS")
BY_TIME = ("MP3", "WAV", "AAC", "OGG", "FLAC", "M4A", "WMA", "AIFF", "WEBM_AUDIO", "MP4", "AVI", "MOV", "MKV", "FLV", "WMV", "MPEG", "WEBM_VIDEO")
#: Types that a thumbnail can be made of.
THUMBNAILABLE = ("PNG", "JPEG", "GIF", "BMP", "TIFF", "WEBP", "MP4", "AVI", "MOV", "MKV", "FLV", "WMV", "MPEG", "WEBM_VIDEO")
#: Page and sheet tags, time marks, and how an instruction names pages.
TAG = r"(?m)^\[(Page|Sheet):\s*([^\]]+?)\]\s*$"
STAMP = r"\[(?:Audio|Sound|Video):\s*(\d{1,2}:\d{2}(?::\d{2})?)(?:\s*-\s*(\d{1,2}:\d{2}(?::\d{2})?))?\]"
PAGE_REFERENCE = r"(?i)(?:on\s+)?pages?\s+(\d+)(?:\s*[-–]\s*(\d+))?"
#: Sizes of slots and segments.
SLOT_SECONDS, PAGES, MEDIA_SECONDS, OVERLAP_SECONDS, CHUNK, PART_BYTES = 120, 3, 1800, 60, 4000, 60_000


def mime_type(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(table[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def modality(mime: Column) -> Column:
    top = F.substring_index(mime, "/", 1)
    return F.when(top.isin("audio", "video", "image"), top).otherwise("document")


def file_type(name: Column) -> Column:
    """TYPE_ and a word by the extension: the extension itself but for some that have another name; without one UNSPECIFIED."""
    ending = F.upper(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    other = {"TXT": "TEXT", "MD": "MARKDOWN", "HTM": "HTML", "JPG": "JPEG", "MPG": "MPEG", "TIF": "TIFF", "WEBM": "WEBM_VIDEO", "": "UNSPECIFIED"}
    named = F.create_map(*(F.lit(x) for kv in other.items() for x in kv))
    return F.concat(F.lit("TYPE_"), F.coalesce(named[ending], ending))


def position_unit(type_: Column) -> Column:
    """What positions in a file of this type are counted in."""
    word = F.regexp_replace(type_, "^TYPE_", "")
    return F.when(word.isin(*BY_CHARACTER), "CHARACTER").when(word.isin(*BY_PAGE), "PAGE").when(word.isin(*BY_TIME), "TIME_MS").otherwise("UNSPECIFIED")


def thumbnailable(type_: Column) -> Column:
    return F.regexp_replace(type_, "^TYPE_", "").isin(*THUMBNAILABLE)


def webm_type(base64_content: Column) -> Column:
    """Video if one of its codecs is named in the first 8 KB, or the content can't be decoded; else audio."""
    raw = F.try_to_binary(base64_content, F.lit("base64"))
    codecs = [F.contains(F.substring(raw, 1, 8192), F.lit(x)) for x in (b"V_VP8", b"V_VP9", b"V_AV1", b"V_MPEG4")]
    return F.when(raw.isNull() | codecs[0] | codecs[1] | codecs[2] | codecs[3], "TYPE_WEBM_VIDEO").otherwise("TYPE_WEBM_AUDIO")


def slug(name: Column) -> Column:
    """Letters, digits and single hyphens, in lower case."""
    plain = F.regexp_replace(name, r"[^a-zA-Z0-9\s-]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), "-+", "-"))


def short_id(prefix: str, uid: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(uid, 256), 1, 8))


def set_key(uids: Column) -> Column:
    """The same for any order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(uids), "|"), 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def escape_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def clean_markdown(text: Column) -> Column:
    """Without the code fence that a model puts around a whole answer."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^```markdown", ""), r"^```", "")
    return F.regexp_replace(F.regexp_replace(out, r"```$", ""), r"^\s+|\s+$", "")


def has_text_layer(pages: Column) -> Column:
    """Fifty printable characters or more in the first three pages."""
    return F.length(F.regexp_replace(F.array_join(F.slice(pages, 1, 3), ""), r"[^\p{Graph}]", "")) >= 50


def seconds(stamp: Column) -> Column:
    """Of HH:MM:SS or MM:SS."""
    return F.aggregate(F.split(stamp, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def stamp(sec: Column) -> Column:
    sec = F.greatest(sec.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(sec / 3600).cast("long"), F.floor(sec % 3600 / 60).cast("long"), sec % 60)


def line_seconds(line: Column) -> Column:
    """Of a line's first mark; null without one."""
    found = F.regexp_extract(line, STAMP, 1)
    return F.when(found != "", seconds(found))


def time_range(text: Column) -> Column:
    """array<long> of milliseconds, from the first mark's start to the last mark's start or end; null without marks."""
    first, last = F.regexp_extract_all(text, F.lit(STAMP), F.lit(1)), F.regexp_extract_all(text, F.lit(STAMP), F.lit(2))
    ends = F.zip_with(first, last, lambda a, b: F.greatest(seconds(a), F.when(b != "", seconds(b))))
    return F.when(F.size(first) > 0, F.array(seconds(first[0]) * 1000, F.element_at(ends, -1) * 1000))


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(2))


def pages_present(text: Column, start: Column, end: Column) -> Column:
    numbers = F.transform(tags(text), lambda t: t.try_cast("long"))
    return F.size(F.array_distinct(F.filter(numbers, lambda n: n.between(start, end))))


def page_slots(pages: Column) -> Column:
    """array<struct<first, last>> of at most three pages each."""
    return F.when(pages > 0, F.transform(F.sequence(F.lit(1).cast("long"), pages, F.lit(PAGES).cast("long")), lambda s: F.struct(s.alias("first"), F.least(s + PAGES - 1, pages).alias("last")))).otherwise(F.array().cast("array<struct<first:long,last:long>>"))


def time_slots(duration: Column, length: int = SLOT_SECONDS) -> Column:
    """array<struct<start, end>> in seconds; the last one ends with the recording."""
    n = F.ceil(duration / length)
    return F.when(duration > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * length).alias("start"), F.least((i + 1) * length, duration).alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def media_splits(duration: Column) -> Column:
    """Half hours, each but the last with a minute of the next."""
    n = F.ceil(duration / MEDIA_SECONDS)
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct((i * MEDIA_SECONDS).alias("start"), F.least((i + 1) * MEDIA_SECONDS + F.when(i < n - 1, OVERLAP_SECONDS).otherwise(0), duration).alias("end")))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def greedy_cuts(bounds: Column, length: Column, target: int = CHUNK) -> Column:
    """Boundaries at least target after the last one taken, and the end; null if there is no second piece.

    The distance to the last cut isn't a prefix sum, so it is a fold over the boundaries.
    """
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("cuts"))
    step = lambda a, b: F.when(b - a["last"] >= target, F.struct(b.alias("last"), F.concat(a["cuts"], F.array(b)).alias("cuts"))).otherwise(a)
    ended = lambda cuts: F.when(F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(-1)) == length, cuts).otherwise(F.concat(cuts, F.array(length)))
    whole = let(F.aggregate(bounds, start, step, lambda a: a["cuts"]), ended)
    return let(whole, lambda w: F.when(F.size(w) >= 2, w))


def line_starts(text: Column) -> Column:
    """Code points before each line."""
    lines = F.split(text, "\n")
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    return F.aggregate(lines, none, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])


def markdown_delimiters(text: Column, target: int = CHUNK) -> Column:
    """Cuts before headings and at the first blank line after text; null for short texts or without a second piece."""

    def bounds(lines: Column) -> Column:
        rows = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("before"), line_starts(text).alias("at"))
        blank = lambda x: F.trim(x) == ""
        here = F.filter(rows, lambda r: (r["at"] > 0) & (F.trim(r["line"]).rlike(r"^#{1,4} ") | (blank(r["line"]) & ~blank(r["before"]))))
        return F.transform(here, lambda r: r["at"].cast("long"))

    return F.when(F.length(text) > target, greedy_cuts(let(F.split(text, "\n"), bounds), F.length(text).cast("long"), target))


def media_delimiters(text: Column, target: int = CHUNK) -> Column:
    """Cuts before lines with a mark; null with fewer than two marks or without a second piece."""
    rows = F.filter(F.arrays_zip(F.split(text, "\n").alias("line"), line_starts(text).alias("at")), lambda r: r["line"].rlike(STAMP))
    cut = lambda r: F.when(F.size(r) >= 2, greedy_cuts(F.transform(F.filter(r, lambda x: x["at"] > 0), lambda x: x["at"].cast("long")), F.length(text).cast("long"), target))
    return let(rows, cut)


def pieces(text: Column, cuts: Column) -> Column:
    """The parts between cuts; the whole text if there are none."""
    starts = F.concat(F.array(F.lit(0).cast("long")), cuts)
    own = F.transform(F.arrays_zip(F.slice(starts, 1, F.size(cuts)).alias("a"), cuts.alias("b")), lambda r: F.substr(text, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")))
    return F.when(cuts.isNull(), F.array(text)).otherwise(own)


def split_text(text: Column, most: int = PART_BYTES) -> Column:
    """Parts of at most so many bytes of UTF-8, ended after the last line break that fits, else between code points.

    A line break at the start of a part doesn't end it. Two parts in a row have more than most - 3 bytes, which bounds the fold.
    """

    def fitting(raw: Column) -> Column:
        follows = lambda k: F.hex(F.substring(raw, most - k + 1, 1)).between("80", "BF")
        n = F.when(F.octet_length(raw) <= most, F.octet_length(raw)).when(~follows(0), F.lit(most)).when(~follows(1), F.lit(most - 1)).when(~follows(2), F.lit(most - 2)).otherwise(F.lit(most - 3))
        return F.decode(F.substr(raw, F.lit(1), n), "utf-8")

    def ended(w: Column) -> Column:
        return let(F.instr(F.reverse(w), "\n"), lambda back: F.when((back > 0) & (back < F.length(w)), F.substr(w, F.lit(1), F.length(w) - back + 1)).otherwise(w))

    def step(a: Column, _: Column) -> Column:
        rest = a["rest"]
        part = F.when(F.octet_length(rest) <= most, rest).otherwise(let(let(F.encode(F.substr(rest, F.lit(1), F.lit(most)), "utf-8"), fitting), ended))
        taken = lambda x: F.struct(F.substr(rest, F.length(x) + 1).alias("rest"), F.concat(a["parts"], F.array(x)).alias("parts"))
        return F.when(rest == "", a).otherwise(let(part, taken))

    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("parts"))
    steps = F.sequence(F.lit(1), F.ceil(2 * F.octet_length(text) / (most - 3)).cast("int") + 2)
    return F.when(F.octet_length(text) <= most, F.array(text)).otherwise(F.aggregate(steps, start, step, lambda a: a["parts"]))


def summary_of(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "## Entities", 1), r"\s+$", "")


def entity_lines(text: Column) -> Column:
    """array<struct<name, type, aliases>> from `- Name [type] (a, b)` lines after `## Entities`; null without that heading."""
    after = F.when(F.contains(text, F.lit("## Entities")), F.substr(text, F.instr(text, "## Entities") + 11))
    lines = F.filter(F.split(after, "\n"), lambda x: x.rlike(r"^- \S"))
    line = r"^- (.*?)\s*(?:\[([^\]]*)\])?\s*(?:\(([^()]*)\))?\s*$"
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, line, 1)).alias("name"), F.regexp_extract(x, line, 2).alias("type"), aliases(F.regexp_extract(x, line, 3), F.trim(F.regexp_extract(x, line, 1))).alias("aliases")))


def aliases(inside: Column, name: Column, most: int = 6) -> Column:
    """Distinct other names, whatever their case, the first six; null if there are none."""
    parts = F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != F.lower(name)))
    empty = F.array().cast("array<string>")
    fold = lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x)))
    own = F.slice(F.aggregate(parts, empty, fold), 1, most)
    return F.when(F.size(own) > 0, own)


def augmented(entities: Column, most: int | None = 2000) -> Column:
    """`Name (a, b); Other`, cut at the last whole entry within so many characters; None: not cut."""
    one = lambda e: F.when(F.size(e["aliases"]) > 0, F.concat(e["name"], F.lit(" ("), F.array_join(e["aliases"], ", "), F.lit(")"))).otherwise(e["name"])
    whole = F.array_join(F.transform(entities, one), "; ")
    if most is None:
        return whole
    cut = F.substr(whole, F.lit(1), F.lit(most))
    last = F.length(cut) - F.length(F.regexp_extract(cut, r"; (?![\s\S]*; )[\s\S]*\z", 0))
    return F.when(F.length(whole) <= most, whole).when(last < F.length(cut), F.substr(cut, F.lit(1), last)).otherwise(cut)


def page_targets(instruction: Column) -> Column:
    """Distinct pages that an instruction names, ranges expanded."""
    first, last = (F.regexp_extract_all(instruction, F.lit(PAGE_REFERENCE), F.lit(k)) for k in (1, 2))
    ranges = F.zip_with(first, last, lambda a, b: F.when(b == "", F.array(a.cast("long"))).when(b.cast("long") >= a.cast("long"), F.sequence(a.cast("long"), F.coalesce(b.try_cast("long"), a.cast("long")))).otherwise(F.array(a.cast("long"))))
    return F.array_distinct(F.flatten(ranges))


def edit_window(targets: Column, n: Column, around: int = 2) -> Column:
    """struct<lo, hi> of segment indices, widened and clamped; null without targets."""
    return F.when(F.size(targets) > 0, F.struct(F.greatest(F.array_min(targets) - around, F.lit(0)).alias("lo"), F.least(F.array_max(targets) + around, n - 1).alias("hi")))


def splice(segments: Column, window: Column, text: Column) -> Column:
    """The segments with those of the window replaced by one text."""
    tail = F.slice(segments, window["hi"].cast("int") + 2, F.greatest(F.size(segments) - window["hi"].cast("int") - 1, F.lit(0)))
    return F.concat(F.slice(segments, F.lit(1), window["lo"].cast("int")), F.array(text), tail)


def merge_tables(parts: Column) -> Column:
    """Parts joined by a blank line; where a table is still open and the next part begins one, its tag goes."""
    count = lambda s, w: (F.length(s) - F.length(F.replace(s, F.lit(w), F.lit("")))) / len(w)
    follows = lambda a, x: (count(a, "<table") > count(a, "</table")) & F.ltrim(x).rlike(r"^<table[^>]*>")
    step = lambda a, x: F.when(a.isNull(), x).when(follows(a, x), F.concat(a, F.lit("\n"), F.regexp_replace(F.ltrim(x), r"^<table[^>]*>", ""))).otherwise(F.concat(a, F.lit("\n\n"), x))
    return F.coalesce(F.aggregate(parts, F.lit(None).cast("string"), step), F.lit(""))


def sheet_markdown(number: Column, rows: Column, most_rows: int = 500, most_columns: int = 30) -> Column:
    """A sheet's rows (array<array<string>>, header first) as a markdown table under its tag."""
    cells = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(r, 1, most_columns), lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    body = F.slice(rows, 2, most_rows)
    head = F.array(F.concat(F.lit("[Sheet: "), number.cast("string"), F.lit("]")), F.lit(""), cells(rows[0]), F.concat(F.lit("| "), F.array_join(F.transform(F.slice(rows[0], 1, most_columns), lambda c: F.lit("---")), " | "), F.lit(" |")))
    more = F.size(rows) - 1 - most_rows
    tail = F.when(more > 0, F.array(F.format_string("... (%d more rows)", more))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(body, cells), tail), "\n")


#: What the messages of errors that may pass hold, case by case.
DEADLINE = ("DEADLINE_EXCEEDED", "504", "context deadline exceeded")
CACHE_EXPIRED = ("is expired",)
RATE_LIMITED = ("RESOURCE_EXHAUSTED", "429")
OTHER_TRANSIENT = ("CANCELLED", "499", "UNAVAILABLE", "503", "document has no pages")


def error_class(message: Column) -> Column:
    """The first that holds of DEADLINE, EXPIRED, RATE, TRANSIENT, all of which may pass when tried again; else PERMANENT. Case matters."""
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(message, w))
    return F.when(holds(DEADLINE), "DEADLINE").when(holds(CACHE_EXPIRED), "EXPIRED").when(holds(RATE_LIMITED), "RATE").when(holds(OTHER_TRANSIENT), "TRANSIENT").otherwise("PERMANENT")


def conversion_timeout(size: Column, base: int = 900) -> Column:
    """Seconds for so many bytes: 15 minutes to 2 hours."""
    return F.least(F.greatest(F.lit(base) + 3 * size.cast("double") / (20 * 1024), F.lit(900)), F.lit(7200)).cast("long")


def standardisation_timeout(size: Column) -> Column:
    """Seconds for so many bytes: 2 minutes and the time at 512 KiB a second, within 5 and 30 minutes."""
    return F.least(F.greatest(F.lit(120) + F.floor(F.greatest(size, F.lit(0)) / (512 * 1024)), F.lit(300)), F.lit(1800)).cast("long")


def resource_part(name: Column, kind: str) -> Column:
    """The id after `kind/` in a resource name."""
    return F.nullif(F.regexp_extract(name, rf"(?:^|/){kind}/([^/]+)", 1), F.lit(""))


def said_query(filter_: Column) -> Column:
    """The text in a filter's q = "..."; null if it has none."""
    return F.nullif(F.regexp_extract(filter_, r'(?:^|[^A-Za-z0-9_.])q\s*=\s*"([^"]*)"', 1), F.lit(""))


def download_name(path: Column) -> Column:
    """The last part; if that is a number and there are more than two, the one before."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return F.when(last.rlike(r"^\d+$") & (F.size(parts) > 2), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def first_duration(text: Column) -> Column:
    """The first line that is a positive finite number."""
    numbers = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull() & (x > 0) & (x < float("inf")))
    return F.get(numbers, F.lit(0))


#: Collections of a resource name, in order.
CHUNK_NAME = ("namespaces", "knowledge-bases", "files", "chunks")
FILE_NAME, SHORT_FILE_NAME, BASE_NAME, OBJECT_NAME = CHUNK_NAME[:3], ("namespaces", "files"), CHUNK_NAME[:2], ("namespaces", "objects")


def name_parts(name: Column, kinds: tuple[str, ...]) -> Column:
    """array<string> of the ids in a name that is made of exactly these collections; null for any other name."""
    parts = F.split(name, "/")
    fits = F.size(parts) == 2 * len(kinds)
    for i, k in enumerate(kinds):
        fits = fits & (F.get(parts, F.lit(2 * i)) == k)
    return F.when(fits, F.array(*(F.get(parts, F.lit(2 * i + 1)) for i in range(len(kinds)))))


def file_of(name: Column) -> Column:
    """struct<namespace, kb, file> of a file's name in its base (kb) or in its namespace alone (kb empty); null for any other."""
    long, short = name_parts(name, FILE_NAME), name_parts(name, SHORT_FILE_NAME)
    one = lambda a, b, c: F.struct(a.alias("namespace"), b.alias("kb"), c.alias("file"))
    return F.when(long.isNotNull(), one(long[0], long[1], long[2])).when(short.isNotNull(), one(short[0], F.lit(""), short[1]))


def tag_of(name: Column) -> Column:
    """struct<repository, tag> of a repository tag's name, anywhere in the text; null without one."""
    found = r"repositories/([^/]+/[^/]+)/tags/([^/]+)"
    return F.when(name.rlike(found), F.struct(F.regexp_extract(name, found, 1).alias("repository"), F.regexp_extract(name, found, 2).alias("tag")))


def has_key(json: Column, key: str) -> Column:
    """Whether a JSON object has the key at its top, whatever its value; null for text that is no object."""
    return F.array_contains(F.json_object_keys(json), key)
