"""Pages, chunks and edit windows of one document, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import TAG, let, markdown_delimiters, media_delimiters, split_text, tags, time_range, token_estimate

#: Words that say nothing about the place an instruction means.
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "not", "but", "are", "was", "were", "will", "would",
    "change", "replace", "correct", "fix", "should", "instead", "update", "wrong", "typo", "error", "says", "reads", "spell", "misspelled", "name",
)
#: Fixed value: the header line of a page.
PAGE_HEADER = r"\[Page:\s*(\d+)\]"
#: Documents of so few segments are edited whole.
SMALL = 5
CHUNK = "struct<text:string,start:long,end:long,tokens:long,page:int,last_page:int,from_ms:long,to_ms:long>"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_pages(text: Column) -> Column:
    """array<struct<page, end>>: what stands between page or sheet tags, trimmed, without empty pages.

    end is the code point where the next tag begins, or the text's length. A text without tags is one page; the empty
    text has none.
    """
    parts = F.split(text, TAG, -1)
    marks = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))

    def ends(both: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<page:string,end:long>>").alias("pages"))
        end = lambda a, r: a["at"] + F.length(r["part"])
        step = lambda a, r: F.struct((end(a, r) + F.coalesce(F.length(r["mark"]), F.lit(0))).alias("at"), F.concat(a["pages"], F.array(F.struct(trimmed(r["part"]).alias("page"), end(a, r).alias("end")))).alias("pages"))
        return F.aggregate(both, none, step, lambda a: a["pages"])

    found = F.filter(let(F.arrays_zip(parts.alias("part"), marks.alias("mark")), ends), lambda p: p["page"] != "")
    whole = F.array(F.struct(text.alias("page"), F.length(text).cast("long").alias("end")))
    return F.when(text == "", F.array().cast("array<struct<page:string,end:long>>")).when(F.size(marks) == 0, whole).otherwise(found)


def missing_pages(text: Column, first: Column, last: Column) -> Column:
    """Numbers of the pages from first to last that no tag names."""
    there = F.transform(tags(text), lambda t: t.try_cast("long"))
    return F.when(last >= first, F.array_except(F.sequence(first.cast("long"), last.cast("long")), there)).otherwise(F.array().cast("array<long>"))


def halves(first: Column, last: Column) -> Column:
    """The two ranges that a range of pages is asked for again in; one for a single page."""
    middle = F.floor((first + last) / 2).cast("long")
    one = lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last"))
    return F.when(first < last, F.array(one(first, middle), one(middle + 1, last))).otherwise(F.array(one(first, last)))


def content_segments(text: Column) -> Column:
    """array<struct<page, body>>: pages with their header line, without line feeds at their ends; what comes before the first is page 0."""
    header = f"(?m)^{PAGE_HEADER}"
    body = lambda x: F.regexp_replace(x, r"\n+$", "")
    number = lambda x: F.coalesce(F.regexp_extract(x, f"^{PAGE_HEADER}", 1).try_cast("int"), F.lit(0))
    parts = F.transform(F.split(text, f"(?m)(?=^{PAGE_HEADER})"), lambda x: F.struct(number(x).alias("page"), body(x).alias("body")))
    return F.when(text.rlike(header), F.filter(parts, lambda s: s["body"] != "")).otherwise(F.array(F.struct(F.lit(0).alias("page"), body(text).alias("body"))))


def by_page(targets: Column, segments: Column) -> Column:
    """Indices of the segments whose page is named."""
    return F.filter(F.transform(segments, lambda s, i: F.when(F.array_contains(targets, s["page"].cast("long")), i)), lambda i: i.isNotNull())


def by_keywords(instruction: Column, segments: Column) -> Column:
    """Indices of the segments that hold the instruction's words most often, all that share the highest count; none without hits.

    Words have more than three bytes and aren't stop words; a word that is said twice counts twice.
    """
    words = F.filter(F.transform(F.split(instruction, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w)), lambda w: (F.octet_length(w) > 3) & ~w.isin(*STOP_WORDS))

    def counts(ws: Column) -> Column:
        of = lambda s: F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + ((F.length(s) - F.length(F.replace(s, w, F.lit("")))) / F.length(w)).cast("long"))
        return F.transform(segments, lambda s: let(F.lower(s["body"]), of))

    best = lambda c: F.filter(F.transform(c, lambda n, i: F.when((n > 0) & (n == F.array_max(c)), i)), lambda i: i.isNotNull())
    return let(let(words, counts), best)


def located(targets: Column, instruction: Column, segments: Column) -> Column:
    """Indices of the segments an instruction means: by the pages that it names, else by its words."""
    return let(by_page(targets, segments), lambda found: F.when(F.size(found) > 0, found).otherwise(by_keywords(instruction, segments)))


def whole_document(found: Column, segments: Column) -> Column:
    """Whether an edit takes the whole document: it is small, or no place was found."""
    return (F.size(segments) <= SMALL) | (F.size(found) == 0)


def _chunks(parts: Column, start: Column, page: Column | None) -> Column:
    """Chunks of a page's parts: starts are the page's place and the bytes of the parts before; without a page, parts are numbered."""
    none = F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{CHUNK}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        number = F.size(a["out"]) + 1 if page is None else page
        ms = lambda k: F.get(time_range(x), F.lit(k))
        end = a["at"] + F.octet_length(x)
        chunk = F.struct(x.alias("text"), a["at"].alias("start"), end.alias("end"), token_estimate(x).alias("tokens"), number.cast("int").alias("page"), number.cast("int").alias("last_page"), ms(0).alias("from_ms"), ms(1).alias("to_ms"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(chunk.cast(CHUNK))).alias("out"))

    return F.aggregate(parts, none, step, lambda a: a["out"])


def chunk_content(text: Column, delimiters: Column | None = None) -> Column:
    """array of CHUNK: one or more for each page that isn't blank, none over 60,000 bytes.

    delimiters: ends of the pages in code points (array<long>); where there are none they are put at time marks, else
    at headings and blank lines. Without any, or if the text's length is beyond half or twice the last delimiter, the
    text is split by size alone and the parts are numbered as pages.
    """
    made = F.coalesce(media_delimiters(text), markdown_delimiters(text))
    given = made if delimiters is None else F.when(F.size(delimiters) > 0, delimiters).otherwise(made)

    def dispatched(ends: Column) -> Column:
        last, n = F.element_at(ends, -1), F.length(text)
        fits = ends.isNotNull() & (n >= F.floor(last / 2)) & (n <= 2 * last)
        bounds = F.transform(ends, lambda e: F.least(e, n.cast("long")))
        starts = F.concat(F.array(F.lit(0).cast("long")), bounds)
        pages = F.transform(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("a"), bounds.alias("b")), lambda r, i: F.struct(r["a"].alias("a"), F.substr(text, (r["a"] + 1).cast("int"), F.greatest(r["b"] - r["a"], F.lit(0)).cast("int")).alias("t"), (i + 1).alias("page")))
        shown = F.filter(pages, lambda p: trimmed(p["t"]) != "")
        paged = F.flatten(F.transform(shown, lambda p: _chunks(split_text(p["t"]), p["a"], p["page"])))
        return F.when(fits, paged).otherwise(_chunks(split_text(text), F.lit(0), None))

    return let(given, dispatched)


def reference(from_ms: Column, to_ms: Column, page: Column, last_page: Column) -> Column:
    """struct<unit, start, end> that a chunk is cited by: its time if it has one, else its pages if it has both, else null."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    by = lambda unit, a, b: F.struct(F.lit(unit).alias("unit"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.when((zero(from_ms) != 0) | (zero(to_ms) != 0), by("TIME_MS", zero(from_ms), zero(to_ms))).when((zero(page) != 0) & (zero(last_page) != 0), by("PAGE", page, last_page))
