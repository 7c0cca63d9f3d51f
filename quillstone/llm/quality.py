"""Line-first quality rules.

Every line of a text is judged by itself: punctuation rules, navigation rules and boilerplate rules. Failed lines
are removed, and a document that loses too much of its text with them is rejected as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import as_bytes, column, mapped, quoted, slices, without

#: Share of a text's word characters that may be in failed lines.
MAX_LOST = 0.5
#: A line without closing punctuation fails if it has fewer words than this (a heading, a menu entry, a fragment).
FRAGMENT_WORDS = 5
#: Share of a line's words that may hold two or more marks like `***`, `%%%`, `!!`.
MAX_MARKED = 0.3
#: A line fails from so many separators on, if there is one for every four words.
SEPARATORS = 3
#: A line of at least so many words fails if the most frequent of them makes up more than this share.
MONOTONE_WORDS, MONOTONE_SHARE = 20, 0.5
#: A line of more words isn't site furniture, though it mentions a phrase of it.
FURNITURE_WORDS = 25
#: Phrases of site furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy",
    "uses cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter",
    "subscribe to our", "follow us on", "powered by", "skip to content", "back to top",
)

CLOSING = re.compile(rb"(?:[.!?:;,\")\]}'|]|\xe2\x80[\x99\x9d\xa6]|\xc2\xbb|\xe3\x80[\x82\x8d]|\xef\xbc[\x81\x9f])$")
MARKED = re.compile(rb"[#*$%&|<>!?=_~^]{2}")
SEPARATOR = frozenset(x.encode() for x in ("|", ">", "/", "::", "»", "•", "›"))
FURNITURE = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE))
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
LATER_BYTES = bytes(range(0x80, 0xC0))


def code_points(x: bytes) -> int:
    return len(x) if x.isascii() else len(x.translate(None, LATER_BYTES))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    grams = list(zip(words, islice(words, 1, None), islice(words, 2, None)))  # noqa: B905
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = {g for g in grams if g in seen or seen.add(g)}
    n, until = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            n += i + 3 - max(until, i)
            until = i + 3
    return n


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words fails: punctuation, navigation or boilerplate; None if it passes."""
    n = len(words)
    if n < FRAGMENT_WORDS and not CLOSING.search(words[-1]):
        return "punctuation"
    if (k := sum(map(SEPARATOR.__contains__, words))) >= SEPARATORS and 4 * k >= n:
        return "navigation"
    if MARKED.search(line) and sum(1 for w in words if MARKED.search(w)) > MAX_MARKED * n:
        return "punctuation"
    if n <= FURNITURE_WORDS and FURNITURE.search(line.lower()):
        return "boilerplate"
    if n >= MONOTONE_WORDS and len(set(words)) < MONOTONE_SHARE * n + 1 and max(Counter(words).values()) > MONOTONE_SHARE * n:
        return "boilerplate"
    return None


def judge(text: bytes) -> tuple[int, int, int, int, int, bool, int, dict[str, int], list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost characters, failed lines by rule, lines kept."""
    words = text.split()
    seen: set[bytes] = set()
    dup = lost = 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    kept = []
    for line in text.split(b"\n"):
        if not (own := line.split()):
            kept.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if why := "boilerplate" if again else line_fails(line, own):
            failed[why] += 1
            lost += code_points(b"".join(own))
        else:
            kept.append(line)
    n, repeats = len(words), repeated_words(words)
    return n, code_points(b"".join(words)), len(text.translate(None, NOT_SYMBOLS)), dup, repeats, n < 50 or 100 * repeats > 50 * n, lost, failed, kept


def line_quality(df: DataFrame, text: str = "text", max_lost: float = MAX_LOST, clean: str | None = None) -> DataFrame:
    """df's columns and the verdict on each whole text.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean), lost_chars,
    n_punctuation, n_navigation, n_boilerplate (long: failed lines by rule), kept (boolean), and the cleaned text in
    the column that clean names, if any. Words are runs other than ASCII white space; a line that equals an earlier
    one counts as boilerplate. kept is false if the base rules fail or over max_lost of the words' characters are in
    failed lines. A null or empty text has no words and isn't kept. Other columns pass; those with an added name are
    replaced. Rows are independent: nothing is shuffled.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_punctuation", "n_navigation", "n_boilerplate"]
    added = [(x, T.LongType()) for x in longs] + [("base_failed", T.BooleanType()), ("kept", T.BooleanType())] + ([(clean, T.StringType())] if clean else [])
    rest = without(df, *(x for x, _ in added if x != text))
    passed = [c for c in rest.columns if c != clean]
    at, others = rest.columns.index(text), [rest.columns.index(c) for c in passed]
    schema = T.StructType([T.StructField(c, rest.schema[c].dataType) for c in passed] + [T.StructField(x, kind) for x, kind in added])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = [judge(x) for x in as_bytes(batch.column(at))]
            keep = [not x[5] and x[6] <= max_lost * x[1] for x in found]
            rows = [(*x[:5], x[6], *x[7].values()) for x in found]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(longs))]
            columns += [pa.array([x[5] for x in found], pa.bool_()), pa.array(keep, pa.bool_())]
            if clean:
                columns.append(pa.array([b"\n".join(x[8]).decode("utf-8", "replace") for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in others] + columns, names=schema.names)

    return mapped(rest, check, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents, whole_texts

    found = line_quality(whole_texts(documents(spark, sf_dir)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r
), l AS (
  SELECT r, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), own AS (
  SELECT *, len(w) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l WHERE len(w) > 0
), judged AS (
  SELECT r, again, length(array_to_string(w, '')) AS chars, again
    OR (n < 5 AND NOT regexp_matches(w[-1], '[.!?:;,")\]}''|’”…»。」！？]$'))
    OR (len(list_filter(w, lambda x: x IN ('|', '>', '/', '::', '»', '•', '›'))) >= greatest(3, n / 4))
    OR len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>!?=_~^]{2}'))) > 0.3 * n
    OR (n <= 25 AND regexp_matches(lower(line), 'all rights reserved|terms of use|terms of service|terms and conditions|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|lorem ipsum|click here|sign up for our newsletter|subscribe to our|follow us on|powered by|skip to content|back to top'))
    OR (n >= 20 AND list_max(map_values(list_histogram(w))) > 0.5 * n) AS fails
  FROM own
), lost AS (
  SELECT r, sum(chars) FILTER (fails) AS lost, count(*) FILTER (again) AS dup FROM judged GROUP BY r
), base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN lost ON lost.r = d.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept, lost_chars
FROM base
"""


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, unchanged, with all their columns.

    A document with a null or empty text has no words and goes; rows are judged one by one, so that null and repeated
    keys play no part; an empty table gives no rows.
    """
    whole = F.struct(*map(column, docs.columns)).alias("row_")
    kept = line_quality(docs.select(column("text").alias("text"), whole)).where(F.col("kept"))
    return kept.select(*(F.col(f"row_.{quoted(c)}").alias(c) for c in docs.columns))
