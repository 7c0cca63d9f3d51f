"""Golden cases of text functions, transcripts and entities."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.trigram import similarity, word_similarity_of
from quillstone.operators import transcripts as R


def value(spark, column, **given):
    df = spark.range(1)
    for k, v in given.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("intro\n[Video: 2:10 - 4:05]\noutro", [130000, 245000]),
        ("[Audio: 0:07 - 1:19] a voice", [7000, 79000]),
        ("[Sound: 12:40] rain", [760000, 760000]),
        ("[Video: 2:00:09 - 2:31:00]", [7209000, 9060000]),
        ("[Audio: 0:12 - 0:34]\nbetween\n[Audio: 1:01 - 1:52]", [12000, 112000]),
        ("nothing to see", None),
        ("", None),
    ],
)
def test_time_range(spark, text, expect):
    assert value(spark, X.time_range(F.col("t")), t=text) == expect


@pytest.mark.parametrize(
    ("make", "text", "target", "least"),
    [
        (X.media_delimiters, "no marks", 4000, None),
        (X.media_delimiters, "[Audio: 00:01:00] one", 4000, None),
        (X.media_delimiters, "\n".join(f"[Video: 00:{m:02d}:00] " + "x" * 480 for m in range(30)), 4000, 3),
        (X.media_delimiters, "\n".join(f"[Audio: {m:02d}:00] " + "a" * 200 for m in range(20)), 500, 5),
        (X.markdown_delimiters, "# Title\na line", 4000, None),
        (X.markdown_delimiters, "x" * 5000, 4000, None),
        (X.markdown_delimiters, "".join(f"## Part {i}\n" + "y" * 800 + "\n" for i in range(15)), 4000, 2),
        (X.markdown_delimiters, ("z" * 500 + "\n\n") * 20, 4000, 2),
    ],
)
def test_delimiters(spark, make, text, target, least):
    cuts = value(spark, make(F.col("t"), target), t=text)
    if least is None:
        assert cuts is None
    else:
        assert len(cuts) >= least and cuts[-1] == len(text) and all(b - a >= target for a, b in zip([0, *cuts], cuts[:-1], strict=False))
        assert "".join(value(spark, X.pieces(F.col("t"), make(F.col("t"), target)), t=text)) == text


def split_bytes(text, most):
    out, raw = [], text.encode()
    while len(raw) > most:
        end = most
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        if (at := raw.rfind(b"\n", 0, end)) > 0:
            end = at + 1
        out.append(raw[:end].decode())
        raw = raw[end:]
    return [*out, raw.decode()] if raw or not out else out


@pytest.mark.parametrize(("text", "most"), [("", 10), ("abc", 10), ("a" * 10, 10), ("a" * 35, 10), ("\n" + "b" * 25, 10), ("ab\ncdefghijklmnop\n\nq\n" * 9, 10), ("é日😀x\n" * 20, 10), ("😀" * 30, 11), ("a\n" + "c" * 70_000 + "\nd", 60_000), ("line é\n" * 20_000, 60_000)])
def test_split_text(spark, text, most):
    assert value(spark, X.split_text(F.col("t"), most), t=text) == split_bytes(text, most)


@pytest.mark.parametrize(("seconds", "n"), [(300, 1), (600, 2), (8935, 30), (1, 1), (299, 1), (301, 2), (0, 0)])
def test_time_slots(spark, seconds, n):
    slots = value(spark, X.time_slots(F.lit(seconds).cast("long"), 300))
    assert len(slots) == n and (not n or slots[-1]["end"] == seconds)


def lines(spark, text):
    return R.lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")


def joined(rows):
    return [r["line"] for r in rows.orderBy("at").collect()]


def marks(*secs, tag="Audio"):
    return "\n".join(f"[{tag}: {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}] w" for s in secs)


@pytest.mark.parametrize(
    ("secs", "start", "end", "tolerance", "left"),
    [
        ((5, 180, 290), 0, 300, 15, 3), ((290, 315), 0, 300, 15, 2), ((290, 310), 300, 600, 15, 2), ((290, 310), 300, 600, 0, 1),
        ((120, 135), 120, 240, 0, 2), ((600, 900), 0, 300, 15, 0), ((5, 120), 300, 600, 15, 0),
    ],
)
def test_clip(spark, secs, start, end, tolerance, left):
    assert len(joined(R.clip(lines(spark, marks(*secs)), "id", start, end, tolerance))) == left


def test_clip_leaves_plain_text(spark):
    assert joined(R.clip(lines(spark, "plain\ntext"), "id", 0, 5)) == ["plain", "text"]


def test_monotonic_twice_is_once(spark):
    once = R.monotonic(lines(spark, marks(5, 60, 30, 61) + "\nplain"), "id")
    assert len(joined(once)) == 4 and joined(R.monotonic(once, "id")) == joined(once)


def test_offset(spark):
    moved = joined(R.offset(lines(spark, "[Audio: 00:00:05] a [Video: 0:10 - 0:20] b\nplain"), 1800))
    assert moved == ["[Audio: 00:30:05] a [Video: 00:30:10 - 00:30:20] b", "plain"]
    assert joined(R.offset(lines(spark, "[Sound: 00:00:05]"), -60)) == ["[Sound: 00:00:00]"]


def test_merge_sides(spark):
    merge = lambda a, v: R.merge_sides(lines(spark, a), lines(spark, v), "id").select("text").collect()
    out = merge(marks(5, 30), marks(10, 25, tag="Video"))[0][0]
    assert [x[1:6] + x[-4:] for x in out.split("\n")] == ["Audio5] w", "Video0] w", "Video5] w", "Audio0] w"]
    assert merge(marks(5), marks(10) + "\n" + marks(15, tag="Video"))[0][0].count("[Audio") == 1
    assert merge(marks(60), marks(60, tag="Video"))[0][0].startswith("[Audio")
    assert merge("", "") == []


def test_entities(spark):
    text = "Short.\n\n## Entities\n- Harbour [place] (port, quay, 港, harbour, dock, Port)\n- Lonely\nprose between\n- X [c] (a, A, b, B, c, C, d, E, F, G)\n- Y [c] ()\n"
    found = value(spark, X.entity_lines(F.col("t")), t=text)
    assert [(e["name"], e["type"], e["aliases"]) for e in found] == [
        ("Harbour", "place", ["port", "quay", "港", "dock"]), ("Lonely", "", None), ("X", "c", ["a", "b", "c", "d", "E", "F"]), ("Y", "c", None)
    ]
    assert value(spark, X.entity_lines(F.col("t")), t="without a list") is None
    assert value(spark, X.augmented(X.entity_lines(F.col("t"))), t=text).startswith("Harbour (port, quay, 港, dock); Lonely; X (a")
    many = "## Entities\n" + "\n".join(f"- ent-{'0' * 18}{i:02d}" for i in range(100))
    cut = value(spark, X.augmented(X.entity_lines(F.col("t"))), t=many)
    assert len(cut) <= 2000 and all(len(x) == 24 for x in cut.split("; "))


@pytest.mark.parametrize(("said", "targets"), [("look at page 31 again", [31]), ("pages 4-6 lack a header", [4, 5, 6]), ("nothing is named", []), ("page 9, then pages 2–3", [9, 2, 3])])
def test_page_targets(spark, said, targets):
    assert value(spark, X.page_targets(F.col("s")), s=said) == targets


def test_windows_and_splice(spark):
    window = lambda t, n: tuple(value(spark, X.edit_window(F.array(F.lit(t)), F.lit(n))))
    assert window(40, 90) == (38, 42) and window(1, 90) == (0, 3) and window(89, 90) == (87, 89)
    parts = F.array(*(F.lit(x) for x in "abcdef"))
    assert value(spark, X.splice(parts, F.struct(F.lit(1).alias("lo"), F.lit(3).alias("hi")), F.lit("X"))) == ["a", "X", "e", "f"]


def test_tables_and_sheets(spark):
    parts = F.array(F.lit("before\n<table border=1><tr><td>north</td></tr>"), F.lit("  <table border=1><tr><td>south</td></tr></table>\nafter"))
    out = value(spark, X.merge_tables(parts))
    assert out == "before\n<table border=1><tr><td>north</td></tr>\n<tr><td>south</td></tr></table>\nafter"
    rows = F.array(*(F.array(F.lit(f"a|{i}"), F.lit("b\nc")) for i in range(4)))
    assert value(spark, X.sheet_markdown(F.lit(1), rows, 2)) == "[Sheet: 1]\n\n| a\\|0 | b c |\n| --- | --- |\n| a\\|1 | b c |\n| a\\|2 | b c |\n... (1 more rows)"


def test_small_functions(spark):
    assert value(spark, X.set_key(F.array(F.lit("aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa")))) == "4242a3bcf13673bb"
    assert value(spark, X.tags(F.col("t")), t="[Sheet: stock (old) 7]\n\nlines\n[Page: 12]\n") == ["stock (old) 7", "12"]
    assert value(spark, X.download_name(F.col("t")), t="a/b/3") == "b" and value(spark, X.download_name(F.col("t")), t="x.pdf") == "x.pdf"
    assert value(spark, X.first_duration(F.col("t")), t="N/A\n-3\n12.5\n7") == 12.5
    assert value(spark, X.resource_part(F.col("t"), "files"), t="namespaces/n/files/f-1/chunks/c") == "f-1"
    assert value(spark, X.error_class(F.col("t")), t="quota: RESOURCE_EXHAUSTED") == "RATE" and value(spark, X.error_class(F.col("t")), t="cancelled") == "PERMANENT"
    assert value(spark, X.said_query(F.col("t")), t='kb = "a" AND q = "two words"') == "two words" and value(spark, X.said_query(F.col("t")), t='seq = "a"') is None
    assert value(spark, X.conversion_timeout(F.lit(10**9))) == 7200


def test_dedup_tags(spark):
    kept = joined(R.dedup_tags(lines(spark, "[Sheet: fruit]\n\npears\n\n[Sheet: fruit]\n\nplums\n"), "id"))
    assert sum(x.startswith("[Sheet") for x in kept) == 1 and "pears" in kept and "plums" in kept


def test_trigrams(spark):
    assert round(value(spark, similarity(F.lit("word"), F.lit("two words"))), 6) == 0.363636
    assert word_similarity_of("word", "two words") == 0.8
