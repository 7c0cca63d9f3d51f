"""Paging, filters, permissions, search scores, table changes and the state table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.operators import catalog as C
from quillstone.operators import lifecycle as L
from quillstone.operators import merges as M
from quillstone.operators import search as S
from quillstone.plans.filters import Clause, Filter, FilterError, permitted


def test_pages_join_to_the_whole_list(spark):
    rows = spark.createDataFrame([(f"u{i:03d}", datetime(2024, 1, 1 + i % 3)) for i in range(57)], "uid string, update_time timestamp")
    whole = [(r.update_time, r.uid) for r in rows.orderBy(F.col("update_time").desc(), F.col("uid").desc()).collect()]
    got, token = [], None
    while True:
        page = [(r.update_time, r.uid) for r in C.page(rows, 10, token).collect()]
        got += page[:10]
        if len(page) <= 10:
            break
        token = page[10]
    assert got == whole


DOCS = [
    (1, "This picture shows a chicken (公雞, 公鸡, rooster, 雞, 鸡). Zodiac."),
    (2, "A flat text doc about English synonyms: rooster, chicken, cock only."),
    (3, "A completely unrelated doc about monopoly and property trading."),
]


@pytest.mark.parametrize(("question", "expect"), [("雞", [(1, 0.9556)]), ("公鸡", [(1, 0.9556)]), ("chicken", [(1, 0.4579), (2, 0.4579)]), ("rooster", [(1, 0.4579), (2, 0.4579)]), ("monopoly", [(3, 1.0355)]), ("absent", [])])
def test_bm25(spark, question, expect):
    index = spark.createDataFrame(DOCS, "uid long, text string")
    assert sorted((r.uid, round(r.score, 4)) for r in S.bm25(index, question).collect()) == expect


def test_fusion(spark):
    legs = [spark.createDataFrame(x, "uid long, score double") for x in ([(1, 0.9), (2, 0.5)], [(1, 7.0), (3, 6.0)])]
    out = {r.uid: r.score for r in S.fuse(legs, 5).collect()}
    assert out[1] == round(2 / 61, 6) and out[2] == out[3] == round(1 / 62, 6)


FILTER = Filter({"a": "number", "b": "number", "c": "number", "tags": "array", "name": "string"})
ROWS = [(a, b, c, ["x"] if a else ["y"], "n") for a in (0, 1) for b in (0, 1) for c in (0, 1)]


@pytest.mark.parametrize(
    ("text", "expect"),
    [
        ("a = 1 AND b = 1 OR c = 1", lambda a, b, c: a and (b or c)),
        ("(a = 1 AND b = 1) OR c = 1", lambda a, b, c: (a and b) or c),
        ("NOT a = 1 AND -b = 1", lambda a, b, c: not a and not b),
        ('tags : "x" AND c != 0', lambda a, b, c: a and c),
        ("", lambda a, b, c: True),
    ],
)
def test_filters(spark, text, expect):
    df = spark.createDataFrame(ROWS, "a int, b int, c int, tags array<string>, name string")
    where = FILTER.compile(text)
    got = {(r.a, r.b, r.c) for r in (df if where is None else df.where(where)).collect()}
    assert got == {r[:3] for r in ROWS if expect(*r[:3])}


@pytest.mark.parametrize("text", ["nope = 1", "a =", "a = 1 b", "(a = 1", 'a : "x"', "= 1"])
def test_filter_errors(spark, text):
    with pytest.raises(FilterError):
        FILTER.compile(text)


def test_permissions(spark):
    assert permitted(None) is None and permitted([]) is None and permitted([Clause(), Clause()]) is None
    df = spark.createDataFrame([("u1", ["k:1"], "P"), ("u2", None, "W"), ("u3", ["z"], "W"), ("u4", ["k:9"], "W"), ("u5", None, "P")], "uid string, tags array<string>, visibility string")
    where = permitted([Clause(tags_overlap=("k:1",)), Clause(uids=("u5",)), Clause(tags_like_none=("k:%",), visibility=("W",))])
    assert {r.uid for r in df.where(where).collect()} == {"u1", "u2", "u3", "u5"}


def test_swap_twice_and_upsert_twice(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "kb string, n int")
    assert sorted(M.swap(M.swap(df, "kb", "a", "b"), "kb", "a", "b").collect()) == sorted(df.collect())
    old = spark.createDataFrame([("k", "n", "t", ["x"])], "kb_uid string, name string, entity_type string, aliases array<string>")
    new = spark.createDataFrame([("k", "n", "", ["y", "x"]), ("k", "m", "u", None)], old.schema)
    once = M.upsert_entities(old, new)
    assert sorted(map(tuple, once.collect())) == [("k", "m", "u", []), ("k", "n", "", ["x", "y"])]
    assert sorted(map(tuple, M.upsert_entities(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_bulk_update_is_all_or_nothing(spark):
    old = spark.createDataFrame([("a", 1)], "uid string, n int")
    with pytest.raises(KeyError):
        M.bulk_update(old, spark.createDataFrame([("z", 2)], "uid string, n int"), "uid", "n")


@pytest.mark.parametrize("text", ["é" * 10, "a€b€c", "😀😀😀", "abc", ""])
def test_truncate_bytes(spark, text):
    for most in range(3, 12):
        got = spark.createDataFrame([(text,)], "t string").select(M.truncate_bytes("t", most)).first()[0]
        assert got == text.encode()[:most].decode("utf-8", "ignore")


def test_states(spark):
    files = spark.createDataFrame([("a", "k", "P"), ("b", "k", "C"), ("c", None, "C"), ("d", "k", "C"), ("e", "k", "C"), ("f", "k", "C")], "uid string, kb_uid string, process_status string")
    files = files.withColumn("process_status", F.when(F.col("process_status") == "C", "FILE_PROCESS_STATUS_COMPLETED").otherwise("FILE_PROCESS_STATUS_PROCESSING"))
    rows = lambda *ids: spark.createDataFrame([(x,) for x in ids], "file_uid string")
    out = L.integrity(files, rows(*"cddeeff"), rows(*"cdeeff"), rows("f"))
    assert {r.uid: r.state for r in out.collect()} == {"a": "NOT_COMPLETED", "b": "EMPTY_PG", "c": "FILE_NOT_FOUND", "d": "MISSING_MILVUS", "e": "MISSING_CONVERTED_FILE", "f": "HEALTHY"}


def test_fuzzy_filter_finds_a_misspelling(spark, data):
    """Against the similarity of every file's name to the misspelt text; ids hold no such text."""
    from quillstone.functions.trigram import word_similarity_of
    from quillstone.plans import registry
    from quillstone.plans.catalog import live_files
    from quillstone.plans.filters import ID_LIKE, WORD_LIKE

    def grams(x):
        return {p[i : i + 3] for w in x.lower().replace("-", " ").split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    asked = grams("reprt 41")
    alike = lambda x: len(grams(x) & asked) / len(grams(x) | asked)
    rows = live_files(spark, data).select("uid", "id", "display_name").collect()
    expected = {r.uid for r in rows if word_similarity_of("reprt 41", r.display_name) >= WORD_LIKE or alike(r.id) > ID_LIKE}
    found = registry.queries()["filter_fuzzy"](spark, data).collect()
    assert {r.uid for r in found} == expected and len(found) == len(expected)
    assert expected and not any("reprt" in r.display_name for r in found)
