"""Stored indexes: what a search reads, changes, and results against a full scan."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions.trigram import word_similarity_of
from quillstone.operators.cells import CellIndex, dense_many
from quillstone.operators.fuzzy import TrigramIndex
from quillstone.operators.postings import SparseIndex
from quillstone.operators.search import bm25
from quillstone.sources.keyed import BUCKET, KeyedTable

WORDS = [f"w{i}" for i in range(400)]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def texts(spark, n=6000, seed=3):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, len(WORDS) + 1)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(1, 30), p=p / p.sum())), f"g{i % 3}") for i in range(n)]
    rows[7], rows[8] = (7, None, "g0"), (8, "", "g1")
    return spark.createDataFrame(rows, "uid long, text string, grp string")


def scores(df):
    return [(r["uid"], r["score"]) for r in df.select("uid", "score").collect()]


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    index = SparseIndex(spark, str(tmp_path_factory.mktemp("postings")))
    index.add(texts(spark))
    return index


def test_bm25_of_an_index_is_that_of_the_rows(spark, sparse):
    rows = texts(spark)
    for asked in ("w3 w250 w17", "w399", "w0", "w1 w1 nothing", "w20 w21 w22 w23 w24 w300"):
        want = scores(bm25(rows, asked, 25))
        assert scores(sparse.search(asked, 25)) == want == scores(sparse.search(asked, 25, prune=False))
    where = F.col("grp") == "g1"
    assert scores(sparse.search("w3 w250 w17", 25, where)) == scores(bm25(rows, "w3 w250 w17", 25, where))
    assert sparse.search("nothing at all", 5).count() == 0 and sparse.search("", 5).count() == 0
    assert SparseIndex(spark, sparse.folder + "-none").search("w1").count() == 0


def test_a_question_reads_its_terms_only(sparse):
    text = plan(sparse.postings_of(sparse.terms_of("w3 w250")))
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters")[1].split("\n")[0] and "In(term, [w250,w3])" in text
    # a rare term excludes the ranges in which it isn't
    found = sparse.part("postings").where("term = 'w0'").agg(F.count("*"), F.max("n")).first()
    assert found[0] >= 6 and found[1] <= 1024


def test_an_updated_index_is_a_new_one(spark, sparse, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "a"))
    rows = texts(spark, 3000)
    index.add(rows.where("uid < 2000"))
    index.add(rows.where("uid >= 2000"))
    index.add(rows.where("uid % 7 = 1").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" w250 w250"))), rows.where("uid % 7 = 1 or uid % 11 = 0").select("uid"))
    index.add(rows.where("uid = 11").withColumn("text", F.lit("w250")))
    index.add(rows.where("uid < 0"), rows.where("uid = 11 or uid = 8").select("uid"))  # only removes
    now = index.live()
    assert now.count() == len({i for i in range(3000) if i % 7 == 1 or i % 11} - {11, 8})
    fresh = index.merged(str(tmp_path / "b"))
    for asked in ("w250", "w3 w250 w17"):
        assert scores(index.search(asked, 30)) == scores(bm25(now, asked, 30)) == scores(fresh.search(asked, 30))
    assert index.rows_of(index.search("w250", 3), "grp").count() == 3


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path))
    index.add(texts(spark, 50))
    before = scores(index.search("w1 w2", 5))
    texts(spark, 50, 9).withColumn("dl", F.lit(1)).withColumn("range", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/documents/segment=2")
    assert scores(index.search("w1 w2", 5)) == before and index.segments() == [1]


def clustered(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.15 * rng.normal(size=16)).tolist(), i % 4) for i in range(n)] + [(n, [0.0] * 16, 0), (n + 1, None, 0), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0] + [0.0] * 15, 2)]
    return spark.createDataFrame(rows, "uid long, embedding array<double>, part int")


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    index = CellIndex(spark, str(tmp_path_factory.mktemp("cells")))
    index.build(clustered(spark), 10)
    return index


def queries(spark, n=40):
    return clustered(spark, n, 6).select(F.col("uid").alias("query_id"), F.col("embedding").alias("vector"))


def pairs(df):
    return {(r["query_id"], r["rank"]): (r["uid"], r["score"]) for r in df.collect()}


def test_cells_hold_the_neighbours(spark, cells):
    rows, asked = clustered(spark), queries(spark)
    want, got = pairs(dense_many(rows, asked, 10)), pairs(cells.search(asked, 10))
    hits = {(q, v[0]) for (q, _), v in want.items()} & {(q, v[0]) for (q, _), v in got.items()}
    assert len(got) == len(want) and len(hits) >= 0.95 * len(want)
    assert pairs(cells.exact(asked, 10)) == want
    where = F.col("part") == 1
    assert pairs(cells.exact(asked, 10, where)) == pairs(dense_many(rows, asked, 10, where))
    assert len(pairs(cells.exact(asked.where("query_id = 3"), 5000))) == 3001  # all that have a direction


def test_a_search_reads_the_visited_cells_only(spark, cells):
    found = cells.search(queries(spark, 1).where("query_id = 0"), 10, visited=3)
    assert "dynamicpruning" in plan(found)
    found.collect()
    node = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in node
    total = spark.read.parquet(f"{cells.folder}/rows").select("cell").distinct().count()
    assert total > 20
    read = {r[0] for r in cells.rows().join(cells.cells_of(queries(spark, 1).where("query_id = 0")).where("place <= 3").select("cell"), "cell").select("cell").distinct().collect()}
    assert len(read) == 3


def test_recall_on_vectors_without_structure(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("uid"), "embedding")
    index = CellIndex(spark, str(tmp_path))
    index.build(rows, 20)
    asked = rows.where("uid % 10 = 0").select(F.col("uid").alias("query_id"), F.col("embedding").alias("vector"))
    want, got = pairs(dense_many(rows, asked, 20)), pairs(index.search(asked, 20))
    hits = {(q, v[0]) for (q, _), v in want.items()} & {(q, v[0]) for (q, _), v in got.items()}
    assert len(hits) >= 0.95 * len(want)


def test_many_queries_at_once(spark, monkeypatch):
    monkeypatch.setattr("quillstone.operators.cells.QUERIES", 7)
    rows, asked = clustered(spark, 200), queries(spark, 20)
    x = {r.uid: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows.collect() if r.uid < 200 or r.uid == 203}
    got = pairs(dense_many(rows, asked, 3))
    for r in asked.collect():
        if r.query_id in (20, 21, 22):
            continue
        v = np.array(r.vector) / np.linalg.norm(r.vector)
        best = sorted(((-round(float(u @ v), 6), i) for i, u in x.items()))[:3]
        assert [got[r.query_id, k + 1] for k in range(3)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in best]
    assert len(got) == 3 * 21
    assert dense_many(rows.where("uid < 0"), asked, 3).count() == 0 and dense_many(rows, asked.where("query_id < 0"), 3).count() == 0
    other = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert dense_many(rows, other, 3).count() == 0  # of another dimension


def test_cells_of_nothing(spark, tmp_path):
    index = CellIndex(spark, str(tmp_path))
    index.build(clustered(spark, 0).where("uid < 0"))
    assert index.search(queries(spark, 2)).count() == 0


def test_trigrams_leave_out_no_row(spark, tmp_path):
    rng = np.random.default_rng(2)
    names = [" ".join(rng.choice(["annual", "budget", "report", "notes", "draft", "Größe", "x1", "of"], rng.integers(0, 4))) + f" {i % 9}" for i in range(300)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(300, None)], "uid long, name string")
    index = TrigramIndex(spark, str(tmp_path), ("name",))
    index.build(rows)
    for asked, least in (("anual bugdet", 0.3), ("größe", 0.3), ("report", 0.9), ("x1", 0.6)):
        want = {i for i, n in enumerate(names) if round(word_similarity_of(asked, n), 6) >= least}
        assert {r.uid for r in index.search(asked, "name", least).collect()} == want and want
        assert len(want) <= index.candidates(asked, {"name": least}).count() < 200
    assert index.candidates("", {"name": 0.3}) is None and index.candidates("of", {"name": 0.3}, ("name",)) is None
    held = F.contains("name", F.lit("udge"))
    assert {r.uid for r in index.matching(held, "udge", {"name": 1.0}, ("name",)).collect()} == {i for i, n in enumerate(names) if "udge" in n}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("uid",), 8)
    rows = spark.range(200).selectExpr("id AS uid", "id % 5 AS file", "'old' AS text")
    table.create(rows)
    before = table.files()
    touched = table.upsert(spark.createDataFrame([(3, 0, "new"), (999, 1, "new")], "uid long, file long, text string"))
    after = table.files()
    assert 1 <= len(touched) <= 2
    kept = {p for p in before if not any(f"{BUCKET}={b}/" in p for b in touched)}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert {r.uid for r in table.read().where("text = 'new'").collect()} == {3, 999} and table.read().count() == 201
    one = table._held().where("uid = 10").first()[BUCKET]
    gone = [r.uid for r in table._held().where(f"{BUCKET} = {one}").collect()]
    assert table.delete(F.col("uid").isin(gone)) == [one]  # a bucket without rows
    assert table.read().count() == 201 - len(gone) and table.delete(F.col("uid") == -1) == []
    table.update(F.col("file") == 2, {"text": F.upper("text"), "file": F.lit(7).cast("long")})
    assert table.read().where("file = 2").count() == 0 and {r.text for r in table.read().where("file = 7").collect()} == {"OLD"}
