"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import trigram
from quillstone.operators import search as S
from quillstone.plans.adapters import INDEX, KBS, LINKS, entities, entity_files, knowledge_bases, sparse_index, table, vector_index
from quillstone.plans.registry import query


def vector(spark, sf_dir, n=0):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == n).first()["embedding"]]


def question(spark, sf_dir, n=0):
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") == n).first()["text"]


COS = "round(list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"
TERMS = r"""q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark WHERE item_id = 0),
tok AS (SELECT uid, tags, file_uid, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM idx),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(t) AS term FROM tok) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT p.uid, any_value(k.tags) AS tags, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(k.t) / avgdl))), 6) AS score
  FROM post p JOIN df USING (term) JOIN tok k USING (uid), stat GROUP BY p.uid)"""


def legs(k: int, where: str = "true") -> str:
    return f"""dl AS (SELECT uid, {COS} AS score FROM idx WHERE {where} ORDER BY score DESC, uid LIMIT {k}),
sl AS (SELECT uid, score FROM bm WHERE {where} ORDER BY score DESC, uid LIMIT {k}),
rk AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS r FROM dl UNION ALL SELECT uid, row_number() OVER (ORDER BY score DESC, uid) FROM sl),
fused AS (SELECT uid, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM rk GROUP BY uid ORDER BY score DESC, uid LIMIT {k})"""


@query(f"WITH {INDEX}, {TERMS}, {legs(20, chr(39) + 'en' + chr(39) + ' = ANY(tags)')} SELECT uid, f.score, file_uid FROM fused f JOIN idx USING (uid)")
def hybrid_search_rrf(spark, sf_dir):
    return sparse_index(spark, sf_dir).hybrid(vector(spark, sf_dir), question(spark, sf_dir), 20, F.array_contains("tags", "en"), ("file_uid",)).select("uid", "score", "file_uid")


@query(f"WITH {INDEX} SELECT uid, {COS} AS score FROM idx ORDER BY score DESC, uid LIMIT 20")
def dense_topk(spark, sf_dir):
    return S.dense(vector_index(spark, sf_dir), vector(spark, sf_dir), 20).select("uid", "score")


@query(f"WITH {INDEX} SELECT uid, {COS} AS score FROM idx WHERE file_uid IN ('group-1', 'group-2') AND list_has_any(tags, ['fr', 'de']) ORDER BY score DESC, uid LIMIT 10")
def dense_filtered(spark, sf_dir):
    where = F.col("file_uid").isin("group-1", "group-2") & F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("de")))
    return S.dense(vector_index(spark, sf_dir), vector(spark, sf_dir), 10, where).select("uid", "score")


@query(f"WITH {INDEX}, {TERMS} SELECT uid, score FROM bm ORDER BY score DESC, uid LIMIT 20")
def bm25_topk(spark, sf_dir):
    return S.bm25(vector_index(spark, sf_dir), question(spark, sf_dir), 20).select("uid", "score")


@query(f"WITH {INDEX}, {TERMS}, {legs(20)} SELECT uid, score, file_uid FROM (SELECT f.uid, f.score, file_uid, row_number() OVER (PARTITION BY file_uid ORDER BY f.score DESC, f.uid) AS n FROM fused f JOIN idx USING (uid)) WHERE n <= 2")
def hybrid_grouped(spark, sf_dir):
    hits = S.hybrid(vector_index(spark, sf_dir), vector(spark, sf_dir), question(spark, sf_dir), 20, keep=("file_uid",))
    return S.first_of_each(hits, "file_uid", 2).select("uid", "score", "file_uid")


@query(f"WITH {INDEX}, s AS (SELECT uid, file_uid, {COS} AS score FROM idx), r AS (SELECT *, row_number() OVER (PARTITION BY file_uid ORDER BY score DESC, uid) AS n FROM s), g AS (SELECT file_uid, max(score) AS b FROM r WHERE n <= 2 GROUP BY 1 ORDER BY b DESC, file_uid LIMIT 5) SELECT uid, file_uid, score FROM r WHERE n <= 2 AND file_uid IN (SELECT file_uid FROM g)")
def dense_grouped(spark, sf_dir):
    return S.dense_by_group(vector_index(spark, sf_dir), vector(spark, sf_dir), 5, 2).select("uid", "file_uid", "score")


@query("WITH a AS (SELECT o_orderkey AS uid, o_totalprice AS score FROM orders ORDER BY 2 DESC, 1 LIMIT 50), b AS (SELECT l_orderkey AS uid, sum(l_quantity) AS score FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), r AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS k FROM a UNION ALL SELECT uid, row_number() OVER (ORDER BY score DESC, uid) FROM b) SELECT uid, round(sum(1.0::DOUBLE / (60 + k)), 6) AS score FROM r GROUP BY uid ORDER BY score DESC, uid LIMIT 50")
def rrf_fusion_only(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("score"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.sum("l_quantity").alias("score"))
    return S.fuse([S.ranked(a, 50), S.ranked(b, 50)], 50)


@query(f"WITH {INDEX} SELECT uid, {COS} AS score FROM idx WHERE false")
def empty_collection_search(spark, sf_dir):
    """A collection that doesn't exist gives no rows and no error."""
    index = S.collection(spark, f"{sf_dir}/no-such-collection", "uid long, embedding array<float>")
    return S.dense(index, vector(spark, sf_dir), 20).select("uid", "score")


@query(f"WITH {INDEX} SELECT uid, tags[1] AS lang FROM idx WHERE list_has_any(tags, ['src3', 'src4'])")
def tags_any_search(spark, sf_dir):
    return vector_index(spark, sf_dir).where(F.arrays_overlap("tags", F.array(F.lit("src3"), F.lit("src4")))).select("uid", F.col("tags")[0].alias("lang"))


@query(f"WITH {LINKS} SELECT DISTINCT file_uid FROM links WHERE entity_uid IN (SELECT entity_uid FROM links WHERE file_uid IN (1, 2, 3)) AND file_uid NOT IN (1, 2, 3)")
def entity_hop(spark, sf_dir):
    return S.entity_hop(entity_files(spark, sf_dir), [1, 2, 3])


@query(f"WITH {LINKS} SELECT e.uid, e.name, e.entity_type FROM entities e JOIN links l ON l.entity_uid = e.uid WHERE l.file_uid = 7")
def entity_list_by_file(spark, sf_dir):
    own = entity_files(spark, sf_dir).where("file_uid = 7")
    return entities(spark, sf_dir).join(own, F.col("uid") == F.col("entity_uid"), "left_semi").select("uid", "name", "entity_type")


@query(f"WITH {LINKS} SELECT l.file_uid, count(*) AS n_entities, min(e.name) AS first_name FROM links l JOIN entities e ON e.uid = l.entity_uid GROUP BY 1")
def files_with_entities(spark, sf_dir):
    joined = entity_files(spark, sf_dir).join(entities(spark, sf_dir), F.col("uid") == F.col("entity_uid"))
    return joined.groupBy("file_uid").agg(F.count("*").alias("n_entities"), F.min("name").alias("first_name"))


@query(f"WITH {LINKS} SELECT uid, name FROM entities WHERE uid NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_entities(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("entity_uid"))
    return entities(spark, sf_dir).join(left, F.col("uid") == F.col("entity_uid"), "left_anti").select("uid", "name")


TRI = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, len(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
_A, _B = TRI.format("p_name"), TRI.format("'" + "green pert steel" + "'")


@query(f"SELECT p_partkey, round(len(list_intersect({_A}, {_B}))::DOUBLE / len(list_distinct(list_concat({_A}, {_B}))), 6) AS score FROM part WHERE len(list_intersect({_A}, {_B})) > 0")
def trigram_similarity(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select("p_partkey", F.round(trigram.similarity(F.col("p_name"), F.lit("green pert steel")), 6).alias("score"))
    return scored.where("score > 0")


def word_similarity_sql(asked: str, name: str, rows: str) -> str:
    """uid, score: over all stretches of the name's trigrams, the greatest similarity to the text's."""
    grams = lambda x: rf"flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, len(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))"
    return f"""(SELECT uid, max(len(list_intersect(s, a)) / (len(a) + len(s) - len(list_intersect(s, a)))::DOUBLE) AS score
  FROM (SELECT uid, list_distinct(g[i : j]) AS s, a FROM (SELECT uid, {grams(name)} AS g, list_distinct({grams(f"'{asked}'")}) AS a FROM {rows}) r, unnest(generate_series(1, len(g))) AS x(i), unnest(generate_series(1, len(g))) AS y(j) WHERE j >= i) GROUP BY uid)"""


@query(f"WITH {KBS} SELECT uid, display_name, round(score, 6) AS score FROM {word_similarity_sql('knowlege bse 1', 'display_name', 'kbs')} JOIN kbs USING (uid) WHERE round(score, 6) >= 0.3")
def word_similarity_search(spark, sf_dir):
    """Knowledge bases whose name holds a stretch like the query, the most alike first."""
    scored = knowledge_bases(spark, sf_dir).select("uid", "display_name", F.round(trigram.word_similarity("knowlege bse 1", F.col("display_name")), 6).alias("score"))
    return scored.where("score >= 0.3").orderBy(F.col("score").desc(), "uid")
