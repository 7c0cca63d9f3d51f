"""The corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages the documents
are written to the shared folder and read again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.batches import written
from quillstone.llm.common import documents
from quillstone.llm.jaccard import keep_first
from quillstone.llm.packing import best_fit_pack
from quillstone.llm.quality import keep_quality
from quillstone.llm.suffix import drop_repeats
from quillstone.llm.toxicity import drop_toxic


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row for each piece of a document, placed in a sequence."""
    return best_fit_pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_first),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack_sequences),
]
#: The toxicity network and the packing order can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
