"""Trigram similarity of strings: words are padded with two blanks before and one after."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, own)))


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def _ordered(text: str) -> list[str]:
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def word_similarity_of(query: str, text: str) -> float:
    """Greatest similarity of the query's trigrams and any stretch of the text's, in order."""
    asked, held = set(_ordered(query)), _ordered(text)
    starts = [i for i, g in enumerate(held) if g in asked]
    best = 0.0
    for i in starts:
        seen: set[str] = set()
        hits = 0
        for g in held[i:]:
            if g not in seen:
                seen.add(g)
                hits += g in asked
            best = max(best, hits / (len(asked) + len(seen) - hits))
    return best


def ordered_trigrams(text: Column) -> Column:
    """All trigrams in order, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def word_similarity(query: str, text: Column) -> Column:
    """Greatest similarity of the query's trigrams and any stretch of the text's, in order; null for a null text.

    For each start a fold over the trigrams from there on keeps those seen, the hits and the best so far.
    """
    asked = list(dict.fromkeys(_ordered(query)))
    if not asked:
        return F.when(text.isNotNull(), F.lit(0.0))
    held = ordered_trigrams(text)

    def best(g: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            hits = a["hits"] + F.when(x.isin(*asked), 1).otherwise(0)
            seen = F.concat(a["seen"], F.array(x))
            now = F.struct(seen.alias("seen"), hits.alias("hits"), F.greatest(a["best"], hits / (len(asked) + F.size(seen) - hits)).alias("best"))
            return F.when(F.array_contains(a["seen"], x), a).otherwise(now)

        none = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("hits"), F.lit(0.0).alias("best"))
        starts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.element_at(g, i).isin(*asked))
        return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(g, i, F.size(g)), none, step, lambda a: a["best"])))

    score = F.get(F.transform(F.array(held), lambda g: F.when(F.size(g) > 0, F.coalesce(best(g), F.lit(0.0))).otherwise(0.0)), F.lit(0))
    return F.when(text.isNotNull(), score)
