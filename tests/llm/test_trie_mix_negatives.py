"""The prefix trie, the mix of sources and hard negatives on awkward tables, against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import mixing, negatives, trie


# ---- prefix trie


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, sha(f"{len(r)}:{r}{x}"), x))
    turns = {c: [(r, x) for *_, r, _, x in sorted(held)] for c, held in own.items()}
    rebuilt = {}
    for c, held in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + held[h:])
    members = defaultdict(list)
    for c, held in rebuilt.items():
        for d in range(len(held) + 1):
            members[held[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].split()) if p else 0
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if rebuilt[c] == p)))
        for p, m in members.items()
    }


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn int, role string, text string, depth string, n long"


def conversations():
    said = ["hello there", "a b c", "", None, "how are you today", "fine"]
    rows = []
    for c in [*range(0, 45), 60, 79, -7, -20, -27, 2**40]:
        for t in range((c * 7) % 6 if c % 20 else 6):
            rows.append((c, t, "user" if t % 2 == 0 else None, said[(t + c // 20 + (c % 3) * (t > 3)) % 6]))
    rows += [(5, None, "system", "first"), (5, None, "system", "first"), (5, 2, "user", "tie"), (5, 2, "user", "tied"), (None, 1, "user", "no conversation"), (100, 0, None, None), (101, 0, "user", "x")]
    rows += [(c, t, "user", f"w{t} of a long one") for c in (200, 201, 203, 222) for t in range(23 + c % 4)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize(("segment", "span"), [(512, 4096), (4, 2)])
def test_trie(spark, monkeypatch, segment, span):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "RANGE", span)
    rows = conversations()
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    want = brute_trie([r[:4] for r in rows])
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(none).count() == 0
    one = trie.conversation_trie(spark.createDataFrame([(3, 1, None, None, "", 0)], SCHEMA)).select(*COLUMNS).collect()
    assert set(map(tuple, one)) == brute_trie([(3, 1, None, None)])


# ---- mix of sources


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        level = left / max(1, sum(w[s] for s in names if s not in full))
        above = {s for s in names if s not in full and most * sizes[s] < level * w[s]}
        if not above:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= above


def awkward_sources():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 40))), f"s{i % 5}" if i % 3 else "hot") for i in range(400)]
    rows += [(1000, "tiny", "small"), (1001, None, "none"), (1002, " \t\n ", "none"), (None, "no id here", None), (None, "nor here", None), (1003, "x " * 3000, "s1"), (7, "repeated row", "s2"), (7, "repeated row", "s2"), (7, "same id", "s2"), (1004, " a\x1fb\x0bc", "\U0001f600"), (1005, "d", "￮")]
    return [(*r, "x", i) for i, r in enumerate(rows)]


def test_mix(spark):
    rows = awkward_sources()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    n = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += n(t)
    targets = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    of = {(r[0], n(r[1])): r[2] for r in rows}
    for r in got:
        s = of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s, t in targets.items():
        assert taken[s] <= t + 1e-6 and t - taken[s] <= max(longest[s], 1), (s, t, taken[s])
    assert taken["small"] == 3 and targets["small"] == 3
    assert all(t - taken[s] < 40 for s, t in targets.items() if s in ("hot", "s0", "s1", "s2", "s3", "s4"))  # small documents fill what is left


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_inclusion_is_as_expected(spark):
    """Over many documents of one size the share taken is the target's, in each half of the ids."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "'a b c d' AS text", "if(id % 4 = 0, 'a', 'b') AS source")
    for r in mixing.mix(df).groupBy("source_size", "target", (mixing.F.col("doc_id") < 10_000).alias("half")).agg(mixing.F.avg(mixing.F.col("taken") / mixing.F.col("size")).alias("copies")).collect():
        assert r.copies == pytest.approx(r.target / r.source_size, abs=0.03)


# ---- hard negatives


def brute_negatives(rows, anchor, positives=5, k=3, low=50, high=95):
    """rows: (id, label, vector), as they take part."""
    x = {i: (y, [int(np.floor(256 * c)) for c in v]) for i, y, v in rows}
    out = set()
    for a in (i for i in x if anchor(i)):
        score = {b: sum(p * q for p, q in zip(x[a][1], x[b][1], strict=True)) for b in x if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if x[b][0] == x[a][0]][:positives]:
            fit = [b for b in order if x[b][0] != x[a][0] and low * score[p] <= 100 * score[b] <= high * score[p]]
            out |= {(a, p, n + 1, b, score[p], score[b]) for n, b in enumerate(fit[:k])}
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
VECTORS = "vec_id long, label int, embedding array<float>, low string, rank int"


@pytest.mark.parametrize("block", [4096, 16])
def test_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=6) / 2).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, i % 3, [0.5, 0.25, 0.0, 0.0, 0.125, 1.0]) for i in range(60)]  # ties
    rows += [(300 + i, i % 2, [0.0] * 6) for i in range(12)]
    rows += [(400, 7, [1.0] * 6), (401, 8, [300.0] * 6)]  # a label of one row
    bad = [(1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, 1, [float("nan")] * 6), (1004, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (1005, 1, [1.0] * 5), (200, 5, [9.0] * 6), (200, 0, [0.5, 0.25, 0.0, 0.0, 0.125, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], VECTORS)
    got = negatives.hard_negatives(df, lambda i: i % 10 == 0).collect()
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) and {tuple(r[c] for c in NAMES) for r in got} == want


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, lambda i: i % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(3, 1, [1.0], "", 0)], VECTORS), lambda i: i % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(10, 1, [1.0], "", 0), (11, 2, [1.0], "", 0)], VECTORS), lambda i: i % 10 == 0).count() == 0


def test_scores_that_fit_no_long_are_an_error():
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert negatives.products(np.array([[1 << 30, 3]]), np.array([[1 << 30, 1]])).tolist() == [[(1 << 60) + 3]]
