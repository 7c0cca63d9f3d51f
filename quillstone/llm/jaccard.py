"""Near-duplicate join on word shingles by chosen paths.

Every distinct shingle set has min-wise samples: coordinate t samples the shingle with the least hash under the t-th
permutation. A run deals the sets by one sampled shingle after another: sets that agree on it stay together, and
only buckets that are still large are split by the next one. Two sets of similarity s stay together for d steps with
probability s^d, so runs with coordinates of their own are repeated until each set, by the depths at which its
buckets really ended, would have met a partner at the threshold with the target recall. Within a small bucket
all pairs are tested, by their samples first and then exactly on the whole sets; a pair is tested in the first run
that brings it together only. A large bucket that a step hardly shrinks holds near copies of one another; it is not
split on but tested in blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.batches import pack, unpack, written
from quillstone.llm.common import column, quoted

WORDS, SIMILARITY = 5, 0.8
#: Probability with which a pair at the threshold is found. The first RUNS are enough for paths of TYPICAL steps, most
#: have one or two; sets with longer ones go through MORE runs at a time, until they are enough.
RECALL, TYPICAL = 0.9999, 4
COORDINATES, STEPS = 64, 8
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILARITY**TYPICAL))
MORE = 8
#: Sets that are tested at once.
BUCKET = 512
#: Buckets whose sizes are sent to all tasks: the largest ones, so that none of the others holds more than BUCKET rows or a HOT-th of all.
HOT = 1024
#: A large bucket that keeps this share of the one it comes from holds near copies: splitting on would only lose links.
SETTLED = 0.6
#: Of 64 samples so many agree at least, but for one pair at the threshold in some millions.
AGREE = 35

STEP = np.uint64(0x9E3779B97F4A7C15)


def coordinate(run: int, step: int) -> int:
    """The sample that a run's step looks at, which no other run looks at."""
    return run * STEPS + step


@functools.cache
def permutation(t: int) -> tuple[np.uint64, np.uint64]:
    """XOR and odd factor of coordinate t."""
    odd, xor = np.random.default_rng([11, t]).integers(1, 1 << 62, 2, dtype=np.uint64)
    return xor * np.uint64(2), odd * np.uint64(2) + np.uint64(1)


def lost(depth: int) -> float:
    """Logarithm of the probability that a run with a path of so many steps misses a pair at the threshold."""
    return math.log(1 - SIMILARITY**depth)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words, ASCII letters in lower case; of fewer words, of all of them."""
    words = text.lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - WORDS + 1) if len(w) else 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(w))):
        h = mixed(h * STEP + w[k : k + n])
    return np.unique(h)


def samples(sets: list[np.ndarray], coordinates: range) -> np.ndarray:
    """[sets, coordinates] of 32 bits; the sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.empty((len(sets), len(coordinates)), dtype=np.uint32)
    mapped = np.empty_like(flat)
    for k, t in enumerate(coordinates):
        xor, odd = permutation(t)
        np.bitwise_xor(flat, xor, out=mapped)
        np.multiply(mapped, odd, out=mapped)
        out[:, k] = np.minimum.reduceat(mapped, starts) >> np.uint64(32)
    return out


def path_samples(runs: range) -> range:
    """The coordinates of consecutive runs."""
    return range(coordinate(runs.start, 0), coordinate(runs.stop, 0))


def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys_, batches, places, prints, sizes, mins, carried = [], [], [], [], [], [], []
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        keys, bounds, text = unpack(row)
        sets = [shingles(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        full = [k for k, s in enumerate(sets) if len(s)]
        values = samples([sets[k] for k in full], path_samples(range(RUNS))) if full else None
        at = dict(zip(full, range(len(full)), strict=True))
        for k, s in enumerate(sets):
            keys_.append(keys[k])
            batches.append(row["batch"])
            places.append(k)
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sizes.append(len(s))
            mins.append(values[at[k]].tobytes() if len(s) else None)
        carried += row["carried"]
    return pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(batches, pa.int64()), pa.array(places, pa.int32()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(mins, pa.binary()), pa.array(carried, pa.string())], names=["key", "batch", "place", "print", "n", "mins", "carried"])


def further(batch: pa.RecordBatch, runs: range) -> pa.RecordBatch:
    """The samples of further runs for each text with words."""
    row = batch.to_pylist()[0]
    _, bounds, text = unpack(row)
    sets = [shingles(text[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    full = [k for k, s in enumerate(sets) if len(s)]
    values = samples([sets[k] for k in full], path_samples(runs)) if full else []
    return pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["batch", "place", "mins"])


def leaves(sets: DataFrame, runs: range) -> tuple[DataFrame, DataFrame]:
    """rep, run, leaf, size: in each run the bucket that a set ends in, where it isn't alone; and rep, deeper.

    mins has the samples of these runs. Buckets without a set that is short of runs are left out. deeper is what the
    logarithm of a set's probability to miss a pair gains over paths of one step.
    """
    # a run's samples in the order of its steps go with each row, so that no step has to look them up
    paths = [F.substring("mins", 4 * STEPS * k + 1, 4 * STEPS) for k in range(len(runs))]
    now = sets.select("rep", "short", F.posexplode(F.array(*paths)).alias("run", "path")).withColumn("run", F.col("run") + runs.start)
    now = now.withColumn("leaf", F.xxhash64("run", F.substring("path", 1, 4))).withColumn("parent", F.lit(None).cast("long"))
    found: list[DataFrame] = []
    deeper: list[DataFrame] = []
    ends = (F.col("size") <= BUCKET) | F.coalesce(F.col("size") > SETTLED * F.col("parent"), F.lit(False))
    for step in range(1, STEPS + 1):
        sizes = written(now.groupBy("leaf").agg(F.count("*").alias("size"), F.max("short").alias("asked")).where("size > 1 and asked").drop("asked"))
        # the rows of the largest buckets stay where they are; any other bucket holds BUCKET rows or a HOT-th of all rows at most
        hot = F.broadcast(sizes.where(F.col("size") > BUCKET).orderBy(F.desc("size"), "leaf").limit(HOT))
        sized = now.join(hot, "leaf").unionByName(now.join(hot.select("leaf"), "leaf", "left_anti").join(sizes, "leaf"))
        together = written(sized.select("rep", "short", "run", "leaf", "size", (ends if step < STEPS else F.lit(True)).alias("ends"), F.when(F.col("size") > BUCKET, F.col("path")).alias("path")))
        found.append(together.where("ends").select("rep", "run", "leaf", "size"))
        large = together.where("not ends")
        if step == STEPS or large.isEmpty():
            break
        deeper.append(large.where("short").groupBy("rep").agg((F.count("*") * (lost(step + 1) - lost(step))).alias("deeper")))
        now = large.select("rep", "short", "run", "path", F.xxhash64("leaf", F.substring("path", 4 * step + 1, 4)).alias("leaf"), F.col("size").alias("parent"))
    none = sets.select("rep", F.lit(0.0).alias("deeper")).limit(0)
    return functools.reduce(DataFrame.unionByName, found), functools.reduce(DataFrame.unionByName, deeper, none).groupBy("rep").agg(F.sum("deeper").alias("deeper"))


def met_often(packed: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """The leaves of as many runs as each set needs, and how many runs there are."""
    enough = math.log(1 - RECALL)
    met, deeper = leaves(sets.withColumn("short", F.lit(True)), range(RUNS))
    runs, miss = RUNS, F.col("miss") + F.coalesce("deeper", F.lit(0.0))
    short = written(deeper.select("rep", (F.col("deeper") + RUNS * lost(1)).alias("miss")).where(F.col("miss") > enough))
    while not short.isEmpty():
        new = range(runs, runs + MORE)
        mins = packed.mapInArrow(lambda it, new=new: (further(b.slice(i, 1), new) for b in it for i in range(b.num_rows)), "batch long, place int, mins binary")
        asked = sets.select("rep", "batch", "place").join(short.select("rep", F.lit(True).alias("short")), "rep", "left").withColumn("short", F.coalesce("short", F.lit(False)))
        more, deeper = leaves(asked.join(mins, ["batch", "place"]), new)
        met, runs = met.unionByName(more), new.stop
        short = written(short.join(deeper, "rep", "left").select("rep", (miss + MORE * lost(1)).alias("miss")).where(F.col("miss") > enough))
    return met, runs


class Groups:
    """Consecutive rows of equal leaf and blocks, over the batches of a sorted partition."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in self.batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if last is not None and (key[0] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            start = 0
            for c in cuts.tolist():
                yield pa.Table.from_batches([*held, b.slice(start, c - start)])
                held, start = [], c
            held.append(b.slice(start))
            last = key[-1]
        if held:
            yield pa.Table.from_batches(held)


def pairs_allowed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the pairs that this bucket or pair of blocks has to test, and the sets' earlier leaves."""
    n, (i, j) = group.num_rows, (group["i"][0].as_py(), group["j"][0].as_py())
    if i == j:
        a, b = np.triu_indices(n, 1)
    else:
        own = group["own"].to_numpy()
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij"))
    size = group["n"].to_numpy()
    ok = np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[ok], b[ok]
    before = np.frombuffer(b"".join(group["before"].to_pylist()), dtype=np.uint32).reshape(n, -1)
    if before.shape[1] and len(a):
        met = np.zeros(len(a), dtype=bool)
        for k in range(before.shape[1]):
            x = before[:, k]
            met |= (x[a] == x[b]) & (x[a] != 0)
        a, b = a[~met], b[~met]
    return a, b, before


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sets that have a likely partner in their bucket."""
    for group in Groups(batches):
        if group.num_rows < 2:
            continue
        a, b, _ = pairs_allowed(group)
        if not len(a):
            continue
        s = np.frombuffer(b"".join(group["mins"].to_pylist()), dtype=np.uint8).reshape(group.num_rows, COORDINATES)
        hit = np.zeros(group.num_rows, dtype=bool)
        for at_ in range(0, len(a), 1 << 15):
            x, y = a[at_ : at_ + (1 << 15)], b[at_ : at_ + (1 << 15)]
            ok = (s[x] == s[y]).sum(axis=1) >= AGREE
            hit[x[ok]] = hit[y[ok]] = True
        if hit.any():
            yield from group.filter(pa.array(hit)).drop_columns(["mins"]).combine_chunks().to_batches()


def common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs."""
    if len(a) <= 8 or len(sets) <= 3:
        return np.array([len(sets[x]) + len(sets[y]) - len(np.unique(np.concatenate([sets[x], sets[y]]))) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    both = count[inverse] > 1
    row, column = row[both], np.unique(inverse[both], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = 8192
    for c in range(0, int(column.max()) + 1 if len(column) else 0, width):
        some = (column >= c) & (column < c + width)
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[some], column[some] - c] = 1
        out += (m @ m.T).astype(np.int64)
    return out[a, b]


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set with partners in a bucket: how many documents they are, and the least set of its group there."""
    reps, links, roots = [], [], []
    for group in Groups(batches):
        if group.num_rows < 2:
            continue
        a, b, _ = pairs_allowed(group)
        if not len(a):
            continue
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        same = common(sets, a, b)
        # in tenths, so that the threshold itself is met exactly
        ok = 10 * same >= round(10 * SIMILARITY) * (size[a] + size[b] - same)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        n = np.zeros(len(rep), dtype=np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        label = rep.copy()
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(n)
        reps.append(rep[some])
        links.append(n[some])
        roots.append(label[some])
        if len(reps) > 4000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, links, roots)], names=["rep", "links", "root"])
            reps, links, roots = [], [], []
    if reps:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, links, roots)], names=["rep", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for edges a, b, by alternating large and small stars until nothing changes."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        ends = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ends.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        now = written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        seen = state


def classes(df: DataFrame, key: str, text: str, carry: str | None = None) -> DataFrame:
    """near_duplicates with first (the row that its class is named by; true for one row of a class) and carried."""
    packed = pack(df, key, text, carry=carry)
    rows = written(packed.mapInArrow(lambda it: (sketch(b.slice(i, 1)) for b in it for i in range(b.num_rows)), "key long, batch long, place int, print binary, n int, mins binary, carried string"))
    row = F.struct("key", "batch", "place")
    sets = rows.where(F.col("print").isNotNull()).groupBy("print").agg(F.min(row).alias("r"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.count("*").alias("copies"))
    # keys may repeat or be null, so that a set goes by a number of its own
    sets = written(sets.select("print", F.monotonically_increasing_id().alias("rep"), "r", F.col("r.batch").alias("batch"), F.col("r.place").alias("place"), "n", "mins", "copies"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BUCKET)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    met, runs = met_often(packed, sets)
    met = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("run", "leaf", "size"))).alias("leaves"))
    # the leaves of earlier runs, 4 bytes each, 0 where the set is alone
    thin = lambda name: F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: F.substr(name, k * 4 + 1, F.lit(1)))
    narrow = F.unhex(F.array_join(F.transform(thin("mins"), F.hex), ""))
    each = met.join(sets.select("rep", "batch", "place", "n", "copies", narrow.alias("mins")), "rep").select("*", F.explode("leaves").alias("x"))
    by_run = F.map_from_entries(F.transform("leaves", lambda s: F.struct(s["run"], F.hex((s["leaf"].bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")))))
    before = F.unhex(F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.lit(True)), lambda r: F.when(r < F.col("x.run"), F.lpad(F.coalesce(F.element_at(by_run, r), F.lit("0")), 8, "0")).otherwise("00000000")), ""))
    each = each.select(F.col("x.leaf").alias("leaf"), F.col("x.size").alias("size"), "rep", "batch", "place", "n", "copies", "mins", before.alias("before")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = each.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "batch", "place", "n", "copies", "before", "mins")
    columns = "leaf long, i int, j int, own int, rep long, batch long, place int, n int, copies long, before binary"
    order = ["leaf", "i", "j"]
    some = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(likely, columns)

    def fetch(batch: pa.Table, asked: pa.Table) -> pa.Table:
        """The rows asked for with their whole shingle sets."""
        sets: list[bytes] = []
        if batch.num_rows and asked.num_rows:
            _, bounds, text = unpack(batch.to_pylist()[0])
            made: dict[int, bytes] = {}
            for k in asked["place"].to_pylist():
                if k not in made:
                    made[k] = shingles(text[bounds[k] : bounds[k + 1]]).tobytes()
                sets.append(made[k])
        else:
            asked = asked.slice(0, 0)
        return asked.append_column("shingles", pa.array(sets, pa.binary()))

    whole = packed.groupBy("batch").cogroup(some.groupBy("batch")).applyInArrow(fetch, columns + ", shingles binary")
    found = written(whole.repartition(*order).sortWithinPartitions(*order).mapInArrow(linked, "rep long, links long, root long"))
    group = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labelled = sets.select("print", "rep", "r", "copies").join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("print", "r", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = labelled.groupBy("class").agg(F.min("r").alias("least"))
    out = rows.select("key", "batch", "place", "print", "carried").join(labelled.join(least, "class").select("print", "least", "links"), "print", "left")
    # a row without words is its own class
    named = F.when(F.col("least").isNull(), F.col("key")).otherwise(F.col("least.key"))
    first = F.coalesce((F.col("batch") == F.col("least.batch")) & (F.col("place") == F.col("least.place")), F.lit(True))
    return out.select(F.col("key").alias(key), named.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), first.alias("first"), "carried")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, n_links for each row: near duplicates by the Jaccard similarity of shingle sets, 0.8 or more.

    class_id is the least key of all documents that links join, directly or through others; n_links is the number of
    other documents linked directly. Words are runs other than ASCII white space, ASCII letters in lower case, and a
    shingle is five of them; a text of one to four words has one shingle of all its words. Rows with equal sets, such
    as copies, are linked to one another and go through the join once. A null text, or one without words, is its own
    class with no links. A null key is kept and comes before all others; the class of such a row is null. Keys may
    repeat: each row takes part with its own text. Other columns are dropped; an empty table gives no rows.
    """
    return classes(df, key, text).select(key, "class_id", "n_links")


def op4(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents

    return near_duplicates(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
  GROUP BY ALL HAVING 10 * count(*) >= 8 * (any_value(s.n) + any_value(t.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), class AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM documents d JOIN class c USING (doc_id)
"""


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near duplicates the document with the least key stays, unchanged, once.

    Documents without a key can't be named by a class and stay, whatever else is in their class; a class that has
    one keeps no other. Of documents that repeat a key with different texts, each is judged by its own text; equal
    rows count once. A null or empty text has no near duplicates. Other columns pass; an empty table gives no rows.
    """
    # a key may repeat, so that what stays is known by its text too; the rows themselves are shuffled once
    print_ = F.md5(F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))).alias("print")
    kept = classes(docs.select("doc_id", "text", print_), "doc_id", "text", "print").where("first")
    kept = kept.select("doc_id", F.col("carried").alias("print")).distinct()
    whole = docs.select("doc_id", print_, F.struct(*map(column, docs.columns)).alias("row_"))
    named = whole.where("doc_id is not null").join(kept, ["doc_id", "print"], "left_semi").dropDuplicates(["doc_id", "print"])
    return whole.where("doc_id is null").unionByName(named.select(*whole.columns)).select(*(F.col(f"row_.{quoted(c)}").alias(c) for c in docs.columns))
