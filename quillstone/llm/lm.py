"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. For every context of up to DEPTH bytes and every decision, a Krichevsky-Trofimov
estimate counts zeros and ones; a node's weighted probability is half its own estimate's and half the product of its
children's, so that all depths are mixed by how well they explain the training texts. A decision's probability is
then, from the root on, the node's own estimate by its share of the node's weighted probability, and for the rest
that of the child on the path; a node that training never met says one half.

Each batch sends its distinct strings of DEPTH + 1 bytes, with their counts in training texts, to the group that
owns the two bytes before the last; relays add up the counts of many batches on the way. All subtrees from depth two
on are whole there; the nodes of depth one and zero, at most 2^16, are finished on the driver. The group answers with
a log-probability for each string, and the answers go back to the batches. Words for the unigram base go the same way
by their hash. No model is broadcast but those few nodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import batches as exchange
from quillstone.llm.batches import MESSAGE, climbed, descended, expand, messages, pack, shares, squeeze, unpack, written
from quillstone.llm.common import column

DEPTH = 5
#: Text of a batch; in a larger one fewer strings are new.
SIZE = 6 << 20
LN2 = np.log(2.0)
#: Bytes that UTF-8 never has: what comes before a text, and its end.
BEFORE, ENDED = b"\xfe", b"\xff"


def held_out(key) -> bool:
    """Nothing is learned from these; a null key's text is learned from."""
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 1/2, by Stirling's series after six steps of the recurrence."""
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


_SMALL = np.arange(4096, dtype=np.float64)
_HALF, _ONE = log_gamma(_SMALL + 0.5), log_gamma(_SMALL + 1)


def looked_up(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], log_gamma(np.maximum(n, 1) + plus))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the block probability of n0 zeros and n1 ones."""
    return looked_up(n0, _HALF, 0.5) + looked_up(n1, _HALF, 0.5) - looked_up(n0 + n1, _ONE, 1.0) - np.log(np.pi)


def grams(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end, the key of it in its context; and the new bounds.

    A key has the context's last byte uppermost, then the ones before it, then the byte itself, so that contexts of
    any depth are ranges of keys.
    """
    parts, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        parts += [BEFORE * DEPTH, text[a:b], ENDED]
        sizes.append(b - a + 1)
    x = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(x) - DEPTH
    key = np.zeros(n, dtype=np.int64)
    for back in range(1, DEPTH + 1):
        key |= x[DEPTH - back : DEPTH - back + n].astype(np.int64) << np.int64(8 * (DEPTH + 1 - back))
    key |= x[DEPTH:]
    new = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=new[1:])
    # places of the texts' own bytes among all, without the padding before each
    at = np.arange(new[-1]) + np.repeat(np.arange(len(sizes)) * DEPTH, sizes)
    return key[at], new


def owners(keys: np.ndarray, width: int) -> np.ndarray:
    """Groups, by the last two bytes of the context."""
    pair = (keys >> np.int64(8 * (DEPTH - 1))).astype(np.uint64)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)


def word_hashes(text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = text[a:b].split()
        words += own
        sizes.append(len(own))
    new = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=new[1:])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)), new


def word_owners(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - width)).astype(np.int64)


OWNERS = (owners, word_owners)


def grouped(keys: np.ndarray, kind: int, width: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the keys by group, and (group, first, end) of each group in it."""
    group = OWNERS[kind](keys, width)
    order = np.argsort(group, kind="stable")
    group = group[order]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return order, list(zip(group[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(group)], strict=True)) if len(group) else []


def segments(bounds: np.ndarray, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Bounds of consecutive texts with about size bytes together, so that a batch's arrays aren't all held at once."""
    start = 0
    while start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1)
        yield bounds[start : end + 1]
        start = end


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.diff(heads, append=len(keys))


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each is in training texts."""
    inside, n = distinct_counts(keys[train])
    outside, _ = distinct_counts(keys[~train])
    return summed([(inside, n), (outside, np.zeros(len(outside), dtype=np.int64))])


def places(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted distinct ones, by a table of their hashes; where two share a slot, by bisection."""
    bits = max(8, int(len(distinct)).bit_length() + 3)
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, dtype=np.int32)
    table[slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = table[slot(keys)]
    other = np.flatnonzero(distinct[at] != keys)
    at[other] = np.searchsorted(distinct, keys[other])
    return at


def dealt_out(keys: np.ndarray, counts: np.ndarray, kind: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Sorted keys and their counts for each group."""
    order, cuts = grouped(keys, kind, width)
    for p, a, b in cuts:
        own, n = keys[order[a:b]], counts[order[a:b]].astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")
        step = np.diff(own, prepend=own[:1] * 0).astype("<u8")
        # equal bytes of many numbers together compress better
        yield p, squeeze(bytes([n.itemsize]) + len(own).to_bytes(4, "little") + step.view(np.uint8).reshape(-1, 8).T.tobytes() + n.view(np.uint8).reshape(-1, n.itemsize).T.tobytes())


def asked(row: dict, width: int) -> Iterator[tuple[int, int, bytes]]:
    """Kind (0 strings, 1 words), group, keys and counts."""
    keys, bounds, text = unpack(row)
    text = text.lower()
    held = np.array([held_out(k) for k in keys], dtype=bool)
    for kind, keys_of in ((0, grams), (1, word_hashes)):
        found, at = [], 0
        for own in segments(bounds):
            some, new = keys_of(text, own)
            found.append(counted(some, ~np.repeat(held[at : at + len(own) - 1], np.diff(new))))
            at += len(own) - 1
        for p, blob in dealt_out(*summed(found), kind, width):
            yield kind, p, blob


def merge_counts(kind: int, width: int, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    yield from dealt_out(*summed([read_asked(x, kind) for x in blobs]), kind, width)


def spread_values(kind: int, width: int, blobs: list[bytes], answers: list[tuple[int, bytes]]) -> list[bytes]:
    own = [read_asked(x, kind)[0] for x in blobs]
    keys = np.unique(np.concatenate(own))
    value = told_values(keys, kind, width, answers)
    return [value_blob(value[places(keys, x)]) for x in own]


def value_blob(values: np.ndarray) -> bytes:
    return squeeze(values.view(np.uint8).reshape(-1, 4).T.tobytes())


#: What is told of strings (log10 probabilities) and of words (counts, up to the largest number).
TOLD = ("<f4", "<u4")


def told_values(keys: np.ndarray, kind: int, width: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """The answered value of each sorted distinct key."""
    order, cuts = grouped(keys, kind, width)
    value, told = np.zeros(len(keys), dtype=TOLD[kind]), dict(answers)
    for p, a, b in cuts:
        value[order[a:b]] = np.ascontiguousarray(np.frombuffer(expand(told[p]), np.uint8).reshape(4, -1).T).view(TOLD[kind]).ravel()
    return value


def read_asked(blob: bytes, kind: int) -> tuple[np.ndarray, np.ndarray]:
    x = expand(blob)
    size, n = x[0], int.from_bytes(x[1:5], "little")
    step = np.ascontiguousarray(np.frombuffer(x, np.uint8, 8 * n, 5).reshape(8, n).T).view("<u8").ravel()
    count = np.ascontiguousarray(np.frombuffer(x, np.uint8, size * n, 5 + 8 * n).reshape(size, n).T).view(f"<u{size}").ravel()
    keys = np.cumsum(step, dtype=np.uint64)
    return (keys if kind else keys.astype(np.int64)), count.astype(np.int64)


def summed(blobs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*blobs, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


class Level:
    """Nodes of one depth for one decision: sorted keys (context and the byte's bits so far), counts, logs."""

    __slots__ = ("keys", "n0", "n1", "own", "weighted")

    def __init__(self, strings: np.ndarray, counts: np.ndarray, bit: int):
        prefix = strings >> np.int64(8 - bit)
        heads = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, np.int64)
        self.keys = prefix[heads]
        ones = counts * ((strings >> np.int64(7 - bit)) & 1)
        self.n1 = np.add.reduceat(ones, heads) if len(heads) else heads
        self.n0 = (np.add.reduceat(counts, heads) if len(heads) else heads) - self.n1
        self.own = log_kt(self.n0, self.n1)
        self.weighted = self.own

    def mix(self, below: np.ndarray) -> None:
        """below: the sum of the children's logs."""
        self.weighted = np.logaddexp(self.own, below) - LN2

    def parents(self, bit: int) -> np.ndarray:
        """Keys of the nodes one depth less."""
        return ((self.keys >> np.int64(bit + 8)) << np.int64(bit)) | (self.keys & np.int64((1 << bit) - 1))

    def estimate(self, keys: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether the node is known, its estimate of the bit, and its share."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.full(len(keys), 0.5), np.ones(len(keys))
        share = np.exp(np.minimum(0, self.own - self.weighted - LN2)) if self.weighted is not self.own else np.ones(len(self.keys))
        return self.keys[at] == keys, (np.where(one, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1), share[at]


def subtrees(keys: np.ndarray, counts: np.ndarray, least: int = 2) -> list[list[Level]]:
    """Levels by depth (from `least` on, at index depth - least) and decision; keys with counts of training texts only."""
    out: list[list[Level]] = []
    strings, n = keys, counts
    for depth in range(DEPTH, least - 1, -1):
        if depth < DEPTH:
            up = ((strings >> np.int64(16)) << np.int64(8)) | (strings & np.int64(255))
            strings, n = summed([(up, n)])
        levels = [Level(strings, n, bit) for bit in range(8)]
        if out:
            for bit, (level, child) in enumerate(zip(levels, out[0], strict=True)):
                below = np.zeros(len(level.keys))
                np.add.at(below, np.searchsorted(level.keys, child.parents(bit)), child.weighted)
                level.mix(below)
        out.insert(0, levels)
    return out


class Root:
    """The nodes of depth zero and one, from sums over the subtrees of depth two."""

    def __init__(self, rows: list[tuple[int, int, int, float]]):
        """rows: context byte * 256 + node (1 to 255), zeros, ones, sum of the children's logs."""
        self.n = np.zeros((257, 256, 2), dtype=np.int64)  # at 256 depth zero
        below = np.zeros((257, 256))
        for at, n0, n1, s in rows:
            self.n[at >> 8, at & 255] = n0, n1
            below[at >> 8, at & 255] = s
        self.known = self.n.sum(axis=2) > 0
        self.n[256] = self.n[:256].sum(axis=0)
        self.known[256] = self.known[:256].any(axis=0)
        own = log_kt(self.n[..., 0], self.n[..., 1])
        weighted = np.logaddexp(own, below) - LN2
        below[256] = np.where(self.known[:256], weighted[:256], 0).sum(axis=0)
        weighted[256] = np.logaddexp(own[256], below[256]) - LN2
        self.share = np.exp(np.minimum(0, own - weighted - LN2))

    def finish(self, p: np.ndarray, context: np.ndarray, node: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The mixture of all depths, p being that from depth two on."""
        for c in (context, np.full_like(context, 256)):
            n = self.n[c, node]
            kt = (np.where(one, n[:, 1], n[:, 0]) + 0.5) / (n.sum(axis=1) + 1)
            p = np.where(self.known[c, node], self.share[c, node] * kt + (1 - self.share[c, node]) * p, 0.5)
        return p


FIRST = "batch long, kind int, pid int, blob binary, node int, n0 long, n1 long, below double"


def first_round(table: pa.Table) -> pa.Table:
    """Answers about words; sums for the nodes of depth one; under node -1 the training words and how many are distinct."""
    kinds, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
    rows: list[tuple] = []
    if strings := [read_asked(x, 0) for x, k in zip(blobs, kinds, strict=True) if k == 0]:
        keys, counts = summed(strings)
        keys, counts = keys[counts > 0], counts[counts > 0]
        for bit, level in enumerate(subtrees(keys, counts)[0] if len(keys) else []):
            up, inverse = np.unique(level.parents(bit), return_inverse=True)
            sums_ = [np.bincount(inverse, weights=v, minlength=len(up)) for v in (level.n0, level.n1, level.weighted)]
            node = ((up >> bit) << 8) | (1 << bit) | (up & ((1 << bit) - 1))
            rows += [(None, None, None, None, *r) for r in zip(node.tolist(), *(v.tolist() for v in sums_), strict=True)]
    at = [i for i, k in enumerate(kinds) if k == 1]
    if at:
        read = [read_asked(blobs[i], 1) for i in at]
        keys, counts = summed(read)
        rows.append((None, None, None, None, -1, int(counts.sum()), int((counts > 0).sum()), 0.0))
        batch, pid = table["batch"].to_pylist(), table["pid"].to_pylist()
        for i, (own, _) in zip(at, read, strict=True):
            values = np.minimum(counts[places(keys, own)], (1 << 32) - 1).astype("<u4")
            rows.append((batch[i], 1, pid[i], value_blob(values), None, None, None, None))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=[x.split()[0] for x in FIRST.split(", ")])


def string_logs(keys: np.ndarray, counts: np.ndarray, root: Root) -> np.ndarray:
    """log10 probability of each string's last byte after the bytes before it."""
    levels = subtrees(keys[counts > 0], counts[counts > 0])
    out = np.zeros(len(keys))
    byte = keys & 255
    for bit in range(8):
        one = ((byte >> (7 - bit)) & 1).astype(bool)
        prefix = byte >> (8 - bit)
        p = np.full(len(keys), 0.5)
        for depth in range(DEPTH, 1, -1):
            context = keys >> np.int64(8 * (DEPTH - depth) + 8)
            known, kt, share = levels[depth - 2][bit].estimate((context << np.int64(bit)) | prefix, one)
            p = np.where(known, share * kt + (1 - share) * p, 0.5)
        out += np.log10(root.finish(p, keys >> np.int64(8 * DEPTH), (1 << bit) | prefix, one))
    return out


def answer(table: pa.Table, root: Root) -> pa.Table:
    """For each message the log-probabilities of its strings."""
    read = [read_asked(x, 0) for x in table["blob"].to_pylist()]
    keys, counts = summed(read)
    values = string_logs(keys, counts, root).astype("<f4")
    out = [value_blob(values[places(keys, own)]) for own, _ in read]
    return table.select(["batch", "kind", "pid"]).append_column("blob", pa.array(out, pa.binary()))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Over each range of values; an empty one has 0."""
    total = np.add.reduceat(np.append(np.asarray(values, dtype=np.float64), 0.0), bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return np.where(np.diff(bounds) > 0, total, 0.0)


def scored(row: dict, answers: list[dict], width: int, train: tuple[int, int, int]) -> list[tuple]:
    keys, bounds, text = unpack(row)
    text = text.lower()
    words_n, words_v, docs_n = train
    n_all, v_all = words_n + docs_n, words_v + (docs_n > 0)
    per_kind = []
    for kind, keys_of in ((0, grams), (1, word_hashes)):
        held = [keys_of(text, own) for own in segments(bounds)]
        distinct = np.unique(np.concatenate([distinct_counts(some)[0] for some, _ in held]))
        value = told_values(distinct, kind, width, [(a["pid"], a["blob"]) for a in answers if a["kind"] == kind])
        per_kind.append([(value[places(distinct, some)], new) for some, new in held])
        del held
    strings, counted_words = per_kind
    score, size = np.concatenate([sums(v, new) for v, new in strings]), np.concatenate([np.diff(new) for _, new in strings])
    words = np.concatenate([np.diff(new) for _, new in counted_words])
    known = np.concatenate([sums(v > 0, new) for v, new in counted_words]).round().astype(int) + (docs_n > 0)
    base = np.concatenate([sums(np.log10(v.astype(np.float64) + 1), new) for v, new in counted_words]) + np.log10(docs_n + 1) - (words + 1) * np.log10(n_all + v_all + 1)
    return [(k, held_out(k), int(w) + 1, int(n), n_all, float(b), float(s), float(-s / np.log10(2) / max(1, z))) for k, w, n, b, s, z in zip(keys, words, known, base, score, size, strict=True)]


OUT = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def weighted_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row.

    Texts are scored whole, A-Z in lower case, as their UTF-8 bytes and an end. score is the context tree's log10
    probability of the bytes and the end; base_score that of the words and the end by training counts plus one.
    Counts come from all rows that aren't held out. A null or empty text has its end only; equal rows count as often
    as they occur; other columns are dropped; an empty table gives no rows. Without training rows every byte's
    decision has probability one half.
    """
    spark = df.sparkSession
    packed = pack(df, key, text, SIZE)
    n, parts, levels = shares(packed, 5 << 20)
    width = exchange.BITS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                yield from messages([(row["batch"], kind, p, x) for kind, p, x in asked(row, width)]).combine_chunks().to_batches()

    sent = climbed(packed.mapInArrow(ask, MESSAGE), n, parts, levels, merge_counts)
    sent[-1] = written(sent[-1])
    dealt = lambda rows: rows.repartition(parts, "pid").groupBy("pid")
    first = written(dealt(sent[-1]).applyInArrow(first_round, FIRST))
    # at most 2^16 nodes
    few = first.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    words = next(((r[1], r[2]) for r in few if r[0] == -1), (0, 0))
    root = Root([tuple(r) for r in few if r[0] >= 0])
    learned = ~F.coalesce(F.crc32(column(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    train = (*words, df.where(learned).count())

    def finish(batch: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [x for row in batch.to_pylist() for x in scored(row, answers.to_pylist(), width, train)]
        names = [x.split()[0] for x in OUT.split(", ")]
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    replies = dealt(sent[-1].where("kind = 0")).applyInArrow(lambda t: answer(t, root), MESSAGE)
    replies = replies.unionByName(first.where("kind = 1").select("batch", "kind", "pid", "blob"))
    replies = descended(sent, n, parts, replies, spread_values)
    return packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(finish, OUT).withColumnRenamed("key", key)


def op9(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents

    return weighted_scores(documents(spark, sf_dir))
