"""Removal of repeated passages by sorted suffixes.

Suffixes are exchanged where it matters only. Every string of LENGTH bytes holds an anchor, a place whose next K
bytes have the least hash among those in the string, and equal strings have equal anchors. A first exchange tells
each batch which of its anchors' hashes occur in other documents too. The suffixes at these anchors, each with the
bytes before it, are sorted within a batch, front-coded, and dealt by their first K bytes. A partition merges the
runs with a loser tree that carries common prefixes, so that bytes known to be equal are never compared again.
Neighbours in the merged order that share K bytes are the candidates; for every string of LENGTH bytes through the
anchor the smallest document that has it is found from them and sent back.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import batches as exchange
from quillstone.llm.batches import MESSAGE, climbed, descended, expand, messages, pack, shares, squeeze, unpack, written
from quillstone.llm.common import column

LENGTH, K = 50, 20
#: Places of a string at which its anchor can be.
PLACES = LENGTH - K + 1
#: Bytes before an anchor that a string through it can hold.
BEFORE = LENGTH - K
#: Bytes of a batch that are hashed at once.
SEGMENT = 1 << 19
NO_KEY = np.iinfo(np.int64).max

_rng = np.random.default_rng(20)
BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place on; doubling, as K = 16 + 4."""
    h1 = BYTE_HASH[x]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    return settled(h16[:-4] * power(4) + h4[16:])


def settled(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def dealt_hash(h: np.ndarray) -> np.ndarray:
    """The least of many hashes are small; mixed once more they are dealt evenly."""
    return (h ^ (h << np.uint64(23))) * MIX ^ (h >> np.uint64(27))


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of that width."""
    done = 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the documents' bytes, in order, and their hashes."""
    places, hashes = [], []
    start = 0
    while start < len(bounds) - 1:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SEGMENT, side="right")) - 1)
        a, b = bounds[start], bounds[end]
        if b - a >= LENGTH:
            h = gram_hashes(data[a:b])
            least = sliding(h, PLACES, np.minimum)
            valid = np.ones(len(least), dtype=bool)
            for e in bounds[start + 1 : end] - a:  # strings that would reach over a document's end
                valid[max(0, e - LENGTH + 1) : e] = False
            least[~valid] = 0
            pad = np.zeros(PLACES - 1, dtype=np.uint64)
            most = sliding(np.concatenate([pad, least, pad]), PLACES, np.maximum)
            at = np.flatnonzero((most == h) & (h > 0))
            places.append(at + a)
            hashes.append(dealt_hash(h[at]))
        start = end
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def owner(hashes: np.ndarray, width: int) -> np.ndarray:
    """The group of each hash: its first bits."""
    return (hashes >> np.uint64(64 - width)).astype(np.int64)


def edges(groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, first, end) of each group in sorted ones."""
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return list(zip(groups[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(groups)], strict=True)) if len(groups) else []


def distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether each is in several of the batch's documents, and each anchor's index in them."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    ends = np.concatenate([heads[1:], [len(s)]]) - 1 if len(s) else heads
    several = docs[order][heads] != docs[order][ends]
    inverse = np.empty(len(s), dtype=np.int64)
    inverse[order] = group
    return s[heads], several, inverse


def short(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, as compressed steps; equal bytes of many numbers together compress better."""
    step = np.diff(hashes >> np.uint64(16), prepend=np.uint64(0)).astype("<u8")
    return squeeze(step.view(np.uint8).reshape(-1, 8).T[:6].tobytes())


def long(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(blob), dtype=np.uint8).reshape(6, -1)
    step = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    step[:, :6] = planes.T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def ask_hashes(row: dict, width: int) -> Iterator[tuple[int, bytes]]:
    _, bounds, text = unpack(row)
    places, hashes = anchors(np.frombuffer(text, dtype=np.uint8), bounds)
    own, _, _ = distinct(hashes, np.searchsorted(bounds, places, side="right"))
    for p, a, b in edges(owner(own, width)):
        yield p, short(own[a:b])


def several_have(blobs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of the blobs, and those that two of them have."""
    every = np.sort(np.concatenate(blobs))
    again = every[1:] == every[:-1]
    return every[np.concatenate([[True], ~again])], np.unique(every[1:][again])


def bits(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is among the sorted values."""
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x if len(among) else np.zeros(len(x), bool)


def shared_hashes(table: pa.Table) -> pa.Table:
    """For each message a bit for each of its hashes: whether another has it too."""
    blobs = [long(x) for x in table["blob"].to_pylist()]
    _, twice = several_have(blobs)
    masks = pa.array([np.packbits(bits(twice, x)).tobytes() for x in blobs], pa.binary())
    return table.select(["batch", "kind", "pid"]).append_column("blob", masks)


def merge_hashes(kind: int, width: int, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    every, _ = several_have([long(x) for x in blobs])
    every = every << np.uint64(16)
    for p, a, b in edges(owner(every, width)):
        yield p, short(every[a:b])


def spread_hashes(kind: int, width: int, blobs: list[bytes], answers: list[tuple[int, bytes]]) -> list[bytes]:
    """A hash is in several batches if two of the relay's messages have it, or if others than the relay do."""
    own = [long(x) for x in blobs]
    every, twice = several_have(own)
    told = dict(answers)
    above = np.concatenate([np.unpackbits(np.frombuffer(told[p], dtype=np.uint8))[: b - a].astype(bool) for p, a, b in edges(owner(every << np.uint64(16), width))])
    twice = np.union1d(twice, every[above])
    return [np.packbits(bits(twice, x)).tobytes() for x in own]


def contexts(data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BEFORE bytes before and LENGTH bytes from each place on, zeros beyond the document; how many are its own on either side."""
    doc = np.searchsorted(bounds, places, side="right") - 1
    left, right = np.minimum(places - bounds[doc], BEFORE), np.minimum(bounds[doc + 1] - places, LENGTH)
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + LENGTH)
    out = view[places]
    column = np.arange(BEFORE + LENGTH)
    out[(column < (BEFORE - left)[:, None]) | (column >= (BEFORE + right)[:, None])] = 0
    return out, left.astype(np.uint8), right.astype(np.uint8)


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length of the prefix that each sorted row shares with the one before, and the remaining bytes."""
    n, width = suffixes.shape
    lcp = np.zeros(n, dtype=np.uint8)
    if n > 1:
        differs = suffixes[1:] != suffixes[:-1]
        lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return lcp, suffixes[np.arange(width) >= lcp[:, None]].tobytes()


def run_blobs(rows: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A front-coded run for each group; rows (suffix, its length, what is before it, its length) are sorted within a group."""
    for p, a, b in edges(groups):
        lcp, tails = front_code(rows[a:b, :LENGTH])
        yield p, squeeze(b"".join([int(b - a).to_bytes(4, "little"), lcp.tobytes(), rows[a:b, LENGTH].tobytes(), rows[a:b, -1].tobytes(), rows[a:b, LENGTH + 1 : -1].tobytes(), low[a:b].tobytes(), (high[a:b] - low[a:b]).tobytes(), tails]))


def sorted_entries(rows: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order of group and suffix, their groups, smallest and largest documents; the rows' order, and each one's entry in that order."""
    whole = np.concatenate([groups.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    order = lexical_order(whole)
    whole = whole[order]
    new = np.concatenate([[True], (whole[1:] != whole[:-1]).any(axis=1)])
    heads = np.flatnonzero(new)
    return whole[heads, 4:], groups[order][heads], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads), order, np.cumsum(new) - 1


def suffix_runs(row: dict, answers: list[dict], width: int) -> Iterator[tuple[int, bytes]]:
    """A sorted front-coded run for each group, and under -1 what the batch needs to use the answers."""
    keys, bounds, text = unpack(row)
    data = np.frombuffer(text, dtype=np.uint8)
    places, hashes = anchors(data, bounds)
    own, several, inverse = distinct(hashes, np.searchsorted(bounds, places, side="right"))
    cut = {p: (a, b) for p, a, b in edges(owner(own, width))}
    for a in answers:
        lo, hi = cut[a["pid"]]
        several[lo:hi] |= np.unpackbits(np.frombuffer(a["blob"], dtype=np.uint8))[: hi - lo].astype(bool)
    chosen = several[inverse]
    places, hashes = places[chosen], hashes[chosen]
    key = np.array([NO_KEY if k is None else k for k in keys], dtype=np.int64)[np.searchsorted(bounds, places, side="right") - 1]
    places, hashes, key = places[key != NO_KEY], hashes[key != NO_KEY], key[key != NO_KEY]
    if not len(places):
        return
    context, left, right = contexts(data, bounds, places)
    rows = np.concatenate([context[:, BEFORE:], right[:, None], context[:, :BEFORE], left[:, None]], axis=1)
    del context
    rows, of, low, high, order, entry = sorted_entries(rows, owner(hashes, width), key, key)
    yield from run_blobs(rows, of, low, high)
    # members of the entries, in order, and each group's first entry
    first = np.searchsorted(of, np.arange((1 << width) + 1))
    memory = [np.array([len(places), len(rows), len(first)], dtype=np.int64), places[order], key[order], entry, left[order].astype(np.int64), right[order].astype(np.int64), first]
    yield -1, squeeze(b"".join(x.astype("<i8").tobytes() for x in memory))


def decoded(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all runs, one run after the other, with their smallest and largest documents, and how many each run has."""
    rows, lows, highs, sizes = [], [], [], []
    for x in blobs:
        run = Run(x)
        own = np.zeros((run.n, LENGTH + 2 + BEFORE), dtype=np.uint8)
        lcp = np.frombuffer(run.lcp, dtype=np.uint8)
        fresh = np.arange(LENGTH) >= lcp[:, None]
        own[:, :LENGTH][fresh] = np.frombuffer(run.tails, dtype=np.uint8, offset=run.tail)
        # a byte that isn't a row's own is that of the last row above that has one there
        source = np.maximum.accumulate(np.where(fresh, np.arange(run.n)[:, None], 0), axis=0)
        own[:, :LENGTH] = np.take_along_axis(own[:, :LENGTH], source, axis=0)
        own[:, LENGTH], own[:, -1] = np.frombuffer(run.right, dtype=np.uint8), np.frombuffer(run.left, dtype=np.uint8)
        own[:, LENGTH + 1 : -1] = np.frombuffer(run.before, dtype=np.uint8).reshape(run.n, BEFORE)
        rows.append(own)
        lows.append(np.array(run.low, dtype=np.int64))
        highs.append(np.array(run.high, dtype=np.int64))
        sizes.append(run.n)
    return np.concatenate(rows), np.concatenate(lows), np.concatenate(highs), np.array(sizes)


def row_owners(rows: np.ndarray, width: int) -> np.ndarray:
    """The groups of rows, by the hash of the first K bytes of their suffixes."""
    powers = np.array([pow(BASE, K - 1 - i, 1 << 64) for i in range(K)], dtype=np.uint64)
    return owner(dealt_hash(settled((BYTE_HASH[rows[:, :K]] * powers).sum(axis=1, dtype=np.uint64))), width)


def merge_entries(kind: int, width: int, blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    rows, low, high, _ = decoded(blobs)
    rows, of, low, high, _, _ = sorted_entries(rows, row_owners(rows, width), low, high)
    yield from run_blobs(rows, of, low, high)


def spread_entries(kind: int, width: int, blobs: list[bytes], answers: list[tuple[int, bytes]]) -> list[bytes | None]:
    """Answers to a relay's entries, for each run that has an entry's row, by the row's number there."""
    rows, low, high, sizes = decoded(blobs)
    _, of, _, _, order, entry = sorted_entries(rows, row_owners(rows, width), low, high)
    first = {p: a for p, a, _ in edges(of)}
    found = []
    for p, blob in answers:
        index, lo, hi, least = np.frombuffer(expand(blob), dtype="<i8").reshape(4, -1)
        which, member = members(entry, index + first[p])
        row = order[member]
        ok = high[row] > least[which]
        found.append(np.stack([row[ok], lo[which[ok]], hi[which[ok]], least[which[ok]]]))
    every = np.concatenate(found, axis=1)
    every = every[:, np.argsort(every[0], kind="stable")]
    ends = np.cumsum(sizes)
    cut = np.searchsorted(every[0], np.concatenate([[0], ends]))
    out: list[bytes | None] = []
    for k, end in enumerate(ends.tolist()):
        own = every[:, cut[k] : cut[k + 1]].copy()
        own[0] -= end - sizes[k]
        out.append(squeeze(own.astype("<i8").tobytes()) if own.shape[1] else None)
    return out


def members(entry: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted entry all its members: the index of the one wanted, and the member's place."""
    begin, end = np.searchsorted(entry, wanted), np.searchsorted(entry, wanted, side="right")
    count = end - begin
    which = np.repeat(np.arange(len(wanted)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def lexical_order(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes: by eight bytes at a time, as big-endian numbers, last first; each pass keeps the order before."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").byteswap(inplace=True).view("<u8")
    order = np.argsort(words[:, 0], kind="stable")
    column = 1
    # rows that are still equal are sorted by the next word within their group
    group = np.concatenate([[0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])]) if n else np.zeros(0, np.int64)
    while column < words.shape[1]:
        tied = np.concatenate([[False], group[1:] == group[:-1]]) | np.concatenate([group[1:] == group[:-1], [False]])
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some = order[at]
        better = np.lexsort((words[some, column], group[at]))
        order[at] = some[better]
        step = np.zeros(n, dtype=np.int64)
        step[1:] = (group[1:] != group[:-1]) | (words[order[1:], column] != words[order[:-1], column])
        group = np.cumsum(step)
        column += 1
    return order


class Run:
    """A front-coded run: its suffixes come one after the other with the prefix that each shares with the last."""

    def __init__(self, blob: bytes):
        x = expand(blob)
        n = self.n = int.from_bytes(x[:4], "little")
        at = 4
        self.lcp, self.right, self.left = x[at : at + n], x[at + n : at + 2 * n], x[at + 2 * n : at + 3 * n]
        at += 3 * n
        self.before = x[at : at + BEFORE * n]
        at += BEFORE * n
        low, over = (np.frombuffer(x, dtype="<i8", count=n, offset=at + k * 8 * n) for k in (0, 1))
        self.low, self.high = array("q", low.tobytes()), array("q", (low + over).tobytes())
        self.tails, self.tail, self.i, self.suffix = x, at + 16 * n, -1, b""

    def advance(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            return False
        keep = self.lcp[self.i]
        end = self.tail + LENGTH - keep
        if keep < LENGTH:
            self.suffix = self.suffix[:keep] + self.tails[self.tail : end]
            self.tail = end
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, prefix shared with the suffix before) in order of suffix, by a loser tree.

    known[r] is what run r's suffix shares with the last one put out. Of two suffixes the one that shares more is
    the smaller; only if both share equally much are bytes compared, and only those after that prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [0] * size
    live = [i < len(runs) and runs[i].advance() for i in range(size)]
    suffix = [runs[i].suffix if live[i] else b"" for i in range(size)]
    tree = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if not live[a] or not live[b]:
            return (a, b) if live[a] else (b, a)
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = suffix[a][ka:], suffix[b][ka:]
        if x == y:
            known[max(a, b)] = LENGTH
            return (a, b) if a < b else (b, a)
        same = ka + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        if x < y:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, loser = play(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return w

    w = build(1) if size > 1 else 0
    while live[w]:
        run = runs[w]
        yield w, run.i, known[w]
        if run.advance():
            suffix[w], known[w] = run.suffix, run.lcp[run.i]
        else:
            live[w] = False
        node = (w + size) >> 1
        while node:
            other = tree[node]
            if live[other]:
                ko, kw = known[other], known[w]
                if not live[w] or ko > kw:
                    tree[node], w = w, other
                elif ko == kw:
                    w, tree[node] = play(w, other)
            node >>= 1


#: Of so many different surroundings each two are compared; of more the strings are looked up.
FEW = 16


def by_pairs(kinds: list[tuple[tuple[bytes, bytes, int, int], int]]) -> list[list[tuple[int, int, int]]]:
    """For each of the surroundings, in order of their smallest document: what it has in common with smaller ones.

    Two surroundings of an anchor have one range of strings in common.
    """
    around = [(int.from_bytes(k[0], "big"), int.from_bytes(k[1], "big")) for k, _ in kinds]
    out: list[list[tuple[int, int, int]]] = []
    for n, ((_, _, left, right), low) in enumerate(kinds):
        told: list[tuple[int, int, int]] = []
        for k in range(n):
            (_, _, other_left, other_right), other = kinds[k]
            if other == low:
                break
            x, y = around[n][0] ^ around[k][0], around[n][1] ^ around[k][1]
            last = min(((x & -x).bit_length() - 1) // 8 if x else BEFORE, left, other_left)
            first = max(0, LENGTH - min(LENGTH - (y.bit_length() + 7) // 8, right, other_right))
            if first <= last and not any(a <= first and last <= b for a, b, _ in told):
                told.append((first, last, other))
        out.append(told)
    return out


def by_strings(kinds: list[tuple[tuple[bytes, bytes, int, int], int]]) -> list[list[tuple[int, int, int]]]:
    """The same as by_pairs, from the smallest document of every string through the anchor."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in kinds]
    for back in range(BEFORE + 1):
        found: dict[bytes, int] = {}
        for n, ((before, suffix, left, right), low) in enumerate(kinds):
            if back <= left and LENGTH - back <= right:
                least = found.setdefault(before[BEFORE - back :] + suffix[: LENGTH - back], low)
                if least < low:
                    told = out[n]
                    if told and told[-1][1] == back - 1 and told[-1][2] == least:
                        told[-1] = (told[-1][0], back, least)
                    else:
                        told.append((back, back, least))
    return out


def least_documents(group: list[tuple[int, int, tuple[bytes, bytes, int, int], int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(run, index, first, last, document): through these places of the anchor the string is in that smaller document.

    group: run, index, the surroundings (bytes before, suffix, own bytes before and from the anchor on), smallest and
    largest document. A string starts 0 to BEFORE bytes before the anchor. What only the entry itself has, in one
    document, isn't told.
    """
    least: dict[tuple[bytes, bytes, int, int], int] = {}
    for _, _, kind, low, _ in group:
        if low < least.get(kind, NO_KEY):
            least[kind] = low
    told: dict[tuple[bytes, bytes, int, int], list[tuple[int, int, int]]] = {}
    if len(least) > 1:
        kinds = sorted(least.items(), key=lambda k: k[1])
        told = dict(zip((k for k, _ in kinds), by_pairs(kinds) if len(kinds) <= FEW else by_strings(kinds), strict=True))
    for run, index, kind, _, high in group:
        low = least[kind]
        first, last = max(0, LENGTH - kind[3]), kind[2]
        if low < high and first <= last:
            yield run, index, first, last, low
        for a, b, other in told.get(kind, ()):
            yield run, index, a, b, other


def merge_runs(table: pa.Table) -> pa.Table:
    """Answers for each batch: entry, first and last place, smallest document. What a batch keeps for itself goes through."""
    if table["pid"][0].as_py() < 0:
        return table.select(["batch", "kind", "pid", "blob"])
    runs = [Run(x) for x in table["blob"].to_pylist()]
    out = [array("q") for _ in runs]
    group: list = []

    def close() -> None:
        if len(group) > 1 or group[0][3] < group[0][4]:
            for r, i, a, b, low in least_documents(group):
                out[r].extend((i, a, b, low))

    for r, i, shared in merge(runs):
        if group and shared < K:
            close()
            group.clear()
        run = runs[r]
        group.append((r, i, (run.before[BEFORE * i : BEFORE * i + BEFORE], run.suffix, run.left[i], run.right[i]), run.low[i], run.high[i]))
    if group:
        close()
    blobs = [squeeze(np.frombuffer(x, dtype="<i8").reshape(-1, 4).T.tobytes()) if x else None for x in out]
    keep = [i for i, x in enumerate(blobs) if x is not None]
    return messages([(table["batch"][i].as_py(), 0, table["pid"][i].as_py(), blobs[i]) for i in keep])


def covered(row: dict, answers: list[dict]) -> tuple[list, np.ndarray, bytes, np.ndarray]:
    """Keys, bounds and bytes of a batch, and which of its bytes are to go."""
    keys, bounds, text = unpack(row)
    mark = np.zeros(len(text) + 1, dtype=np.int64)
    memory = next((a["blob"] for a in answers if a["pid"] == -1), None)
    if memory is not None:
        x = np.frombuffer(expand(memory), dtype="<i8")
        n, _, groups = x[:3].tolist()
        places, key, entry, left, right = (x[3 + k * n : 3 + (k + 1) * n] for k in range(5))
        first = x[3 + 5 * n : 3 + 5 * n + groups]
        for a in answers:
            if a["pid"] < 0:
                continue
            index, lo, hi, low = np.frombuffer(expand(a["blob"]), dtype="<i8").reshape(4, -1)
            which, member = members(entry, index + first[a["pid"]])
            ok = key[member] > low[which]
            which, member = which[ok], member[ok]
            np.add.at(mark, places[member] - hi[which], 1)
            np.add.at(mark, places[member] - lo[which] + LENGTH, -1)
    return keys, bounds, text, np.cumsum(mark)[:-1] > 0


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """key, n_bytes, spans (array<struct<start, end>>, bytes, maximal), kept (binary, the bytes outside the spans), text, carried.

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller key; texts are taken as
    UTF-8 bytes, matches never cross documents, and every string is judged on the input. A null text is empty. A
    document with a null key takes no part and keeps all; documents with equal keys are no smaller than one another.
    carried is the string column named in carry, and text what is kept, without the rest of characters that were cut,
    both null if none is named; other columns are dropped; an empty table gives no rows. A passage that a third of all documents share costs
    each batch one entry, whatever the number of documents in it, and relays merge equal entries of many batches.
    """
    packed = pack(df, key, text, carry=carry)
    n, parts, levels = shares(packed, 2 << 20, 4 << 20)
    width = exchange.BITS

    def rows_of(batch: pa.RecordBatch | pa.Table) -> list[dict]:
        return batch.to_pylist()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from messages([(row["batch"], 0, p, x) for p, x in ask_hashes(row, width)]).combine_chunks().to_batches()

    def sort(batch: pa.Table, answers: pa.Table) -> pa.Table:
        return messages([(row["batch"], 0, p, x) for row in rows_of(batch) for p, x in suffix_runs(row, rows_of(answers), width)])

    def finish(batch: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, spans, kept, carried = [], [], [], [], []
        for row in rows_of(batch):
            keys, bounds, whole, gone = covered(row, rows_of(answers))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            # a run ends at its document's end too
            inner = np.unique(bounds[1:-1])
            inner = inner[(inner > 0) & (inner < len(gone))]
            inner = inner[gone[inner] & gone[inner - 1]]
            starts, ends = np.sort(np.concatenate([edges[::2], inner])), np.sort(np.concatenate([edges[1::2], inner]))
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                lo, hi = np.searchsorted(starts, a), np.searchsorted(starts, b)
                own = [{"start": int(s) - a, "end": int(e) - a} for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)] if b > a else []
                at, parts_ = a, []
                for s in own:
                    parts_.append(whole[at : a + s["start"]])
                    at = a + s["end"]
                ids.append(keys[k])
                carried.append(row["carried"][k])
                sizes.append(b - a)
                spans.append(own)
                kept.append(b"".join([*parts_, whole[at:b]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"key": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()), "text": pa.array([x.decode("utf-8", "ignore") for x in kept] if carry else [None] * len(ids), pa.string()), "carried": pa.array(carried, pa.string())})

    asked = climbed(packed.mapInArrow(ask, MESSAGE), n, parts, levels, merge_hashes)
    shared = descended(asked, n, parts, asked[-1].repartition(parts, "pid").groupBy("pid").applyInArrow(shared_hashes, MESSAGE), spread_hashes)
    runs = packed.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(sort, MESSAGE)
    if levels > 1:
        runs = written(runs)
        own, runs = runs.where("pid < 0"), runs.where("pid >= 0")
    sent = climbed(runs, n, parts, levels, merge_entries)
    # runs meet by group; what a batch keeps for itself is dealt by the batch
    dealt = sent[-1].withColumn("to", F.when(F.col("pid") < 0, -1 - F.col("batch")).otherwise(F.col("pid").cast("long")))
    back = descended(sent, n, parts, dealt.repartition(parts, "to").groupBy("to").applyInArrow(merge_runs, MESSAGE), spread_entries)
    back = written(back.unionByName(own) if levels > 1 else back)
    out = packed.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(finish, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, text string, carried string")
    return out.withColumnRenamed("key", key)


def op6(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents

    done = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated bytes (and without what is left of a character cut by that); n_chars follows the text.

    Other columns pass as they are. A null text becomes the empty one; a document with a null key keeps its whole
    text; documents that repeat a key are no smaller than one another; an empty table gives no rows.
    """
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    # by place, as JSON objects don't hold two names that differ in case only
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rest)])
    carried = F.to_json(F.struct(F.lit(0).alias("row"), *(column(f.name).alias(f"c{i}") for i, f in enumerate(rest))))
    done = remove_repeats(docs.select("doc_id", "text", carried.alias("rest_")), carry="rest_")
    done = done.select("doc_id", "text", F.from_json("carried", plain).alias("rest_"))
    if rest:
        done = done.select("doc_id", "text", *(F.col(f"rest_.c{i}").alias(f.name) for i, f in enumerate(rest)))
    if any(f.name == "n_chars" for f in rest):
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*map(column, docs.columns))
