"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a trained vector of its own, if the sampled labels tell it apart, and as the two last states of a
bidirectional GRU over its characters. Every character of a text but white space belongs to a word. A bidirectional
GRU runs over windows of words that overlap, attention pools the states of a window, and a document's score is that
of its worst window. A word's share of the window network's input depends on the word
alone, so scoring computes it once for each distinct word and then only gathers rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import as_bytes, column, documents, groups, mapped, slices, without

#: Words of a window and words from one window's start to the next; the last window of a text reaches its end.
WINDOW, STRIDE = 48, 36
#: Longer words enter as pieces of this many bytes each.
WORD_BYTES = 24
WORD_DIM, CHAR_DIM, CHAR_STATE, STATE, ATTENTION = 8, 8, 12, 8, 8
#: A word gets a vector of its own if so many sampled texts have it and its chi-square between the labels is as large:
#: vectors of words that tell nothing would only remember the sample.
KNOWN, TELLS = 5, 11.0
#: At most so many labelled rows, those with the smallest hash of their key, are learned from, each with its whole text,
#: as long as their texts hold so many bytes together at most: the driver gets no more than that.
SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
STEPS, EPOCHS, BATCH, RATE, DECAY, WORD_DROPOUT = 160, 4, 64, 0.012, 0.05, 0.3
THRESHOLD = 0.7
#: Distinct words whose input rows a worker keeps.
MEMO = 250_000

#: Letters, digits and bytes beyond ASCII, with marks between them that can stand for a letter; or a run of marks.
WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[!@#$*+]{1,3}[a-z0-9\x80-\xff]+)*|[^ \t-\ra-z0-9\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """All of the text but ASCII white space, in lower case: words, with the digits and marks inside them, and runs of marks."""
    found = WORD.findall(text.lower())
    if any(len(w) > WORD_BYTES for w in found):
        found = [w[i : i + WORD_BYTES] for w in found for i in range(0, len(w), WORD_BYTES)]
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(x: np.ndarray, u: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States [steps, rows, size] for input shares x [steps, rows, 3 size]; at step t the first live[t] rows move on, the others' states stay."""
    size = u.shape[0]
    h, states, trace = np.zeros((x.shape[1], size), dtype=x.dtype), np.empty((*x.shape[:2], size), dtype=x.dtype), []
    for t, m in enumerate(live.tolist()):
        old = h[:m]
        g = old @ u
        zr = sigmoid(x[t, :m, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(x[t, :m, 2 * size :] + r * g[:, 2 * size :])
        if keep:
            trace.append((old, z, r, n, g[:, 2 * size :]))
        h = np.concatenate([old + (1 - z) * (n - old), h[m:]]) if m < len(h) else old + (1 - z) * (n - old)
        states[t] = h
    return states, trace


def gru_back(d_states: np.ndarray, trace: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u."""
    size = u.shape[0]
    dx, du, dh = np.zeros((*d_states.shape[:2], 3 * size), dtype=d_states.dtype), np.zeros_like(u), np.zeros(d_states.shape[1:], dtype=d_states.dtype)
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, n, gn = trace[t]
        dh += d_states[t]
        m = dh[: len(h)]
        dn = m * (1 - z) * (1 - n * n)
        dz = m * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t, : len(h)] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dg
        dh[: len(h)] = m * z + dg @ u.T
    return dx, du


def added(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values for each row number in at."""
    out = np.zeros((rows, values.shape[1]), dtype=values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        own = at[order]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[heads]] = np.add.reduceat(values[order], heads, axis=0)
    return out


def char_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, which come longest first, as rows' columns [steps, words], and how many words reach each step."""
    steps = max(map(len, words), default=1)
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), dtype=np.uint8).reshape(len(words), steps).T
    size = np.array([len(w) for w in words])
    return flat.astype(np.int64), (size[None, :] > np.arange(steps)[:, None]).sum(axis=1)


class Network:
    def __init__(self, known: dict[bytes, float], seed: int = 5):
        """known: the words with vectors of their own, and how far each speaks for the label."""
        self.known = {w: n for n, w in enumerate(known, 1)}  # row 0 is for all other words
        g = np.random.default_rng(seed)
        at = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        inside = WORD_DIM + 2 * CHAR_STATE
        self.p = {
            "word": (0.1 * g.standard_normal((len(known) + 1, WORD_DIM))).astype(np.float32), "char": (0.5 * g.standard_normal((256, CHAR_DIM))).astype(np.float32),
            **{f"c_in{d}": at(CHAR_DIM, 3 * CHAR_STATE) for d in "fb"}, **{f"c_u{d}": at(CHAR_STATE, 3 * CHAR_STATE) for d in "fb"}, **{f"c_b{d}": np.zeros(3 * CHAR_STATE, np.float32) for d in "fb"},
            **{f"in{d}": at(inside, 3 * STATE) for d in "fb"}, **{f"u{d}": at(STATE, 3 * STATE) for d in "fb"}, **{f"b{d}": np.zeros(3 * STATE, np.float32) for d in "fb"},
            "a_in": at(2 * STATE, ATTENTION), "a_out": at(ATTENTION), "out": at(2 * STATE), "bias": np.full(1, -2, np.float32),
        }
        self.p["word"][1:, 0] += np.clip(np.array([*known.values()], dtype=np.float32) / 6, -2, 2)

    def word_vectors(self, words: list[bytes], keep: bool = False, dropped: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Of words that come longest first."""
        p = self.p
        bucket = np.fromiter((self.known.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        if dropped is not None:
            bucket = np.where(dropped, 0, bucket)
        ids, live = char_ids(words)
        emb = p["char"][ids]
        f, tf = gru((p["char"] @ p["c_inf"] + p["c_bf"])[ids], p["c_uf"], live, keep)
        b, tb = gru((p["char"] @ p["c_inb"] + p["c_bb"])[ids][::-1], p["c_ub"], live[::-1], keep)
        return np.concatenate([p["word"][bucket], f[-1], b[-1]], axis=1), (bucket, ids, emb, tf, tb)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input shares of both directions of the window network, [words, 6 STATE]."""
        out = np.empty((len(words), 6 * STATE), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            v, _ = self.word_vectors([words[i] for i in some])
            out[some] = np.concatenate([v @ self.p["inf"] + self.p["bf"], v @ self.p["inb"] + self.p["bb"]], axis=1)
        return out

    def pooled(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows that come longest first; x [steps, windows, 6 STATE]."""
        p, live = self.p, mask.sum(axis=1).astype(np.int64)
        f, tf = gru(x[:, :, : 3 * STATE], p["uf"], live, keep)
        b, tb = gru(x[::-1, :, 3 * STATE :], p["ub"], live[::-1], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        a = np.tanh(h @ p["a_in"])
        e = np.where(mask > 0, a @ p["a_out"], np.float32(-1e9))
        w = np.exp(e - e.max(axis=0)) * mask
        w = w / np.maximum(w.sum(axis=0), np.float32(1e-9))
        pool = np.einsum("tw,twk->wk", w, h)
        return pool @ p["out"] + p["bias"], (tf, tb, h, a, w, pool)

    def gradients(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, label: np.ndarray, dropped: np.ndarray) -> tuple[float, dict]:
        """index [steps, windows] into words; words and windows come longest first."""
        p = self.p
        v, (bucket, ids, emb, ctf, ctb) = self.word_vectors(words, True, dropped)
        shares = np.concatenate([v @ p["inf"] + p["bf"], v @ p["inb"] + p["bb"]], axis=1)
        x = shares[index]
        logit, (tf, tb, h, a, w, pool) = self.pooled(x, mask, True)
        q = sigmoid(logit)
        loss = -float(np.mean(label * np.log(q + 1e-9) + (1 - label) * np.log(1 - q + 1e-9)))
        d = ((q - label) / len(label)).astype(np.float32)
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        dh = w[:, :, None] * d_pool
        dw = np.einsum("twk,wk->tw", h, d_pool)
        de = w * (dw - (w * dw).sum(axis=0))
        da = de[:, :, None] * p["a_out"] * (1 - a * a)
        g["a_out"] = np.einsum("tw,twk->k", de, a)
        g["a_in"] = np.einsum("twi,twj->ij", h, da)
        dh = dh + da @ p["a_in"].T
        dxf, g["uf"] = gru_back(dh[:, :, :STATE], tf, p["uf"])
        dxb, g["ub"] = gru_back(dh[::-1, :, STATE:], tb, p["ub"])
        dx = np.concatenate([dxf, dxb[::-1]], axis=2).reshape(-1, 6 * STATE)
        d_shares = added(len(shares), index.ravel(), dx)
        sf, sb = d_shares[:, : 3 * STATE], d_shares[:, 3 * STATE :]
        g |= {"inf": v.T @ sf, "inb": v.T @ sb, "bf": sf.sum(axis=0), "bb": sb.sum(axis=0)}
        dv = sf @ p["inf"].T + sb @ p["inb"].T
        g["word"] = added(len(p["word"]), bucket, np.ascontiguousarray(dv[:, :WORD_DIM]))
        d_emb = np.zeros_like(emb)
        for name, trace, part, step in (("f", ctf, dv[:, WORD_DIM : WORD_DIM + CHAR_STATE], 1), ("b", ctb, dv[:, WORD_DIM + CHAR_STATE :], -1)):
            last = np.zeros((len(ids), len(words), CHAR_STATE), dtype=part.dtype)
            last[-1] = part
            dcx, g[f"c_u{name}"] = gru_back(last, trace, p[f"c_u{name}"])
            dcx = dcx[::step]
            g[f"c_in{name}"] = np.einsum("twi,twj->ij", emb, dcx)
            g[f"c_b{name}"] = dcx.sum(axis=(0, 1))
            d_emb += dcx @ p[f"c_in{name}"].T
        g["char"] = added(256, ids.ravel(), d_emb.reshape(-1, CHAR_DIM))
        return loss, g


def window_starts(n: int) -> range:
    """Windows of a text of n words overlap and cover all of it."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


class Scorer:
    """Logits of whole texts; remembers the input rows of a bounded number of distinct words."""

    def __init__(self, network: Network):
        self.net = network
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, 6 * STATE), dtype=np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        missing = list(set(words).difference(self.row))
        if missing:
            first = len(self.row)
            if first + len(missing) > len(self.table):
                bigger = np.zeros((max(2 * len(self.table), first + len(missing)), 6 * STATE), dtype=np.float32)
                bigger[:first] = self.table[:first]
                self.table = bigger
            self.table[first : first + len(missing)] = self.net.inputs(missing)
            self.row.update(zip(missing, range(first, first + len(missing)), strict=True))
        return np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))

    def windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each window its text's index, and its logit."""
        cut = [words_of(x) for x in texts]
        index = np.concatenate([self.rows([w for x in cut for w in x]), np.zeros(WINDOW, dtype=np.int64)])
        begin, end, of, at = [], [], [], 0
        for i, x in enumerate(cut):
            for s in window_starts(len(x)):
                begin.append(at + s)
                end.append(min(at + s + WINDOW, at + len(x)))
                of.append(i)
            at += len(x)
        begin, end, of = (np.array(v, dtype=np.int64) for v in (begin, end, of))
        logit = np.empty(len(of), dtype=np.float32)
        order = np.argsort(begin - end, kind="stable")
        for k in range(0, len(of), 2048):
            some = order[k : k + 2048]
            where = begin[None, some] + np.arange(WINDOW)[:, None]
            mask = (where < end[None, some]).astype(np.float32)
            logit[some] = self.net.pooled(self.table[index[np.minimum(where, len(index) - 1)]], mask)[0]
        return of, logit

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in groups(texts):
            if len(self.row) > MEMO:
                self.forget()
            of, logit = self.windows(texts[a:b])
            worst = np.full(b - a, -np.inf)
            np.maximum.at(worst, of, logit)
            out[a:b] = sigmoid(worst)
        return out


def telling(cut: list[list[bytes]], labels: np.ndarray) -> dict[bytes, float]:
    """Words that tell the labels apart: the signed root of chi-square between having the word and the label."""
    having = [Counter(w for x, y in zip(cut, labels, strict=True) if y == label for w in set(x)) for label in (0, 1)]
    n0, n1 = (int((labels == label).sum()) for label in (0, 1))
    out = {}
    for w in sorted(having[0].keys() | having[1].keys()):
        c0, c1 = having[0][w], having[1][w]
        if KNOWN <= c0 + c1 < n0 + n1:
            z = (c1 * n0 - c0 * n1) * ((n0 + n1) / ((c0 + c1) * (n0 + n1 - c0 - c1) * n0 * n1)) ** 0.5
            if z * z >= TELLS:
                out[w] = float(z)
    return out


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """Train on one window of each text, its worst, so that a text is as its worst window is; without both labels the score is constant.

    At first the worst window is the one whose words speak most for the label, later the one that scores highest.
    """
    one: dict[bytes, bytes] = {}  # equal words are held once
    cut = [[one.setdefault(w, w) for w in words_of(x) or [b"\x01"]] for x in texts]
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    rng = np.random.default_rng(seed)
    if not len(toxic) or not len(clean):
        net = Network({}, seed)
        net.p["out"] *= 0
        net.p["bias"][:] = 4.0 if len(toxic) else -4.0
        return net
    known = telling(cut, labels)
    net = Network(known, seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    starts = [list(window_starts(len(x))) for x in cut]
    most = min(len(clean), 3 * len(toxic))
    size = len(toxic) + most
    step, per_epoch = 0, -(-steps // EPOCHS)
    for epoch in range(EPOCHS):
        if epoch == 0:
            chosen = []
            for x, s in zip(cut, starts, strict=True):
                told = np.concatenate([[0.0], np.cumsum([max(0.0, known.get(w, 0.0)) for w in x])])
                value = [told[min(a + WINDOW, len(x))] - told[a] for a in s]
                best = int(np.argmax(value))
                chosen.append(best if value[best] > 0 else int(rng.integers(len(s))))
        elif epoch < EPOCHS - 1:
            scorer = Scorer(net)
            for a, b in groups(texts):
                if len(scorer.row) > MEMO:
                    scorer.forget()
                of, logit = scorer.windows(texts[a:b])
                heads = np.searchsorted(of, np.arange(b - a + 1))
                for i in range(b - a):
                    chosen[a + i] = int(np.argmax(logit[heads[i] : heads[i + 1]])) if heads[i + 1] > heads[i] else 0
        drawn = np.zeros(0, dtype=np.int64)
        while len(drawn) < per_epoch * BATCH:
            drawn = np.concatenate([drawn, rng.permutation(np.concatenate([toxic, rng.permutation(clean)[:most]]))])
        for k in range(0, per_epoch * BATCH, min(BATCH, size)):
            some = drawn[k : k + min(BATCH, size)]
            held = [cut[i][starts[i][chosen[i]] : starts[i][chosen[i]] + WINDOW] for i in some]
            order = sorted(range(len(held)), key=lambda j: -len(held[j]))
            held, some = [held[j] for j in order], some[order]
            words = sorted({w for x in held for w in x}, key=lambda w: (-len(w), w))
            place = {w: n for n, w in enumerate(words)}
            index, mask = np.zeros((WINDOW, len(some)), dtype=np.int64), np.zeros((WINDOW, len(some)), dtype=np.float32)
            for j, x in enumerate(held):
                index[: len(x), j], mask[: len(x), j] = [place[w] for w in x], 1
            dropped = rng.random(len(words)) < WORD_DROPOUT
            _, g = net.gradients(words, index, mask, labels[some].astype(np.float32), dropped)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * min(1.0, 2.2 - 2.2 * epoch / EPOCHS)
            for name, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                m, s = moment[name]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                s += 0.01 * v * v
                net.p[name] -= rate * DECAY * net.p[name]
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def crc_of(key: str) -> F.Column:
    return F.crc32(column(key).cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: F.Column | None = None) -> Network:
    """Fit on at most sample labelled rows, those whose key has the smallest hash; learn: which of the labels may be used.

    Rows are taken in order of that hash, with whole texts, while their texts hold SAMPLE_BYTES together at most, so that
    what the driver gets is bounded; a row that would exceed it, and rows after it, are not learned from. Null keys
    and labels other than 0 and 1 are not used; of a key with several labels, the largest; rows that repeat a key are
    all learned from within the bound. A null text is empty. Without labels, or with one of the two only, the network
    gives every text the same score, below the threshold unless all labels are 1.
    """
    rows = labels.where(column(label).isin(0, 1) & (F.lit(True) if learn is None else learn) & column(key).isNotNull())
    few = F.broadcast(rows.groupBy(column(key).alias("key_")).agg(F.max(column(label).cast("int")).alias("label_")).orderBy(F.xxhash64("key_"), "key_").limit(sample))
    named = docs.select(column(key).alias("key_"), F.coalesce(column(text), F.lit("")).alias("text_")).join(few, "key_")
    order = (F.xxhash64("key_"), F.xxhash64("text_"))
    # sizes first, so that the rows that are sent are within the bound
    sizes = named.select(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.octet_length("text_").alias("size")).orderBy("o0", "o1").limit(sample)
    within = sizes.withColumn("upto", F.sum("size").over(Window.orderBy("o0", "o1").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= SAMPLE_BYTES)
    last = within.agg(F.max(F.struct("o0", "o1")).alias("last")).first()["last"]
    if last is None:
        return fit([], np.zeros(0, dtype=np.int64))
    held = named.where(F.struct(order[0].alias("o0"), order[1].alias("o1")) <= F.struct(F.lit(last["o0"]).alias("o0"), F.lit(last["o1"]).alias("o1"))).orderBy(*order).limit(sample).select("text_", "label_").collect()
    texts, known = [r[0].encode() for r in held], np.array([r[1] for r in held], dtype=np.int64)
    del held
    return fit(texts, known)


def score_toxicity(df: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """df and score (double, 0 to 1): the highest score of any window of the whole text.

    A null or empty text, or one of white space, gets the score of an empty window; equal texts get equal scores up
    to rounding; other columns pass, one named as score is replaced; an empty table gives no rows.
    """
    rest = without(df, score)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rest.schema.fields] + [T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(network)
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = scorer.scores(as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return mapped(rest, run, schema)


def fold(key: str = "doc_id") -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(crc_of(key) % 3 == 1, F.lit(False))


def trained(spark, sf_dir: str) -> Network:
    return train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~fold())


def op10(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), trained(spark, sf_dir))
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below the threshold, unchanged, with all their columns.

    The network is trained on all labelled documents of sf_dir (see train), not on those that are left. A document
    with a null or empty text scores as an empty window and stays; a null or repeated key plays no part; an empty
    table gives no rows.
    """
    return score_toxicity(docs, trained(spark, sf_dir), score="toxicity_score_").where(F.col("toxicity_score_") < THRESHOLD).select(*map(column, docs.columns))
