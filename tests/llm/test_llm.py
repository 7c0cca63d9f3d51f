"""The operators against brute force, exact round trips and held-out accuracy, on small fixtures with awkward rows."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import ann, arrowseq, batches, bpe, chat, jaccard, lm, packing, quality, suffix, tokens, toxicity

HARD = [
    "a  b  c\n\n d", " lead", "trail ", "a<|endoftext|>b \n\n<|endoftext|> x", "don't we'll I'm ‘quoted’", "日本語のテキスト　です", "\n   b", "aaaaaaaaaaaaaaaaaaaa" * 50,
    "tab\t\tx y", "é ñ 😀😀 \x1c\x1f", "", "x\r\n\r\ny", "1234567890 12,000.5", " " * 30 + "z", "<|ENDOFTEXT|> I'<|endoftext|>", "..“x”.. ×3÷2", " \n   b",
]


def fuzz(n, alphabet="abZ .,\n'é×“日s1 <|>°́T", seed=1):
    r = random.Random(seed)
    return HARD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def table(spark, texts, extra=()):
    """doc_id and text, a null text, and columns whose names operators use themselves."""
    rows = [(i, t, "v", i) for i, t in enumerate([*texts, None])]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, key string, n long")


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    words = ["".join(r.choice(["th", "er", "on", "in", "at", "é", "st"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    docs = ["\n".join(line(r.randint(5, 15)) for _ in range(r.randint(2, 12))) for _ in range(60)]
    passage = "\n".join(line(12) for _ in range(6))
    docs += [docs[3], docs[3], docs[5].replace("the", "that", 1), docs[7][: len(docs[7]) * 19 // 20], passage + "\n" + line(30), line(40) + "\n" + passage, "ab " * 200, "ab " * 150, "two words", "two words", "one"]
    return docs


# --- tokens, encoding, packing, files


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_memoised_ids_are_the_librarys(name, kind):
    vocabulary = tokens.vocabulary_text(name)
    texts = fuzz(4000)
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_str(vocabulary).encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(vocabulary, kind).encode([t.encode() for t in texts]) == want


def test_bpe_round_trip(spark):
    texts = fuzz(600)
    library = Tokenizer.from_str(tokens.vocabulary_text("byte_bpe_50k.json"))
    df = table(spark, texts).withColumn("ids", F.lit("old"))
    out = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect()}
    assert len(out) == len(texts) + 1 and out[len(texts)].ids == [] and out[len(texts)].text == "" and out[0].key == "v"
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].text == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0)).count() == 0
    # in one pass the same, whatever column the decoded text takes the place of
    for name in ("text", "Key", "back"):
        once = bpe.bpe_encode(df, decoded=name)
        assert {r.doc_id: (r.ids, r[name]) for r in once.collect()} == {d: (r.ids, r.text) for d, r in out.items()}
        assert [c.lower() for c in once.columns].count(name.lower()) == 1
    with pytest.raises(ValueError, match="same column"):
        bpe.bpe_encode(df, decoded="IDS")


def test_long_pre_token_takes_linear_time():
    model = bpe.PrefixBpe(tokens.vocabulary_text("byte_bpe_50k.json"))
    ids = np.frombuffer(model.encode([b"ab" * 100_000])[0], dtype="<i4").tolist()
    assert model.decode(ids) == "ab" * 100_000


def test_packing(spark, prose):
    texts = [*prose, "word " * 5000, "word " * 1023, ""]
    rows = packing.best_fit_pack(table(spark, texts).repartition(2), bins=16).collect()
    library = Tokenizer.from_str(tokens.vocabulary_text("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate([*texts, ""]):
        own = sorted(pieces[i], key=lambda r: r.piece)
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(r.ids for r in own), dtype="<u4").tolist() == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert len(own) == max(1, math.ceil(len(ids) / 1024)) and all(r.length == 1024 for r in own[1:])
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(r.length for r in rows) / 1024 * 1.15 + 2


def test_many_small_partitions_are_packed_together(spark, data):
    rows = packing.best_fit_pack(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").repartition(64)).select("sequence_id", "length").collect()
    assert sum(r.length for r in rows) / (1024 * len({r.sequence_id for r in rows})) >= 0.97


def test_bounded_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    # 6 and 5 open two bins; 8 closes the one with 4 left; 2 then fits the one with 2 left best; 9 closes the one with 5 left
    assert [bins.place(n) for n in (6, 5, 8, 2, 9, 5)] == [(0, 0), (1, 0), (2, 0), (2, 8), (3, 0), (1, 5)]


def test_sequences_are_read_back(spark, prose, tmp_path):
    df = table(spark, prose).orderBy(F.rand(1)).unionByName(spark.createDataFrame([(2, "again", "v", 1), (None, "x", "v", 1)], "doc_id long, text string, key string, n long"))
    files = arrowseq.write_sequences(df, folder=f"file://{tmp_path}/out", length=64, partitions=3)
    library = Tokenizer.from_str(tokens.vocabulary_text("word_bpe_49k.json"))
    got = arrowseq.read_sequences(files).orderBy("start").collect()
    keys = [r.key for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:]) and len(keys) == len(prose) + 3
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        if r.key not in (None, 2):
            text = prose[r.key] if r.key < len(prose) else ""
            assert np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [1]
    import pyarrow as pa

    with pa.OSFile(files.first()["path"]) as source:
        assert arrowseq.documents_of(source)["n_tokens"].to_pylist() == arrowseq.SequenceReader(pa.memory_map(files.first()["path"]).read_buffer()).documents["n_tokens"].to_pylist()
    reader = arrowseq.SequenceReader(pa.memory_map(files.first()["path"]).read_buffer())
    ids, mask = reader[len(reader) - 1]
    assert len(ids) == 64 and mask.sum() == (files.first()["n_tokens"] - 1) % 64 + 1 and (ids[~mask] == 0).all()
    assert arrowseq.read_sequences(arrowseq.write_sequences(df.limit(0), folder=f"file://{tmp_path}/none")).count() == 0


# --- quality


def brute_quality(text):
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality(spark, prose):
    good = "\n".join(" ".join(f"word{(7 * i + k) % 91}x{i}" for k in range(12)) + "." for i in range(8))
    nav = "\n".join("Home | News | Sport | About us | Contact" for _ in range(1)) + "\n" + "\n".join(f"Item {i} | more{i} | next{i} | back{i} | word{i} |" for i in range(12))
    marks = " ".join(f"word{i}***" for i in range(80)) + "."
    texts = [*prose, *fuzz(300), good, nav, marks]
    out = {r.doc_id: r for r in quality.line_quality(table(spark, texts), clean="cleaned").collect()}
    for i, t in enumerate([*texts, ""]):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    base = len(prose) + len(HARD) + 300
    assert out[base].kept and out[base].cleaned == good and not out[base + 1].kept and out[base + 1].n_navigation > 5 and not out[base + 2].kept
    assert quality.line_quality(table(spark, []).limit(0)).count() == 0


# --- suffixes


def brute_repeats(docs):
    """doc -> (spans, kept); docs in order of key."""
    first, out = {}, {}
    for d, t in docs:
        b = t.encode()
        gone, own = [False] * len(b), set()
        for s in range(len(b) - suffix.LENGTH + 1):
            w = b[s : s + suffix.LENGTH]
            if first.get(w, d) < d:
                gone[s : s + suffix.LENGTH] = [True] * suffix.LENGTH
            own.add(w)
        for w in own:
            first.setdefault(w, d)
        runs = [len(x) for x in "".join("x" if g else " " for g in gone).split()]
        out[d] = (len(b), sum(runs), len(runs), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def relays_in_between(monkeypatch, bits, levels):
    """Exchanges with 2 ** bits groups a sender and so many levels."""
    monkeypatch.setattr(batches, "BITS", bits)
    own = batches.shares
    for module in (suffix, lm):
        monkeypatch.setattr(module, "shares", lambda *a: (*own(*a)[:2], levels))


@pytest.mark.parametrize(("size", "bits", "levels"), [(300, 8, 1), (3000, 8, 1), (batches.BATCH_BYTES, 8, 1), (400, 2, 2), (200, 1, 3)])
def test_repeats(spark, prose, size, bits, levels, monkeypatch):
    relays_in_between(monkeypatch, bits, levels)
    monkeypatch.setattr(batches.pack, "__defaults__", ("doc_id", "text", size, None))
    texts = [*prose, "é" * 60, "x" + "é" * 55, prose[60] + prose[61]]
    df = table(spark, texts, [(None, prose[3], "v", 0)])
    rows = suffix.remove_repeats(df).collect()
    want = brute_repeats(list(enumerate([*texts, ""])))
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert not r.spans and r.kept == prose[3].encode()
        else:
            assert (r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), r.kept) == want[r.doc_id]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_merge_carries_common_prefixes():
    r = random.Random(2)
    rows = [bytes(r.choice(b"ab") for _ in range(suffix.LENGTH)) for _ in range(400)]
    rows = [x[: r.randint(1, 50)].ljust(suffix.LENGTH, b"a") for x in rows]
    runs = []
    for k in range(5):
        own = np.frombuffer(b"".join(sorted(rows[k::5])), dtype=np.uint8).reshape(-1, suffix.LENGTH)
        n = len(own)
        lcp, tails = suffix.front_code(own)
        zero = np.zeros(n, np.uint8)
        runs.append(suffix.Run(batches.squeeze(b"".join([n.to_bytes(4, "little"), lcp.tobytes(), zero.tobytes(), zero.tobytes(), np.zeros((n, suffix.BEFORE), np.uint8).tobytes(), np.zeros(2 * n, "<i8").tobytes(), tails]))))
    got, last = [], b""
    for k, _, shared in suffix.merge(runs):
        x = runs[k].suffix
        if got:
            assert shared == next((i for i in range(suffix.LENGTH) if x[i] != last[i]), suffix.LENGTH)
        got.append(x)
        last = x
    assert got == sorted(rows)


# --- near duplicates


def brute_classes(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in sets}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (label[i], len(links[i])) for i in sets}


def test_near_duplicates(spark, prose):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    near = [" ".join(r.choice(words) if r.random() < 0.02 else w for w in base) for _ in range(40)]
    texts = [*prose, *near, *near[:5], "", " \n"]
    df = table(spark, texts)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(df).collect()}
    assert got == brute_classes([*texts, None])
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    stays = {x.doc_id for x in jaccard.keep_first(spark, df, "").collect()}
    assert stays == {i for i, (c, _) in got.items() if c == i}


@pytest.mark.parametrize("hot", [1, jaccard.HOT])
def test_large_buckets_are_split_into_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "HOT", hot)
    r = random.Random(6)
    base = [f"w{r.randrange(300)}" for _ in range(100)]
    texts = [" ".join(f"x{i}" if k == i * 7 % 100 else w for k, w in enumerate(base)) for i in range(30)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_classes([*texts, None])


def test_near_duplicates_with_repeated_and_null_keys(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(60)]
    one = " ".join(base)
    near = [" ".join([*base, *(f"{c}{k}" for k in range(3))]) for c in "abc"]
    other = " ".join(f"v{r.randrange(300)}" for _ in range(60))
    third = " ".join(f"u{r.randrange(300)}" for _ in range(60))
    rows = [(7, one), (7, near[0]), (3, near[1]), (7, other), (8, other + " end"), (None, third), (None, third + " end"), (4, third + " so"), (None, "x y"), (-(1 << 63), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((x.doc_id, x.class_id, x.n_links) for x in jaccard.near_duplicates(df).collect()), key=str)
    expected = [(7, 3, 2), (7, 3, 2), (3, 3, 2), (7, 7, 1), (8, 7, 1), (None, None, 2), (None, None, 2), (4, None, 2), (None, None, 0), (-(1 << 63), -(1 << 63), 0)]
    assert got == sorted(expected, key=str)
    stays = sorted(((x.doc_id, x.text) for x in jaccard.keep_first(spark, df, "").collect()), key=str)
    assert stays == sorted([(3, near[1]), (7, other), *((k, t) for k, t in rows if k is None), (-(1 << 63), None)], key=str)


def test_runs_meet_the_recall():
    miss = (1 - jaccard.SIMILARITY**jaccard.TYPICAL) ** jaccard.RUNS
    assert miss <= 1 - jaccard.RECALL
    assert len({jaccard.coordinate(r, 0) for r in range(jaccard.RUNS)}) == jaccard.RUNS


def test_runs_have_coordinates_of_their_own():
    own = [jaccard.coordinate(r, k) for r in range(60) for k in range(jaccard.STEPS)]
    assert len(set(own)) == len(own)


def test_deep_tables_get_more_runs(spark, monkeypatch):
    """Texts of shared passages, whose buckets take some steps, and a recall too high for the first runs: each set's runs are enough for its depths."""
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "RECALL", 1 - 1e-10)
    asked, deep = [], []
    leaves = jaccard.leaves

    def seen(sets, runs):
        found, deeper = leaves(sets, runs)
        asked.append(runs)
        deep.append({x.rep: x.deeper for x in deeper.collect()})
        return found, deeper

    monkeypatch.setattr(jaccard, "leaves", seen)
    r = random.Random(12)
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(40)]
    texts = [" ".join(r.sample(passages, 18)) for _ in range(120)]
    texts += [t + " " + " ".join(f"z{k}q{i}" for i in range(48)) for k, t in enumerate(texts[:20])]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_classes([*texts, None])
    assert asked[0] == range(jaccard.RUNS) and len(asked) > 1 and all(a.stop == b.start for a, b in zip(asked, asked[1:], strict=False))
    assert max(deep[0].values()) + jaccard.RUNS * jaccard.lost(1) > math.log(1 - jaccard.RECALL)
    for rep in deep[0]:
        miss = done = 0.0
        for runs, deeper in zip(asked, deep, strict=True):
            miss += len(runs) * jaccard.lost(1) + deeper.get(rep, 0.0)
            done = done or miss <= math.log(1 - jaccard.RECALL)
            if done:
                break
        assert done


# --- neighbours


@pytest.mark.parametrize("block", [2048, 16])
def test_neighbours(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", block)
    g = np.random.default_rng(4)
    x = g.standard_normal((900, 16))
    x[300:600] = x[300]  # a third of all rows are one vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000, None, "c"), (5020, [0.0] * 16, "c"), (5040, [float("nan")] * 16, "c"), (5060, [1.0, None] * 8, "c"), (5080, [1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    out = ann.nearest_neighbours(df, lambda i: i % 20 == 0, 10).collect()
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, got in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(s, 9)))[:10]
        assert [r.rank for r in got] == list(range(1, 11)) and np.allclose([r.score for r in got], [s[r.vec_id] for r in got])
        hits += len({r.vec_id for r in got} & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(by)
    twice = df.where("vec_id < 30").unionByName(spark.createDataFrame([(20, (-x[20]).tolist(), "c")], df.schema))
    asked = min(x[20].tolist(), (-x[20]).tolist())
    first = ann.nearest_neighbours(twice, lambda i: i == 20, 3).orderBy("rank").collect()
    s = x[:30] @ np.array(asked)
    s[20] = -np.inf
    assert [r.vec_id for r in first] == np.argsort(-s, kind="stable")[:3].tolist()
    few = ann.nearest_neighbours(df.where("vec_id in (20, 21, 22)"), lambda i: i % 20 == 0, 10).collect()
    assert len(few) == 2 and ann.nearest_neighbours(df.limit(0), lambda i: i % 20 == 0).count() == 0


# --- chat


@pytest.mark.parametrize(
    ("schema", "row", "turns"),
    [
        ("prompt string, response string", ("p", "r"), [("user", "p"), ("assistant", "r")]),
        ("instruction string, input string, output string", ("i", "", "o"), [("user", "i"), ("assistant", "o")]),
        ("instruction string, input string, output string", ("i", "x", "o"), [("user", "i"), ("user", "x"), ("assistant", "o")]),
        ("conversations array<struct<from:string,value:string>>", ([("human", "h"), ("gpt", "g"), (None, None)],), [("user", "h"), ("assistant", "g"), ("user", "")]),
        ("system string, messages array<struct<role:string,content:string>>", ("s", [("User", "u")]), [("system", "s"), ("user", "u")]),
        ("messages array<struct<role:string,content:string>>", (None,), []),
    ],
)
def test_layouts(spark, schema, row, turns):
    df = spark.createDataFrame([(7, *row)], "conv_id int, " + schema)
    out = chat.format_conversations(df, ignore=("conv_id",)).select("turns", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("back")).first()
    assert [tuple(t) for t in out.turns] == turns == [tuple(t) for t in out.back]
    assert "".join(out.formatted[s["start"] : s["end"]] for s in out.loss) == "".join(t for r, t in turns if r == "assistant")


def test_unknown_layout(spark):
    with pytest.raises(ValueError, match="fingerprint"):
        chat.canonical_turns(spark.createDataFrame([(1,)], "odd int"))


def test_json_records(spark):
    more = ['{"messages":[]}', '{"system":"s","messages":[]}', '{"messages":[{"id":"7","role":"user","content":"u"},{"role":"assistant","content":"a","name":"n"}]}', '{"messages":[null,{"role":"user"},{"content":"c"}]}']
    df = spark.createDataFrame([('{"prompt":"p","response":"r"}',), ('{"messages":[{"role":"user","content":"u"}]}',), ('{"odd":1}',), ("no json",), (None,), *((m,) for m in more)], "rec string")
    out = [r.turns for r in chat.canonical_json(df, "rec").collect()]
    assert [[tuple(t) for t in x] for x in out[5:]] == [[], [("system", "s")], [("user", "u"), ("assistant", "a")], [("user", ""), ("user", "c")]]
    out = out[:5]
    assert [tuple(t) for t in out[0]] == [("user", "p"), ("assistant", "r")] and [tuple(t) for t in out[1]] == [("user", "u")] and out[2:] == [None, None, None]


def test_texts_with_control_strings_come_back(spark):
    parts = ["<|turn|>", "<|end|>\n", "\\", "[INST]", "</s>", "\n", "assistant", "<", "\\<", "é😀", "|>"]
    r = random.Random(8)
    rows = [(i, [(r.choice(["user", "assistant", "system"]), "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 5))]) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id int, messages array<struct<role:string,content:string>>")
    out = chat.format_conversations(df, ignore=("conv_id",))
    learned = F.array_join(F.transform("loss", lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    for x in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("back"), learned.alias("learned")).collect():
        want = rows[x.conv_id][1]
        assert [tuple(t) for t in x.back] == want and x.learned == "".join(t for ro, t in want if ro == "assistant")
        assert x.formatted.count("<|turn|>") == len(want)


# --- language model


def brute_tree(texts, held):
    d = lm.DEPTH
    lower = lambda t: t.encode().lower()
    grams = Counter()
    for i, t in enumerate(texts):
        x = b"\xfe" * d + lower(t) + b"\xff"
        if not held(i):
            grams.update(x[k - d : k + 1] for k in range(d, len(x)))
    n = defaultdict(lambda: [0, 0])
    for g, c in grams.items():
        for depth in range(d + 1):
            m = 1
            for j in range(7, -1, -1):
                bit = g[-1] >> j & 1
                n[g[d - depth : d], m][bit] += c
                m = 2 * m + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    w, below = {}, defaultdict(float)
    for c, m in sorted(n, key=lambda k: -len(k[0])):
        own = kt(*n[c, m])
        w[c, m] = own if len(c) == d else np.logaddexp(own, below[c, m]) - math.log(2)
        if c:
            below[c[1:], m] += w[c, m]

    def score(t):
        x, total = b"\xfe" * d + lower(t) + b"\xff", 0.0
        for k in range(d, len(x)):
            m = 1
            for j in range(7, -1, -1):
                bit, p = x[k] >> j & 1, 0.5
                for depth in range(d, -1, -1):
                    key = (x[k - depth : k], m)
                    if key not in w:
                        p = 0.5
                        continue
                    e = (n[key][bit] + 0.5) / (sum(n[key]) + 1)
                    share = 1 if depth == d else math.exp(min(0, kt(*n[key]) - w[key] - math.log(2)))
                    p = share * e + (1 - share) * p
                total += math.log10(p)
                m = 2 * m + bit
        return total

    return score


@pytest.mark.parametrize(("size", "bits", "levels"), [(2000, 8, 1), (lm.SIZE, 8, 1), (1500, 2, 2)])
def test_language_model(spark, prose, size, bits, levels, monkeypatch):
    relays_in_between(monkeypatch, bits, levels)
    monkeypatch.setattr(lm, "SIZE", size)
    texts = [*prose[:30], "Ünseen Ωmega", "", "  ", "a\0b \0", prose[4].replace(" ", "  \n\t"), prose[4]]
    out = {r.doc_id: r for r in lm.weighted_scores(table(spark, texts)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    every = [*texts, ""]
    words = [t.encode().lower().split() for t in every]
    c = Counter(w for i, x in enumerate(words) if not held(i) for w in [*x, None])
    n, v, score = sum(c.values()), len(c), brute_tree(every, held)
    for i, t in enumerate(every):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words[i], None])
        assert out[i].held_out == held(i) and out[i].n_tokens == len(words[i]) + 1 and out[i].train_tokens == n and out[i].n_known == sum(c[w] > 0 for w in [*words[i], None])
        assert out[i].base_score == pytest.approx(base, rel=1e-9) and out[i].score == pytest.approx(score(t), rel=1e-5)
    assert lm.weighted_scores(table(spark, []).limit(0)).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "in", "at", "st", "ea"]) for _ in range(r.randint(1, 3)))
    bad, texts, labels = ["zorkle", "vexmud", "grubbin"], [], []
    for i in range(500):
        w = [word() for _ in range(r.randint(10, 150))]
        if i % 4 == 0:
            for _ in range(max(1, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(bad)
        texts.append(" ".join(w).capitalize() + ".")
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_gradients():
    net = toxicity.Network({b"aa": 3.0, b"bb": -2.0})
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words, index = [b"bbb", b"aa", b"c"], np.array([[0, 1], [1, 2], [0, 0]])
    mask, label, none = np.array([[1, 1], [1, 1], [1.0, 0]]), np.array([1.0, 0.0]), np.zeros(3, dtype=bool)
    loss, g = net.gradients(words, index, mask, label, none)
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(3):
            at = tuple(r.integers(s) for s in v.shape)
            if k == "char":
                at = (ord("a"), at[1])
            old = v[at]
            v[at] = old + 1e-5
            up = net.gradients(words, index, mask, label, none)[0]
            v[at] = old - 1e-5
            down = net.gradients(words, index, mask, label, none)[0]
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=2e-5), k
    assert loss > 0


def plain_forward(net, words):
    """The network's logit of one window, one number at a time."""
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    s = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda v, m: [sum(a * row[j] for a, row in zip(v, m, strict=True)) for j in range(len(m[0]))]

    def states(xs, w, b, u):
        h, out = [0.0] * len(u), []
        n = len(u)
        for x in xs:
            i, g = [a + c for a, c in zip(dot(x, w), b, strict=True)], dot(h, u)
            h = [(1 - (z := s(i[k] + g[k]))) * math.tanh(i[2 * n + k] + s(i[n + k] + g[n + k]) * g[2 * n + k]) + z * h[k] for k in range(n)]
            out.append(h)
        return out

    v = []
    for w in words:
        x = [p["char"][c] for c in w]
        v.append(p["word"][net.known.get(w, 0)] + states(x, p["c_inf"], p["c_bf"], p["c_uf"])[-1] + states(x[::-1], p["c_inb"], p["c_bb"], p["c_ub"])[-1])
    h = [f + b for f, b in zip(states(v, p["inf"], p["bf"], p["uf"]), states(v[::-1], p["inb"], p["bb"], p["ub"])[::-1], strict=True)]
    e = [math.exp(sum(math.tanh(a) * o for a, o in zip(dot(x, p["a_in"]), p["a_out"], strict=True))) for x in h]
    pool = [sum(w * x[k] for w, x in zip(e, h, strict=True)) / sum(e) for k in range(len(p["out"]))]
    return sum(a * b for a, b in zip(pool, p["out"], strict=True)) + p["bias"][0]


def test_scores_are_those_of_a_plain_forward_pass():
    net, r = toxicity.Network({b"idea": 9.0, b"the": -3.0}, seed=8), random.Random(4)
    texts = [" ".join(r.choice(["the", "Idea", "1d10t", "sh!t", "é", "x" * 30, "...", "42"]) for _ in range(n)).encode() for n in (1, 7, 48, 49, 130)]
    for x, got in zip(texts, toxicity.Scorer(net).scores(texts), strict=True):
        words = toxicity.words_of(x)
        windows = [words[a : a + toxicity.WINDOW] for a in toxicity.window_starts(len(words))]
        assert windows[-1][-1] == words[-1]
        assert got == pytest.approx(1 / (1 + math.exp(-max(plain_forward(net, w) for w in windows))), abs=1e-5)


def test_words_hold_all_but_white_space():
    for t in fuzz(500):
        assert b"".join(toxicity.words_of(t.encode())) == b"".join(t.encode().lower().split())
    assert toxicity.words_of(b"You 1d10t, sh!t (#1)") == [b"you", b"1d10t", b",", b"sh!t", b"(#", b"1", b")"]


def test_training_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, 1), (1, None)], "doc_id long, toxic int")
    assert max(toxicity.Scorer(toxicity.train(docs, labels)).scores([b"a b", b""])) < toxicity.THRESHOLD
    assert max(toxicity.Scorer(toxicity.train(docs, labels.limit(0))).scores([b"a b", b""])) < toxicity.THRESHOLD


def test_toxicity(spark, labelled):
    texts, labels = labelled
    net = toxicity.fit([t.encode() for t in texts[:350]], labels[:350])
    unseen = texts[350:]
    df = table(spark, [*unseen, "", "123 !!", "w" * 5000, unseen[0]]).withColumn("score", F.lit("old"))
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(df, net).collect()}
    got, y = np.array([out[i] for i in range(len(unseen))]), labels[350:]
    assert np.mean((got >= toxicity.THRESHOLD) == (y == 1)) > 0.97
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == len(unseen) + 5
    assert out[len(unseen) + 3] == pytest.approx(out[0], abs=1e-4) and out[len(unseen)] < 0.7
    long = " ".join(unseen[i] for i in range(len(unseen)) if y[i] == 0) + " zorkle vexmud grubbin zorkle"
    assert toxicity.Scorer(net).scores([long.encode()])[0] >= toxicity.THRESHOLD
    assert toxicity.score_toxicity(df.limit(0), net).count() == 0


# --- pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as cp
    from quillstone.llm.common import documents

    docs = documents(spark, data)
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = batches.written(stage(spark, docs, data))
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            want = {}
            for d, t in kept.items():
                j = quality.judge((t or "").encode())
                if not j[5] and j[6] <= quality.MAX_LOST * j[1]:
                    want[d] = t
        elif name == "toxicity":
            scores = toxicity.Scorer(toxicity.trained(spark, data)).scores([t.encode() for t in kept.values()])
            want = {d: t for (d, t), s in zip(kept.items(), scores, strict=True) if s < toxicity.THRESHOLD}
        elif name == "ngram_jaccard_join":
            order = sorted(kept)
            classes = brute_classes([kept[d] for d in order])
            want = {d: kept[d] for i, d in enumerate(order) if classes[i][0] == i}
        else:
            repeats = brute_repeats(sorted(kept.items()))
            want = {d: repeats[d][3].decode("utf-8", "ignore") for d in kept}
            assert all(r.n_chars == len(r.text) for r in got.values())
        kept = {d: r.text for d, r in got.items()}
        assert kept == want, name
    packed = cp.STAGES[-1][1](spark, docs, data).collect()
    library = Tokenizer.from_str(tokens.vocabulary_text("byte_bpe_50k.json"))
    own = defaultdict(dict)
    for r in packed:
        own[r.doc_id][r.piece] = r.ids
    assert {d: hashlib.sha256(b"".join(p[k] for k in sorted(p))).digest() for d, p in own.items()} == {d: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids + [2], dtype="<u4").tobytes()).digest() for d, t in kept.items()}


def test_ids_around_control_characters():
    """Marks, letters and control characters in every order give the library's ids, for both vocabularies."""
    rng = np.random.default_rng(8)
    alphabet = [*map(chr, range(0x20)), "\x7f", *".,-<]{'!a$Zé", "ß", "中", "word", "  ", "​", "\xa0", "9"]
    texts = ["-\x01", "hello.\x00world", "<\x1c]"] + ["".join(rng.choice(alphabet, rng.integers(1, 12))) for _ in range(6000)]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        made = tokens.Encoder(tokens.vocabulary_text(name), kind)
        got = made.encode([t.encode() for t in texts])
        want = made.library.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_a_line_of_a_million_words():
    began = time.perf_counter()
    assert quality.line_fails(b" ".join(b"w%d" % (i % 400_000) for i in range(1_000_000)), [b"w%d" % (i % 400_000) for i in range(1_000_000)]) is None
    assert quality.line_fails(b"x " * 1_000_000, [b"x"] * 1_000_000) == "boilerplate"
    assert time.perf_counter() - began < 5


def test_training_takes_whole_texts(spark, monkeypatch):
    """What tells a label may be anywhere in a long text; the bound is one of bytes over all rows."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels.tolist())))
    docs = spark.createDataFrame([(i, f"{i} " + "filler " * 10_000 + "end") for i in range(20)] + [(20, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(22)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert len(seen[0][0]) == 21 and sum(t.endswith(b"end") for t in seen[0][0]) == 20
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 300_000)
    toxicity.train(docs, labels)
    assert 3 <= len(seen[1][0]) <= 5 and all(t == b"" or t.endswith(b"end") for t in seen[1][0])


def test_training_holds_equal_words_once():
    texts = [b"some words that come again " * 20_000] * 12
    tracemalloc.start()
    toxicity.fit(texts, np.zeros(len(texts), dtype=np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, texts))
