"""Byte-pair encoding and decoding.

Encoding is a dynamic program over the prefixes of each pre-token. An automaton over the vocabulary reports, for
every prefix, the tokens that are its suffixes, longest first. The encoding of a prefix ends in exactly one token:
the suffix match that is compatible with the last token of the prefix before it. Compatible means that merging the
bytes of both in order of rank never merges across their boundary. Following the stored tokens back from the end
gives the ids, the same as by merging pairs, in linear time whatever the length of the pre-token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import as_bytes, groups, int_lists, mapped, slices, without
from quillstone.llm.tokens import LONGEST, STALE, byte_level_chunks, vocabulary_text

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The public pre-tokenizer pattern, with white space spelled out.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pre-token chunks and tested pairs that a worker remembers.
MEMO, PAIRS = 250_000, 300_000


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE vocabulary (the JSON text of a tokenizer)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        to_byte = printable_bytes()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in added.items()}
        self.splits = regex.compile(b"(" + b"|".join(regex.escape(k) for k in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in added} | {v: k for k, v in self.special.items()}
        self.size = {i: len(x) for i, x in self.bytes_of.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.bytes_of}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for i, x in self.bytes_of.items():
            if i in self.parts or len(x) == 1:
                self.automaton.add_word(x.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, bytes] = {}
        self.full = 0

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves the tokens a and b.

        At each moment the boundary lies between a token of a's right edge and one of b's left edge. Going back in
        time, the later of the two merges is undone; their pair must not have been merged before that: not earlier
        than the left one, nor at the same rank or earlier than the right one (equal pairs merge from the left).
        """
        left, right = self.rank[a], self.rank[b]
        until_left = until_right = 1 << 60
        while True:
            crossing = self.merge.get((a, b))
            if crossing is not None and crossing < until_left and crossing <= until_right:
                return False
            if left < 0 and right < 0:
                return True
            if left > right:
                until_left, a = left, self.parts[a][1]
                left = self.rank[a]
            else:
                until_right, b = right, self.parts[b][0]
                right = self.rank[b]

    def piece(self, x: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[int] = [-1] * (len(x) + 1)
        pairs, size = self.pairs, self.size
        for end, token in self.automaton.iter(x.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            if start:
                key = (last[start], token)
                if (ok := pairs.get(key)) is None:
                    if len(pairs) > PAIRS:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(*key)
                if not ok:
                    continue
            last[end] = token
        ids, at = [], len(x)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def stretch(self, x: bytes) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit integers."""
        ids: list[int] = []
        for p in PRE_TOKEN.findall(x.decode("utf-8", "replace")):
            ids += self.piece(p.encode())
        return np.array(ids, dtype="<i4").tobytes()

    def _whole(self, x: bytes) -> bytes:
        parts = self.splits.split(x) if self.splits else [x]
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.stretch(p) for p in parts)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        memo, get, out = self.memo, self.memo.get, []
        for a, b in groups(texts):
            self.full += len(memo) > MEMO
            if self.full > STALE:
                memo.clear()
                self.full = 0
            for x in texts[a:b]:
                if (chunks := byte_level_chunks(x, tuple(self.special))) is None:
                    out.append(self._whole(x))
                    continue
                found = list(map(get, chunks))
                if None in found:
                    for i, c in enumerate(chunks):
                        if found[i] is None:
                            found[i] = ids = get(c) or self.stretch(c)
                            if len(c) <= LONGEST and not self.full:
                                memo[c] = ids
                out.append(b"".join(found))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[int, PrefixBpe] = {}


def _model(vocabulary: str) -> PrefixBpe:
    key = hash(vocabulary)
    if key not in _made:
        _made[key] = PrefixBpe(vocabulary)
    return _made[key]


def _texts(model: PrefixBpe, ids: pa.ListArray) -> pa.Array:
    """The text that each row's ids stand for; null ids give the empty text."""
    get, values = model.bytes_of.__getitem__, ids.values.to_numpy(zero_copy_only=False)
    offsets = ids.offsets.to_numpy().tolist()
    return pa.array([b"".join(map(get, values[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def bpe_encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df's columns other than text, and ids (array<int>): the exact token ids of each whole text.

    vocabulary: name or path of a byte-level tokenizer file. A special token's string becomes its id. A null or
    empty text has no ids; equal texts have equal ids; other columns pass, but a column named as ids is replaced.
    decoded: a column for the text decoded from those ids, as bpe_decode gives it, without another pass of Python
    workers; a column of that name is replaced, and ids and decoded have to differ. Rows are independent, nothing is
    shuffled, and what a worker remembers is bounded.
    """
    if decoded is not None and decoded.lower() == ids.lower():
        raise ValueError("ids and decoded name the same column")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded is not None else [])
    gone = {f.name.lower() for f in new} - {text.lower()}
    rest = without(df, *gone)
    at = rest.columns.index(text)
    schema = T.StructType([f for i, f in enumerate(rest.schema.fields) if i != at] + new)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = int_lists(model.encode(as_bytes(batch.column(at))))
            made = [found, _texts(model, found)] if decoded is not None else [found]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *made], names=schema.names)

    return mapped(rest, encode, schema)


def bpe_decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", ids: str = "ids", text: str = "text") -> DataFrame:
    """df and text (string): the whole text that the ids stand for, special tokens included.

    Null ids or none give the empty text; bytes that are no UTF-8 become U+FFFD; an id that the vocabulary lacks is
    an error. A column named as text is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    rest = without(df, text)
    schema = T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())])
    at = rest.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(model, batch.column(at))], names=schema.names)

    return mapped(rest, decode, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import documents, whole_texts

    done = bpe_encode(whole_texts(documents(spark, sf_dir)), decoded="text")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
