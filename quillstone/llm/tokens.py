"""Exact token ids of whole texts by the tokenizers library, with a bounded memo of white-space delimited chunks.

A chunk is a stretch whose ids do not depend on its surroundings, so the ids of a text are those of its chunks,
one after the other. Each distinct chunk is encoded by the library once and remembered; where a text breaks the
conditions (other white space, a special token's string), the library gets the text itself.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

from quillstone.llm.common import groups

#: Entries that a worker remembers, and the groups of texts after which a full memo starts anew.
MEMO, STALE = 700_000, 256
#: Longer chunks are not remembered.
LONGEST = 64
#: Chunks that the library is given at once: few results of it are held together.
AT_ONCE = 512
#: White space outside ASCII, in UTF-8.
OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"
MARK, FIRST_MARK = rb"[!-/:-@\[-`{-~]", rb"[!-&(-/:-@\[-`{-~]"
#: Control characters and bytes beyond ASCII prolong a run of marks.
MARKS_END = rb"(?![\x00-\x08\x0e-\x1f\x7f-\xff])"
#: A run of Latin letters, a run of ASCII marks, or else all up to white space, each with the space before it; white
#: space without the space that belongs to the next word. A run ends where other bytes could not prolong it.
CHUNK = re.compile(rb" ?" + LETTERS + rb"|(?: " + MARK + rb"|" + FIRST_MARK + rb")" + MARK + rb"*+" + MARKS_END + rb"| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
WORD_CHUNK = re.compile(LETTERS + rb"|" + FIRST_MARK + MARK + rb"*+" + MARKS_END + rb"|[^ \t-\r]+")


def byte_level_chunks(text: bytes, specials: tuple[bytes, ...]) -> list[bytes] | None:
    """Chunks for a byte-level pre-tokenizer that lets one space lead a word; None if the text must be taken whole."""
    if any(s in text for s in specials) or (not text.isascii() and OTHER_SPACE.search(text)):
        return None
    return CHUNK.findall(text)


def word_chunks(text: bytes, specials: tuple[bytes, ...]) -> list[bytes] | None:
    """Chunks for a tokenizer that ignores case and white space; None if the text must be taken whole."""
    lower = text.lower()
    return None if any(s in lower for s in specials) else WORD_CHUNK.findall(lower)


class Encoder:
    """Texts to ids. vocabulary: the JSON text of a tokenizer; kind: "byte" or "word" chunks."""

    def __init__(self, vocabulary: str, kind: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.largest = max(self.library.get_vocab().values())
        self.specials = tuple(t.content.encode() for t in self.library.get_added_tokens_decoder().values())
        self.chunks = byte_level_chunks if kind == "byte" else word_chunks
        self.memo: dict[bytes, bytes] = {}
        self.full = 0

    def library_ids(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), AT_ONCE):
            found = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in texts[i : i + AT_ONCE]], add_special_tokens=False)
            out += [array("I", x.ids).tobytes() for x in found]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in groups(texts):
            cut = [self.chunks(x, self.specials) for x in texts[a:b]]
            self.full += len(self.memo) > MEMO
            if self.full > STALE:
                self.memo.clear()
                self.full = 0
            missing = set().union(*(x for x in cut if x)).difference(self.memo)
            # every chunk of the group must be found; the long ones are forgotten afterwards
            if missing := list(missing):
                self.memo.update(zip(missing, self.library_ids(missing), strict=True))
            whole = iter(self.library_ids([x for x, c in zip(texts[a:b], cut, strict=True) if c is None]))
            get = self.memo.__getitem__
            out += [next(whole) if c is None else b"".join(map(get, c)) for c in cut]
            for x in missing:
                if self.full or len(x) > LONGEST:
                    del self.memo[x]
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(vocabulary: str, kind: str) -> Encoder:
    """A worker keeps one encoder for each vocabulary."""
    key = (hash(vocabulary), kind)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, kind)
    return _encoders[key]


def vocabulary_text(name: str) -> str:
    """A public tokenizer's file; name is a file name in the installed folder or a path."""
    import public_tokenizers

    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()
