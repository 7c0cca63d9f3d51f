"""A filter language for listings, compiled to a Column.

    expression = sequence {AND sequence};  sequence = term {OR term} is evaluated before AND, as the public grammar has it
    term = [NOT | -] (restriction | "(" expression ")");  restriction = name (= != < <= > >= :) value

Names are a table's own in camelCase or snake_case; `a.b` reads field b of the JSON text in a.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.trigram import similarity, word_similarity

TOKEN = re.compile(r"\s*(?:(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<op><=|>=|!=|=|<|>|:)|(?P<mark>[()-])|(?P<time>timestamp\s*\(\s*\"[^\"]*\"\s*\))|(?P<word>[^\s()=<>!:\"']+))")
#: Least similarities for `q`.
WORD_LIKE, ID_LIKE = 0.3, 0.2


class FilterError(ValueError):
    pass


@dataclass
class Filter:
    """columns: names that may be used, and their kind: string, number, bool, time, array, json."""

    columns: dict[str, str] = field(default_factory=dict)

    def compile(self, text: str) -> Column | None:
        """None for an empty filter."""
        self.tokens = self._tokens(text)
        self.at = 0
        if not self.tokens:
            return None
        out = self._and()
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _tokens(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise FilterError(f"can't read {text[at:]!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return out

    def _peek(self, word: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "mark") and self.tokens[self.at][1] == word

    def _take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FilterError("the filter ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _and(self) -> Column:
        out = self._or()
        while self._peek("AND"):
            self._take()
            out = out & self._or()
        return out

    def _or(self) -> Column:
        out = self._term()
        while self._peek("OR"):
            self._take()
            out = out | self._term()
        return out

    def _term(self) -> Column:
        if self._peek("NOT") or self._peek("-"):
            self._take()
            return ~self._term()
        if self._peek("("):
            self._take()
            out = self._and()
            if self._take()[1] != ")":
                raise FilterError("a parenthesis isn't closed")
            return out
        kind, name = self._take()
        op_kind, op = self._take()
        if kind != "word" or op_kind != "op":
            raise FilterError(f"{name!r} isn't followed by an operator")
        return self._restriction(name, op, *self._take())

    def _restriction(self, name: str, op: str, kind: str, raw: str) -> Column:
        top, _, rest = re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: f"_{m[1].lower()}", name).partition(".")
        if top not in self.columns and top != "q":
            raise FilterError(f"unknown name {name!r}")
        value = self._value(kind, raw)
        if top == "q":
            return self._fuzzy(raw.strip("\"'"))
        column = F.get_json_object(top, f"$.{rest}") if rest else F.col(top)
        if self.columns[top] == "array":
            if op not in (":", "=", "!="):
                raise FilterError(f"{op} isn't defined for {name}")
            held = F.array_contains(column, value)
            return ~held if op == "!=" else held
        if op == ":":
            raise FilterError(f"{name} isn't repeated")
        if top == "id" and op == "=" and not rest:
            plain = raw.strip("\"'")
            uid_like = len(plain) == 36 and all(plain[i] == "-" for i in (8, 13, 18, 23))
            other = F.col("uid") == value if uid_like else F.array_contains("aliases", value)
            return (column == value) | other
        return {"=": column.__eq__, "!=": column.__ne__, "<": column.__lt__, "<=": column.__le__, ">": column.__gt__, ">=": column.__ge__}[op](value)

    def _value(self, kind: str, raw: str) -> Column:
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", raw[1:-1]))
        if kind == "time":
            return F.to_timestamp(F.lit(re.search(r"\"([^\"]*)\"", raw)[1]))
        if kind != "word":
            raise FilterError(f"{raw!r} isn't a value")
        if raw in ("true", "false"):
            return F.lit(raw == "true")
        if re.fullmatch(r"-?\d+", raw):
            return F.lit(int(raw))
        if re.fullmatch(r"-?\d*\.\d+(?:[eE][+-]?\d+)?", raw):
            return F.lit(float(raw))
        return F.lit(raw)

    def _fuzzy(self, text: str) -> Column:
        """Alike in a stretch of the name, in the id, or part of name, id or description; % and _ stand for themselves."""
        low = text.lower()
        parts = [word_similarity(low, F.col("display_name")) >= WORD_LIKE, F.contains(F.lower("display_name"), F.lit(low)), similarity(F.col("id"), F.lit(low)) > ID_LIKE, F.contains("id", F.lit(text))]
        if "description" in self.columns:
            parts.append(F.contains("description", F.lit(text)))
        out = parts[0]
        for p in parts[1:]:
            out = out | F.coalesce(p, F.lit(False))
        return out


@dataclass(frozen=True)
class Clause:
    """A way to be permitted: all of its conditions that are given hold."""

    tags_overlap: tuple[str, ...] = ()
    uids: tuple[str, ...] = ()
    tags_like_none: tuple[str, ...] = ()
    visibility: tuple[str, ...] = ()

    def column(self) -> Column | None:
        parts = []
        if self.tags_overlap:
            parts.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags_overlap))), F.lit(False)))
        if self.uids:
            parts.append(F.col("uid").isin(*self.uids))
        for p in self.tags_like_none:  # without tags none is like the pattern
            parts.append(~F.coalesce(F.exists("tags", _like(p)), F.lit(False)))
        if self.visibility:
            parts.append(F.col("visibility").isin(*self.visibility))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def _like(pattern: str):
    return lambda t: t.like(pattern)


def permitted(clauses: list[Clause] | None) -> Column | None:
    """Any clause; None, no clauses or empty ones only: no restriction."""
    out = None
    for c in clauses or []:
        if (p := c.column()) is not None:
            out = p if out is None else out | p
    return out
