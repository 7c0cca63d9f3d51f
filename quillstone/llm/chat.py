"""Chat formatting in DataFrame functions only.

Rows of any prompt, instruction or message layout become canonical turns: array<struct<role, text>>. The nested field
paths of a layout, sorted and hashed, are its fingerprint, and the fingerprint selects a declarative mapping. Turns
are then written in a template whose control strings cannot occur inside texts, because they are escaped there in a
way that can be undone; the output can be read back to the turns and to the text under the loss mask.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import column

TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a schema's leaves, as `messages[].content`, in order."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip(".")))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Fields whose empty text means that they aren't there.
OPTIONAL = ("input", "context")


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns. single: (role, field) pairs in order; array: (field, role field, text field)."""

    single: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        return [f for _, f in self.single] + ([f"{self.array[0]}[].{x}" for x in self.array[1:]] if self.array else [])

    def turns(self, field) -> Column:
        alone = []
        for role, f in self.single:
            given = field(f).isNotNull()
            if role == "system" or f in OPTIONAL:
                given = given & (field(f) != "")
            alone.append(F.when(given, F.array(turn(F.lit(role), field(f)))).otherwise(F.array().cast(TURNS)))
        many = []
        if self.array:
            name, role, text = self.array
            many = [F.coalesce(F.transform(F.filter(field(name), lambda m: m.isNotNull()), lambda m: turn(m[role], m[text])), F.array().cast(TURNS))]
        return functools.reduce(lambda a, b: F.concat(a, b), [*alone, *many])


#: Other names of the four canonical roles.
ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "developer": "system", "function": "tool", "observation": "tool"}
LAYOUTS = tuple(
    [Mapping(single=(("user", p), ("assistant", a))) for p, a in (("prompt", "response"), ("prompt", "completion"), ("prompt", "chosen"), ("question", "answer"), ("input", "output"), ("instruction", "response"), ("instruction", "output"), ("query", "response"))]
    + [Mapping(single=(("system", s), ("user", p), ("assistant", a))) for s, p, a in (("system", "prompt", "response"), ("system_prompt", "question", "response"), ("system", "question", "answer"), ("system", "instruction", "output"))]
    + [Mapping(single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))), Mapping(single=(("user", "instruction"), ("user", "input"), ("assistant", "response"))), Mapping(single=(("user", "instruction"), ("user", "context"), ("assistant", "response")))]
    + [Mapping(array=(m, r, t)) for m in ("messages", "conversations", "conversation", "turns", "dialog") for r, t in (("role", "content"), ("from", "value"), ("role", "text"), ("speaker", "text"))]
    + [Mapping(single=(("system", "system"),), array=(m, r, t)) for m in ("messages", "conversations") for r, t in (("role", "content"), ("from", "value"))]
)
BY_FINGERPRINT = {fingerprint(m.paths): m for m in LAYOUTS}


def turn(role: Column, text: Column) -> Column:
    """A canonical turn: known names of a role become one; null role: user; null text: empty."""
    known = F.replace(F.lower(F.trim(role)), F.lit("\n"), F.lit(" "))
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.struct(F.coalesce(names[known], F.nullif(known, F.lit("")), F.lit("user")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).cast("struct<role:string,text:string>")


def canonical_turns(df: DataFrame, ignore: tuple[str, ...] = (), turns: str = "turns") -> DataFrame:
    """df and its canonical turns; the layout is that of df's columns other than those in ignore.

    Columns of no mapping's layout must be named in ignore; a layout that no mapping knows is an error that gives its
    paths and fingerprint. A null field gives no turn, a null message none, a null text the empty one; in layouts of
    an instruction and an input an empty input or system text gives no turn. A row without turns has an empty array.
    """
    kind = T.StructType([f for f in df.schema.fields if f.name not in (*ignore, turns)])
    print_ = fingerprint(field_paths(kind))
    if print_ not in BY_FINGERPRINT:
        raise ValueError(f"no mapping for fingerprint {print_}: {field_paths(kind)}")
    return df.withColumn(turns, BY_FINGERPRINT[print_].turns(lambda f: F.col(f"`{f}`")))


def canonical_json(df: DataFrame, record: str, turns: str = "turns") -> DataFrame:
    """df and the canonical turns of a JSON record in a column, whose layout may differ from row to row.

    Each record's own paths are fingerprinted: its fields, and the fields of all of its messages together, of which
    those that no mapping reads (an id, a name) are left out. A record with no message has the mapping's other turns,
    or none. Null, malformed or unknown records have null turns; other columns pass, one named as turns is replaced.
    """
    top = F.json_object_keys(column(record))
    arrays = sorted({m.array[0] for m in LAYOUTS if m.array})
    known = sorted({x for m in LAYOUTS if m.array for x in m.array[1:]})
    messages = lambda name: F.from_json(F.get_json_object(column(record), f"$.{name}"), "array<map<string,string>>")

    def inner(name: str) -> Column:
        fields = F.array_distinct(F.flatten(F.transform(F.filter(messages(name), lambda m: m.isNotNull()), lambda m: F.map_keys(m))))
        read = F.filter(fields, lambda f: f.isin(*known))
        usual = F.array(*(F.lit(x) for x in ("role", "content")))  # of a layout without messages any fields will do
        return F.when(F.size(messages(name)) == 0, usual).otherwise(read)

    paths_of = lambda name: F.when(F.array_contains(top, name), F.transform(inner(name), lambda f: F.concat(F.lit(f"{name}[]."), f))).otherwise(F.array().cast("array<string>"))
    leaves = F.filter(top, lambda k: ~k.isin(*arrays))
    paths = F.array_sort(F.concat(leaves, *(F.coalesce(paths_of(a), F.array().cast("array<string>")) for a in arrays)))
    print_ = F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)
    out = F.lit(None).cast(TURNS)
    for key, m in BY_FINGERPRINT.items():
        fields = {f: "string" for _, f in m.single} | ({m.array[0]: f"array<struct<{m.array[1]}:string,{m.array[2]}:string>>"} if m.array else {})
        read = F.from_json(column(record), ", ".join(f"`{k}` {v}" for k, v in fields.items()))
        out = F.when(F.col("fingerprint_") == key, m.turns(lambda f, read=read: read[f])).otherwise(out)
    return df.withColumn("fingerprint_", print_).withColumn(turns, out).drop("fingerprint_")


#: The template's marks; texts can't hold them, as a backslash follows every `<`, `[` and backslash of a text.
OPEN, CLOSE = "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    """A backslash goes after every character that a control string can begin with, and after itself, so that none stays whole."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_turns(turns: Column) -> Column:
    """One string: for each turn `<|turn|>role`, a line feed, the escaped text, `<|end|>` and a line feed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(f"{CLOSE}\n"))), "")


def read_turns(formatted: Column) -> Column:
    """The turns back from format_turns: a control string occurs only where a turn begins or ends."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n(?=<\|turn\|>|$)"), lambda x: x != "")
    body = lambda x: F.substring(x, len(OPEN) + 1, F.length(x))
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(body(x), "\n", 1)).alias("role"), unescape(F.substring(body(x), F.length(F.substring_index(body(x), "\n", 1)) + F.lit(2), F.length(x))).alias("text")))


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, end>>: code points (from 0, end excluded) of the assistant's escaped texts in the string."""
    parts = F.split(formatted, r"(?<=<\|end\|>\n)(?=<\|turn\|>|$)")
    head = f"{OPEN}assistant\n"
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x)).alias("at"),
        F.when(x.startswith(head), F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(head)).alias("start"), (acc["at"] + F.length(x) - (len(CLOSE) + 1)).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(parts, none, step, lambda acc: acc["spans"])


def format_conversations(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """df, its canonical turns, formatted (string) and loss (array of spans), by any layout that a mapping knows.

    Columns of those names are replaced, others named in ignore pass; an empty table gives no rows; equal rows give
    equal ones. A conversation is one row, so that it has to fit into a task's memory.
    """
    return canonical_turns(df, ignore).withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss", loss_spans(F.col("formatted")))


def gathered(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation with messages in order of their turn; ties in order of role and text.

    A null role is the user's, a null text empty, a null turn comes first; a null key is a conversation of its own;
    other columns are dropped; an empty table gives no rows.
    """
    message = F.struct(F.col(order).alias("at"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(message)).alias("held"))
    return held.select(key, F.transform("held", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def op3(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_conversations(gathered(rows.unionByName(extra)), ignore=("conv_id",))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("learned"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), named AS (
  SELECT conv_id, turn, role AS raw, text,
    CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'question' THEN 'user' WHEN 'gpt' THEN 'assistant'
      WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'chatbot' THEN 'assistant' WHEN 'developer' THEN 'system'
      WHEN 'function' THEN 'tool' WHEN 'observation' THEN 'tool' WHEN '' THEN 'user' ELSE lower(trim(role)) END AS role
  FROM rows_
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, raw, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, raw, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(regexp_replace(role, '([<\[\\])', '\\\1', 'g')) + length(regexp_replace(text, '([<\[\\])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM named GROUP BY conv_id
"""
