"""The library's functions for SQL, under names that begin with quill_."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Functions that are expressions of SQL: arguments, result and body.
EXPRESSIONS = {
    "quill_tokens": ("t STRING", "BIGINT", "octet_length(t) div 4"),
    "quill_slug": ("t STRING", "STRING", r"lower(regexp_replace(regexp_replace(regexp_replace(t, '[^a-zA-Z0-9\\s-]', ''), '\\s+', '-'), '-+', '-'))"),
}


class Chunks:
    """Rows n, text: parts of a text of at most so many bytes (four at least), ended after the last line break that fits.

    It runs row by row in Python, for SQL; in DataFrames use functions.text.split_text, its twin of built-in functions.
    """

    def eval(self, text: str, most: int = 60_000):
        raw, n, most = (text or "").encode(), 0, max(most, 4)
        while n == 0 or raw:
            end = len(raw)
            if end > most:
                end = most
                while raw[end] & 0xC0 == 0x80:
                    end -= 1
                if (at := raw.rfind(b"\n", 0, end)) > 0:
                    end = at + 1
            n += 1
            yield n, raw[:end].decode()
            raw = raw[end:]


def register(spark: SparkSession) -> None:
    for name, (takes, gives, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udtf.register("quill_chunks", udtf(Chunks, returnType="n int, text string"))
