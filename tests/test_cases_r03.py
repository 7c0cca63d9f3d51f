"""Cases that were found at larger sizes."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.operators import ranges
from quillstone.operators.cells import CellIndex, dense_many, unit
from quillstone.operators.postings import blocks_of
from quillstone.plans import registry
from quillstone.streaming import machine as M


def sql(name, folder, *tables):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(registry.oracle_sql()[name]).fetchall()


def test_augmented_cut_at_separators(spark, tmp_path):
    """The 2,000th character falls on each place of an entry and its separator."""
    entry = "x" * 92 + " (AB)"  # 97 characters, 99 with the separator
    rows = [(100 * b + n, entry[b:] if n == 0 else entry, f"Brand#{b:02d}") for b in range(74, 84) for n in range(30)]
    spark.createDataFrame([(k, name[:-5], brand, "AB") for k, name, brand in rows], "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part")
    duckdb.sql(f"copy (select * from '{tmp_path}/part/*.parquet') to '{tmp_path}/part.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["augmented_cut"](spark, str(tmp_path)).select("kb_uid", "t").collect())
    want = sorted(sql("augmented_cut", tmp_path, "part"))
    assert got == want and {t[-1] for _, t in got} == {")", ";"}


class Held:
    """A key's state as the machine sees it, with the number of calls that it took."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, schema):
        return HeldPart(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class HeldPart:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def __getattr__(self, call):
        def made(*given):
            values = self.held.values
            self.held.calls += 1
            if call == "get":
                return values.get(self.name) if self.name == "memory" else iter(values.get(self.name, []))
            if call == "appendValue":
                values.setdefault(self.name, []).append(*given)
            elif call in ("update", "put"):
                values[self.name] = given[0]
            elif call == "clear":
                values.pop(self.name, None)
            elif call == "exists":
                return self.name in values

        return made


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_calls_of_a_keys_state():
    """They don't grow with its events: those of a batch wait in blocks, with one timer."""
    held, machine = Held(), M.StatusMachine()
    machine.init(held)
    events = [Row(at=1000 * n, id=n, value=M.TERMINAL[n % 2]) for n in range(1, 3001)]
    assert not list(machine.handleInputRows((7,), iter(events[::-1] + events[:100]), At(0)))
    assert held.timers == {1000} and held.calls < 10
    first = list(machine.handleExpiredTimer((7,), At(2_000_500), None))
    assert [r["at"] for r in first] == [1000 * n for n in range(1, 2001)] and 2_001_000 in held.timers
    rest = list(machine.handleExpiredTimer((7,), At(9_000_000), None))
    assert [r["at"] for r in rest] == [1000 * n for n in range(2001, 3001)] and held.calls < 25


def test_blocks_are_made_where_their_rows_are_read():
    """A range's blocks need no shuffle, however its rows are dealt to batches."""
    texts = {1: (0, "a b a"), 2: (0, ""), 5: (0, "c a"), 7: (1, "b"), 8: (1, "b b d"), 9: (4, "a")}
    rows = [{"range": r, "id": i, "dl": len(t.split()), "terms": t.split()} for i, (r, t) in texts.items()]
    kind = pa.schema([("range", pa.int64()), ("id", pa.int64()), ("dl", pa.int32()), ("terms", pa.list_(pa.string()))])
    for size in (1, 2, 3, 6):
        batches = [pa.RecordBatch.from_pylist(rows[a : a + size], kind) for a in range(0, len(rows), size)]
        got = [x for b in blocks_of(iter(batches)) for x in b.to_pylist()]
        want = {(t, r) for r, text in texts.values() for t in text.split()}
        assert len(got) == len(want) and {(x["term"], x["range"]) for x in got} == want
        for x in got:
            held = [{"id": i, "tf": t.split().count(x["term"]), "dl": len(t.split())} for i, (r, t) in texts.items() if r == x["range"] and x["term"] in t.split()]
            assert (x["held"], x["n"], x["most"], x["least"]) == (held, len(held), max(h["tf"] for h in held), min(h["dl"] for h in held))


def test_cells_are_written_and_scored_in_blocks(spark, tmp_path, monkeypatch):
    """A small cell is one file, a large one several; a task hands on the best of each query, and a vector's length is computed once."""
    monkeypatch.setattr("quillstone.operators.cells.FILE_ROWS", 300)
    rng = np.random.default_rng(4)
    centres = 4 * rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20 if i < 800 else 0] + (0.1 * rng.normal(size=8) if i < 800 else 0)).tolist()) for i in range(2400)]
    df = spark.createDataFrame(rows, "uid long, embedding array<double>")
    assert df.select(unit(F.col("embedding")).alias("u"))._jdf.queryExecution().analyzed().toString().count("zip_with") == 1
    index = CellIndex(spark, str(tmp_path))
    index.build(df, 5)
    found = {r["cell"]: (r["n"], r["files"]) for r in index.rows().select("cell", F.input_file_name().alias("file")).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect()}
    assert sum(n for n, _ in found.values()) == 2400 and {f for n, f in found.values() if n <= 100} == {1} and all(f > 1 for n, f in found.values() if n > 1000)
    asked = df.where("uid % 300 = 7").select(F.col("uid").alias("query_id"), F.col("embedding").alias("vector"))
    got = index.exact(asked, 5)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and sorted(map(tuple, got.collect())) == sorted(map(tuple, dense_many(df, asked, 5).collect()))
    assert index.search(asked.select("query_id", F.slice("vector", 1, 3).alias("vector")), 5).count() == 0  # of another dimension
    named = asked.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    assert index.exact(named, 2500).groupBy("query_id").count().select("count").distinct().collect() == [Row(count=2400)]


def test_pages_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Documents stay where they are while ranges of them are asked for, and only the answers that are kept are written with their texts."""
    held = []
    made = ranges._written
    monkeypatch.setattr(ranges, "_written", lambda df: held.append((df, made(df))) or held[-1][1])
    lines = ["\n".join(f"line {i} of {d}" for i in range(n)) for d, n in enumerate((1, 2, 5, 16, 17, 70))]
    spark.createDataFrame([(d, t) for d, t in enumerate(lines)] + [(9, None), (10, ""), (11, "a\nb"), (11, "c\nd\ne")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    duckdb.sql(f"copy (select * from '{tmp_path}/documents/*.parquet') to '{tmp_path}/documents.parquet'")
    got = sorted(tuple(r) for r in registry.queries()["missing_page_bisection"](spark, str(tmp_path)).collect())
    want = sorted(sql("missing_page_bisection", tmp_path, "documents"))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r for r in got if r[0] != 11] == [r for r in want if r[0] != 11]
    assert len(held) > 4
    for df, table in held:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and plan.count("Exchange hashpartitioning") <= 1
        assert table.where("again and text is not null").isEmpty()
