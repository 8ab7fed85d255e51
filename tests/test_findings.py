"""Cases of the third round's findings."""

import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import compress, config
from driftline.operators import filters, gaps, reassembly
from driftline.plans import catalog
from driftline.sources import readers


def test_broken_frames_are_never_sound(spark, tmp_path):
    """Documents whose id has the checksum of the same id with another last character."""
    ids = [197812, 289447, 667422, 2, 7]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["parse_errors"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("bad checksum", 5)]


def peak_of(f) -> int:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_streams_are_split_in_slices():
    """A batch of 64 MB is split with few of its rows as objects at a time, and its frames come in small batches."""
    frame = b"\x06\0\1\0\1\0\1a0000\x7d\0" + b"x" * 32_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([frame * 4] * 500, pa.binary())], ["id", "stream"])
    split = {}

    class Frames:
        columns, schema = ["id", "stream"], T.StructType([T.StructField("id", T.LongType()), T.StructField("stream", T.BinaryType())])

        def mapInArrow(self, run, schema):
            split["run"] = run

    readers.stream_frames(Frames())
    got = []
    assert peak_of(lambda: got.extend((x.num_rows, x.nbytes) for x in split["run"](iter([batch])))) < 16 << 20
    assert sum(n for n, _ in got) == 2000 and max(size for _, size in got) < 4 << 20


def test_gzip_in_slices(spark):
    """Many batches of one task come back in order, with nulls and errors in their places."""
    rows = spark.range(0, 9000, 1, 2).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.col("id").cast("string"), 200)).cast("binary").alias("value"))
    zipped = rows.withColumn("z", F.when(F.col("id") % 11 == 0, F.lit("junk").cast("binary")).otherwise(compress.gzip("value")))
    back = zipped.withColumn("u", compress.gunzip(F.col("z")))
    good = (F.col("u.value").eqNullSafe(F.col("value"))) & F.col("u.error").eqNullSafe(F.when(F.col("value").isNull(), "empty input"))
    assert back.filter("id % 11 <> 0").filter(~good).isEmpty()
    assert back.filter("id % 11 = 0 AND (u.value IS NOT NULL OR u.error IS NULL)").isEmpty() and back.count() == 9000


def test_gzip_holds_one_slice():
    batch = pa.array([bytes([k % 251]) * 32_000 for k in range(2000)], pa.binary())
    got = []
    assert peak_of(lambda: got.extend(map(len, compress.gzip.func(iter([batch]))))) < 16 << 20
    assert sum(got) == 2000 and len(got) > 50


@pytest.mark.parametrize("pattern,part", [(r"[\w.]+@[\w-]+", "@"), (r"a\.b+c", "a.b"), ("x{,2}", "x{,2}"), ("ab?!", "!"), ("a@|b", ""), ("(?i)x@", ""), ("(x@)?y-z", "y-z"), ("@{0}", ""), (r"\bé", "é"), ("the", "the")])
def test_what_a_rule_needs(pattern, part):
    assert config.needed(pattern) == part


def test_rules_on_odd_texts_as_re2(spark):
    """The patterns of cheaper form against DuckDB, whose engine is RE2."""
    rng = random.Random(2)
    signs = [*"aAkKsS zZ09_-.\n\r\t\v\féÉ ſKß@!&x1αλ", "THE", "\n\n", "a@b.co"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(1500)]
    patterns = [r"(?i)\bTHE\b", r"(?i)\w{3}", r"(?i)[^\w]{2}", r"(?i)\W\W", r"[^[:^digit:]a]{2}", "(?m)^$", "(?m)^a", "(?m)[a-z]$", r"\B-", r"[\W\d]{3}", r"[^\Wa]{3}", "(?i)[^k]{2}s", r"[^\s\w]\z", r"\bé", r"(\pL+)@", r"a+b?1?\."]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(*[filters.found(F.col("text"), p) for p in patterns])
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS text", [texts])
    for p, ours in zip(patterns, zip(*rows.collect())):
        theirs = con.execute("SELECT text, regexp_matches(text, ?) FROM t", [p]).fetchall()
        assert sorted(zip(texts, ours)) == sorted(theirs), p


def test_reports_are_states_of_windows(spark):
    """A window that keeps its gap for 100,000 ticks is one report, with as many ticks."""
    rows = [("t", 0, 0, 3, 5, None), ("t", 0, 0, 4, 25, None), ("t", 0, 0, 0, 45, None)]
    marked = spark.createDataFrame(rows, "topic string, part int, win long, off long, arrival long, died long")
    reports = gaps.reports(marked, 10, spark.range(99_999, 100_000).select(F.col("id").alias("last")))
    assert sorted((r.since, r.until, r.gaps) for r in reports.collect()) == [(0, 1, [[0, 2]]), (2, 3, [[0, 2]]), (4, 99_999, [[1, 2]])]
    assert gaps.each_tick(reports).count() == 100_000


def test_reassembly_parses_a_frame_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(id):
        seen.add(1)
        return id

    rows = [(f"m{k % 3}", 6, p, 2, bytearray(b"x"), 10 * k + p) for k in range(9) for p in (1, 2)]
    parsed = spark.createDataFrame(rows, "id string, type int, part_no int, n_parts int, payload binary, arrival long")
    got = reassembly.messages(parsed.select(counted("id").alias("id"), "type", "part_no", "n_parts", "payload", "arrival", F.lit(None).cast("string").alias("error")), 1000)
    assert got.count() == 9 and seen.value == len(rows)


PARSED = "id string, type int, part_no int, n_parts int, payload binary, arrival long, error string"


def test_payloads_are_shuffled_once(spark):
    """By hash of the id; the other shuffle has fragments without payloads."""
    rows = [(f"m{k % 3}", 6, p, 2, bytearray(b"x"), 10 * k + p, None) for k in range(9) for p in (1, 2)]
    plan = reassembly.messages(spark.createDataFrame(rows, PARSED), 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange") == 2


def test_each_delivery_has_its_own_part_count(spark):
    """A message that comes again in more parts, and one of which a part comes twice; the type is that of the frame that completes it."""
    rows = [("a", 6, 1, 2, b"x", 1), ("a", 7, 2, 2, b"y", 2), ("a", 6, 3, 3, b"", 3), ("a", 8, 1, 3, b"p", 4), ("a", 6, 1, 3, b"q", 5), ("a", 9, 2, 3, b"\xff\x00", 6), ("b", 6, 2, 2, b"z", 7)]
    df = spark.createDataFrame([(i, t, p, n, bytearray(v), a, None) for i, t, p, n, v, a in rows], PARSED)
    for most in (None, 1, 9):
        got = reassembly.messages(df.repartition(3), 100, most).collect()
        assert sorted((r.id, r.epoch, r.type, bytes(r.value)) for r in got) == [("a", 2, 7, b"xy"), ("a", 6, 9, b"q\xff\x00")]


@pytest.mark.parametrize("block", [1, 7, 50, 1 << 20])
def test_stretches_and_open_entries_across_blocks(spark, block):
    rng, at = random.Random(block), sorted(random.Random(3).sample(range(-300, 3000), 300))
    want, now = {}, None
    for before, a in zip([None, *at], at):
        now = a if before is None or a - before > 12 else now
        want[a] = now
    rows = spark.createDataFrame([(a,) for a in at], "arrival long").repartition(5)
    assert {r.arrival: r.stretch for r in reassembly.stretches(rows, 12, block).collect()} == want
    lives = [(a, a + rng.randrange(1, 40)) for a in at]
    got = reassembly.open_entries(spark.createDataFrame(lives, "begun long, ends long"), block).collect()
    assert {r.begun: r.open for r in got} == {a: sum(b < a <= e for b, e in lives) for a, _ in lives}
