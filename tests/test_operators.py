"""Cases of the operators: codec, detector, gaps, bundles, filters, helpers."""

import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import compress, config, gap_bitmap, key_exchange, wire
from driftline.operators import dedup, filters, gaps, rates, resend, stats, transport
from driftline.sources import readers, sinks

KEY32 = b"thirty-two bytes of a test key ."


def frames_of(spark, values, mtu, id="testID", compat=False):
    rows = [(f"{id}{k}" if k else id, 6, bytearray(v)) for k, v in enumerate(values)]
    return wire.fragment(spark.createDataFrame(rows, "id string, type int, value binary"), mtu, compat)


@pytest.mark.parametrize("size,mtu,n", [(22, 100, 1), (104, 25, 18), (132, 25, 22), (0, 100, 1)])
def test_frame_counts(spark, size, mtu, n):
    rows = frames_of(spark, [b"x" * size], mtu).collect()
    assert len(rows) == n and {r.n_parts for r in rows} == {n}


def test_exact_multiple_declares_one_more_in_compat(spark):
    rows = frames_of(spark, [b"x" * 132], 25, compat=True).collect()
    assert len(rows) == 22 and rows[0].n_parts == 23


def test_frame_layout_and_checksum(spark):
    (row,) = frames_of(spark, [b"hello"], 100).collect()
    assert bytes(row.frame) == struct.pack(">BHHH", 6, 1, 1, 6) + b"testID" + b"c592" + struct.pack(">H", 5) + b"hello"


def test_id_that_leaves_no_room(spark):
    with pytest.raises(Exception, match="does not fit"):
        frames_of(spark, [b"x"], 19).collect()


def test_parse_errors(spark):
    good = bytes(frames_of(spark, [b"hello"], 100).first().frame)
    cases = {good: None, good[:12]: "too short", good + b"x": "bad length", good[:-1] + b"x": "bad checksum", good[:3] + b"\xff\xff" + good[5:]: "too many parts", good[:5] + b"\x0f\xff" + good[7:]: "bad id length"}
    got = {bytes(r.frame): (r.error, r.payload) for r in wire.parse(spark.createDataFrame([(bytearray(f),) for f in cases], "frame binary")).collect()}
    assert {f: e for f, (e, _) in got.items()} == cases
    assert all((p is None) == (e is not None) for e, p in got.values())


def test_transport_round_trip(spark):
    rng = random.Random(1)
    rows = [("t", p, o, bytearray(rng.randbytes(n))) for p, (o, n) in enumerate([(0, 0), (1, 1), (2, 22 * 6), (3, 5000), (4, 104)])]
    ev = spark.createDataFrame(rows, "topic string, part int, off long, value binary")
    for key in (None, KEY32):
        frames = transport.encode(ev, transport.SendConfig(mtu=60, gzip_over=100, key=key, partition_start=2, topics={"t": "u"}))
        frames = frames.withColumn("arrival", F.monotonically_increasing_id())
        out = transport.decode(frames.select("frame", "arrival").orderBy(F.rand(3)), key)
        assert {(r.id, r.topic, r.part, bytes(r.value)) for r in out.records.collect()} == {(f"u_{p + 2}_{o}", "u", p + 2, bytes(v)) for _, p, o, v in rows}
        assert out.errors.count() == 0
    wrong = transport.decode(frames.select("frame", "arrival"), b"x" * 32)
    assert wrong.records.count() == 0 and {r.error for r in wrong.errors.collect()} == {"cannot decrypt"}


def test_incomplete_messages_vanish(spark):
    frames = frames_of(spark, [b"x" * 100, b"y"], 40).withColumn("arrival", F.monotonically_increasing_id())
    out = transport.decode(frames.filter("part_no <> 2").select("frame", "arrival"))
    assert [r.id for r in out.records.collect()] == ["testID1"]


def test_gunzip():
    assert compress.inflate(gzip.compress(b"abc") + gzip.compress(b"def")) == (b"abcdef", None)
    assert compress.inflate(b"")[1] and compress.inflate(b"junk")[1] and compress.inflate(gzip.compress(b"x" * 99), 98)[1]
    assert compress.inflate(gzip.compress(b"x" * 99), 99) == (b"x" * 99, None)


def test_bitmap_of_hand_made_bytes():
    assert list(gap_bitmap.load(struct.pack("<IIHHI3H", 12346, 1, 0, 2, 16, 1, 5, 9))) == [1, 5, 9]
    assert list(gap_bitmap.load(struct.pack("<HHBHHHHH", 12347, 0, 1, 0, 3, 1, 7, 3))) == [7, 8, 9, 10]
    assert gap_bitmap.decode_payload(b"\1")[3] == "too short"
    assert gap_bitmap.decode_payload(struct.pack(">Bqq", 2, 0, 9))[3] == "unknown version"
    assert gap_bitmap.decode_payload(struct.pack(">Bqq", 1, 0, 9)) == (0, 9, [], None)


@pytest.mark.parametrize("seed", range(4))
def test_bitmap_round_trip(seed):
    rng = np.random.default_rng(seed)
    v = np.unique(rng.integers(0, 300_000, [10, 3000, 60_000, 200_000][seed]))
    assert (gap_bitmap.load(gap_bitmap.dump(v)) == v).all()
    assert gap_bitmap.decode_payload(gap_bitmap.encode_payload(5, 99, gap_bitmap.to_ranges(v)))[2] == gap_bitmap.to_ranges(v)


@pytest.mark.parametrize(
    "numbers,codes,missing",
    [
        (list(range(10)), [0] * 10, []),
        ([0, 2, 3], [0, 0, 0], [[1, 1]]),
        ([0, 2, 4, 5, 6], [0] * 5, [[1, 1], [3, 3]]),
        ([0, 0], [0, 1], []),
        ([0, 2, 3, 4, 5, 6, 7, 8, 9, 1], [0] * 9 + [-1], []),
        ([5, 25, 15, 35, 3, 3, 16], [0, 0, -1, 0, -2, -2, -1], None),
    ],
)
def test_detector(numbers, codes, missing):
    d = dedup.Detector(10, 3)
    assert [d.check(n)[0] for n in numbers] == codes
    if missing is not None:
        assert [g for lo in d.windows for g in d.gaps(lo)] == missing
    again = dedup.Detector(10, 3, d.state())
    assert again.state() == d.state()


def test_detector_evicts_in_order_of_creation():
    d = dedup.Detector(10, 3)
    purged = [d.check(n)[1] for n in [5, 25, 15, 35]]
    assert purged[:3] == [None] * 3 and purged[3] == (0, [[0, 4]]) and list(d.windows) == [20, 10, 30]
    assert d.emissions() == [(20, [[20, 24]]), (10, [[10, 14]]), (30, [[30, 34]])]


def test_empty_windows_are_reported_once():
    d = dedup.Detector(10, 3)
    d.check(0), d.check(2)
    assert d.emissions() == [(0, [[1, 1]])]
    d.check(1)
    assert d.emissions() == [(0, [])] and d.emissions() == []
    assert d.missing() == 0 and d.memory() == 16 + 48 and d.purge_full() == 0


def model(numbers, width, most):
    """An independent reading of the rules, with lists."""
    wins, last, out = [], None, []
    for n in numbers:
        last = n if last is None else max(last, n)
        w = next((w for w in wins if w[0] <= n < w[0] + width), None)
        if w is None:
            if wins and n < wins[0][0]:
                out.append(-2)
                continue
            if len(wins) >= most:
                wins.pop(0)
            w = (n - n % width, set())
            wins.append(w)
        out.append(1 if n in w[1] else 0 if n == last else -1)
        w[1].add(n)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fold_against_model(spark, seed):
    rng = random.Random(seed)
    numbers = [max(0, k + rng.randint(-40, 40)) for k in range(0, 300)]
    log = spark.createDataFrame([("t", 0, n, k) for k, n in enumerate(numbers)], "topic string, part int, off long, arrival long").repartition(3)
    got = [r.status for r in dedup.fold(log, 10, 3).filter("kind = 'row'").orderBy("arrival").collect()]
    assert got == model(numbers, 10, 3)
    if seed < 3:
        many = [r.status for r in dedup.statuses(log, 10, block=50).orderBy("arrival").collect()]
        assert many == model(numbers, 10, 10**6)


def test_legacy_tracker(spark):
    def after(numbers):
        df = spark.createDataFrame([("k", n) for n in numbers], "k string, off long")
        return sorted((r.gap_from, r.gap_to) for r in gaps.interval_tracker(df, ["k"]).collect())

    assert after([0, 1, 2, 4]) == [(3, 3)] and after([0, 1, 2, 4, 3]) == []
    assert after([0, 1, 2, 4, 3, 10]) == [(5, 9)] and after([0, 1, 2, 4, 3, 10, 7, 10]) == [(5, 6), (8, 9)]


WINDOWS = "topic string, part int, window_min long, window_max long, gaps array<array<bigint>>"


def test_bundles(spark, tmp_path):
    rows = [("t", 0, 0, 999, [[3], [7, 9]]), ("t", 0, 1000, 1999, [[5], [10, 15]]), ("t", 1, 0, 999, [[2]])]
    df = spark.createDataFrame(rows, WINDOWS)
    got = {r.part: (r.window_min, r.window_max, r.gaps) for r in gaps.bundle(df).collect()}
    assert got == {0: (0, 1999, [[3], [7, 9], [1005], [1010, 1015]]), 1: (0, 999, [[2]])}
    first = spark.createDataFrame([("t", 0, 1000, 1999, [[5]]), ("t", 0, 0, 999, [[8]])], WINDOWS)
    assert gaps.bundle(first, "first").first().gaps == [[8]]
    empty = spark.createDataFrame([("t", 0, 0, 999, [])], WINDOWS)
    assert gaps.bundle(empty).first().gaps == []
    sinks.write_bundle(gaps.bundle(df), str(tmp_path / "b.json"))
    back = {(r.topic, r.part): r.gaps for r in readers.read_bundle(spark, str(tmp_path / "b.json")).collect()}
    assert back == {("t", 0): got[0][2], ("t", 1): [[2]]}


def test_null_gaps_of_a_bundle_are_empty(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"type": "all", "results": [{"topic": "t", "partition": 0, "window_min": 0, "window_max": 9, "gaps": null}]}')
    assert readers.read_bundle(spark, str(tmp_path / "b.json")).first().gaps == []


def test_resend_kinds(spark):
    ev = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in range(10_000)], "topic string, part int, off long")
    g = spark.createDataFrame([("t", 0, 3, 3), ("t", 0, 4000, 8300), ("t", 1, 9998, 10_500)], "topic string, part int, gap_from long, gap_to long")
    assert resend.in_gaps(ev, g).count() == 1 + 4301 + 2
    assert resend.from_first(ev, g).count() == 9997 + 2
    assert resend.not_found(ev, g).count() == 501
    assert resend.manual(ev, "t", 0, 1, 1).count() == 1 and resend.manual(ev, "t", 0, 9990).count() == 10


def test_complete_gaps_have_tails_and_skipped_windows(spark):
    log = spark.createDataFrame([("t", 0, n, n) for n in [0, 1, 3, 31]], "topic string, part int, off long, arrival long")
    m = gaps.received(log, 10)
    assert sorted((r.gap_from, r.gap_to) for r in gaps.complete_ranges(m).collect()) == [(2, 2), (4, 30)]
    assert sorted((r.gap_from, r.gap_to) for r in gaps.ranges(m).collect()) == [(2, 2), (30, 30)]


def test_ids(spark):
    ids = ["a_1_2", "a_1_2__", "a_b_1_2", "a_1", "a_ 1 _2", "a_1_99999999999999999999", "_1_2", None, "a_+1_-2"]
    rows = spark.createDataFrame([(i, i) for i in ids], "id string, v string").select("id", wire.dedup_id(F.col("id")).alias("d"), wire.dedup_id(F.col("id"), rightmost=True).alias("r"), wire.split_id(F.col("id")).alias("g")).collect()
    got = {r.id: r for r in rows}
    assert tuple(got["a_1_2"].d) == ("a", 1, 2) == tuple(got["a_1_2__"].d) and got["a_1_2__"].g is None
    assert got["a_b_1_2"].d is None and tuple(got["a_b_1_2"].r) == ("a_b", 1, 2)
    assert all(got[i].d is None for i in ("a_1", "a_ 1 _2", "a_1_99999999999999999999", None))
    assert tuple(got["a_+1_-2"].d) == ("a", 1, -2) and tuple(got["_1_2"].d) == ("", 1, 2)


def test_rules():
    rules = config.load_rules("deny:secret, allow:^a")
    assert [r.allow for r in rules] == [False, True] and "deny: secret" in config.rules_summary(rules, True)
    for bad in (r"deny:(\w+)*", "deny", "maybe:x", "deny:" + "x" * 1001, r"deny:\d{1,3}x"):
        with pytest.raises(ValueError):
            config.load_rules(bad)
    assert config.java_regex(r"(?P<n>a)[$]\$$") == r"(?d)(a)[\x{24}]\x{24}\z"


def test_content_filter_order_and_defaults(spark):
    df = spark.createDataFrame([("secret a",), ("a",), ("b",), (None,)], "value string")
    rules = [config.Rule(False, "secret"), config.Rule(True, "a")]
    got = [(r.value, r.filtered) for r in filters.content_filter(df, rules, default_allow=False).collect()]
    assert got[0] == ("", True) and got[1] == ("a", False) and got[2] == ("", True)
    assert [r.filtered for r in filters.content_filter(df, [], default_allow=False).collect()] == [False] * 4


def test_deliver_filter(spark):
    assert [n for n in range(9) if config.DeliverFilter("1,3,5").delivers(n)] != []
    with pytest.raises(ValueError):
        config.DeliverFilter("0,5,10")
    with pytest.raises(ValueError):
        config.DeliverFilter("1,2")
    df = spark.range(0, 12).select(F.col("id").alias("off"))
    parts = [{r.off for r in filters.deliver(df, c).collect()} for c in ("1,3,5", "2,4,6")]
    assert parts[0] & parts[1] == set() and 0 not in parts[0] | parts[1]
    assert 0 in {r.off for r in filters.deliver(df, config.DeliverFilter("2,4,6", floor_mod=True)).collect()}
    for pipes in range(2, 6):
        for more in range(pipes):
            rows = [config.DeliverFilter(",".join(map(str, sorted(f)))) for f in config.generate_filters(pipes, more)] if more == 0 else []
            for n in range(1, 40) if rows else ():
                assert sum(f.delivers(n) for f in rows) == 1


def test_helpers():
    assert [config.parse_size(s) for s in ("5", "5B", "2KiB", "3MiB", "1GiB", "1TiB")] == [5, 5, 2048, 3 << 20, 1 << 30, 1 << 40]
    with pytest.raises(ValueError):
        config.parse_size("5kb")
    assert [config.backoff_ms(n, 5000, 60000) for n in (1, 2, 100)] == [5000, 10000, 60000]
    assert all(900 <= config.jitter_ms(1000, 10) <= 1100 for _ in range(50)) and config.jitter_ms(1000, 0) == 1000
    assert [config.host_of(h) for h in ("h:9092", "PLAINTEXT://h:9092", "[2001:db8::1]:9092", "h")] == ["h", "h", "2001:db8::1", "h"]
    assert config.missing_topics(" a, b,,c ", {"a"}) == ["b", "c"]
    for bad in ((-1, 1, 0), (5, 1, 0), (1, 5, 101)):
        with pytest.raises(ValueError):
            config.validate_retry(*bad)


def test_key_exchange():
    p, q = 2**521 - 1, 2**607 - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    sealed = key_exchange.seal(b"k" * 32, n, e)
    assert key_exchange.unseal(sealed, [(n, d + 2), (n, d)]) == b"k" * 32
    assert key_exchange.unseal(sealed, [(n, d + 2)]) is None


def test_split_stream(spark):
    frames = [bytes(r.frame) for r in frames_of(spark, [b"hello", b"", b"x" * 50], 40).collect()]
    assert list(readers.split_stream(b"".join(frames) + b"\0\0")) == frames
    df = spark.createDataFrame([(1, bytearray(b"".join(frames)))], "k int, stream binary")
    assert [bytes(r.frame) for r in readers.stream_frames(df).orderBy("seq").collect()] == frames


def test_sources_and_sinks(spark, tmp_path):
    assert readers.kafka_options("b:1", "a, c", partition=2, start_offset=7)["startingOffsets"] == '{"a": {"2": 7}, "c": {"2": 7}}'
    assert readers.kafka_options("b:1", "a", per_trigger=5)["maxOffsetsPerTrigger"] == "5"
    assert sinks.count_only(readers.counter(spark, 321)) == 321
    errors = spark.createDataFrame([("a_0_1", "bad"), (None, "worse")], "id string, error string")
    rows = sinks.status_rows(errors, "log", "2024-01-01").collect()
    assert rows[0].value.startswith(b"2024-01-01T00:00:00Z a_0_1 bad") and len(rows[1].key) == 36 and sinks.status_rows(errors, "").count() == 0
    (tmp_path / "p.properties").write_text("# x\na = 1\nb=c=d\n")
    assert readers.read_properties(str(tmp_path / "p.properties")) == {"a": "1", "b": "c=d"}


def test_reconciliation_states(spark):
    h = lambda xs: spark.createDataFrame([(x,) for x in xs], "hash string")
    got = {r.hash: (r.state, r.duplicated_times) for r in stats.reconcile(h("abc"), h("bccdee")).collect()}
    assert got == {"a": ("SENT", 0), "b": ("RECEIVED", 0), "c": ("DUPLICATED", 1), "d": ("UNKNOWN", 0), "e": ("UNKNOWN_DUPLICATED", 1)}


class Broker:
    """A session whose Kafka reader gives the same rows whatever it is asked, and tells what that was."""

    def __init__(self, spark):
        schema = "topic string, partition int, offset long, timestamp timestamp, value binary"
        self.rows = spark.createDataFrame([("t", 1, 7, None, bytearray(b"v"))], schema)
        self.asked = []

    read = property(lambda self: self._as("batch"))
    readStream = property(lambda self: self._as("stream"))

    def _as(self, kind):
        self.asked.append({"kind": kind})
        return self

    def format(self, name):
        self.asked[-1]["format"] = name
        return self

    def options(self, **given):
        self.asked[-1].update(given)
        return self

    def load(self):
        return self.rows


def test_reading_to_the_end_and_tailing(spark):
    b = Broker(spark)
    (row,) = readers.kafka(b, streaming=False, brokers="h:9092", topics="t").collect()
    assert (row.topic, row.part, row.off, row.id, bytes(row.value)) == ("t", 1, 7, "t_1_7", b"v")
    readers.tail(b, "h:9092", "t")
    to_end, tail = b.asked
    assert to_end["kind"] == "batch" and to_end["format"] == "kafka" and to_end["endingOffsets"] == "latest" and to_end["startingOffsets"] == "earliest"
    assert tail["kind"] == "stream" and tail["startingOffsets"] == "latest" and "endingOffsets" not in tail


def test_small_sinks(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("t", 1, 7, "hello", None), ("t", 0, 8, "there", None)], "topic string, part int, off long, payload string, ts timestamp")
    clean = sinks.clean_rows(rows)
    assert [(r.id, r.value) for r in clean.orderBy("id").collect()] == [("t_0_8", "there"), ("t_1_7", "hello")]
    sinks.console(clean)
    assert "hello" in capsys.readouterr().out
    sinks.write_stats(rows.select("topic", "part", "off"), str(tmp_path / "stats"))
    got = spark.read.option("header", True).csv(str(tmp_path / "stats"))
    assert sorted(map(tuple, got.collect())) == [("t", "0", "8"), ("t", "1", "7")]


def test_gap_payload_bytes():
    """The payload byte by byte, as the public formats say: version, bounds, then a portable Roaring bitmap of one array container."""
    head = bytes([1]) + (100).to_bytes(8, "big") + (199).to_bytes(8, "big")
    # Cookie without runs, one container; key 0 of cardinality 4 (less one); its offset; values 3, 7, 8, 9.
    body = bytes.fromhex("3a300000" "01000000" "0000" "0300" "10000000" "0300" "0700" "0800" "0900")
    assert gap_bitmap.encode_payload(100, 199, [[3], [7, 9]]) == head + body
    assert gap_bitmap.decode_payload(head + body) == (100, 199, [[3], [7, 9]], None)
    # The same numbers as runs: one container, flagged, two runs of 0 and 2 more.
    runs = bytes.fromhex("3b30" "0000" "01" "0000" "0300" "0200" "0300" "0000" "0700" "0200")
    assert gap_bitmap.decode_payload(head + runs) == (100, 199, [[3], [7, 9]], None)
    assert gap_bitmap.encode_payload(0, 99, []) == bytes([1]) + bytes(8) + (99).to_bytes(8, "big") + bytes.fromhex("3a300000" "00000000")


def test_rates(spark):
    df = spark.createDataFrame([("k", n, float(t)) for n, t in enumerate([0, 0, 0, 0, 10, 10.5])], "key string, n long, t double")
    assert [r.release for r in rates.spaced(df, ["key"], 2).orderBy("n").collect()] == [0, 2, 4, 6, 10, 12]
    assert [r.t for r in rates.accepted_every(df, "key", 1).orderBy("n").collect()] == [0, 10]
    bucket, tokens, at = [], 2.0, 0.0
    for t in [0, 0, 0, 0, 10, 10.5]:  # a bucket of two that refills two a second
        now = max(t, at)
        tokens = min(2.0, tokens + (now - at) * 2)
        if tokens < 1:
            now += (1 - tokens) / 2
            tokens = 1.0
        tokens, at = tokens - 1, now
        bucket.append(now)
    assert [r.release for r in rates.token_bucket(df, ["key"], 2).orderBy("n").collect()] == bucket


def test_chaos_converges(spark):
    """Lossy transport, deduplication, bundle and resend, until nothing is missing."""
    ev = spark.createDataFrame([("t", p, o, bytearray(f"{p}:{o}".encode() * 9)) for p in range(3) for o in range(60)], "topic string, part int, off long, value binary").cache()
    log, send = None, ev
    for attempt in range(12):
        frames = transport.encode(send, transport.SendConfig(mtu=40)).withColumn("arrival", F.monotonically_increasing_id())
        last = (F.col("id").endswith("_59") | F.col("id").endswith("_0"))
        kept = frames.filter(last | (F.pmod(F.xxhash64("id", "part_no", F.lit(attempt)), F.lit(10)) > 0))
        got = transport.decode(kept.select("frame", "arrival")).records
        rows, _ = filters.split_standard(got, wire.dedup_id(F.col("id")))
        rows = rows.select("topic", "part", "off", F.col("value").alias("payload"), (F.lit(attempt * 1000) + F.col("off")).alias("arrival"))
        log = spark.createDataFrame((log.union(rows) if log is not None else rows).collect(), rows.schema)
        g = gaps.complete_ranges(gaps.received(log, 10))
        if g.isEmpty():
            break
        send = resend.in_gaps(ev, g)
    assert attempt < 11 and g.isEmpty()
    delivered = dedup.clean(log, 10)
    states = stats.state_counts(stats.reconcile(ev.select(F.sha2("value", 256).alias("hash")), delivered.select(F.sha2("payload", 256).alias("hash")))).collect()
    assert [(r.state, r.n) for r in states] == [("RECEIVED", 180)]


def test_parse_time(spark):
    texts = {"2024-03-01T10:00:00Z": 1709287200, "2024-03-01T10:00:00.5+02:00": 1709280000, "2024-03-01T10:00:00-07:00": 1709312400, "2024-03-01 10:00:00": None, "2024-13-01T10:00:00Z": None, "x": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_timestamp(wire.parse_time(F.col("t"))).alias("s")).collect()
    assert {r.t: r.s for r in rows} == texts


def test_kafka_options_of_groups_times_and_tls(tmp_path):
    got = readers.kafka_options("b:9093", "a,b", group="g1", since="2024-05-01T12:00:00+02:00")
    assert got["kafka.group.id"] == "g1" and got["startingTimestamp"] == "1714557600000" and "startingOffsets" not in got
    with pytest.raises(ValueError):
        readers.kafka_options("b", "a", since="2024-05-01T12:00:00")
    cert, key, locked = (tmp_path / x for x in ("cert.pem", "key.pem", "locked.pem"))
    cert.write_text("-----BEGIN CERTIFICATE-----")
    key.write_text("-----BEGIN PRIVATE KEY-----")
    locked.write_text("-----BEGIN ENCRYPTED PRIVATE KEY-----")
    own = readers.tls_options("ca.pem", str(cert), str(key))
    assert own["kafka.ssl.truststore.location"] == "ca.pem" and own["kafka.ssl.keystore.key"] == key.read_text() and "kafka.ssl.key.password" not in own
    assert readers.tls_options("ca.pem", str(cert), str(locked), "pw")["kafka.ssl.key.password"] == "pw"
    for bad in ((str(cert), None), (None, str(key)), (str(cert), str(locked))):
        with pytest.raises(ValueError):
            readers.tls_options("ca.pem", *bad)
    assert readers.kafka_options("b", "a", tls=own)["kafka.security.protocol"] == "SSL" == sinks.writer_options("b", own)["kafka.security.protocol"]


@pytest.mark.parametrize("bad", ["a**", "(?=a)", r"\1", "[z-a]", "(a", "a)", r"\Z", "[[:foo:]]", "*a", "a{1001}", "[a", r"\p{", "(?)", r"\C", "a{2}{3}", r"\y", "[a", "x{3,2}"])
def test_rules_that_are_refused(bad):
    with pytest.raises(ValueError):
        config.java_regex(bad)
