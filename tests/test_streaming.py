"""Streaming twins give the batch operators' rows."""

import time
from collections import Counter

from pyspark.sql import functions as F

from driftline.functions import wire
from driftline.operators import dedup
from driftline.plans import catalog
from driftline.streaming import stateful


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_dedup_stream_is_batch(spark, sf, tmp_path):
    log = catalog.raw_log(spark, sf).select("topic", "part", "off", "arrival")
    log.orderBy("arrival").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "log"))
    # One file a trigger; files are taken in order of their names, which follow the arrivals.
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "log"))
    got = drained(stateful.dedup_stream(stream, 50, 3), tmp_path, "dedup_rows")
    ours = sorted(tuple(map(str, r)) for r in got.collect())
    assert ours == sorted(tuple(map(str, r)) for r in dedup.fold(log, 50, 3).collect())


def test_rows_without_offset_go_past_the_stream(spark, tmp_path):
    rows = [("t", 0, None, 1), (None, 0, 2, 2), ("t", 0, 3, 3), ("t", 0, 3, 4)]
    spark.createDataFrame(rows, "topic string, part int, off long, arrival long").write.parquet(str(tmp_path / "odd"))
    got = drained(stateful.dedup_stream(spark.readStream.schema("topic string, part int, off long, arrival long").parquet(str(tmp_path / "odd")), 10, 3), tmp_path, "odd_rows")
    assert sorted((r.arrival, r.status) for r in got.collect() if r.status is not None) == [(3, 0), (4, 1)] and got.count() == 4


def test_reassembly_stream(spark, tmp_path):
    rows = [(f"t_0_{k}", 6, bytearray(b"ab" * n)) for k, n in enumerate([0, 3, 40, 200])]
    frames = wire.fragment(spark.createDataFrame(rows, "id string, type int, value binary"), 60).select("frame", F.monotonically_increasing_id().alias("arrival"))
    frames.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames"))
    q = stateful.reassemble_stream(stream).writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        # A query with processing-time timeouts never runs out of batches; wait for the rows instead.
        end = time.time() + 60
        while q.isActive and time.time() < end and spark.table("whole").count() < len(rows):
            time.sleep(0.5)
        got = {r.id: bytes(r.value) for r in spark.table("whole").collect()}
    finally:
        q.stop()
    assert got == {i: bytes(v) for i, _, v in rows}


def test_assembler_rules():
    a = stateful.Assembler()
    assert a.add(1, 2, b"x", 0, 30) is None and a.add(1, 2, b"y", 1, 30) is None
    assert stateful.Assembler(a.state()).add(2, 9, b"z", 2, 30) == b"yz"  # the last payload of a part, the first count
    assert a.add(2, 2, b"z", 40, 30) is None  # too old: begun anew


def test_rate_stats(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("topic"))
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    got = drained(stateful.rate_stats(stream, 3600), tmp_path, "rates", "complete")
    assert got.agg(F.sum("received"), F.sum("sent")).first() == (rows.count(), rows.count())
    from driftline.operators import stats

    total = stats.with_totals(got, ["topic"]).groupBy("topic").agg(F.max("total_received").alias("n"))
    assert {(r.topic, r.n) for r in total.collect()} == {(r.topic, r["count"]) for r in rows.groupBy("topic").count().collect()}


def test_supervise():
    calls = []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError

    assert stateful.supervise(Query, 5, 10, 100, sleep=lambda s: None) == 3


def rsa(seed):
    """(n, e, d) of 1,024 bits, for tests only."""
    import random

    rng = random.Random(seed)

    def prime():
        while True:
            p = rng.getrandbits(512) | 1 << 511 | 1 | 1 << 510
            if all(p % k for k in (3, 5, 7, 11, 13, 17, 19, 23)) and all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7)) and p % 65537 != 1:
                return p

    p, q = prime(), prime()
    return p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))


def wait_for(query, done, seconds=90):
    end = time.time() + seconds
    while query.isActive and time.time() < end and not done():
        time.sleep(0.3)
    if query.exception():
        raise query.exception()


def test_link_with_changing_keys_and_restarts(spark, tmp_path):
    """Events over the whole link: the sender changes its key between runs, the receiver is stopped and started again half way."""
    from driftline.operators.transport import SendConfig
    from driftline.streaming import link

    n, e, d = rsa(1)
    m, _, other = rsa(2)
    schema = "topic string, part int, off long, ts timestamp, value string"
    events, frames, records, ring = (str(tmp_path / x) for x in ("events", "frames", "records", "ring"))
    count = [0]

    def deliver(rows, number):
        count[0] += 1
        rows.coalesce(1).select("frame", (F.lit(count[0] << 20) + F.monotonically_increasing_id()).alias("arrival")).write.mode("append").parquet(frames)

    def sink(got, number):
        got.records.write.mode("overwrite").parquet(f"{records}/batch={number}")
        assert got.errors.count() == 0

    def send(key, lo, hi):
        rows = spark.range(lo, hi).selectExpr("'t' AS topic", "CAST(id % 3 AS INT) AS part", "id AS off", "current_timestamp() AS ts", "repeat(concat('value ', id, ' '), CAST(id % 60 AS INT)) AS value")
        rows.coalesce(1).write.mode("append").parquet(events)
        source = spark.readStream.schema(schema).parquet(events)
        q = link.send_stream(source, SendConfig(mtu=300, key=key, gzip_over=400), deliver, (n, e)).option("checkpointLocation", str(tmp_path / "up")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    def receive(until):
        source = spark.readStream.schema("frame binary, arrival long").parquet(frames)
        q = link.receive_stream(source, ring, [(m, other), (n, d)], sink).option("checkpointLocation", str(tmp_path / "down")).start()
        try:
            wait_for(q, lambda: (tmp_path / "records").exists() and read().count() >= until)
        finally:
            q.stop()

    def read():
        return spark.read.schema("id string, topic string, part int, value binary").option("recursiveFileLookup", True).parquet(records)

    send(b"0" * 16, 0, 100)
    receive(100)
    send(b"1" * 32, 100, 180)
    receive(180)
    got = sorted((r.id, r.topic, r.part, bytes(r.value).decode()) for r in read().collect())
    assert got == sorted((f"t_{k % 3}_{k}", "t", k % 3, f"value {k} " * (k % 60)) for k in range(180))
    assert {bytes(r.key) for r in link.read_ring(spark, ring).collect()} == {b"0" * 16, b"1" * 32}


def test_false_envelopes_tell_no_key(spark, tmp_path):
    """Envelopes that can't be opened, without value or arrival, among good ones: only good ones join the ring, and a repeated batch leaves it as it is."""
    from driftline.functions import key_exchange
    from driftline.streaming import link

    n, e, d = rsa(3)
    good = {k: key_exchange.seal(bytes([k]) * 32, n, e) for k in (7, 200)}
    rows = [("k", wire.KEY_EXCHANGE, bytearray(b"\x05" * (k % 90)), k) for k in range(400)]
    rows += [("k", wire.KEY_EXCHANGE, bytearray(v), 1000 + k) for k, v in good.items()]
    rows += [("k", wire.KEY_EXCHANGE, None, 5), ("k", wire.KEY_EXCHANGE, bytearray(good[7]), None)]
    messages = spark.createDataFrame(rows, "id string, type int, value binary, arrival long").repartition(4)
    for number in (0, 0, 1):
        link.opened(messages.filter("arrival < 1000") if number else messages, number, str(tmp_path / "ring"), [(n, d)])
        assert {(r.epoch, bytes(r.key)) for r in link.read_ring(spark, str(tmp_path / "ring")).collect()} == {(1000 + k, bytes([k]) * 32) for k in good}


def test_sent_frames_are_the_same_again(spark):
    from driftline.operators.transport import SendConfig, encode

    rows = spark.createDataFrame([("t", 0, k, f"secret {k}" * 50) for k in range(20)], "topic string, part int, off long, value string")
    runs = [[tuple(r) for r in encode(rows, SendConfig(mtu=100, key=b"k" * 16)).orderBy("id", "part_no").collect()] for _ in range(2)]
    assert runs[0] == runs[1] and len({bytes(r[4])[-12:] for r in runs[0]}) > 20


def test_datagrams(spark, tmp_path):
    import socket

    from driftline.sources import readers

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    name = readers.register_udp(spark)
    q = spark.readStream.format(name).option("port", str(port)).load().writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "c")).start()
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    try:
        sent = [0]

        def done():
            out.sendto(f"frame {sent[0]}".encode(), ("127.0.0.1", port))
            sent[0] += 1
            return spark.table("datagrams").count() >= 5

        wait_for(q, done)
        got = [(r.arrival, bytes(r.frame)) for r in spark.table("datagrams").orderBy("arrival").collect()]
    finally:
        q.stop()
        out.close()
    assert len(got) >= 5 and [a for a, _ in got] == list(range(len(got))) and all(f.startswith(b"frame ") for _, f in got)
    assert len({f for _, f in got}) == len(got)


def test_receivers_spool_what_a_failed_batch_needs_again(spark, tmp_path):
    import socket

    import pytest

    from driftline.sources import udp

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    spool = str(tmp_path / "spool")
    (tmp_path / "spool").mkdir()
    got = udp.receive(spark, port, spool, host="127.0.0.1", receivers=2, roll_seconds=0.2, lasting=90)
    end = time.time() + 60
    while len(list((tmp_path / "spool").glob("_ready/*"))) < 2 and time.time() < end:
        time.sleep(0.1)
    for k in range(300):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:  # another port each, so the kernel deals them to both
            s.sendto(f"frame {k}".encode(), ("127.0.0.1", port))
    counts = got.stop()
    assert sum(counts.values()) == 300 and min(counts.values()) > 0
    out, failed = str(tmp_path / "out"), []

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if not failed:
            failed.append(number)
            raise RuntimeError("the batch is lost")

    def run():
        q = udp.frames(spark, spool).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="the batch is lost"):
        run()
    run()
    rows = spark.read.schema(udp.FRAMES).option("recursiveFileLookup", True).parquet(out).collect()
    assert sorted(bytes(r.frame) for r in rows) == sorted(f"frame {k}".encode() for k in range(300))
    assert len({r.arrival for r in rows}) == 300 and {r.receiver for r in rows} == {0, 1}


def test_delayed_stream(spark, tmp_path):
    spark.sql("SELECT concat('e', id) AS id, current_timestamp() AS ts, CAST('v' AS BINARY) AS value FROM range(6)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, value binary").parquet(str(tmp_path / "in"))
    q = stateful.delayed_stream(stream, {"now": 0, "late": -8}).writeStream.format("memory").queryName("delayed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        wait_for(q, lambda: spark.table("delayed").count() >= 6)
        first = Counter(r.thread for r in spark.table("delayed").collect())
        wait_for(q, lambda: spark.table("delayed").count() >= 12)
        got = Counter((r.thread, r.id) for r in spark.table("delayed").collect())
    finally:
        q.stop()
    assert first["now"] == 6 and got == Counter((t, f"e{k}") for t in ("now", "late") for k in range(6))


GAP_TOPIC = "topic string, part int, window_min long, read_seq long, window_max long, gaps array<array<long>>"


def test_live_report_keeps_what_earlier_batches_told(spark, tmp_path):
    batches = [[("t", 0, 100, 1, 199, [[3]]), ("t", 0, 100, 2, 199, []), ("t", 1, 0, 3, 99, [[1, 4]])], [("t", 0, 200, 4, 299, [[5]]), ("t", 1, 0, 5, 99, [[2]])], [("t", 0, 100, 6, 199, [[9]])]]
    shown = []
    show = lambda w: shown.append(sorted((r.topic, r.part, r.window_min, r.gaps) for r in w.collect()))
    want = [[("t", 0, 100, []), ("t", 1, 0, [[1, 4]])], [("t", 0, 100, []), ("t", 0, 200, [[5]]), ("t", 1, 0, [[2]])], [("t", 0, 100, [[9]]), ("t", 0, 200, [[5]]), ("t", 1, 0, [[2]])]]
    for k, rows in enumerate(batches):  # the query is started again for each
        spark.createDataFrame(rows, GAP_TOPIC).coalesce(1).write.mode("append").parquet(str(tmp_path / "gaps"))
        stream = spark.readStream.schema(GAP_TOPIC).parquet(str(tmp_path / "gaps"))
        q = stateful.live_report(stream, show, str(tmp_path / "seen")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert shown[-1] == want[k] and len(shown) == k + 1


def test_latest_table_merges_and_repeats(spark, tmp_path):
    from driftline.streaming.compacted import LatestTable

    t = LatestTable(spark, str(tmp_path / "t"), ["k"], "seq", merge_every=3)
    assert t.read() is None and t.read("k int, seq long, v string").collect() == []
    want = {}
    for n in range(11):
        rows = [(k, n * 10 + k, f"{n}:{k}") for k in range(n % 4, n % 4 + 3)] + [(0, -1, "old")] * (n > 3) + [(None, n, "none")]
        df = spark.createDataFrame(rows, "k int, seq long, v string")
        for _ in range(2):  # a batch that runs again
            t.upsert(df, n)
            for k, s, v in rows:
                want[k] = max(want.get(k, (s, v)), (s, v))
            assert {r.k: (r.seq, r.v) for r in t.read().collect()} == want
    base, deltas = t.parts()
    assert base >= 5 and len(deltas) < 3
    before = t.parts()
    t.upsert(spark.createDataFrame([(0, 999, "late")], "k int, seq long, v string"), base)  # merged already
    assert t.parts() == before and {r.k: (r.seq, r.v) for r in t.read().collect()} == want


def staged(spark, tmp_path, name, schema, batches, start):
    """Runs start(stream) anew for each batch, over one checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        q = start(spark.readStream.schema(schema).parquet(str(tmp_path / name))).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        if q.exception():
            raise q.exception()


LOG = "topic string, part int, off long, arrival long, control string"


def test_map_state_is_the_batch_and_can_be_read(spark, sf, tmp_path):
    from driftline.operators import gaps
    from driftline.streaming import map_state

    map_state.rocksdb(spark)
    log = [(*r, None) for r in catalog.raw_log(spark, sf).select("topic", "part", "off", "arrival").orderBy("arrival").collect()]
    third = len(log) // 3
    out = str(tmp_path / "rows")
    start = lambda s: map_state.dedup_stream(s, 50, 3).writeStream.format("parquet").option("path", out)
    staged(spark, tmp_path, "log", LOG, [log[:third], log[third:-1], log[-1:]], start)
    batch = spark.createDataFrame([r[:4] for r in log], "topic string, part int, off long, arrival long")
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert plain(spark.read.parquet(out)) == plain(dedup.fold(batch, 50, 3))
    # The stopped query's state: the windows that are still there.
    lives = dedup.lives(batch, 50, 3).filter("died IS NULL")
    got = map_state.windows_in(spark, str(tmp_path / "log-c"))
    assert plain(got.select("topic", "part", "win")) == plain(lives.select("topic", "part", "win"))
    marked = dedup.lived(batch, 50, 3).filter("seen = 1 AND born IS NOT NULL AND died IS NULL").select(*gaps.WIN, "off")
    assert plain(map_state.introspection(got)) == plain(gaps.introspection(marked, gaps.ranges(marked)).select("topic", "part", "windows", "bytes", "missing"))
    ranges = sorted((r.topic, r.part, r.win, *g) for r in got.collect() for g in r.gaps)
    assert ranges == sorted(tuple(r) for r in gaps.ranges(marked).collect())
    # The last batch was one row: one window has been written.
    changed = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", 2).option("stateVarName", "windows").load(str(tmp_path / "log-c"))
    assert changed.count() <= 1


def test_control_rows_reset_a_detector(spark, tmp_path):
    from driftline.streaming import map_state

    map_state.rocksdb(spark)
    row = lambda off, at, control=None: ("t", 0, off, at, control)
    first = [row(k, k) for k in range(10)] + [row(12, 20), row(12, 21), ("t", 0, None, 22, None), (None, 0, 1, 23, None)]
    batches = [first, [row(None, 30, "purge_full"), row(5, 31)], [row(None, 40, "purge"), row(3, 41), row(12, 42)]]
    out = str(tmp_path / "rows")
    staged(spark, tmp_path, "log", LOG, batches, lambda s: map_state.dedup_stream(s, 10, 3).writeStream.format("parquet").option("path", out))
    got = {(r.off, r.arrival): r.status for r in spark.read.parquet(out).collect()}
    assert got[9, 9] == 0 and got[12, 21] == 1 and got[None, 22] is None and got[1, 23] is None
    assert got[5, 31] == -2  # its window was full and is gone
    assert got[3, 41] == -1 and got[12, 42] == 0  # all was forgotten but the greatest number
    assert [(r.win, r.received, r.gaps) for r in map_state.windows_in(spark, str(tmp_path / "log-c")).orderBy("win").collect()] == [(0, 1, [[0, 2]]), (10, 1, [[10, 11]])]


def test_map_state_reports_on_a_timer(spark, tmp_path):
    from driftline.streaming import map_state

    map_state.rocksdb(spark)
    spark.createDataFrame([("t", 0, 0, 1, None), ("t", 0, 3, 2, None), ("t", 0, 11, 3, None), ("t", 0, 10, 4, None)], LOG).write.parquet(str(tmp_path / "log"))
    q = map_state.dedup_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), 10, 3, 1).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        wait_for(q, lambda: spark.table("timed").filter("kind = 'gap' AND window_min = 0").count() >= 2)
        got = [(r.window_min, r.gap_from, r.gap_to) for r in spark.table("timed").filter("kind = 'gap'").collect()]
    finally:
        q.stop()
    assert got.count((10, None, None)) == 1 and set(got) == {(10, None, None), (0, 1, 2)}


def test_parts_in_map_state(spark, tmp_path):
    from driftline.streaming import map_state

    map_state.rocksdb(spark)
    rows = [(f"t_0_{k}", 6, bytearray(bytes([k]) * 90 * n)) for k, n in enumerate([0, 1, 4, 9])]
    frames = [(bytearray(r.frame), r.id, r.part_no) for r in wire.fragment(spark.createDataFrame(rows, "id string, type int, value binary"), 60).collect()]
    late = [f for f in frames if f[1] == "t_0_3" and f[2] == 2]
    first = [f for f in frames if f not in late]
    schema, out = "frame binary, arrival long", str(tmp_path / "out")
    path = str(tmp_path / "frames")

    def batch(some):
        nonlocal at
        spark.createDataFrame([(f[0], at + k) for k, f in enumerate(some)], schema).coalesce(1).write.mode("append").parquet(path)
        at += len(some)

    at = 0
    batch(first)
    got = lambda: {r.id: bytes(r.value) for r in spark.read.schema(map_state.MESSAGE).parquet(out).collect()} if (tmp_path / "out").exists() else {}
    q = map_state.reassemble_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 600).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        wait_for(q, lambda: len(got()) >= 3)
        n = q.lastProgress["batchId"]
        batch(late)
        wait_for(q, lambda: len(got()) >= 4)
    finally:
        q.stop()
    assert got() == {i: bytes(v) for i, _, v in rows} and n is not None
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "parts").load(str(tmp_path / "c"))
    assert state.count() == 0  # what is complete leaves nothing


def test_send_tries_again_and_counter_stream(spark, tmp_path):
    from driftline.sources import readers, sinks

    folder = str(tmp_path / "sent")
    (tmp_path / "sent").mkdir()

    def deliver(rows):
        from pathlib import Path
        from uuid import uuid4

        flag = Path(folder, "failed")
        if not flag.exists():
            flag.write_text("once")
            raise OSError
        assert len(rows) <= 7
        Path(folder, f"{uuid4().hex}.txt").write_text("\n".join(r.id for r in rows))

    spark.range(40).selectExpr("concat('m', id) AS id").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sinks.send(spark.readStream.schema("id string").parquet(str(tmp_path / "in")), deliver, wait=0.01, size=7).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [x for p in (tmp_path / "sent").glob("*.txt") for x in p.read_text().split("\n")]
    assert sorted(got) == sorted(f"m{k}" for k in range(40))
    q = readers.counter_stream(spark, 50).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "d")).start()
    try:
        wait_for(q, lambda: spark.table("counted").count() >= 20)
        rows = spark.table("counted").collect()
    finally:
        q.stop()
    assert {(r.id, bytes(r.value).decode()) for r in rows} == {(f"random_{k}", f"Random message {k}") for k in range(len(rows))}
