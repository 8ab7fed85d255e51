"""Replay with evictions, reports over time, chains, redelivery and chunked streams, each against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import wire
from driftline.operators import dedup, gaps, rates, reassembly, stats
from driftline.operators.dedup import KEY, Detector
from driftline.sources import byte_streams, readers
from driftline.streaming.stateful import Assembler
from driftline.tables import reachable

LOG = "topic string, part int, off long, arrival long"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(5)


def messy(seed, n=600, spread=60, top=400):
    """Offsets that rise, fall back, repeat, and now and then jump far; most of them of one key."""
    rng, rows, at = random.Random(seed), [], [0, 50, 7]
    for arrival in range(n):
        k = 0 if rng.random() < 0.9 else rng.randint(1, 2)
        at[k] = max(0, at[k] + rng.choice([1, 1, 1, 2, 5, -3, 40, -40])) if rng.random() < 0.9 else rng.randrange(top)
        rows.append(("t", k, max(0, at[k] - rng.choice([0, 0, 0, rng.randrange(spread)])), arrival))
    return rows


def plain(df):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("seed,width,most,block", [(1, 10, 3, 64), (2, 10, 2, 16), (3, 7, 1, 50), (4, 25, 4, 600), (5, 10, 3, 4)])
def test_replay_equals_the_detector(spark, seed, width, most, block):
    log = log_of(spark, messy(seed))
    assert plain(dedup.replay(log, width, most, block)) == plain(dedup.fold(log, width, most))


def test_a_hot_key_is_replayed_by_its_windows(spark):
    rng = random.Random(8)
    rows = [("hot", 0, max(0, k + rng.choice([0, 0, 0, -9, -30, 3])), k) for k in range(9000)] + [(f"t{p}", p, k, k) for p in range(10) for k in range(100)]
    log = log_of(spark, rows)
    touches = log.withColumn("win", F.expr("off - off % 100")).select("win", F.expr("arrival div 4096")).filter("win >= 0").distinct().count()
    assert touches < 200  # what the replaying task reads of 9,000 rows
    lives = dedup.lives(log, 100, 3).collect()
    assert sum(r.topic == "hot" for r in lives) == 90
    assert plain(dedup.replay(log, 100, 3)) == plain(dedup.fold(log, 100, 3))


def test_rows_without_key_or_offset_go_past_the_detector(spark):
    odd = [(None, 0, 1, 1), ("t", None, 1, 2), ("t", 0, None, 3), ("t", 0, 1, None)]
    log = log_of(spark, odd + [("t", 0, 1, 5), ("t", 0, 1, 6)])
    for run in (dedup.fold, dedup.replay):
        got = run(log, 10, 2).collect()
        assert len(got) == 6 and sorted(r.status for r in got if r.status is not None) == [0, 1]
        assert plain(run(log.limit(0), 10, 2)) == []


def walked(rows, every, width, most):
    """(report lines, emissions) of detectors that are asked at each tick."""
    detectors, counts, lines, sent, now = {}, {}, [], [], 0
    last = max(r[3] for r in rows) // every

    def tick(t):
        for (topic, part), d in detectors.items():
            lines.append((t, topic, part, d.missing(), *counts[topic, part]))
            sent.extend((t, topic, part, lo, tuple(map(tuple, g))) for lo, g in d.emissions())

    for topic, part, off, arrival in sorted(rows, key=lambda r: r[3]):
        while now < arrival // every:
            tick(now)
            now += 1
        d = detectors.setdefault((topic, part), Detector(width, most))
        c = counts.setdefault((topic, part), [0, 0, 0, 0])
        status = d.check(off)[0]
        for k, x in enumerate((True, status == 1, status == -1, status == -2)):
            c[k] += x
    while now <= last:
        tick(now)
        now += 1
    return sorted(map(tuple, lines)), sorted(sent)


@pytest.mark.parametrize("seed,every,most", [(1, 50, 3), (2, 7, 2), (3, 100, 1000)])
def test_reports_and_emissions_at_ticks(spark, seed, every, most):
    rows = messy(seed)
    lines, sent = walked(rows, every, 10, most)
    lived = dedup.lived(log_of(spark, rows), 10, most, 64)
    status = F.when(F.col("born").isNull(), -2).when(F.col("seen") > 1, 1).when(F.col("off") == F.col("hi"), 0).otherwise(-1)
    rows_ = lived.select(*KEY, "off", "arrival", "win", status.alias("status"), F.col("died").alias("evicted"), F.lit("x").alias("payload"))
    got = stats.missing_ticks(rows_, every, KEY).select("tick", *KEY, "total_missing", "received", "duplicates", "gap_fill", "below_range")
    assert sorted(tuple(r) for r in got.collect()) == lines
    marked = lived.filter("seen = 1 AND born IS NOT NULL")
    out = gaps.emissions(marked, every, lived.agg(F.floor(F.max("arrival") / every).alias("last")))
    assert sorted((r.tick, r.topic, r.part, r.win, tuple(map(tuple, r.gaps))) for r in out.collect()) == sent


def accepted(rows, gap):
    out, last = set(), {}
    for k, t in sorted({(k, t) for k, t, _ in rows if t is not None}, key=lambda x: (str(x[0]), x[1])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.add((k, t))
    return out


@pytest.mark.parametrize("gap", [1, 5, 12])
def test_accepted_every(spark, gap):
    rng = random.Random(gap)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([None, *range(300)] if rng.random() < 0.1 else range(300)), k) for k in range(500)]
    rows += [("k", None, 1), ("k", 1, 2), ("k", 100, 3), ("only null", None, 4)]
    got = rates.accepted_every(spark.createDataFrame(rows, "key string, t long, n long").repartition(4), "key", gap).collect()
    assert sorted((str(r.key), r.t) for r in got) == sorted((str(k), t) for k, t in accepted(rows, gap))
    least = {}
    for k, t, n in rows:
        least[k, t] = min(n, least.get((k, t), n))
    assert all(r.n == least[r.key, r.t] for r in got)
    assert {r.t for r in got if r.key == "k"} == {1, 100}
    df = spark.createDataFrame(rows, "key string, t long, n long")
    assert rates.accepted_every(df, "key", 0).count() == sum(t is not None for _, t, _ in rows)
    assert rates.accepted_every(df.limit(0), "key", gap).collect() == []


def test_chains(spark):
    edges = spark.createDataFrame([("a", 1, 4), ("a", 4, 9), ("a", 5, 9), (None, 2, 3), ("b", 7, 8)] + [("long", k, k + 1) for k in range(100)], "k string, at long, to long")
    roots = spark.createDataFrame([("a", 1), (None, 2), ("c", 5), ("long", 37)], "k string, at long")
    got = {(r.k, r["at"]) for r in reachable(edges, roots, ["k"]).collect()}
    assert got == {("a", 1), ("a", 4), ("a", 9), (None, 2), (None, 3), ("c", 5)} | {("long", k) for k in range(37, 101)}


@pytest.mark.parametrize("ttl", [None, 15, 60])
def test_deliveries_against_the_assembler(spark, ttl):
    rng, rows, want = random.Random(ttl or 1), [], []
    for i in range(40):
        n, held = rng.randint(1, 4), Assembler()
        for arrival in sorted(rng.sample(range(i * 1000, i * 1000 + 200), rng.randint(1, 40))):
            part = rng.randint(1, n) if rng.random() < 0.95 else n + 1
            payload = bytes([arrival % 251])
            rows.append((f"m{i}", 6, part, n, bytearray(payload), arrival, None))
            whole = payload if n == 1 else held.add(part, n, payload, arrival, ttl or 10**9)
            if whole is not None:
                want.append((f"m{i}", arrival, whole))
    rows.append(("bad", 6, 1, 2, bytearray(b"x"), 5, "bad checksum"))
    rows.append((None, 6, 1, 2, bytearray(b"x"), 6, None))
    df = spark.createDataFrame(rows, "id string, type int, part_no int, n_parts int, payload binary, arrival long, error string").repartition(3)
    got = reassembly.messages(df, ttl).collect()
    n_of = {r[0]: r[3] for r in rows}
    assert sorted((r.id, r.epoch, bytes(r.value)) for r in got if n_of[r.id] > 1) == sorted(w for w in want if n_of[w[0]] > 1)
    assert {(r.id, r.epoch) for r in got if n_of[r.id] == 1} == {(r[0], r[5]) for r in rows if r[3] == 1 and r[0] and not r[6]}
    assert reassembly.messages(df.limit(0), ttl).collect() == []


def through(rows, ttl, most):
    """(id, arrival) of what a cache of at most so many entries lets through."""
    held, out = {}, []
    for id, part, n, arrival in sorted(rows, key=lambda r: r[3]):
        held = {i: e for i, e in held.items() if arrival - e[1] <= ttl}
        if id not in held:
            if len(held) >= most:
                continue
            held[id] = n, arrival, set()
        held[id][2].add(part)
        if held[id][2] >= set(range(1, held[id][0] + 1)):
            del held[id]
            out.append((id, arrival))
    return sorted(out)


@pytest.mark.parametrize("seed,most,ttl", [(1, 3, 40), (2, 1, 15), (3, 5, 60), (4, 50, 40)])
def test_a_cap_of_open_entries(spark, seed, most, ttl):
    rng, rows, at = random.Random(seed), [], 0
    for k in range(700):
        at += 1 if rng.random() < 0.96 else rng.choice([ttl, ttl + 1, 3 * ttl])
        id = rng.randrange(12) + k // 90 * 10
        rows.append((f"m{id}", rng.randint(1, 2 + id % 3), 2 + id % 3, at))
    df = spark.createDataFrame([(i, 6, p, n, bytearray(bytes([a % 251])), a, None) for i, p, n, a in rows], "id string, type int, part_no int, n_parts int, payload binary, arrival long, error string")
    got = reassembly.messages(df.repartition(4), ttl, most).select("id", "epoch").collect()
    assert sorted(map(tuple, got)) == through(rows, ttl, most)
    with pytest.raises(ValueError):
        reassembly.messages(df, None, 5)


def chunked(rng, data, stream):
    rows, at = [], 0
    while at < len(data):
        n = rng.choice([1, 10, 700, 5000])
        rows.append((stream, at, bytearray(data[at : at + n])))
        at += n
    return rows


def test_chunks_of_streams(spark):
    rng, rows, want = random.Random(6), [], {}
    for s, many in (("long", 60), ("short", 3), (None, 2)):
        made = []
        for k in range(many):
            id = f"t_{k}_" + "i" * rng.choice([0, 5, 900])
            body = rng.choice([b"\0", b"abc", bytes(range(256))]) * rng.choice([0, 1, 200, 250])
            made.append(bytes([6]) + (1).to_bytes(2, "big") * 2 + len(id).to_bytes(2, "big") + id.encode() + b"0000" + len(body).to_bytes(2, "big") + body)
        data = b"".join(made) + made[0][:9]  # the last frame is cut off
        assert list(readers.split_stream(data)) == made
        rows += chunked(rng, data, s)
        if s:
            want[s] = made
    rows += rows[::3]  # sent twice
    rows += [("bad", 0, bytearray(want["short"][0])), ("bad", len(want["short"][0]), bytearray(b"\6\0\1\0\1\xff\xff" + b"x" * 90))]
    want["bad"] = want["short"][:1]
    hole = b"".join(want["long"])
    rows += [("hole", 0, bytearray(hole[: len(hole) // 2])), ("hole", len(hole) // 2 + 1, bytearray(hole[len(hole) // 2 + 1 :]))]
    want["hole"] = list(readers.split_stream(hole[: len(hole) // 2]))
    rows += [("empty", 0, bytearray(b"")), ("late", 50, bytearray(want["short"][0])), ("none", None, bytearray(b"x")), ("null", 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream string, start long, data binary").repartition(4)
    for size in (70_000, 3000, 1 << 20):
        got = {}
        for r in byte_streams.split_chunks(df, size).orderBy("stream", "at").collect():
            got.setdefault(r.stream, []).append(bytes(r.frame))
        assert got == want
    assert byte_streams.split_chunks(df.limit(0)).collect() == []


def test_frames_to_chunks_and_back(spark):
    rows = [(k % 3, k, bytearray(wire_frame(k))) for k in range(200)]
    df = spark.createDataFrame(rows, "s int, k long, frame binary")
    chunks = byte_streams.to_chunks(df, "s", ["k"], 64, block=16)
    assert max(len(r.data) for r in chunks.collect()) == 64
    assert sorted((r.stream, bytes(r.frame)) for r in byte_streams.split_chunks(chunks, 100_000).collect()) == sorted((s, bytes(f)) for s, _, f in rows)


def wire_frame(k):
    body = bytes(range(k % 97))
    return bytes([6]) + b"\0\1\0\1\0\3" + f"{k:03d}".encode() + b"0000" + len(body).to_bytes(2, "big") + body
