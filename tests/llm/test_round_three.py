"""Chat formatting, vector codes and centroid clustering against brute force, and on odd tables."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import centroids, chat, passages, registry, vector_codes

CLASH = ["seq", "n", "task", "after", "ok", "rid", "pos", "part", "weight", "entry", "code", "error", "cluster", "z", "upper", "lower", "_c", "_t", "h", "x.y"]


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def norm(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op11_chat", "op12_vector_codes", "op13_centroids"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = registry.queries()[name](spark, sf)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert norm([r[c] for c in names] for r in df.collect()) == norm(got.fetchall())


# --- 11

PIECES = [*chat.CHAT.controls, "\\", "\\a", "a", " ", "\n", "[", "]", "</", "s>", "é", "😀", "[INST", "/INST]", "<<SYS", "\\\\"]
talk = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[SAYS]"]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(talk)
def test_any_text_comes_back(turns):
    pieces = [chat.CHAT.segments(r, t) for r, t in turns]
    assert chat.CHAT.read("".join(s for p in pieces for s, _ in p)) == turns
    for p, (_, text) in zip(pieces, turns):
        escaped = chat.CHAT.escape(text)
        assert not any(c in escaped for c in chat.CHAT.controls)
        assert [s for s, loss in p if loss] in ([], [escaped])


def test_templates_that_cannot_be_read_back_are_refused():
    for change in ({"controls": ("aa",)}, {"controls": ("a b",)}, {"controls": ("\\x",)}, {"turns": {"user": [(chat.TEXT, False), ("<s>", False)]}}, {"turns": {"user": [("<s>", False), (chat.TEXT, False), (" plain", False)]}}):
        with pytest.raises(ValueError):
            chat.Template(**{k: change.get(k, getattr(chat.CHAT, k)) for k in ("turns", "other", "controls", "steps", "resume", "start", "accept")})


def told(turns):
    """What reading back must give for (role, text) in order, by one walk of the machine."""
    state, odd, size = "start", 0, 0
    for role, text in turns:
        odd += (state, role) not in chat.CHAT.steps
        state = chat.CHAT.steps.get((state, role)) or chat.CHAT.resume.get(role, state)
        size += sum(len(s) for s, _ in chat.CHAT.segments(role, text))
    said = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), size, odd, odd == 0 and state == "answered"


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_conversations_over_many_tasks(spark, partitions):
    rng = random.Random(partitions)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.choice(PIECES) * rng.randint(0, 3)) for t in range(900)]
    rows += [(8, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(100, 160) for t in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), partitions=partitions)
    if partitions > 1:
        assert out.filter("conv_id = 7").select(F.expr("seq >> 40")).distinct().count() > 1  # a long conversation isn't one task
    got = {r[0]: tuple(r[1:]) for r in chat.read_back(out).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = told([(r, t) for _, _, r, t in sorted(x for x in rows if x[0] == c)])
    assert got == want
    # Each turn's own flag and state, too.
    state = "start"
    for r in out.filter("conv_id = 7").orderBy("seq").collect():
        assert r.in_order == ((state, r.role) in chat.CHAT.steps)
        state = chat.CHAT.steps.get((state, r.role)) or chat.CHAT.resume.get(r.role, state)
        assert r.state == state


def test_odd_conversations(spark):
    long = "word </s> \\ " * 30_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "who?"), (2, None, "user", "first"), (None, 0, "user", "x"), (None, 1, "assistant", long), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, None, None), (5, 1, "assistant", "yes"), (5, 0, "user", long)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(4)
    for n in (1, 5):
        got = {r[0]: tuple(r[1:]) for r in chat.read_back(chat.format_turns(df, partitions=n)).collect()}
        assert got == {
            1: told([("user", ""), ("assistant", "")]),
            2: told([("user", "first"), ("", "who?")]),
            None: told([("user", "x"), ("assistant", long)]),
            3: told([("assistant", "a"), ("assistant", "a"), ("assistant", "b")]),
            4: told([("", "")]),
            5: told([("user", long), ("assistant", "yes")]),
        }
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


# --- 12


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    z = [(i, lab, np.floor(scale * np.asarray(v, np.float32).astype(np.float64)).astype(object)) for i, v, lab in rows]
    ids = sorted({i for i, _, _ in z if i is not None})[:entries]
    first = {i: min(tuple(x) for j, _, x in z if j == i) for i in ids}
    width = len(z[0][2]) // parts
    cut = lambda x, p: [int(y) for y in x[p * width : (p + 1) * width]]
    books = [[cut(first[i], p) for i in ids] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((d2(cut(x, p), b), e) for e, b in enumerate(books[p]))[::-1]
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(ids)):
                own = [cut(x, p) for _, _, x in z if near(x, p)[0] == e]
                if own:
                    new[p][e] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    out = [(i, lab, "".join(f"{near(x, p)[0]:02x}" for p in range(parts)), sum(near(x, p)[1] for p in range(parts))) for i, lab, x in z]
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e
    text = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return norm((i, c, e, by[lab], text) for i, lab, c, e in out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("heavy", [512, 3, 1])
def test_codes_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(vector_codes, "HEAVY", heavy)
    rng = random.Random(heavy)
    few = [[rng.choice([-0.25, 0.0, 0.5, 0.1]) for _ in range(16)] for _ in range(12)]
    rows = [(i, rng.choice(few) if i % 3 else [rng.gauss(0, 1) for _ in range(16)], rng.choice([None, 0, 1, 2])) for i in range(5, 60)]
    rows += [(100 + i, few[0], 1) for i in range(40)] + [rows[3], rows[3], (6, few[1], None), (None, few[2], 0), (None, few[2], None), (200, [30.0] * 16, 1)]
    bad = [(0, None, 1), (1, [None] * 16, 1), (2, [float("nan")] * 16, None), (3, [float("inf")] * 16, 1), (4, [-float("inf")] + [0.0] * 15, 1)]
    df = clashing(spark.createDataFrame(rows + bad, VECTORS)).repartition(5)
    assert norm(tuple(r) for r in vector_codes.digests(df).collect()) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.digests(empty).collect() == []
    few = spark.createDataFrame([(3, [0.5] * 8, None), (9, [0.25] * 8, None), (10, [], 1), (11, [0.1] * 7, 1), (12, [0.5] * 16, 1)], VECTORS)
    got = {r.vec_id: r for r in vector_codes.digests(few).collect()}
    assert (got[3].code, got[3].error, got[9].code, got[9].label_error) == ("00" * 8, 0, "01" * 8, 0)
    assert all(got[k].code is None and got[k].error is None for k in (10, 11, 12))
    assert {r.code for r in vector_codes.digests(few.filter("size(embedding) = 7")).collect()} == {None}
    with pytest.raises(Exception, match="exact distances"):
        vector_codes.digests(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS)).collect()


# --- 13


def brute_clusters(rows, k, rounds, scale=256, salt="2:"):
    z = [(i, [int(x) for x in np.floor(scale * np.asarray(v, np.float32).astype(np.float64))]) for i, v, _ in rows]
    centres = [c for _, _, c in sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), i, v) for i, v in z if i is not None)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres))[::-1]
    for _ in range(rounds):
        own = [near(v)[0] for _, v in z]
        centres = [[sum(c) // len(g) for c in zip(*g)] if (g := [v for o, (_, v) in zip(own, z) if o == j]) else centres[j] for j in range(len(centres))]
    return sorted((i is None, i or 0, *near(v)) for i, v in z), centres


def test_clusters_against_brute_force(spark):
    rng = random.Random(3)
    spots = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [round(x + rng.gauss(0, 0.05), 2) for x in rng.choice(spots)], 0) for i in range(300)]
    rows += [(400 + i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(6)], 0) for i in range(150)]  # ties
    rows += [(600 + i, spots[0], 0) for i in range(200)] + rows[:3] + [(None, spots[1], None)] * 2 + [(900, [100.0] * 6, 1)]
    bad = [(901, None, 1), (902, [None] * 6, 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 1), (905, [0.0] * 5, 1), (906, [], 1)]
    df = clashing(spark.createDataFrame(rows + bad, VECTORS)).repartition(6)
    for k, rounds in ((9, 5), (1, 2), (40, 3)):
        found, centres = centroids.cluster(df, k=k, rounds=rounds, dim=6)
        want, at = brute_clusters(rows, k, rounds)
        assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == want
        assert centres.tolist() == at


def test_bounds_skip_distances_and_keep_ties():
    rng = np.random.default_rng(5)
    spots = rng.integers(-4000, 4000, (12, 8))
    z = (spots[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    centres, before = spots[:12].astype(np.int64), None
    own, upper, lower, done = np.zeros(len(z), np.int32), np.full(len(z), np.inf), np.zeros((len(z), 12)), []
    for r in range(6):
        done.append(centroids.assign(z, own, upper, lower, centroids.Move(centres, before)))
        d = ((z[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        assert (upper**2 >= d[np.arange(len(z)), own] * (1 - 1e-15)).all() and (lower**2 <= d * (1 + 1e-15)).all()
        before, centres = centres, centres + rng.integers(-3, 4, centres.shape)
    assert done[0] > 10 * done[-1]  # later rounds compute next to none
    same = np.zeros((50, 8), np.int64)
    pair = np.array([[3] + [0] * 7, [-3] + [0] * 7, [0, 3] + [0] * 6], np.int64)
    own, upper, lower = np.full(50, 2, np.int32), np.full(50, np.inf), np.zeros((50, 3))
    centroids.assign(same, own, upper, lower, centroids.Move(pair))
    assert (own == 0).all()  # a tie goes to the smaller number, whatever came first


def test_clusters_of_odd_tables(spark):
    assert centroids.digests(spark.createDataFrame([], VECTORS)).collect() == []
    assert centroids.digests(spark.createDataFrame([(1, [0.5] * 8, 1), (None, [0.5] * 64, 1)], VECTORS)).collect() == []
    got = centroids.digests(spark.createDataFrame([(1, [0.5] * 64, None)] * 3, VECTORS)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(1, 0, 0, 0)] * 3


# --- 3, fuzzy passages


class Corpus:
    """Documents of invented words with planted passages; share is how many words of the planted ones are found."""

    def __init__(self, seed):
        self.rng, self.rows, self.planted = random.Random(seed), [], {}

    def words(self, n):
        return ["".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.rng.randint(3, 8))) for _ in range(n)]

    def add(self, passage, kind=None):
        before = self.words(self.rng.randint(20, 80))
        self.rows.append((len(self.rows), " ".join(before + passage + self.words(self.rng.randint(20, 80)))))
        if kind:
            self.planted[len(self.rows) - 1] = kind, len(before), len(before) + len(passage)

    def changed(self, passage, share):
        """Inner words exchanged."""
        out = list(passage)
        for i in self.rng.sample(range(1, len(out) - 1), round(share * len(out))):
            out[i] = self.words(1)[0]
        return out

    def found(self, spark):
        got, share = {}, {}
        for r in passages.passages(spark.createDataFrame(self.rows, "doc_id long, text string").repartition(4)).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        for doc, (kind, lo, hi) in self.planted.items():
            share.setdefault(kind, []).append(len(got.get(doc, set()) & {*range(lo, hi)}) / (hi - lo))
        assert set(got) <= set(self.planted)
        return share


def test_fuzzy_passages_whose_parts_are_first_in_many_documents(spark):
    c = Corpus(11)
    for parts in (2, 3):
        for share in (0.05, 0.1):
            for lap in (30, 15):  # parts side by side, and such that no seed is first in the whole passage
                for _ in range(20):
                    whole = c.words(30 * parts)
                    for a in range(0, len(whole) - 29, lap):
                        c.add(whole[a : a + 30])
                    c.add(whole)
                    c.add(c.changed(whole, share), (parts, share, lap))
    for kind, shares in c.found(spark).items():
        assert sum(s >= 0.8 for s in shares) >= 18, kind


def test_fuzzy_passages_at_the_limit(spark):
    c = Corpus(12)
    for n, share in ((40, 0.2), (40, 0.1), (60, 0.2), (100, 0.2)):
        for _ in range(60):
            whole = c.words(n)
            c.add(whole)
            c.add(c.changed(whole, share), (n, share))
    for kind, shares in c.found(spark).items():
        assert sum(s >= 0.8 for s in shares) >= 54, kind


def test_fuzzy_passages_of_text_that_repeats_itself(spark):
    c = Corpus(13)
    for period in (1, 2, 3, 4, 7):
        for share in (0.0, 0.05, 0.15):
            for n in (60, 120, 300):
                text = c.words(period) * 400
                c.add(text[:n])
                c.add(c.changed(text[c.rng.randrange(period) :][:n], share), (period, share))
    for kind, shares in c.found(spark).items():
        assert sum(shares) / len(shares) >= 0.9, kind
