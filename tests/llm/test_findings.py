"""Cases of the third round's findings."""

import numpy as np
import pyarrow as pa

from driftline.llm import common, passages, textops


def brute(a, b, cost):
    """The words that the best alignment from the start takes, place by place."""
    m = passages.MARGIN
    score = [[-cost * (i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(m + 1)]
    best, took = 0, (0, 0)
    for i in range(1, m + 1):
        for j in range(1, m + 1):
            same = i <= len(a) and j <= len(b) and a[i - 1] == b[j - 1]
            score[i][j] = max(score[i - 1][j] - cost, score[i][j - 1] - cost, score[i - 1][j - 1] + (1 if same else -cost))
        if (top := max(score[i])) >= best:
            best, took = top, (i, score[i].index(top))
    return took


def test_alignment_leaves_out_what_cannot_matter():
    """Ends of equal words, pairs that are past their best and empty sides change nothing."""
    rng = np.random.default_rng(4)
    pairs = [(np.zeros(0, np.uint32), np.arange(9, dtype=np.uint32)), (np.arange(64, dtype=np.uint32),) * 2]
    for words in (2, 3, 30, 1000):
        for _ in range(6):
            a = rng.integers(0, words, rng.integers(1, 65)).astype(np.uint32)
            b = np.where(rng.random(len(a)) < 0.2, a + 1, a).astype(np.uint32)
            pairs += [(a, b), (a, np.delete(b, rng.integers(0, len(b)))), (a, rng.integers(0, words, 40).astype(np.uint32))]
    for cost in (1, 2, 4):
        got = passages.extended(pairs, cost)
        assert [*zip(*(x.tolist() for x in got))] == [brute(a, b, cost) for a, b in pairs]
    assert all(passages.matched(a, b) == passages.common(a.tolist(), b.tolist()) for a, b in pairs)


def test_seeds_and_matches_leave_in_small_batches():
    """What a task gathers goes to the executor about PASS bytes at a time; all places and matches arrive, once each."""
    n, bits = passages.HELD, 9
    h = textops.mix(np.repeat(np.arange(n // 2, dtype=np.uint64), 2))
    doc, pos = np.arange(n) // 2 % 500 + np.arange(n) % 2 * 500, np.repeat(np.arange(n // 2), 2)
    seeds = [*passages._seed_rows([(h, doc, pos)], bits)]
    width = 12 + passages.BYTES
    assert max(b.nbytes for b in seeds) < 1.5 * passages.PASS and sum(len(d) for b in seeds for d in b.column("data").to_pylist()) == n * width
    met = [*passages._stars(bits)(seeds)]
    assert {k for b in met for k in b.column("kind").to_pylist()} == {passages.MATCHES} and max(b.nbytes for b in met) < 1.5 * passages.PASS
    doc, src, y, x = (np.concatenate(c) for c in zip(*passages._matches(met)))
    assert (x == y).all() and (src == y % 500).all() and sorted(y[doc == src]) == [*range(n // 2)] == sorted(y[doc == src + 500])


def test_batches_of_written_plans_are_small(spark):
    """Wide rows reach the workers in batches of about BATCH bytes; the session's own limit is back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    was = spark.conf.get(name)
    rows = common.written(spark.range(0, 2000, 1, 1).selectExpr("cast(repeat('x', 10000) AS binary) AS data").mapInArrow(sizes, "size long, n long")).collect()
    assert sum(r.n for r in rows) == 2000 and max(r["size"] for r in rows) < 1.5 * common.BATCH
    assert spark.conf.get(name) == was
