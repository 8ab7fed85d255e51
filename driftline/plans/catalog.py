"""Registered queries of the reference's operators, and their SQL oracles over the same tables.

The wire log is derived from `events`: losses, late duplicates, late resends,
empty payloads and arrivals below the first window.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, gap_bitmap, wire
from ..operators import dedup, filters, gaps, rates, reassembly, resend, stats, transport
from ..sources import byte_streams, readers
from ..tables import kept

KEY = dedup.KEY
AES_KEY = b"0123456789abcdef0123456789abcdef"
RULES = [config.Rule(False, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), config.Rule(False, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"), config.Rule(True, r"^The ")]


def tab(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, block: int = 1 << 18) -> DataFrame:
    """Source records (topic, part, off, event_id, ts, payload) of the events table.

    Offsets number a key's events in two levels: inside blocks of events, and by what comes before a block, one row for each. So a key with most of
    the events is no single sort.
    """
    payload = F.when(F.col("event_id") % 13 == 6, "").otherwise(F.concat("event_type", F.lit(":"), "props"))
    rows = tab(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"), "event_id", "ts", payload.alias("payload"), F.floor(F.col("event_id") / block).alias("_b"))
    before = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    ahead = rows.groupBy(*KEY, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*KEY, "_b", F.coalesce(before, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*KEY, "_b").orderBy("event_id"))
    return rows.withColumn("_in", inside).join(ahead, [*KEY, "_b"]).select(*KEY, (F.col("_in") - 1 + F.col("_ahead")).cast("long").alias("off"), "event_id", "ts", "payload")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, part, off, ts, payload, arrival): what arrives downstream. One pass; each record is repeated for the deliveries that it has. Written, as a log is a table that queries read more than once."""
    n, late = F.col("event_id"), (F.col("part") == 3) & (F.col("off") < 120)
    got = n % 7 != 3
    when = lambda ok, add: F.when(ok, n * 10 + add)
    arrivals = F.array_compact(F.array(when(got & ~late, 0), when(got & (n % 11 == 5) & ~late, 4003), when((n % 14 == 3) & ~late, 20011), when(got & late, 50007), when((n % 14 == 0) & late, 60009)))
    return kept(source(spark, sf_dir).withColumn("arrival", F.explode(arrivals)).select(*KEY, "off", "ts", "payload", "arrival"))


SRC = """src AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part,
         row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS off,
         event_id, ts, CASE WHEN event_id % 13 = 6 THEN '' ELSE concat(event_type, ':', props) END AS payload FROM events)"""
LOG = SRC + """, raw AS (
  SELECT topic,part,off,ts,payload, event_id*10 AS arrival FROM src WHERE event_id % 7 <> 3 AND NOT (part=3 AND off<120)
  UNION ALL SELECT topic,part,off,ts,payload, event_id*10+4003 FROM src WHERE event_id % 7 <> 3 AND event_id % 11 = 5 AND NOT (part=3 AND off<120)
  UNION ALL SELECT topic,part,off,ts,payload, event_id*10+20011 FROM src WHERE event_id % 14 = 3 AND NOT (part=3 AND off<120)
  UNION ALL SELECT topic,part,off,ts,payload, event_id*10+50007 FROM src WHERE event_id % 7 <> 3 AND part=3 AND off<120
  UNION ALL SELECT topic,part,off,ts,payload, event_id*10+60009 FROM src WHERE event_id % 14 = 0 AND part=3 AND off<120)"""
STATUS = LOG + """, w AS (
  SELECT *, off - off % 100 AS win, first_value(off - off % 100) OVER (PARTITION BY topic,part ORDER BY arrival) AS fw,
         row_number() OVER (PARTITION BY topic,part,off ORDER BY arrival) AS seen,
         max(off) OVER (PARTITION BY topic,part ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS hi FROM raw), s AS (
  SELECT topic,part,off,ts,payload,arrival,win, CAST(CASE WHEN off < fw THEN -2 WHEN seen > 1 THEN 1 WHEN off = hi THEN 0 ELSE -1 END AS INTEGER) AS status FROM w)"""
GAPS = STATUS + """, marked AS (SELECT DISTINCT topic,part,win,off FROM s WHERE status <> -2), g AS (
  SELECT topic,part,win,coalesce(prev+1,win) AS gap_from, off-1 AS gap_to
  FROM (SELECT *, lag(off) OVER (PARTITION BY topic,part,win ORDER BY off) AS prev FROM marked) l WHERE coalesce(prev+1,win) <= off-1)"""
COMPACT = GAPS + """, c AS (SELECT topic,part,win, count(*) AS n_gaps, sum(gap_to-gap_from+1) AS missing,
  string_agg(CASE WHEN gap_from=gap_to THEN CAST(gap_from AS VARCHAR) ELSE concat(gap_from,'-',gap_to) END, ', ' ORDER BY gap_from) AS text FROM g GROUP BY 1,2,3)"""


def marked(spark, d):
    return gaps.received(raw_log(spark, d))


def windows(spark, d) -> DataFrame:
    """Gap-topic records: per window with gaps its bounds and relative gaps, read twice (an older, fuller record first)."""
    c = gaps.compact(gaps.ranges(marked(spark, d)), relative=True)
    new = kept(c.select(*KEY, F.col("win").alias("window_min"), (F.col("win") + 99).alias("window_max"), "gaps", F.lit(2).cast("long").alias("read_seq")))
    old = new.withColumns({"gaps": F.array(F.array(F.lit(0).cast("long"), F.lit(99).cast("long"))), "read_seq": F.lit(1).cast("long")})
    return old.unionByName(new)


def text_of(column: str):
    return F.array_join(F.transform(column, lambda g: wire.format_range(g[0], F.element_at(g, -1))), ", ")


def documents(spark, d):
    """Documents as messages: id, type and binary value."""
    rows = tab(spark, d, "documents")
    return rows.select(F.concat(F.lit("doc_"), F.col("doc_id") % 8, F.lit("_"), "doc_id").alias("id"), F.lit(wire.CLEARTEXT).alias("type"), F.col("text").cast("binary").alias("value"), "doc_id")


def bundle(spark, d, limit="all"):
    return gaps.bundle(gaps.latest_windows(windows(spark, d)).drop("read_seq"), limit)


Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


@query(f"WITH {GAPS} SELECT * FROM g")
def gaps_ranges(spark, d):
    return gaps.ranges(marked(spark, d))


@query(f"WITH {STATUS} SELECT topic, part, off, arrival, win, status FROM s")
def dedup_status(spark, d):
    return dedup.statuses(raw_log(spark, d)).select(*KEY, "off", "arrival", "win", "status")


@query(f"WITH {STATUS} SELECT topic, part, off, arrival, payload FROM s WHERE status <> 1 AND payload <> ''")
def dedup_clean(spark, d):
    return dedup.clean(raw_log(spark, d)).select(*KEY, "off", "arrival", "payload")


@query(f"WITH {STATUS} SELECT topic, part, off, arrival, status FROM s")
def dedup_fold(spark, d):
    """The exact detector, with more windows than any key has."""
    return dedup.fold(raw_log(spark, d), 100, 1_000_000).filter("kind = 'row'").select(*KEY, "off", "arrival", "status")


#: The detector as a recursive query: one arrival of each key a round; w has the windows in order of creation with their numbers.
EVICTING = f"""WITH RECURSIVE {LOG}, o AS MATERIALIZED (SELECT topic, part, off, arrival, row_number() OVER (PARTITION BY topic, part ORDER BY arrival) AS n FROM raw),
d AS (
  SELECT topic, part, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS off, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS INTEGER) AS status, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS least,
         CAST([] AS STRUCT(lo BIGINT, seen BIGINT[])[]) AS w, CAST(NULL AS STRUCT(lo BIGINT, seen BIGINT[])) AS gone FROM o GROUP BY topic, part
  UNION ALL
  SELECT topic, part, n, off, arrival, CAST(CASE WHEN under THEN -2 WHEN known THEN 1 WHEN off = top THEN 0 ELSE -1 END AS INTEGER), top, low,
         CASE WHEN under OR known THEN w WHEN open THEN list_transform(w, lambda x: CASE WHEN x.lo = lo THEN struct_pack(lo := lo, seen := list_append(x.seen, off)) ELSE x END)
              ELSE list_append(CASE WHEN len(w) >= 3 THEN w[2:] ELSE w END, struct_pack(lo := lo, seen := [off])) END,
         CASE WHEN NOT under AND NOT open AND len(w) >= 3 THEN w[1] END
  FROM (SELECT *, NOT open AND len(w) > 0 AND off < w[1].lo AS under FROM (
    SELECT d.topic, d.part, o.n, o.off, o.arrival, d.w, greatest(coalesce(d.last, o.off), o.off) AS top, least(d.least, o.off) AS low, o.off - o.off % 50 AS lo,
           len(list_filter(d.w, lambda x: x.lo = o.off - o.off % 50)) > 0 AS open, len(list_filter(d.w, lambda x: list_contains(x.seen, o.off))) > 0 AS known
    FROM d JOIN o ON o.topic = d.topic AND o.part = d.part AND o.n = d.n + 1))),
gone AS (SELECT topic, part, off, arrival, gone.lo AS lo, least, unnest(list_sort(gone.seen)) AS x FROM d WHERE gone IS NOT NULL),
holes AS (SELECT *, greatest(coalesce(lag(x) OVER (PARTITION BY topic, part, arrival ORDER BY x) + 1, lo), least) AS gap_from, x - 1 AS gap_to FROM gone)
SELECT topic, part, off, arrival, 'row' AS kind, status, off - off % 50 AS window_min, CAST(NULL AS BIGINT) AS gap_from, CAST(NULL AS BIGINT) AS gap_to FROM d WHERE n > 0
UNION ALL SELECT topic, part, off, arrival, 'gap', NULL, lo, gap_from, gap_to FROM holes WHERE gap_from <= gap_to"""


@query(EVICTING)
def dedup_fold_evicting(spark, d):
    """The exact detector with windows of 50, 3 of them: statuses and gaps of evicted windows."""
    return dedup.replay(raw_log(spark, d), 50, 3)


@query(f"WITH {LOG}, f AS (SELECT topic, part, arg_min(off - off % 100, arrival) AS fw FROM raw GROUP BY 1, 2) SELECT topic, part, count(DISTINCT off - off % 100) AS windows, count(DISTINCT off - off % 100) > 3 AS evicts FROM raw JOIN f USING (topic, part) WHERE off - off % 100 >= fw GROUP BY 1, 2")
def dedup_needs_fold(spark, d):
    return dedup.needs_fold(raw_log(spark, d), 100, 3)


@query(f"WITH {GAPS}, a AS (SELECT topic, part, off, lag(off) OVER (PARTITION BY topic, part ORDER BY off) AS prev, min(win) OVER (PARTITION BY topic, part) AS w0 FROM marked), e AS (SELECT topic, part, max(off) AS m FROM src GROUP BY 1, 2), t AS (SELECT topic, part, max(off) AS m FROM marked GROUP BY 1, 2) SELECT topic, part, coalesce(prev + 1, w0) AS gap_from, off - 1 AS gap_to FROM a WHERE coalesce(prev + 1, w0) <= off - 1 UNION ALL SELECT topic, part, t.m + 1, e.m FROM t JOIN e USING (topic, part) WHERE t.m < e.m")
def gaps_complete(spark, d):
    ends = source(spark, d).groupBy(*KEY).agg(F.max("off").alias("end"))
    return gaps.complete_ranges(kept(marked(spark, d)), ends)


@query(f"WITH {GAPS} SELECT topic, part, CAST(sum(gap_to - gap_from + 1) AS BIGINT) AS missing FROM g GROUP BY 1, 2")
def missing_by_partition(spark, d):
    return gaps.missing(gaps.ranges(marked(spark, d)))


@query(f"WITH {GAPS} SELECT topic, part, win, unnest(range(gap_from, gap_to + 1)) AS off FROM g")
def gaps_expanded(spark, d):
    return gaps.expand(gaps.ranges(marked(spark, d)))


@query(f"WITH {GAPS}, x AS (SELECT topic, part, off, off - row_number() OVER (PARTITION BY topic, part ORDER BY off) AS r FROM (SELECT DISTINCT topic, part, off FROM marked)) SELECT topic, part, min(off) AS run_from, max(off) AS run_to FROM x GROUP BY topic, part, r")
def islands(spark, d):
    return gaps.islands(marked(spark, d), KEY)


@query(f"WITH {COMPACT} SELECT topic, part, win, n_gaps, text FROM c")
def gaps_compact(spark, d):
    c = gaps.compact(gaps.ranges(marked(spark, d)))
    return c.select(*KEY, "win", F.size("gaps").cast("long").alias("n_gaps"), text_of("gaps").alias("text"))


@query(f"WITH {GAPS} SELECT topic, part, win, string_agg(CASE WHEN gap_from = gap_to THEN CAST(gap_from - win AS VARCHAR) ELSE concat(gap_from - win, '-', gap_to - win) END, ', ' ORDER BY gap_from) AS text FROM g GROUP BY 1, 2, 3")
def gaps_relative(spark, d):
    c = gaps.compact(gaps.ranges(marked(spark, d)), relative=True)
    return c.select(*KEY, "win", text_of("gaps").alias("text"))


@query(f"WITH {GAPS} SELECT topic, part, win, count(DISTINCT off) = 100 AS full FROM marked GROUP BY 1, 2, 3")
def windows_full(spark, d):
    return gaps.full_windows(marked(spark, d))


@query(f"WITH {GAPS} SELECT topic, part, count(DISTINCT win) AS windows, 16 * count(DISTINCT win) + 16 * count(*) AS bytes FROM marked GROUP BY 1, 2")
def memory_estimate(spark, d):
    return gaps.memory_estimate(marked(spark, d))


@query(f"WITH {GAPS}, m AS (SELECT topic, part, count(DISTINCT win) AS windows, 16 * count(DISTINCT win) + 16 * count(*) AS bytes FROM marked GROUP BY 1, 2), x AS (SELECT topic, part, CAST(sum(gap_to - gap_from + 1) AS BIGINT) AS missing FROM g GROUP BY 1, 2) SELECT m.*, coalesce(missing, 0) AS missing FROM m LEFT JOIN x USING (topic, part)")
def detector_introspection(spark, d):
    m = kept(marked(spark, d))
    return gaps.introspection(m, gaps.ranges(m))


@query(f"WITH {LOG}, u AS (SELECT DISTINCT topic, part, off FROM raw) SELECT topic, part, coalesce(p + 1, 0) AS gap_from, off - 1 AS gap_to FROM (SELECT *, lag(off) OVER (PARTITION BY topic, part ORDER BY off) AS p FROM u) WHERE coalesce(p + 1, 0) <= off - 1")
def legacy_intervals(spark, d):
    return gaps.interval_tracker(raw_log(spark, d), KEY)


HISTORY = LOG + """, h AS (SELECT topic, part, off, arrival, row_number() OVER (PARTITION BY topic, part, off ORDER BY arrival) > 1 AS duplicate,
  coalesce(max(off) OVER (PARTITION BY topic, part ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS hi FROM raw),
u AS (SELECT DISTINCT topic, part, off FROM raw), i AS (SELECT topic, part, coalesce(p + 1, 0) AS gap_from, off - 1 AS gap_to FROM (SELECT *, lag(off) OVER (PARTITION BY topic, part ORDER BY off) AS p FROM u) WHERE coalesce(p + 1, 0) <= off - 1),
f AS (SELECT i.*, arrival AS found FROM i JOIN h ON h.topic = i.topic AND h.part = i.part AND hi < gap_from AND gap_to < h.off)"""


@query(f"WITH {HISTORY} SELECT topic, part, off, arrival, duplicate, CASE WHEN off > hi + 1 THEN hi + 1 END AS gap_from, CASE WHEN off > hi + 1 THEN off - 1 END AS gap_to FROM h")
def legacy_history(spark, d):
    """What each arrival tells the legacy tracker: a duplicate, or an interval that it opens."""
    return gaps.tracker_history(raw_log(spark, d), KEY).select(*KEY, "off", "arrival", "duplicate", "gap_from", "gap_to")


@query(f"WITH {HISTORY} SELECT * FROM f")
def legacy_intervals_found(spark, d):
    """The tracker's final intervals with the arrival that opened them, through all shrinking and splitting since."""
    return gaps.tracker_found(raw_log(spark, d), KEY)


@query(f"WITH {HISTORY} SELECT topic, part, min(gap_from) FILTER (WHERE found < (SELECT max(arrival) FROM raw) - 30000) AS first_gap, CAST(sum(gap_to - gap_from + 1) AS BIGINT) AS total FROM f GROUP BY 1, 2")
def first_old_gaps(spark, d):
    """The least number of each key that has been missing for 30 seconds at the log's end; arrivals are milliseconds."""
    log = raw_log(spark, d)
    now = log.agg(F.timestamp_millis(F.max("arrival"))).first()[0]
    found = gaps.tracker_found(log, KEY).withColumn("found", F.timestamp_millis("found"))
    return gaps.first_old_gaps(found, now, KEY)


@query(f"WITH {COMPACT} SELECT topic, part, win AS window_min, win + 99 AS window_max, CAST(2 AS BIGINT) AS read_seq, n_gaps FROM c")
def latest_window(spark, d):
    w = gaps.latest_windows(windows(spark, d))
    return w.select(*KEY, "window_min", "window_max", "read_seq", F.size("gaps").cast("long").alias("n_gaps"))


@query(f"WITH {COMPACT} SELECT topic, part, CAST(0 AS BIGINT) AS window_min, max(win) + 99 AS window_max, string_agg(text, ', ' ORDER BY win) AS text FROM c GROUP BY 1, 2")
def bundle_all(spark, d):
    return bundle(spark, d).select(*KEY, "window_min", "window_max", text_of("gaps").alias("text"))


@query(f"WITH {GAPS} SELECT topic, part, CAST(0 AS BIGINT) AS window_min, max(win) + 99 AS window_max, arg_min(CASE WHEN gap_from = gap_to THEN CAST(gap_from AS VARCHAR) ELSE concat(gap_from, '-', gap_to) END, gap_from) AS text FROM g GROUP BY 1, 2")
def bundle_first(spark, d):
    return bundle(spark, d, "first").select(*KEY, "window_min", "window_max", text_of("gaps").alias("text"))


@query(f"WITH {COMPACT}, x AS (SELECT *, row_number() OVER (PARTITION BY topic, part, win ORDER BY gap_from) AS k FROM g), p AS (SELECT topic, part, win, string_agg(CASE WHEN gap_from = gap_to THEN CAST(gap_from AS VARCHAR) ELSE concat(gap_from, '-', gap_to) END, ', ' ORDER BY gap_from) AS t FROM x WHERE k <= 5 GROUP BY 1, 2, 3) SELECT topic, part, win AS window_min, win + 99 AS window_max, CAST(missing AS BIGINT) AS missing, t || CASE WHEN n_gaps > 5 THEN ', ...' ELSE '' END AS first FROM c JOIN p USING (topic, part, win) UNION ALL SELECT topic, NULL, NULL, NULL, CAST(sum(missing) AS BIGINT), NULL FROM c GROUP BY topic")
def gaps_report(spark, d):
    return gaps.report(gaps.latest_windows(windows(spark, d)))


@query(f"WITH {GAPS} SELECT s.topic, s.part, s.off, s.payload FROM src s WHERE EXISTS (SELECT 1 FROM g WHERE g.topic = s.topic AND g.part = s.part AND s.off BETWEEN gap_from AND gap_to)")
def resend_all(spark, d):
    """Straight from the windows' gaps; resend_from_bundle takes the way over the bundle."""
    return resend.in_gaps(source(spark, d), resend.window_gaps(gaps.latest_windows(windows(spark, d)))).select(*KEY, "off", "payload")


@query(SQL["resend_all"])
def resend_from_bundle(spark, d):
    return resend.select(source(spark, d), bundle(spark, d), "all").select(*KEY, "off", "payload")


@query(f"WITH {GAPS}, f AS (SELECT topic, part, min(gap_from) AS lo FROM g GROUP BY 1, 2) SELECT s.topic, s.part, s.off FROM src s JOIN f USING (topic, part) WHERE s.off >= lo")
def resend_first(spark, d):
    return resend.select(source(spark, d), bundle(spark, d, "first"), "first").select(*KEY, "off")


@query(f"WITH {GAPS} SELECT topic, part, off FROM src WHERE (topic, part) IN (SELECT topic, part FROM g)")
def resend_other(spark, d):
    return resend.select(source(spark, d), bundle(spark, d), "everything").select(*KEY, "off")


@query(f"WITH {SRC} SELECT topic, part, off, payload FROM src WHERE topic = 'click' AND part = 1 AND off BETWEEN 5 AND 60")
def resend_manual(spark, d):
    return resend.manual(source(spark, d), "click", 1, 5, 60).select(*KEY, "off", "payload")


@query(f"WITH {SRC}, b AS (SELECT min(ts) + INTERVAL 3600 SECONDS AS lo, max(ts) - INTERVAL 3600 SECONDS AS hi FROM events) SELECT topic, part, off FROM src, b WHERE topic = 'click' AND ts BETWEEN lo AND hi")
def resend_time_range(spark, d):
    lo, hi = tab(spark, d, "events").agg(F.min("ts") + F.expr("INTERVAL 3600 SECONDS"), F.max("ts") - F.expr("INTERVAL 3600 SECONDS")).first()
    return resend.time_range(source(spark, d), "click", lo, hi).select(*KEY, "off")


@query(f"WITH {GAPS} SELECT topic, part, u.off FROM (SELECT DISTINCT topic, part, unnest(range(gap_from, gap_to + 1)) AS off FROM g) u WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.topic = u.topic AND s.part = u.part AND s.off = u.off AND s.event_id % 7 <> 3)")
def resend_not_found(spark, d):
    """Missing numbers that a source which lost the same records can't give."""
    return resend.not_found(source(spark, d).filter("event_id % 7 <> 3"), gaps.ranges(marked(spark, d)))


@query(f"WITH {SRC} SELECT topic, part, max(off) + 1 AS next_off FROM src GROUP BY 1, 2")
def next_offsets(spark, d):
    return resend.next_offsets(source(spark, d))


@query(f"WITH {SRC} SELECT topic, part, off FROM src WHERE off >= 40 AND part = 2")
def read_from_offset(spark, d):
    return resend.read_from(source(spark, d), 40, 2).select(*KEY, "off")


@query(f"WITH {SRC} SELECT topic, part, off, payload FROM src WHERE topic = 'click' AND part = 0 AND off = 7")
def lookup_offset(spark, d):
    return resend.lookup(source(spark, d), "click", 0, 7).select(*KEY, "off", "payload")


@query(f"WITH {SRC} SELECT topic, part, off FROM src WHERE part >= 1 AND part < 3")
def partition_range(spark, d):
    return filters.partition_range(source(spark, d), 1, 2).select(*KEY, "off")


@query(f"WITH {SRC} SELECT topic, part, off FROM src WHERE ((off - 1) % 6) + 1 IN (1, 3, 5)")
def deliver_filter(spark, d):
    return filters.deliver(source(spark, d), "1,3,5,7,9,11,13,15,17").select(*KEY, "off")


@query(f"WITH {SRC}, m AS (SELECT min(ts) + INTERVAL 7200 SECONDS AS lo FROM events) SELECT topic, part, off FROM src, m WHERE ts >= lo")
def since_time(spark, d):
    lo = tab(spark, d, "events").agg(F.min("ts") + F.expr("INTERVAL 7200 SECONDS")).first()[0]
    return filters.since(source(spark, d), lo).select(*KEY, "off")


@query(r"""SELECT doc_id, filtered, CAST(length(CASE WHEN filtered THEN '' ELSE text END) AS BIGINT) AS n FROM (SELECT doc_id, text, coalesce(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN true WHEN regexp_matches(text, '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b') THEN true WHEN regexp_matches(text, '^The ') THEN false ELSE true END, false) AS filtered FROM documents)""")
def content_filter(spark, d):
    rows = tab(spark, d, "documents").select("doc_id", F.col("text").alias("value"))
    return filters.content_filter(rows, RULES, default_allow=False).select("doc_id", "filtered", F.length("value").cast("long").alias("n"))


#: Patterns in which RE2 and Java differ, on the text of a document and a marked tail.
DIALECT = [
    r"\p{L}\p{Lu}", r"^\p{Lu}\p{Ll}+", r"[[:digit:]]{4}", r"[[:^alpha:]][[:upper:]]{2}", r"(?m)^[A-Z][a-z]+\.$", r"(?m)[a-z]$", r"[a-z]$", r"(?i)\bTHE\b", r"[&&x][^&&a-z ]",
    r"(?P<some_word>\pL+)@", r"\Q1.2\E", r"x{,2}", r"[]x]", r"(?s)a.b", r"a.b", r"\s\S\s", r"\x{E9}|\xFC", r"[\w.]+@[\w-]+\.[[:alpha:]]{2,}", r"(?i:É)", r"\Aw", r"[^\s\w]\z", r"[[:punct:]]{3}", r"\bé", r"\P{L}\p{^L}[^\pL]", r"\p{Latin}\p{Greek}", r"(?i)[[:upper:]]{9}", r"[a\]-]{2}", r"\v|\f|\a",
]
MARKED = ["", " x{,2} && ]x[ αβγ aα", "\n", " a\nb &&. ÉTÉ \x0b", " Ends.\n\n", " -]a \\ !?;"]


@query("WITH t AS (SELECT doc_id, text || " + "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN " + " || ".join("chr(10)" if x == "\n" else "chr(11)" if x == "\x0b" else f"'{x}'" for x in re.split("(\n|\x0b)", m) if x or not m) for k, m in enumerate(MARKED)) + " END AS text FROM documents), p AS (" + " UNION ALL ".join(f"SELECT {k} AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS n FROM t" for k, p in enumerate(DIALECT)) + ") SELECT CAST(pattern AS INTEGER) AS pattern, n FROM p")
def rule_dialect(spark, d):
    """How many texts each pattern of the rule dialect is found in."""
    tail = F.element_at(F.array(*map(F.lit, MARKED)), (F.col("doc_id") % len(MARKED) + 1).cast("int"))
    rows = tab(spark, d, "documents").select(F.concat("text", tail).alias("text"))
    counts = rows.agg(*[F.count(F.when(filters.found(F.col("text"), p), 1)).alias(f"p{k}") for k, p in enumerate(DIALECT)])
    return counts.select(F.posexplode(F.array(*[f"p{k}" for k in range(len(DIALECT))])).alias("pattern", "n"))


@query(f"WITH {SRC} SELECT DISTINCT topic, CASE topic WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' ELSE topic END AS new_topic FROM src")
def topic_translate(spark, d):
    return source(spark, d).select("topic", wire.translate(F.col("topic"), {"click": "clicks", "view": "views"}).alias("new_topic")).distinct()


@query(f"WITH {SRC} SELECT topic, part + 10 AS up, CASE WHEN part - 2 >= 0 THEN part - 2 END AS down, count(*) AS n FROM src GROUP BY 1, 2, 3")
def partition_shift(spark, d):
    rows = source(spark, d).select("topic", wire.shift_partition(F.col("part"), 10).alias("up"), wire.unshift_partition(F.col("part"), 2).alias("down"))
    return rows.groupBy("topic", "up", "down").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT topic, part, count(*) AS n FROM (SELECT topic, part FROM raw UNION ALL SELECT topic, part FROM src) GROUP BY 1, 2")
def fan_in_union(spark, d):
    from ..sources.readers import fan_in

    return fan_in([raw_log(spark, d).select(*KEY), source(spark, d).select(*KEY)]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SRC}, t AS (SELECT * FROM (VALUES ('now', 0), ('late', 10)) v(thread, s)) SELECT topic, part, off, thread, ts + to_seconds(s) AS send_ts FROM src, t")
def delayed_sends(spark, d):
    return rates.delayed(source(spark, d), {"now": 0, "late": -10}).select(*KEY, "off", "thread", "send_ts")


@query("WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT event_type AS topic, CAST(epoch_ms(ts) AS BIGINT) // 60000 AS t FROM events), a AS (SELECT topic, min(t) AS t FROM e GROUP BY topic UNION ALL SELECT a.topic, min(e.t) FROM a JOIN e ON e.topic = a.topic AND e.t >= a.t + 45 GROUP BY a.topic) SELECT topic, t FROM a")
def key_exchange_interval(spark, d):
    """Control messages that are accepted: the first of each key, then such as come at least 45 minutes after the last accepted one."""
    e = tab(spark, d, "events").select(F.col("event_type").alias("topic"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 60").alias("t"))
    return rates.accepted_every(e, "topic", 45)


@query("WITH e AS (SELECT event_type AS topic, event_id AS n, CAST(epoch_ms(ts) AS BIGINT) // 600000 AS t FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t, n) AS k FROM e) SELECT topic, n, CAST(max(t - k * 2) OVER (PARTITION BY topic ORDER BY t, n ROWS UNBOUNDED PRECEDING) + k * 2 AS DOUBLE) AS release FROM k")
def spaced_sends(spark, d):
    e = tab(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("n"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 600").alias("t"))
    return rates.spaced(e, ["topic"], 2).select("topic", "n", F.col("release").cast("double").alias("release"))


@query("WITH e AS (SELECT event_type AS topic, event_id AS n, CAST(epoch_ms(ts) AS BIGINT) // 600000 AS t FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t, n) AS k FROM e) SELECT topic, n, greatest(CAST(t AS DOUBLE), (max(t * 4 - k) OVER (PARTITION BY topic ORDER BY t, n ROWS UNBOUNDED PRECEDING) + k - 4 + 1) / 4) AS release FROM k")
def token_bucket(spark, d):
    e = tab(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("n"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 600").alias("t"))
    return rates.token_bucket(e, ["topic"], 4).select("topic", "n", "release")


@query(f"WITH {STATUS}, c AS (SELECT sha256(payload) AS hash, count(*) AS n FROM (SELECT payload FROM s WHERE payload <> '') GROUP BY 1), p AS (SELECT DISTINCT sha256(payload) AS hash FROM src WHERE event_id % 5 <> 0), r AS (SELECT p.hash IS NOT NULL AS known, coalesce(n, 0) AS n FROM p FULL OUTER JOIN c USING (hash)), k AS (SELECT CASE WHEN known AND n = 0 THEN 'SENT' WHEN known AND n = 1 THEN 'RECEIVED' WHEN known THEN 'DUPLICATED' WHEN n = 1 THEN 'UNKNOWN' ELSE 'UNKNOWN_DUPLICATED' END AS state FROM (SELECT p.hash IS NOT NULL AS known, coalesce(n, 0) AS n FROM p FULL OUTER JOIN c ON p.hash = c.hash)) SELECT state, count(*) AS n FROM k GROUP BY 1")
def reconcile(spark, d):
    hashed = lambda df: df.select(wire.content_hash(F.col("payload").cast("binary")).alias("hash"))
    produced = hashed(source(spark, d).filter("event_id % 5 <> 0"))
    consumed = hashed(raw_log(spark, d).filter("payload <> ''"))
    return stats.state_counts(stats.reconcile(produced, consumed))


@query(f"WITH {LOG}, t AS (SELECT topic, time_bucket(INTERVAL 3600 SECONDS, ts) AS time_start, count(*) AS received, CAST(count(*) FILTER (WHERE payload <> '') AS BIGINT) AS sent FROM raw GROUP BY 1, 2) SELECT *, received // 3600 AS eps, CAST(sum(received) OVER w AS BIGINT) AS total_received, CAST(sum(sent) OVER w AS BIGINT) AS total_sent FROM t WINDOW w AS (PARTITION BY topic ORDER BY time_start ROWS UNBOUNDED PRECEDING)")
def interval_stats(spark, d):
    return stats.intervals(raw_log(spark, d), 3600, ["topic"], sent=F.when(F.col("payload") != "", 1).otherwise(0))


@query(f"WITH {GAPS}, r AS (SELECT topic, part, count(*) AS received, count(*) FILTER (WHERE status <> 1 AND payload <> '') AS emitted, count(*) FILTER (WHERE status = 1) AS duplicates, count(*) FILTER (WHERE status = -1) AS gap_fill, count(*) FILTER (WHERE status = -2) AS below_range FROM s GROUP BY 1, 2), x AS (SELECT topic, part, CAST(sum(gap_to - gap_from + 1) AS BIGINT) AS m FROM g GROUP BY 1, 2) SELECT r.*, coalesce(m, 0) AS total_missing FROM r LEFT JOIN x USING (topic, part)")
def missing_report(spark, d):
    s = kept(dedup.statuses(raw_log(spark, d)))
    g = gaps.ranges(s.filter("status <> -2").select(*gaps.WIN, "off").distinct())
    return stats.missing_report(s, g, KEY)


#: The clock of reports ticks after every so many arrivals' time.
TICK = 10_000


@query(f"""WITH {STATUS}, k AS (SELECT topic, part, min(arrival) // {TICK} AS first FROM s GROUP BY 1, 2),
t AS (SELECT topic, part, unnest(range(first, (SELECT max(arrival) // {TICK} + 1 FROM s))) AS tick FROM k),
v AS (SELECT t.tick, topic, part, win, max(off) - win + 1 - count(*) AS n FROM t JOIN s USING (topic, part) WHERE status IN (0, -1) AND arrival < (t.tick + 1) * {TICK} GROUP BY t.tick, topic, part, win),
m AS (SELECT tick, topic, part, sum(n) AS n FROM v GROUP BY 1, 2, 3),
c AS (SELECT t.tick, topic, part, count(*) AS received, count(*) FILTER (status <> 1 AND payload <> '') AS emitted, count(*) FILTER (status = 1) AS duplicates, count(*) FILTER (status = -1) AS gap_fill, count(*) FILTER (status = -2) AS below_range
  FROM t JOIN s USING (topic, part) WHERE arrival < (t.tick + 1) * {TICK} GROUP BY 1, 2, 3),
r AS (SELECT c.*, CAST(coalesce(n, 0) AS BIGINT) AS total_missing FROM c LEFT JOIN m USING (tick, topic, part))
SELECT tick, topic, part, total_missing, total_missing - lag(total_missing, 1, 0) OVER o AS delta_missing, received, received - lag(received, 1, 0) OVER o AS delta_received,
  emitted, emitted - lag(emitted, 1, 0) OVER o AS delta_emitted, duplicates, gap_fill, below_range, (received - lag(received, 1, 0) OVER o) // {TICK} AS eps FROM r WINDOW o AS (PARTITION BY topic, part ORDER BY tick)""")
def missing_report_ticks(spark, d):
    """What each key's report says at each tick."""
    return stats.missing_ticks(kept(dedup.statuses(raw_log(spark, d))), TICK, KEY)


@query(f"""WITH {STATUS}, f AS (SELECT topic, part, win, off, arrival // {TICK} AS t FROM s WHERE status IN (0, -1)), b AS (SELECT topic, part, win, min(t) AS born FROM f GROUP BY 1, 2, 3),
y AS (SELECT *, unnest(range(born, (SELECT max(arrival) // {TICK} + 1 FROM raw))) AS tick FROM b),
x AS (SELECT y.tick, y.topic, y.part, y.win, off, coalesce(lag(off) OVER (PARTITION BY y.tick, y.topic, y.part, y.win ORDER BY off) + 1, y.win) AS a FROM y JOIN f ON f.topic = y.topic AND f.part = y.part AND f.win = y.win AND f.t <= y.tick),
n AS (SELECT tick, topic, part, win, count(*) FILTER (a < off) AS n_gaps, coalesce(string_agg(CASE WHEN a = off - 1 THEN CAST(a AS VARCHAR) ELSE concat(a, '-', off - 1) END, ', ' ORDER BY a) FILTER (a < off), '') AS text FROM x GROUP BY 1, 2, 3, 4),
e AS (SELECT *, lag(n_gaps, 1, 1) OVER (PARTITION BY topic, part, win ORDER BY tick) AS before FROM n)
SELECT tick, topic, part, win, n_gaps, text FROM e WHERE n_gaps > 0 OR before > 0""")
def gap_emissions(spark, d):
    """The gap topic's records of each tick."""
    s = kept(dedup.statuses(raw_log(spark, d)))
    marked = s.filter("status IN (0, -1)").withColumn("died", F.lit(None).cast("long"))
    out = gaps.reports(marked, TICK, s.agg(F.floor(F.max("arrival") / TICK).alias("last")))
    text = F.array_join(F.transform("gaps", lambda g: wire.format_range(g[0], g[1])), ", ")
    out = out.select(*gaps.WIN, F.size("gaps").cast("long").alias("n_gaps"), text.alias("text"), "since", "until")
    # Texts are joined once for each state of a window, not again at each tick.
    return gaps.each_tick(out)


@query(f"WITH {LOG}, t AS (SELECT topic, time_bucket(INTERVAL 3600 SECONDS, ts) AS time_start, count(*) AS received FROM raw GROUP BY 1, 2) SELECT topic, time_start, received, received - coalesce(lag(received) OVER (PARTITION BY topic ORDER BY time_start), 0) AS delta_received FROM t")
def report_deltas(spark, d):
    rows = stats.intervals(raw_log(spark, d), 3600, ["topic"]).select("topic", "time_start", "received")
    return stats.deltas(rows, ["topic"], "time_start", "received")


@query(f"WITH {LOG}, u AS (SELECT count(*) AS sent FROM src), v AS (SELECT count(DISTINCT (topic, part, off)) AS received FROM raw), o AS (SELECT count(*) AS overflow FROM src WHERE event_id % 21 = 3) SELECT sent, received, overflow, sent - received AS loss, round((sent - received) / sent * 100, 2) AS loss_percent, CASE WHEN sent - received > 1000 AND overflow = 0 THEN 'outside the host' WHEN sent - received > 1000 THEN 'receiver too slow' WHEN sent - received > 0 THEN 'minor loss' ELSE 'no loss' END AS verdict FROM u, v, o")
def loss_report(spark, d):
    up = source(spark, d).agg(F.count(F.lit(1)).alias("total"), F.max("ts").alias("time"))
    dropped = tab(spark, d, "events").filter("event_id % 21 = 3").agg(F.count(F.lit(1)).alias("overflow"))  # what the receiver's socket threw away
    down = raw_log(spark, d).agg(F.count_distinct(*KEY, "off").alias("total"), F.max("ts").alias("time")).join(dropped)
    return stats.loss_report(up, down)


@query("SELECT doc_id, right(md5(text), 4) AS checksum, sha256(text) AS hash FROM documents")
def checksum(spark, d):
    v = F.col("value")
    return documents(spark, d).select("doc_id", wire.checksum(v).alias("checksum"), wire.content_hash(v).alias("hash"))


@query("WITH m AS (SELECT doc_id, concat('doc_', doc_id % 8, '_', doc_id) AS id, octet_length(encode(text)) AS n FROM documents), c AS (SELECT *, 1400 - 13 - length(id) AS cap FROM m) SELECT doc_id, CAST(greatest(1, (n + cap - 1) // cap) AS INTEGER) AS n_parts, CAST(1 + n // cap AS INTEGER) AS compat FROM c")
def frame_counts(spark, d):
    rows = documents(spark, d)
    cap, size = wire.capacity(1400, F.col("id")), F.octet_length("value")
    return rows.select("doc_id", wire.part_count(size, cap).alias("n_parts"), wire.part_count(size, cap, compat=True).alias("compat"))


FRAMES = "WITH m AS (SELECT concat('doc_', doc_id % 8, '_', doc_id) AS id, encode(text) AS b FROM documents), c AS (SELECT *, 1400 - 13 - length(id) AS cap FROM m), p AS (SELECT id, cap, hex(b) AS h, CAST(greatest(1, (octet_length(b) + cap - 1) // cap) AS INTEGER) AS n, unnest(range(1, greatest(1, (octet_length(b) + cap - 1) // cap) + 1)) AS k FROM c), f AS (SELECT id, CAST(k AS INTEGER) AS part_no, n, substr(h, CAST((k - 1) * cap * 2 + 1 AS BIGINT), CAST(cap * 2 AS BIGINT)) AS pay FROM p) SELECT id, part_no, n AS n_parts, concat('06', lpad(upper(to_hex(part_no)), 4, '0'), lpad(upper(to_hex(n)), 4, '0'), lpad(upper(to_hex(length(id))), 4, '0'), hex(encode(id)), hex(encode(right(md5(unhex(pay)), 4))), lpad(upper(to_hex(length(pay) // 2)), 4, '0'), pay) AS frame FROM f"


@query(FRAMES)
def fragments(spark, d):
    return wire.fragment(documents(spark, d).select("id", "type", "value"), 1400).select("id", "part_no", "n_parts", F.hex("frame").alias("frame"))


@query(FRAMES)
def split_stream_frames(spark, d):
    """Each message's frames as one byte stream, split again by the frames' own lengths."""
    sent = wire.fragment(documents(spark, d).select("id", "type", "value"), 1400)
    streams = sent.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part_no", F.hex("frame").alias("frame")))).alias("frames"), F.max("n_parts").alias("n_parts"))
    joined = streams.select("id", "n_parts", F.unhex(F.array_join(F.transform("frames", lambda f: f["frame"]), "")).alias("stream"))
    return readers.stream_frames(joined).select("id", (F.col("seq") + 1).alias("part_no"), "n_parts", F.hex("frame").alias("frame"))


@query(FRAMES)
def split_chunked_streams(spark, d):
    """All frames as eight byte streams in chunks of 1,000 bytes, split again."""
    sent = kept(wire.fragment(documents(spark, d).withColumn("stream", F.col("doc_id") % 8), 1400))
    got = byte_streams.split_chunks(byte_streams.to_chunks(sent, "stream", ["doc_id", "part_no"], 1000))
    return wire.parse(got.select("frame"), 65_535).select("id", "part_no", "n_parts", F.hex("frame").alias("frame"))


@query("WITH m AS (SELECT doc_id, concat('doc_', doc_id % 8, '_', doc_id) AS id, sha256(text) AS hash, octet_length(encode(text)) AS n, 1400 - 13 - length(concat('doc_', doc_id % 8, '_', doc_id)) AS cap FROM documents) SELECT id, hash, CAST(CASE WHEN doc_id % 7 = 0 OR n > cap AND doc_id % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n FROM m")
def redelivered(spark, d):
    """Messages that come twice: of some the first delivery lacks its first part, of some the second one's last part comes after the entry's life."""
    n, part, again = F.col("doc_id"), F.col("part_no"), F.col("again")
    frames = wire.fragment(documents(spark, d), 1400).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    frames = frames.filter(~((again == 0) & (n % 7 == 0) & (part == 1)))
    late = F.when((again == 1) & (n % 5 == 0) & (part == F.col("n_parts")) & (part > 1), 10**12).otherwise(0)
    parsed = wire.parse(frames.select("frame", (n * 100_000 + again * 50_000 + part + late).alias("arrival")), 65_535)
    got = reassembly.messages(parsed, 60_000)
    return got.groupBy("id", wire.content_hash(F.col("value")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


#: The receiver's cache as a recursive query: one fragment of each group a round; w has the open entries.
OVERFLOW = """WITH RECURSIVE m AS (SELECT doc_id, doc_id // 100 AS g, concat('doc_', doc_id % 8, '_', doc_id) AS id, sha256(text) AS hash, octet_length(encode(text)) AS n, 1400 - 13 - length(concat('doc_', doc_id % 8, '_', doc_id)) AS cap FROM documents),
f AS (SELECT g, id, n // cap + CASE WHEN n % cap > 0 THEN 1 ELSE 0 END AS n, doc_id, unnest(range(1, n // cap + CASE WHEN n % cap > 0 THEN 2 ELSE 1 END)) AS part FROM m WHERE n > cap),
o AS MATERIALIZED (SELECT g, id, n, part, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN g % 2 = 0 THEN part * 1000 + doc_id % 100 ELSE doc_id % 100 * 1000 + part END) AS k FROM f),
d AS (
  SELECT g, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS done, CAST([] AS STRUCT(id VARCHAR, parts BIGINT[])[]) AS w FROM o GROUP BY g
  UNION ALL
  SELECT g, k, CASE WHEN len(got) = n THEN id END, CASE WHEN NOT open AND len(w) >= 20 THEN w WHEN len(got) = n THEN list_filter(w, lambda x: x.id <> o_id)
         WHEN open THEN list_transform(w, lambda x: CASE WHEN x.id = o_id THEN struct_pack(id := o_id, parts := got) ELSE x END) ELSE list_append(w, struct_pack(id := o_id, parts := got)) END
  FROM (SELECT *, id AS o_id, list_distinct(list_append(coalesce(list_filter(w, lambda x: x.id = id)[1].parts, []), part)) AS got, len(list_filter(w, lambda x: x.id = id)) > 0 AS open
        FROM (SELECT d.g, o.k, d.w, o.id, o.n, o.part FROM d JOIN o ON o.g = d.g AND o.k = d.k + 1)))
SELECT id, hash FROM m WHERE n <= cap OR id IN (SELECT done FROM d WHERE done IS NOT NULL)"""


@query(OVERFLOW)
def reassembly_overflow(spark, d):
    """Messages that get through a receiver with 20 open entries: groups of 100 documents, every other one with its fragments interleaved."""
    n, part = F.col("doc_id"), F.col("part_no")
    at = F.when(F.floor(n / 100) % 2 == 0, part * 1000 + n % 100).otherwise(n % 100 * 1000 + part)
    sent = wire.fragment(documents(spark, d), 1400).select("frame", (F.floor(n / 100) * 1_000_000_000 + at).alias("arrival"))
    return reassembly.messages(wire.parse(sent, 65_535), 1_000_000, 20).select("id", wire.content_hash(F.col("value")).alias("hash"))


@query("SELECT concat('doc_', doc_id % 8, '_', doc_id) AS id, sha256(text) AS hash, 'doc' AS topic, CAST(doc_id % 8 AS INTEGER) AS part FROM documents")
def round_trip(spark, d):
    """Gzip, encrypt, fragment, parse, reassemble, decrypt, decompress: the texts come back."""
    ev = tab(spark, d, "documents").select(F.lit("doc").alias("topic"), (F.col("doc_id") % 8).cast("int").alias("part"), F.col("doc_id").alias("off"), F.col("text").alias("value"))
    frames = transport.encode(ev, transport.SendConfig(mtu=1400, gzip_over=1200, key=AES_KEY))
    got = transport.decode(frames.select("frame", F.monotonically_increasing_id().alias("arrival")), AES_KEY).records
    return got.select("id", wire.content_hash(F.col("value")).alias("hash"), "topic", "part")


@query("WITH m AS (SELECT concat('doc_', doc_id % 8, '_', doc_id) AS id, doc_id % 5 AS k FROM documents) SELECT CASE k WHEN 0 THEN 'too short' WHEN 1 THEN 'bad length' WHEN 2 THEN 'bad checksum' WHEN 3 THEN 'bad id length' ELSE 'ok' END AS error, count(*) AS n FROM m GROUP BY 1")
def parse_errors(spark, d):
    """Frames of one part, four fifths of them broken in known ways."""
    rows = documents(spark, d).withColumn("value", F.encode("id", "utf-8"))
    f, k = wire.fragment(rows, 1400), F.col("doc_id") % 5
    # The checksum itself is broken, by a character that none has: of changed payloads one in 65,536 has its old checksum.
    fr = F.col("frame")
    broken = F.when(k == 0, F.substring(fr, 1, 9)).when(k == 1, F.concat(fr, F.unhex(F.lit("00")))).when(k == 2, F.overlay(fr, F.unhex(F.lit("21")), F.octet_length("id") + 11)).when(k == 3, F.concat(F.substring(fr, 1, 5), F.unhex(F.lit("0FFF")), F.substring(fr, F.lit(8), F.octet_length(fr)))).otherwise(fr)
    parsed = wire.parse(f.select(broken.alias("frame")))
    return parsed.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT topic, part, off, count(*) AS n FROM raw GROUP BY 1, 2, 3")
def parsed_ids(spark, d):
    log = raw_log(spark, d).select(F.concat(wire.make_id(F.col("topic"), F.col("part"), F.col("off")), F.when(F.col("off") % 3 == 0, "_").otherwise("")).alias("id"), F.col("payload").alias("value"))
    standard, _ = filters.split_standard(log, wire.dedup_id(F.col("id")))
    return standard.groupBy(*KEY, "off").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('random_', user_id) AS id, event_type AS value FROM events WHERE event_id % 13 <> 6")
def passthrough(spark, d):
    """Rows without a standard id go on undeduplicated, empty ones don't."""
    rows = tab(spark, d, "events").select(F.concat(F.lit("random_"), "user_id").alias("id"), F.when(F.col("event_id") % 13 == 6, "").otherwise(F.col("event_type")).alias("value"))
    return filters.split_standard(rows, wire.dedup_id(F.col("id")))[1].select("id", "value")


@query("WITH m AS (SELECT CAST(doc_id % 128 AS INTEGER) AS t, octet_length(encode(text)) AS n, 1400 - 13 - length(concat('doc_', doc_id % 8, '_', doc_id)) AS cap FROM documents) SELECT t AS type, CASE WHEN t < 32 AND t = 6 OR t >= 32 AND t & 6 = 6 THEN 'clear' WHEN t = 3 THEN 'keys' WHEN t = 1 THEN 'errors' WHEN t = 5 THEN 'drop' WHEN t = 0 OR t >= 32 THEN 'decrypt' ELSE 'internal' END AS route, t | 32 AS zipped, CAST(sum(greatest(1, (n + cap - 1) // cap)) AS BIGINT) AS frames FROM m GROUP BY t")
def type_dispatch(spark, d):
    """Where frames of all types go, as read from the frames of the documents."""
    sent = kept(wire.fragment(documents(spark, d).withColumn("type", (F.col("doc_id") % 128).cast("int")), 1400).select("frame"))
    t = F.col("type").cast("int")
    rows = wire.parse(sent, 65_535).select(t.alias("type"), wire.route(t).alias("route"), wire.merge_flag(t, wire.GZIP).alias("zipped"))
    return rows.groupBy("type", "route", "zipped").agg(F.count(F.lit(1)).alias("frames"))


@query(f"WITH {SRC} SELECT topic, part, off, count(*) AS copies, count(*) FILTER (pipe <> 1) > 0 AS survives FROM src JOIN (VALUES (0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 1)) v(pipe, g) ON ((off - 1) % 3) + 1 = g GROUP BY 1, 2, 3")
def redundant_pipes(spark, d):
    """Each record over two of three pipes by generated filters, merged again: its copies, and whether it survives the loss of a pipe."""
    src = kept(source(spark, d).select(*KEY, "off"))
    pipes = [filters.deliver(src, ",".join(map(str, f))).withColumn("pipe", F.lit(p)) for p, f in enumerate(config.generate_filters(3, 1))]
    return readers.fan_in(pipes).groupBy(*KEY, "off").agg(F.count(F.lit(1)).alias("copies"), (F.count_if(F.col("pipe") != 1) > 0).alias("survives"))


@query(f"WITH {COMPACT} SELECT topic, part, win AS window_min, win + 99 AS window_max, n_gaps, missing_n AS missing FROM (SELECT *, CAST(missing AS BIGINT) AS missing_n FROM c)")
def gap_topic_round_trip(spark, d):
    """Windows to the gap topic's key and binary payload, and back."""
    from ..sources.sinks import gap_rows

    w = gaps.latest_windows(windows(spark, d))
    back = gap_rows(w).select(gap_bitmap.parse_gap_key(F.col("key")).alias("k"), gap_bitmap.parse_gap_payload(F.col("value")).alias("v")).filter("v.error IS NULL")
    size = F.aggregate("v.gaps", F.lit(0).cast("long"), lambda acc, g: acc + F.element_at(g, -1) - g[0] + 1)
    return back.select("k.topic", "k.part", "v.window_min", "v.window_max", F.size("v.gaps").cast("long").alias("n_gaps"), size.alias("missing"))


@query("WITH e AS (SELECT event_id AS arrival FROM events) SELECT arrival, CASE WHEN arrival >= 100 THEN concat('key', CAST((arrival - 100) // 2500 AS BIGINT)) END AS key FROM e")
def keys_in_force(spark, d):
    """The key that is in force at each arrival: a new one from arrival 100 on, every 2,500."""
    rows = tab(spark, d, "events").select(F.col("event_id").alias("arrival"))
    epochs = rows.filter("arrival >= 100").select(F.expr("(arrival - 100) div 2500").alias("id")).distinct()
    ring = epochs.select((F.col("id") * 2500 + 100).alias("epoch"), F.concat(F.lit("key"), F.col("id")).cast("binary").alias("key"))
    return transport.keys_in_force(rows, ring).select("arrival", F.col("key").cast("string").alias("key"))


@query("SELECT count(*) AS frames, count(DISTINCT id) AS messages FROM (SELECT concat('doc_', doc_id % 8, '_', doc_id) AS id, unnest(range(0, greatest(1, (octet_length(encode(text)) + 1387 - length(concat('doc_', doc_id % 8, '_', doc_id)) - 1) // (1387 - length(concat('doc_', doc_id % 8, '_', doc_id)))))) FROM documents)")
def frames_and_messages(spark, d):
    return stats.frame_counts(wire.fragment(documents(spark, d).select("id", "type", "value"), 1400))


@query("SELECT concat('random_', i) AS id, concat('Random message ', i) AS value FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS i)")
def counter_source(spark, d):
    """As many generated messages as there are events."""
    from ..sources.readers import counter

    return counter(spark, tab(spark, d, "events").count()).select("id", F.col("value").cast("string").alias("value"))


@query("WITH m AS (SELECT concat('doc_', doc_id % 8, '_', doc_id) AS id FROM documents) SELECT id, 'doc' AS topic, CAST(split_part(id, '_', 2) AS INTEGER) AS part FROM m UNION ALL SELECT 'x' || id, 'other', 0 FROM (SELECT split_part(id, '_', 3) AS id FROM m)")
def fallback_routing(spark, d):
    ids = documents(spark, d).select("id")
    odd = ids.select(F.concat(F.lit("x"), F.split("id", "_")[2]).alias("id"))
    topic, part = wire.fallback(F.col("id"), "other")
    return ids.unionByName(odd).select("id", topic.alias("topic"), part.alias("part"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(epoch_ms(date_trunc('second', ts)) // 1000 - 7200 AS BIGINT) ELSE CAST(epoch_ms(date_trunc('second', ts)) // 1000 AS BIGINT) END AS seconds FROM events")
def parse_times(spark, d):
    """Times as text in both accepted forms, with an offset, and in a form that isn't accepted."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 4
    given = F.when(n == 0, F.concat(text, F.lit("Z"))).when(n == 1, F.concat(text, F.lit(".000+00:00"))).when(n == 2, F.concat(text, F.lit("+02:00"))).otherwise(text)
    return tab(spark, d, "events").select("event_id", F.unix_timestamp(wire.parse_time(given)).alias("seconds"))


@query(f"WITH {GAPS}, first AS (SELECT topic, part, off FROM raw), again AS (SELECT s.topic, s.part, s.off FROM src s WHERE EXISTS (SELECT 1 FROM g WHERE g.topic = s.topic AND g.part = s.part AND s.off BETWEEN gap_from AND gap_to)), u AS (SELECT DISTINCT topic, part, off FROM (SELECT * FROM first UNION ALL SELECT * FROM again)) SELECT topic, part, count(*) AS have, max(off) + 1 - min(off - off % 100) - count(*) AS inner_missing FROM (SELECT u.* FROM u JOIN (SELECT topic, part, min(win) AS w0 FROM marked GROUP BY 1, 2) m ON u.topic = m.topic AND u.part = m.part AND u.off >= m.w0) GROUP BY 1, 2")
def repaired(spark, d):
    """What is there after the bundle's records have been sent again: have, and what is still missing below the last number."""
    m = kept(marked(spark, d))
    again = resend.in_gaps(source(spark, d).select(*KEY, "off"), gaps.ranges(m).select(*KEY, "gap_from", "gap_to"))
    start = m.groupBy(*KEY).agg(F.min("win").alias("w0"))
    have = raw_log(spark, d).select(*KEY, "off").unionByName(again).distinct().join(start, KEY).filter("off >= w0")
    return have.groupBy(*KEY).agg(F.count(F.lit(1)).alias("have"), (F.max("off") + 1 - F.min(F.col("off") - F.col("off") % 100) - F.count(F.lit(1))).alias("inner_missing"))


def queries() -> dict:
    def shipped(f):
        return lambda spark, sf_dir: f(ready(spark), sf_dir)

    return {name: shipped(f) for name, f in Q.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a session that began without this repository on its path import it."""
    import os
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])
    return spark
