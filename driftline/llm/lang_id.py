"""Language ID by Bayesian evidence fusion.

Four kinds of evidence give the posterior of each language: the text (naive
Bayes over hashed byte trigrams of lower-cased letters), the declared language,
the address suffix, and a prior of the host. Priors are soft counts of the text
posterior, summed by host, by parent domain and over all rows, each level
smoothed by the one above with WEIGHT pseudo-rows. How well each declaration and
each suffix tells the language is estimated from the corpus itself, by grouped
aggregation. There is no list of languages, declarations or suffixes but what the rows hold.

The trigram model is fitted on the labelled documents with the SAMPLE least hashes
of doc_id, whole texts, one row (the least) of each doc_id; everything else counts all rows.
A byte lies in three trigrams, so a text's log likelihood is a third of their sum.

Rows with the same declaration, suffix and host are one class, whose evidence is
summed once. Classes of many rows are told by a broadcast of bounded size, so neither
a common declaration nor the null host is a hot key of a join.

A row is accepted if its text has LETTERS letters at least and the posterior of
its best language reaches LEAST; else its language is "und". Null and empty
texts are rejected; null addresses, declarations and hosts are classes of their
own; ties go to the language first in the alphabet; repeated rows are repeated.
Without labelled rows the language is "und" and letters alone decide. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import cut, plain, same_columns

SAMPLE, BUCKETS = 3000, 1 << 15
WEIGHT, LETTERS, LEAST = 20.0, 3, 0.5
HEAVY = 512

#: Trigrams that a byte lies in.
_OVERLAP = 3
_KEY = "_driftline_key"


def _trigrams(text: str | None) -> tuple[np.ndarray, int]:
    """Bucket of each byte trigram with a letter, of the lower-cased text with all else as single spaces; number of letters."""
    kept = "".join([c if c.isalpha() else " " for c in (text or "").lower()]) if text and not text.isascii() else (text or "").lower()
    raw = np.frombuffer(f"  {kept}  ".encode(), np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    raw = np.where(letter, raw, np.uint8(32))
    use = letter.copy()
    use[1:] |= letter[:-1]  # a letter, or the space behind one
    raw = raw[use].astype(np.uint32)
    raw = np.r_[np.uint32(32), raw, np.uint32(32)]
    if len(raw) < 3:
        return np.zeros(0, np.uint32), 0
    mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 15), int(letter.sum())


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of the buckets, from (doc_id, text, lang)."""

    def count(batches):
        for batch in textops.slices(batches):
            total: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(_trigrams(text)[0], minlength=BUCKETS)
            for lang, own in total.items():
                some = np.flatnonzero(own)
                # A language counts even where its sample has no trigram.
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1)), pa.array([*some.tolist(), 0], pa.int32()), pa.array([*own[some].tolist(), 0], pa.int64())], ["lang", "bucket", "n"])

    rows = plain(labelled, "doc_id", "text", "lang").filter("lang IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("lang", F.lower(F.split("lang", "[-_]")[0])).withColumn("k", F.xxhash64("doc_id"))
    # Only hashes are sorted; then the texts of the chosen are read, at most one for each.
    last = rows.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    if last is None:
        return [], np.zeros((0, BUCKETS), np.float32)
    chosen = rows.filter(F.col("k") <= last).groupBy("k").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.text", "row.lang")
    # At most languages of the sample x buckets rows, however many documents there are.
    found = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist())
    langs = sorted({*names.tolist()})
    table = np.full((len(langs), BUCKETS), 0.05)
    table[np.searchsorted(langs, names), found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def log_likelihoods(text: str | None, table: np.ndarray) -> tuple[int, np.ndarray]:
    """Letters of the text and its log likelihood in each language."""
    grams, n = _trigrams(text)
    return n, table[:, grams].sum(axis=1, dtype=np.float64) / _OVERLAP


def likelihoods(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows (key columns, text, declared, suffix, host) with letters and the text's log likelihoods, without the text."""
    model = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        logs = model.value
        for batch in textops.slices(batches):
            told = [log_likelihoods(text, logs) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([n for n, _ in told], pa.int64()), pa.array([v.tolist() for _, v in told], pa.list_(pa.float64()))], [*names, "letters", "ll"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, letters long, ll array<double>")


def _shares(logs: Column) -> Column:
    """exp(v) / sum of exp, safely, of an array."""
    each = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(each, lambda v: v / F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def _arrays(soft: DataFrame, *by: str) -> DataFrame:
    """(by, sums, n): the soft counts summed by these columns, as an array over the languages; n of the classes have them."""
    pairs = soft.groupBy(*by, "k").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("sums"), F.max("n").alias("n"))
    return pairs.withColumn("sums", F.transform("sums", lambda x: x["s"]))


def _told(rows: DataFrame, table: DataFrame, by: list[str], total: Column) -> DataFrame:
    """rows with what the table (by, n, ...) says of their class, n being how many of the total rows are of it.

    Classes with more than one in HEAVY of the rows, so HEAVY at most, are told by a broadcast, and their rows aren't moved; the
    rest is joined by a shuffle in which no class is large.
    """
    heavy = F.col("n") * HEAVY > total
    often, rest = table.filter(heavy).drop("n"), table.filter(~heavy).drop("n")
    return rows.join(F.broadcast(often), by).unionByName(rows.join(F.broadcast(often.select(*by)), by, "left_anti").join(rest, by))


def fuse(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows without text, with lang, posterior and accepted; rows have text, declared, suffix and host."""
    keys = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host")]
    if not langs:
        text = likelihoods(rows, langs, table)
        return text.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), (F.col("letters") >= LETTERS).alias("accepted"))
    kinds = ("declared", "suffix", "host")
    none = {c: F.coalesce(c, F.lit("")) for c in kinds}
    # Rows with the same evidence beside their text are a class, known by a digest of fixed size.
    rows = rows.withColumns(none).withColumn("_class", F.md5(F.to_json(F.array(*kinds))))
    text = cut(likelihoods(rows, langs, table))
    soft = text.select("_class", *kinds, F.posexplode(_shares(F.col("ll"))).alias("k", "s")).groupBy("_class", *kinds, "k").agg(F.sum("s").alias("s"))
    soft = cut(soft.withColumn("parent", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    # One number for each language of the sample.
    total, classes = [0.0] * len(langs), 0
    for k, s, n in soft.groupBy("k").agg(F.sum("s"), F.count(F.lit(1))).collect():
        total[k], classes = s, n
    everything = [(t + 1.0) / (sum(total) + len(langs)) for t in total]
    totals, base = F.array(*map(F.lit, total)), F.array(*map(F.lit, everything))

    def likely(column: str) -> DataFrame:
        """log P(value | language) of each declaration or suffix, add-one smoothed over their values."""
        values = soft.select(column).distinct().count()
        logs = F.zip_with("sums", totals, lambda v, t: F.log((v + 1.0) / (t + values)))
        return _arrays(soft, column).select(F.lit(column).alias("kind"), F.col(column).alias("value"), "n", logs.alias("logs"))

    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda c, upper: F.zip_with(c, upper, lambda v, u: (v + WEIGHT * u) / (mass(c) + WEIGHT))
    parents = _arrays(soft, "parent").select("parent", "n", smooth(F.col("sums"), base).alias("upper"))
    hosts = _told(_arrays(soft, "host", "parent").withColumnRenamed("n", "_n"), parents, ["parent"], F.lit(classes))
    prior = hosts.select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.col("_n").alias("n"), F.transform(smooth(F.col("sums"), F.col("upper")), lambda v: F.log(v)).alias("logs"))
    evidence = cut(likely("declared").unionByName(likely("suffix")).unionByName(prior))
    # Each class asks for three kinds of evidence; their logs are added in one order.
    ask = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in kinds])).alias("ask")
    asking = soft.groupBy("_class", *kinds).agg(F.sum("s").alias("_rows")).select("_class", "_rows", ask).select("_class", "_rows", "ask.*")
    beside = _told(asking, evidence, ["kind", "value"], F.lit(classes)).groupBy("_class").agg(F.max("_rows").alias("n"), F.array_sort(F.collect_list(F.struct("kind", "logs"))).alias("all"))
    added = F.aggregate("all", F.array(*[F.lit(0.0)] * len(langs)), lambda acc, x: F.zip_with(acc, x["logs"], lambda a, b: a + b))
    beside = cut(beside.select("_class", "n", added.alias("_beside")))
    both = _told(text.select(*keys, "letters", "ll", "_class"), beside, ["_class"], F.lit(sum(total)))
    score = F.zip_with("ll", "_beside", lambda a, b: a + b)
    out = both.select(*keys, "letters", score.alias("score")).select(*keys, "letters", _shares(F.col("score")).alias("shares"))
    best = F.array_max("shares")
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("shares", best).cast("int"))
    ok = (F.col("letters") >= LETTERS) & (best >= LEAST)
    return out.select(*keys, F.when(ok, name).otherwise("und").alias("lang"), F.round(best, 4).alias("posterior"), ok.alias("accepted"))


def _evidence() -> Column:
    """A key of all that decides on a document: text, declaration and host."""
    return F.md5(F.concat_ws("\0", *[F.concat(F.col(f"`{c}`").isNull().cast("string"), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in ("lang", "source", "text")]))


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told; columns unchanged. Each row is decided on by itself, whatever its doc_id."""
    langs, model = fit(docs)
    keyed = plain(docs, "doc_id", "text", "lang", "source").withColumn("doc_id", _evidence())
    rejected = fuse(document_rows(keyed), langs, model).filter("NOT accepted").select(F.col("doc_id").alias(_KEY)).distinct()
    return docs.join(rejected, _evidence() == F.col(_KEY), "left_anti").transform(same_columns, docs)


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id and the evidence of raw web pages: text without markup, declared language, suffix, host."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]*>|&[a-zA-Z]{1,10};", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return plain(pages, "page_id", "url", "html").select("page_id", text.alias("text"), declared.alias("declared"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"))


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the evidence of documents: the lang column is the declaration, the source the host."""
    return plain(docs, "doc_id", "text", "lang", "source").select("doc_id", "text", F.lower(F.split("lang", "[-_]")[0]).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
