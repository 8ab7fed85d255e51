"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

A set's 64-bit shingle hashes are dealt to BANDS * ROWS bins by their high bits;
a bin keeps its least hash and an empty bin takes that of the first non-empty
bin in a fixed pseudo-random order of its own (densification). Documents whose
sets are equal are merged first. In each bucket of a band every member is
joined with at most three centres, which the bucket's key picks out: these first
edges grow with the rows, never with the square of a bucket. Each candidate is
then confirmed on the full sets, and linked documents form components.

Stars alone miss a pair of which, in no shared bucket, one is a centre. Members
of the buckets in which those that are no centre are still of several components therefore
meet once more, through an exact prefix filter: on the rarest of their shingles, as
many as a linked pair can't avoid sharing, and only where sizes and places leave
room for a link. So each pair that shares a bucket is compared, shown to be no link, or
already connected. Variants of one form differ in rare shingles of their own, so hardly any
pair of them is made. With r = 6 rows and b = 32 bands a pair of similarity 0.85 shares no bucket with
probability (1 - 0.85**6)**32 < 1e-6, one of 0.8 (the pipeline's stage) with 6e-5.

Results: one row for each input row. Null or blank text has the empty set and
links with nothing; a row with null doc_id links with nothing, its component is
null and so is kept; drop_near_duplicates keeps it. Rows that share a doc_id stand by their own texts, but
different texts whose smallest doc_id is the same are taken together: what one is linked with, all are. A
row repeated whole stays as often as it came. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import connected, cut, plain, same_columns, written

BANDS, ROWS, SHINGLE, PERCENT = 32, 6, 5, 85
#: Ratio of the bounds of a class of set sizes.
CLASS = 1.04

_ID, _HASH = "_driftline_id", "_driftline_hash"
_BINS = BANDS * ROWS
_ORDER = np.random.Generator(np.random.PCG64(77)).random((_BINS, _BINS), dtype=np.float32)
_STEP = textops.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = textops.mix(np.arange(101, 101 + BANDS, dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Bucket key of each band of a non-empty sorted set."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full, least = bins[first].astype(np.int64), hashes[first]
    values = np.empty(_BINS, np.uint64)
    values[full] = least
    if len(full) < _BINS:
        empty = np.ones(_BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        values[empty] = least[_ORDER[np.ix_(empty, full)].argmin(axis=1)]
    return textops.mix((values.reshape(BANDS, ROWS) * _STEP).sum(axis=1, dtype=np.uint64) + _BAND)


def _signatures(batches):
    for batch in textops.slices(batches):
        n, a, b, keys = [], [], [], []
        for s in textops.shingle_sets(batch.column("text"), SHINGLE):
            n.append(len(s))
            a.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            b.append(int(textops.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            keys.append(bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), batch.column("text_hash")], ["doc_id", "n", "a", "b", "bands", "text_hash"])


def _sets(batches):
    for batch in textops.slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in textops.shingle_sets(batch.column("text"), SHINGLE)], pa.binary())], ["id", "shingles"])


def _shingles(batches):
    for batch in textops.slices(batches):
        sets = [s.view(np.int64) for s in textops.shingle_sets(batch.column("text"), SHINGLE)]
        n = pa.array([len(s) for s in sets], pa.int32())
        at = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.ListArray.from_arrays(pa.array(at), flat)], ["id", "n", "shingles"])


def similar(one, two, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct 64-bit hashes."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            ok = [similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column("one"), batch.column("two"))]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _fits(n: str, m: str, percent: int):
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(key, id, n, centres) of the buckets with several members, from (id, n, bands); centres are (id, n) of three members, at least two of them different."""
    member = sets.select("id", "n", F.explode("bands").alias("key"))
    mixed = F.struct(F.col("id").bitwiseXOR(F.col("key")).alias("x"), "n")
    found = member.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c1"), F.min(mixed).alias("c2"), F.max(mixed).alias("c3")).filter("c2.x <> c3.x")
    plain_ = lambda c: F.struct(F.col(f"{c}.x").bitwiseXOR(F.col("key")).alias("id"), F.col(f"{c}.n").alias("n"))
    return member.join(found.select("key", F.array("c1", plain_("c2"), plain_("c3")).alias("centres")), "key").select("key", "id", "n", "centres")


def candidates(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v, hits): each member of a bucket with the bucket's centres."""
    star = shared.select("id", "n", F.explode(F.array_distinct("centres")).alias("c")).select("id", "n", F.col("c.id").alias("c"), F.col("c.n").alias("m"))
    star = star.filter((F.col("id") != F.col("c")) & _fits("n", "m", percent))
    return star.groupBy(F.least("id", "c").alias("u"), F.greatest("id", "c").alias("v")).agg(F.count(F.lit(1)).alias("hits"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the component of each id."""
    return rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(id, component) of the members but centres of the buckets in which those are of several components: no two of them have met there."""
    rest = shared.filter("NOT array_contains(transform(centres, c -> c.id), id)").select("key", "id")
    rest = _labelled(rest, label)
    several = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return rest.join(several, "key").select("id", "component").distinct()


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")


def _ordered(shingles: DataFrame, percent: int) -> DataFrame:
    """(id, n, component, order) from (id, n, component, shingle): each set's shingles that others have, from rare to frequent, unless too many are its own for any link."""
    often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    sets = shingles.join(often, "shingle").groupBy("id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("order"))
    return sets.filter(F.size("order") * 100 >= F.col("n") * percent).withColumn("order", F.transform("order", lambda x: x["shingle"]))


def _prefixes(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What each set of _ordered shows as the smaller and as the larger of a pair: (key, class, id, n, component, left).

    Of a linked pair, the first common shingle in this
    order has at least `left` shingles from it on in both sets, and these must be
    as many as the pair has in common at least; shingles that no other set has are
    never met, but count. The larger of a pair shows itself once for each class of sizes that the
    smaller may be of, with what that class asks for.
    """
    need = lambda n, m: F.ceil((n + m) * percent / (100 + percent)).cast("int")  # noqa: E731  common shingles of a linked pair

    def shown(rows, least):
        # The first size - least + 1 shingles have at least `least` from them on.
        head = F.slice("order", F.lit(1), F.greatest(F.size("order") - least + 1, F.lit(0)))
        rows = rows.select("id", "n", "component", "class", F.size("order").alias("total"), F.posexplode(head).alias("at", "key"))
        return rows.withColumn("left", F.col("total") - F.col("at")).drop("total", "at")

    n = F.col("n")
    small = shown(sets.withColumn("class", _size_class(n)), need(n, n))
    low = F.ceil(n * percent / 100)
    classes = F.sequence(_size_class(low), _size_class(n))
    # A class may begin a little below its power by rounding; asking for one shingle less is safe.
    least = F.greatest(low, F.floor(F.pow(F.lit(CLASS), F.col("class")) - 1e-6))
    large = shown(sets.withColumn("class", F.explode(classes)), need(n, least) - 1)
    return small, large


def _met(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    right = large.select("key", "class", F.col("id").alias("v"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("left").alias("left_v"))
    after = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("id") < F.col("v")))
    able = F.least("left", "left_v") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return small.join(right, ["key", "class"]).filter(after & (F.col("component") != F.col("other")) & _fits("n", "m", percent) & able).select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v"))


def further_pairs(docs: DataFrame, open_: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): all pairs of the open sets, of different components, that could be similar by an exact prefix filter."""
    ids = open_.select(F.col("id").alias("doc_id"))
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_shingles, "id long, n int, shingles array<long>")
    rows = written(sets.join(open_, "id").select("id", "n", "component", F.explode("shingles").alias("shingle")))
    small, large = _prefixes(written(_ordered(rows, percent)), percent)
    # Most members of a hot key are of one component, the core: only the others meet the whole key.
    part = small.unionByName(large).groupBy("key", "class", "component").agg(F.count(F.lit(1)).alias("size"))
    core = part.groupBy("key", "class").agg(F.max_by("component", F.struct("size", "component")).alias("core"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    core = written(core)
    # Written, so that each join below stands alone and Spark can split its hot keys.
    small, large = (written(x.join(core, ["key", "class"])) for x in (small, large))
    outer, inner = F.col("component") != F.col("core"), F.col("component") == F.col("core")
    return _met(small.filter(outer), large, percent).union(_met(small.filter(inner), large.filter(outer), percent)).distinct()


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label after further links: components are the nodes, so the work is that of the links."""
    ends = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    every = label.union(ends.join(label, "id", "left_anti").select("id", F.col("id").alias("component")))
    of = lambda c: every.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    moved = connected(links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
    moved = moved.select(F.col("id").alias("component"), F.col("component").alias("now"))
    return written(every.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component")))


def confirm(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (u, v) whose full shingle sets are similar."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, shingles binary")
    both = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("one")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("two")), "v")
    return both.select("u", "v", "one", "two").mapInArrow(_confirmed(percent), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text); texts are linked from this similarity on."""
    return _decided(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates with a hash of each row's text."""
    docs = plain(docs, "doc_id", "text")
    # The text's hash goes along in place of the text.
    signed = cut(docs.withColumn("text_hash", F.md5("text")).mapInArrow(_signatures, "doc_id long, n long, a long, b long, bands array<long>, text_hash string"))
    sets = signed.filter("doc_id IS NOT NULL AND n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    sets = written(sets)
    shared = written(shared_buckets(sets))
    # From here on only texts that share a bucket count. The ids grow with the data and are never broadcast.
    docs = written(docs.join(shared.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    every = written(candidates(shared, percent))
    # Each document's most shared neighbour first; of the rest only what could still join two components.
    best = every.groupBy("v").agg(F.max_by("u", F.struct("hits", -F.col("u"))).alias("u")).select("u", "v").union(every.groupBy("u").agg(F.max_by("v", F.struct("hits", -F.col("v"))).alias("v")).select("u", "v")).distinct()
    label = connected(written(confirm(docs, written(best), percent)))
    of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    rest = every.join(best, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
    label = _with(docs, written(rest.filter("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v")), label, percent)
    open_ = written(_open(shared, label))
    if not open_.isEmpty():
        label = _with(docs, written(further_pairs(docs, open_, percent)), label, percent)
    home = sets.select("a", "b", "n", "id").join(label, "id", "left").select("a", "b", "n", F.coalesce("component", "id").alias("component"))
    joined = signed.drop("bands").join(home, ["a", "b", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "text_hash")


def _with(docs: DataFrame, pairs: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """label after those of the pairs that are links."""
    links = written(confirm(docs, pairs, percent))
    return label if links.isEmpty() else _merged(label, links)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, one document of each component kept; columns unchanged. Rows go by their doc_id and text."""
    gone = _decided(docs, percent).filter("NOT kept").select(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(_ID)) & (F.md5("text") == F.col(_HASH)), "left_anti").transform(same_columns, docs)
