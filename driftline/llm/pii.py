"""PII sanitisation by information content, in DataFrame functions only.

Base spans: e-mail, IP, card and phone values found by patterns and checks.
They are the protected entities. A term t discloses an entity c in proportion to

    PMI(c; t) / IC(c),  PMI = log2(p(c | t) / p(c)),  IC = -log2 p(c)

with probabilities from document frequencies over all documents: 1 means that
the term tells the entity. Inside documents that hold c, terms at or above
GENERALISE become a tag of their shape, those at or above REMOVE go.

p(c | t) is estimated without the text at hand, which would always speak for itself, and with one more draw of chance p(c):
(k - 1 + p(c)) / n, of n texts with the term k with the entity. So the estimate is cautious where there is little to go by, and
a term seen with an entity in one text alone tells exactly nothing; there is no least number of texts. Copies of one text count once in
k, as documents in n. Terms of any length count. Documents without an entity are left as they are.

Co-occurrence is counted per entity class: entities with the same document set
(by two order-free 64-bit sums) have the same statistics and are counted once.

Null text has no spans; a null doc_id is carried along; repeated rows and equal
texts get equal results; an empty table gives an empty result; other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, same_columns

GENERALISE, REMOVE = 0.8, 0.95
#: Items of one fold; code points of a block of text.
FOLD, BLOCK = 256, 1024

#: Local parts and domains are taken possessively; \\G and the look-behind start a match only where the leftmost one can start, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back, total = F.reverse(digits), F.lit(0)
    for i in range(19):
        d = F.coalesce(F.substring(back, i + 1, 1).try_cast("int"), F.lit(0))
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if i % 2 else d)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    size = F.length(_digits(value))
    if kind == "phone":
        return size.between(8, 15)
    return F.when(size.between(16, 19), _luhn(_digits(value))).otherwise(False)


def _chunks(items: Column, fold) -> Column:
    """fold(chunk) of each FOLD items in turn."""
    many = F.greatest(F.ceil(F.size(items) / FOLD).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), many - 1), lambda c: fold(F.slice(items, c * FOLD + 1, FOLD)))


def _located(text: Column, pattern: str, keep) -> Column:
    """[(start, end, value)] of the pattern's matches for which keep(value); places come from the lengths of matches and of the pieces between.

    An array that grows in a fold is copied at each step, so places are summed inside chunks, then over the chunks.
    """
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    inside = _chunks(both, lambda some: F.aggregate(some, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    begin = F.aggregate(inside, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    moved = F.zip_with(inside, F.slice(begin, F.lit(1), F.size(inside)), lambda c, by: F.transform(c["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))))
    return F.flatten(moved)


def base_spans(text: Column) -> Column:
    """All base spans (kind, start, end, value), by kind as listed, then start; code points, end exclusive."""

    def of(kind: str) -> Column:
        # No default arguments in these lambdas: a second parameter would be the element's index.
        found = _located(text, PATTERNS[kind], lambda v: _valid(kind, v))
        tagged = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(text.rlike(_HINT[kind]), tagged).otherwise(F.array()).cast(SPAN)

    return F.concat(*[of(kind) for kind in PATTERNS])


def redact(text: Column, spans: Column, put) -> Column:
    """The text with each span replaced by put(span); spans that overlap the one before only lengthen it."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put"))))
    ends = _chunks(order, lambda some: F.aggregate(some, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))))
    begin = F.aggregate(ends, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), c["at"]))))
    # at: where the spans before end.
    at = F.flatten(F.zip_with(ends, F.slice(begin, F.lit(1), F.size(ends)), lambda c, by: F.transform(c["out"], lambda x: F.greatest(x, by))))
    # A place in a string is found from its beginning, so the text is taken in blocks.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(a, b):
        def part(k):
            low = F.greatest(a - k * BLOCK, F.lit(0))
            return F.substring(F.element_at(blocks, k + 1), low + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - low)

        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")), part), "")).otherwise("")

    pieces = F.zip_with(order, at, lambda s, a: F.when(s["start"] >= a, F.concat(between(a, s["start"]), s["put"])).otherwise(""))
    done = F.concat(F.array_join(pieces, ""), between(F.element_at(begin, -1), F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _entity(s: Column) -> Column:
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing_terms(docs: DataFrame, entity: DataFrame) -> DataFrame:
    """(_pii_key, _pii_terms): per text with entities, its disclosing terms and their ratios, as a map."""
    texts = entity.groupBy("_pii_key").agg(F.first("text").alias("text"), F.first("_pii_spans").alias("spans"), F.count(F.lit(1)).alias("w"))
    held = texts.select("_pii_key", "w", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("c"))
    known = (
        held.groupBy("c")
        .agg(F.sum("w").alias("df_c"), F.count(F.lit(1)).alias("texts"), F.expr("bit_xor(xxhash64(_pii_key, 1))").alias("x"), F.expr("bit_xor(xxhash64(_pii_key, 2))").alias("y"))
        .filter("texts > 1")  # in one text all terms' ratios are 0
    )
    classes = held.join(known, "c").groupBy("_pii_key", "x", "y").agg(F.max("df_c").alias("df_c"))
    said = texts.select("_pii_key", "w", _terms(redact(F.col("text"), F.col("spans"), lambda s: F.lit(" "))).alias("terms"))
    pairs = classes.join(said, "_pii_key").select("_pii_key", "x", "y", "df_c", "w", F.explode("terms").alias("term"))
    joint = pairs.groupBy("x", "y", "df_c", "term").agg(F.sum("w").alias("joint"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    df = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    n = F.lit(float(docs.count()))
    chance = F.col("df_c") / n
    pmi = F.log2((F.col("k") - 1 + chance) / (F.greatest("df_t", "joint") - F.col("joint") + F.col("k")) / chance)
    told = joint.join(df, "term").withColumn("ratio", F.when(F.col("df_c") < n, pmi / F.log2(n / F.col("df_c")))).filter(F.col("ratio") >= GENERALISE)
    own = pairs.join(told.select("x", "y", "term", "ratio"), ["x", "y", "term"]).groupBy("_pii_key", "term").agg(F.max("ratio").alias("ratio"))
    return own.groupBy("_pii_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "ratio")))).alias("_pii_terms"))


def _sanitised(docs: DataFrame) -> DataFrame:
    """docs (text, _pii_row) with the text sanitised, and _pii_spans and _pii_added."""
    found = docs.withColumn("_pii_spans", F.coalesce(base_spans(F.col("text")), F.array().cast(SPAN)))
    clean = found.filter(F.size("_pii_spans") == 0).withColumn("_pii_added", F.array().cast(SPAN))
    entity = cut(found.filter(F.size("_pii_spans") > 0).withColumn("_pii_key", F.md5("text")))
    rows = entity.join(disclosing_terms(docs, entity), "_pii_key", "left")
    terms = F.col("_pii_terms")
    places = _located(F.col("text"), WORD, lambda v: F.map_contains_key(terms, F.lower(v)))
    inside = lambda w: F.exists("_pii_spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))
    action = lambda w: F.when(F.element_at(terms, F.lower(w["value"])) >= REMOVE, "remove").otherwise("generalise")
    added = F.transform(F.filter(places, lambda w: ~inside(w)), lambda w: F.struct(action(w).alias("kind"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value")))
    rows = rows.withColumn("_pii_added", F.array_sort(F.when(terms.isNotNull(), added).otherwise(F.array()).cast(SPAN)))
    shape = lambda v: F.when(v.rlike("^[0-9]+$"), "<NUMBER>").when(v.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
    put = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", shape(s["value"])).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    every = F.concat("_pii_spans", "_pii_added")
    rows = rows.withColumn("text", redact(F.col("text"), every, put))
    return clean.unionByName(same_columns(rows, clean))


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one: so their names can't be ours."""
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"]
    return docs.select("text", F.struct(*(rest or [F.lit(0).alias("c")])).alias("_pii_row"))


def _unpacked(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col(f"_pii_row.c{k}").alias(c) for k, c in enumerate(docs.columns)]


def sanitise(docs: DataFrame, spans: str = "_pii_spans", added: str = "_pii_added") -> DataFrame:
    """docs with the text sanitised, and two more columns of the names given: base spans, and spans of the method."""
    if {spans, added} & {*docs.columns}:
        raise ValueError(f"the table has a column {spans} or {added}: give other names for the new ones")
    return _sanitised(_packed(docs)).select(*_unpacked(docs), F.col("_pii_spans").alias(spans), F.col("_pii_added").alias(added))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans as they come, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts, and n_chars to match where there is such a column."""
    out = _sanitised(_packed(docs))
    columns = dict(zip(docs.columns, _unpacked(docs)))
    if "n_chars" in columns:
        held = columns["n_chars"]
        columns["n_chars"] = F.when(F.size("_pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(held).alias("n_chars")
    return out.select(*columns.values())
