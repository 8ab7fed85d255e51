"""Queries of the training-data operators; the thin queries derive their digest columns from the operators' results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, binary_rows, centroids, chat, lang_id, media, near_dup, passages, pii, repeats, sentencepiece_bpe, top_k, vector_codes
from .common import ready, table

#: Folder of the public tokenizer files; None takes that of the installed package.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document and the spans that the disclosure analysis adds."""
    rows = pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("_pii_spans", kind(k))).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    every = F.concat("_pii_spans", "_pii_added")
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("_pii_spans")), 256).alias("base_sha256"), pii.joined(every).alias("spans"))


def kind(name: str):
    return lambda s: s["kind"] == name


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encode(table(spark, sf_dir, "documents")))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fuzzy passage that repeats one of an earlier document."""
    return passages.passages(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents and of all raw pages (the other's id is null)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, model = lang_id.fit(docs)
    own = lang_id.fuse(lang_id.document_rows(docs), langs, model).withColumn("page_id", F.lit(None).cast("long"))
    web = lang_id.fuse(lang_id.page_rows(pages), langs, model).withColumn("doc_id", F.lit(None).cast("long"))
    return own.unionByName(web).select("doc_id", "page_id", "lang", "posterior", "accepted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), ids=False)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of all documents."""
    return binary_rows.matrices(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ids=False)


#: A conversation that holds control strings, beside those of the table.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, formatted, and read back from the segments."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-1).alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(PROBE).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(probe.select(*[F.col(c).cast(t) for c, t in turns.dtypes]))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings"))


_ALL = [op1_pii, op2_media, op3_passages, op4_near_duplicates, op5_repeats, op6_language, op7_sentencepiece, op8_token_binary, op9_top_k, op10_best_fit, op11_chat, op12_vector_codes, op13_centroids]


def queries() -> dict:
    def shipped(f):
        return lambda spark, sf_dir: f(ready(spark), sf_dir)

    return {f.__name__: shipped(f) for f in _ALL}


def _words(count: int) -> str:
    return reduce(lambda a, k: f"{a}, w[i+{k}]", range(1, count), "w[i]")


_SOUND = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
_FLOOR = "(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"


def _codes_sql(rounds: int = 6) -> str:
    """One assignment and one update a round, as common tables; parts of equal value are one row with a weight."""
    d, below = "sum((p.z[i] - b.z[i]) * (p.z[i] - b.z[i]))", _FLOOR.format(s="CAST(sum(w * z) AS BIGINT)", n="CAST(sum(w) AS BIGINT)")
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT pos, z, w, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT p.pos, p.z, p.w, b.e, list_sum(list_transform(list_zip(p.z, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist FROM dist p JOIN b{r} b USING (pos)) GROUP BY 1, 2, 3)"""  # noqa: E731
    step = lambda r: f"""u{r} AS (SELECT pos, e, i, {below} AS x FROM (SELECT pos, e, w, unnest(z) AS z, generate_subscripts(z, 1) AS i FROM a{r}) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(m.z, b.z) AS z FROM b{r} b LEFT JOIN (SELECT pos, e, list(x ORDER BY i) AS z FROM u{r} GROUP BY 1, 2) m USING (pos, e))"""  # noqa: E731
    rest = ",\n".join(f"{near(r)},\n{step(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings WHERE embedding IS NOT NULL AND {_SOUND}),
parts AS MATERIALIZED (SELECT vec_id, label, pos, z[pos * len(z) // 8 + 1 : (pos + 1) * len(z) // 8] AS z FROM v, range(8) t(pos)),
dist AS MATERIALIZED (SELECT pos, z, count(*) AS w FROM parts GROUP BY 1, 2),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT pos, e, z FROM parts JOIN seeds USING (vec_id)),
{rest},
{near(rounds)},
whole AS (SELECT vec_id, label, string_agg(printf('%02x', a.e), '' ORDER BY pos) AS code, CAST(sum(a.dist) AS BIGINT) AS error FROM parts JOIN a{rounds} a USING (pos, z) GROUP BY 1, 2),
book AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM whole, book"""


def _centroids_sql(rounds: int = 5) -> str:
    below = _FLOOR.format(s="CAST(sum(x) AS BIGINT)", n="count(*)")
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT vec_id, z, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
  SELECT v.vec_id, v.z, c.c, list_sum(list_transform(list_zip(v.z, c.z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist FROM v, c{r} c) GROUP BY 1, 2)"""  # noqa: E731
    step = lambda r: f"""u{r} AS (SELECT c, i, {below} AS x FROM (SELECT c, unnest(z) AS x, generate_subscripts(z, 1) AS i FROM a{r}) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.z, c.z) AS z FROM c{r} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS z FROM u{r} GROUP BY 1) m USING (c))"""  # noqa: E731
    rest = ",\n".join(f"{near(r)},\n{step(r)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, z FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40),
{rest},
{near(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.z, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""


def _chat_sql() -> str:
    held, size = "text", {r: sum(len(p) for p, _ in ps if isinstance(p, str)) for r, ps in chat.CHAT.turns.items()}
    for i, c in enumerate((chat.ESCAPE, *chat.CHAT.controls)):
        held = f"replace({held}, '{c}', '{chat.ESCAPE}{chr(96 + i) if i else c}')"
    marks, order = " ".join(f"WHEN '{r}' THEN {n}" for r, n in size.items()), "ORDER BY turn, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
p AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id {order}), '') AS prev FROM t),
m AS (SELECT *, (prev, role) NOT IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS odd FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({held}) + CASE role {marks} END) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (odd) AS BIGINT) AS out_of_order,
  NOT bool_or(odd) AND last(role {order}) = 'assistant' AS complete
FROM m GROUP BY conv_id"""


ORACLES = {
    "op11_chat": _chat_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_centroids": _centroids_sql(),
    # Squared work: only the queries' rows meet all others.
    "op9_top_k": """
WITH flat AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
     ok AS (SELECT vec_id FROM flat GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
     v AS (SELECT vec_id, d, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS z FROM flat WHERE vec_id IN (SELECT vec_id FROM ok)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.z * c.z) AS BIGINT) AS score
           FROM v q JOIN v c ON q.d = c.d WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op4_near_duplicates": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: [{_words(5)}])) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM docs),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN comp ON id = doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
