"""Registered queries of the numbered operators and their SQL, with production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, langid, linedup, neardup, quality, simhash, topk, toxicity, urls, whiten
from .common import crc_mod, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Rules of the URL filter: verdict, host, start of the path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
LEAST_SCORE = 0.3
ITEMS_SHA = "sha2(concat_ws(',', item_ids), 256)"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), langid.identify(docs, model).alias("r")).select(
        "doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.col("r.rejected").alias("rejected"))


@query
def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs, as counts and a digest of the remaining text."""
    out = linedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=50)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", decontam.covered(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.expr(ITEMS_SHA).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    rows = stored(docs.select("doc_id", held.alias("held_out"), quality.features(docs.text).alias("features")))
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(rows.where("NOT held_out").join(labels, "doc_id"))
    scored = rows.select("doc_id", "held_out", quality.score(model, F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


@query
def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on 4-word shingles at similarity 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Settings(shingle=4, percent=80))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of every speaker, in blocks of turns."""
    out = chat.dialogues(table(spark, sf_dir, "conversations"))
    span = F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string")))
    return out.select("conv_id", "participant", "block", "part", "messages", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                      F.array_join(span, ",").alias("spans"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("label"))
    taught = toxicity.labelled_sample(labels.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    stems = toxicity.learn_stems(docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id"))
    rows = stored(docs.select("doc_id", held.alias("held_out"), toxicity.totals(docs.text, toxicity.Grammar(stems)).alias("total")))
    curve = toxicity.calibrate(rows.where("NOT held_out").join(labels, "doc_id"))
    scored = rows.select("doc_id", "held_out", curve.probability(F.col("total")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


@query
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("ratio")


@query
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of two tokenizers for every document and how common its linked pairs of ids are."""
    rows = align.alignments(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align.scored(rows.withColumn("groups_sha256", digest).drop("groups"))


@query
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, by fingerprints of 3-word shingles that differ in 3 bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


@query
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 16 whitened components."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=16)


CHECKS["op2_topk"] = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)) FOR x IN embedding]), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5
"""
CHECKS["op4_linedup"] = linedup.SQL.format(min_words=50)
CHECKS["op5_decontam"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS span
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span FROM d, ns, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.span = bw.span),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
CHECKS["op8_chat"] = chat.SQL
CHECKS["op10_urls"] = urls.sql(URL_RULES)
