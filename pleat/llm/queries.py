"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, fm_classifier, html_text, jaccard, metric_join, packing, pieces, pii, quality_rules, secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def n_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def joined(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return [*(n_of(spans, k) for k in kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), out="pii", keep=["doc_id"])
    return found.select("doc_id", *digest("pii", pii.BASE))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fm_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = fm_classifier.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", fm_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), out="secrets", keep=["doc_id"])
    return found.select("doc_id", *digest("secrets", secrets.BASE))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    coded = pieces.encode_sampled(table(spark, sf_dir, "documents"), model, seed=1, keep=["doc_id"], verified="lossless")
    return coded.select("doc_id", (F.length("pieces") / 4).cast("long").alias("n_pieces"), F.crc32("pieces").alias("ids_crc32"), "lossless")


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score_backoff(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_html_text": op3_html_text,
    "op4_quality_fm": op4_quality_fm,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_metric_join": op9_metric_join,
    "op10_backoff_lm": op10_backoff_lm,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words of every document, A-Z lower-cased, as lists.
WORDS_SQL = f"SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents"


def components_sql(nodes: str, edges: str) -> str:
    """Smallest node reachable, for a table nodes (id) and symmetric edges (u, v)."""
    return f"reach(id, c) AS (SELECT id, id FROM {nodes} UNION SELECT e.v, reach.c FROM reach JOIN {edges} e ON e.u = reach.id), component AS (SELECT id, min(c) AS c FROM reach GROUP BY id)"


ORACLE: dict[str, str] = {
    "op7_ngram_jaccard": f"""
WITH RECURSIVE d AS MATERIALIZED ({WORDS_SQL}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i + 3], ' ') ELSE array_to_string(ws, ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT d.doc_id AS id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
{components_sql("n", "e")}
SELECT n.id AS doc_id, n.n AS n_shingles, c AS component_id FROM n JOIN component ON component.id = n.id""",
    "op9_metric_join": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
{components_sql("v", "e")}
SELECT v.id AS vec_id, (SELECT count(*) FROM e WHERE e.u = v.id) AS n_links, c AS component_id, v.id = c AS kept FROM v JOIN component ON component.id = v.id""",
    "op10_backoff_lm": f"""
WITH d AS MATERIALIZED ({WORDS_SQL}),
t AS MATERIALIZED (SELECT doc_id, i, w, lag(w, 1) OVER o AS p, lag(w, 2) OVER o AS q FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT q, p, w, count(*) AS n FROM t WHERE q IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT t.doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n / k2.n)
    WHEN c2.n >= 2 THEN CASE WHEN t.q IS NULL THEN 0 ELSE ln(0.4) END + ln(c2.n / k1.n)
    ELSE CASE WHEN t.p IS NULL THEN 0 WHEN t.q IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END + ln(c1.n / (SELECT count(*) FROM t)) END AS s
  FROM t JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.p = t.p AND c2.w = t.w LEFT JOIN c3 ON c3.q = t.q AND c3.p = t.p AND c3.w = t.w
  LEFT JOIN c1 k1 ON k1.w = t.p LEFT JOIN c2 k2 ON k2.p = t.q AND k2.w = t.p)
SELECT d.doc_id, count(s) AS n_words, ROUND(coalesce(sum(s), 0.0), 4) AS log_score, ROUND(sum(s) / count(s), 6) AS mean_log_score FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id""",
}
