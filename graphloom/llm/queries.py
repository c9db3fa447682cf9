"""Queries of the operators for training data."""

from __future__ import annotations

from graphloom.llm import leaks, neighbours, split, tokenize
from graphloom.sources.tables import read


def p5_found(spark, d):
    return neighbours.similar_pairs(read(spark, d, "node_vectors"))


def p6_ids(spark, d):
    return tokenize.encode(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_found(spark, d):
    return leaks.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark, d):
    return split.split(read(spark, d, "documents").select("doc_id", "text")).filter("piece_no = 1").select("doc_id")


def p8_pieces(spark, d):
    return split.split(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "piece_no", "own_start", "start", "tokens", "piece")


QUERIES = {f.__name__: f for f in (p5_found, p6_ids, p7_found, p8_found, p8_pieces)}
#: Every pair of a group is compared here; the groups of the correctness run are small enough for that.
ORACLE: dict[str, str] = {
    "p5_found": """
WITH v AS (
  SELECT DISTINCT vec_id, target_prop, dim, embedding::DOUBLE[] AS e FROM node_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 1e-20),
p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.target_prop = b.target_prop AND a.dim = b.dim AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 12) DESC, y) AS n FROM p)
SELECT DISTINCT least(x, y) AS vec_a, greatest(x, y) AS vec_b FROM r WHERE n <= 5 AND c >= 0.85
""",
}
