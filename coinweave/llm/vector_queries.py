"""Query: vector codes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, compress
from coinweave.session import broadcast_if_small, materialize


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings; errors also summed by label."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = materialize(found, "vector_codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = found.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return found.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _codes_sql() -> str:
    """Rounds are unrolled; every round reads the entries before it."""
    step = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS val
  FROM v, unnest(generate_series(1, len(embedding))) AS g(i)
), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}
), b0 AS MATERIALIZED (SELECT part, entry, pos, val FROM x JOIN first USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        step.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(dist := dist, entry := entry)) AS best FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.val - b.val) * (x.val - b.val)) AS dist
    FROM x JOIN b{r} b ON x.part = b.part AND x.pos = b.pos GROUP BY 1, 2, 3)
  GROUP BY vec_id, part)""")
        if r < ROUNDS:
            step.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.val, b.val) AS val FROM b{r} b LEFT JOIN (
    SELECT x.part, a.best.entry AS entry, x.pos, CAST(floor(sum(x.val) / count(*)) AS BIGINT) AS val
    FROM x JOIN a{r} a USING (vec_id, part) GROUP BY 1, 2, 3) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return "WITH " + ",".join(step) + f""",
c AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.dist) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id
), h AS (SELECT sha256(string_agg(val, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), h"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _codes_sql()}
