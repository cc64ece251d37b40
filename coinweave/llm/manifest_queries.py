"""Query: Merkle manifest of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.llm.common import crc_mod, documents
from coinweave.llm.merkle import FANOUT, fold, leaf_digest, manifest, proof_text

FIELDS = ["doc_id", "source", "lang", "n_chars"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every fifth document, by the checksum of its id, is checked with a changed text.
TAMPERED = 5


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; the proof is folded from the changed leaf where there is one."""
    docs = documents(spark, sf_dir)
    fields = [F.col(c) for c in FIELDS]
    changed = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), TAMPERED) == 0)
    other = F.when(changed, leaf_digest(*fields, F.translate("text", CAPITALS, SMALL)))
    found = manifest(docs, "doc_id", "source", leaf_digest(*fields, F.col("text")), other)
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}) || ':' || {name} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*[_field(f"CAST({c} AS VARCHAR)") for c in FIELDS], _field(text)]) + ")"


def _manifest_sql(levels: int = 6) -> str:
    """Trees of up to ``FANOUT`` to the power of ``levels`` rows; a tree that ended stays as it is. ``k``
    holds the key of each row's node at the level reached, ``c`` how many nodes its tree has there."""
    parts = [f"""
crc_table AS MATERIALIZED (
  WITH RECURSIVE t(b, step, v) AS (
    SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE step < 8)
  SELECT list(v ORDER BY b) AS crcs FROM t WHERE step = 8
), d AS MATERIALIZED (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: xor(a >> 8, crcs[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc,
    row_number() OVER () AS rid
  FROM documents, crc_table
), s0 AS MATERIALIZED (
  SELECT rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, leaf, leaf AS digest,
    CASE WHEN crc % {TAMPERED} = 0 THEN {_leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE leaf END AS folded, '' AS proof,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS c
  FROM (SELECT *, {_leaf('text')} AS leaf FROM d)
)"""]

    def climb(before: str, after: str) -> str:
        """One level up for every row: its node's run, hashed, and the digests beside it."""
        return f"""
{after}_n AS MATERIALIZED (SELECT DISTINCT tree, pos, digest, c FROM {before}
), {after}_r AS MATERIALIZED (
  SELECT tree, pos // {FANOUT} AS up, list(digest ORDER BY pos) AS run FROM {after}_n WHERE c > 1 GROUP BY 1, 2
), {after} AS MATERIALIZED (
  SELECT rid, doc_id, b.tree, leaf, CASE WHEN r.run IS NULL THEN digest ELSE sha256(array_to_string(run, '')) END AS digest,
    CASE WHEN r.run IS NULL THEN folded ELSE sha256(array_to_string(run[1:pos % {FANOUT}], '') || folded || array_to_string(run[pos % {FANOUT} + 2:], '')) END AS folded,
    CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(run[1:pos % {FANOUT}], '') || array_to_string(run[pos % {FANOUT} + 2:], '') END AS proof,
    pos // {FANOUT} AS pos, CAST(ceil(c / {FANOUT}) AS BIGINT) AS c{", subroot" if after.startswith("t") else ""}
  FROM {before} b LEFT JOIN {after}_r r ON b.tree = r.tree AND b.pos // {FANOUT} = r.up AND b.c > 1
)"""

    parts += [climb(f"s{k}", f"s{k + 1}") for k in range(levels)]
    parts.append(f"""
t0 AS MATERIALIZED (
  SELECT rid, doc_id, 0 AS tree, leaf, digest, folded, proof, tree AS pos, (SELECT count(DISTINCT tree) FROM s{levels}) AS c, digest AS subroot FROM s{levels}
)""")
    parts += [climb(f"t{k}", f"t{k + 1}") for k in range(levels)]
    return "WITH RECURSIVE " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM t{levels}"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _manifest_sql()}
