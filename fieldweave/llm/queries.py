"""The registered queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import langid, lattice, minhash, multiindex, packing, partitions, quality, secrets, suffixes, tokens


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids, and the digest of the text that they decode to."""
    return lattice.encode(_read(spark, sf_dir, "documents")).select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "decoded_sha256")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text after sampling and decoding, which SQL can hold against the text before."""
    decoded = lattice.decode(lattice.encode(_read(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"), with_text=False).drop("redacted")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_multi_index, op2_minhash, op3_learned_partitions, op4_language, op5_sampled_pieces, op6_secrets, op7_suffix_repeats, op8_best_fit_packing, op9_token_counts, op10_quality, piece_round_trip)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


#: Nodes that each node reaches over links, itself included.
_REACH = "reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.c = l.u)"
_OP1 = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE u = id) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM reach GROUP BY id"""
_OP2 = f"""WITH RECURSIVE words AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
flat AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.id AS u, b.id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM flat a JOIN flat b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
links AS (SELECT u, v FROM pairs WHERE 100 * k >= 75 * (nu + nv - k)), nodes AS (SELECT id FROM sets),
{_REACH}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, id = c AS kept FROM sets JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) USING (id)"""
_OP7 = """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, unnest(list_transform(range(0, n - 99), lambda i: md5(h[2 * i + 1:2 * i + 200]))) AS s FROM docs),
later AS (SELECT doc_id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
steps AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps) GROUP BY doc_id, run),
parts AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS gone, count(*) AS n_runs, max(e) AS last, string_agg(h[2 * before + 1:2 * s], '' ORDER BY s) AS head FROM parts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n_runs, 0) AS n_spans, sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256 FROM docs LEFT JOIN cut USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_multi_index": _OP1,
        "op2_minhash": _OP2,
        "op7_suffix_repeats": _OP7,
        "piece_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    }
