"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import html_blocks, knn, merkle, mixing, packing, periodic, pii, repair, rules, simhash, suffix, tiling, warc
from tallgrass.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tallgrass.surrogates.key", "of the demonstration, known to all")
    found = pii.anonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return found.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.array_join("_kinds", ",").alias("kinds"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rules.judged(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"), F.col("_n_repeat_words").alias("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"),
    )


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = knn.scored(docs, labels.filter(~knn.held_out(F.col("doc_id"))))
    return found.select("doc_id", knn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, domains = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), keep_text=False)
    return rated.select(
        "doc_id", F.col("_n").alias("n_tokens"), *[F.get("_p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], F.col("_rate").alias("rate")
    )


def op8_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encoded(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(table(spark, sf_dir, "documents"), with_text=True)
    left = F.expr("make_valid_utf8(cast(kept AS string))")  # a cut may fall inside a character
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", left.alias("text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.lowered(F.col("doc_id"), F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.col("_best")
    return periodic.with_runs(docs).withColumn("_best", periodic.longest(F.col("_runs"))).select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["shorter"]).alias("length"), best["period"].alias("period"),
        F.floor(-1000 * best["shorter"] / best["period"]).alias("exponent_milli"), periodic.runs_digest(F.col("_runs")).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _merkle_sql(levels: int = 8) -> str:
    """DuckDB SQL of the manifest for up to 16 to the power of ``levels`` rows a source and sources.

    ``c`` is the common crc32, bit by bit; ``l`` are the levels of the trees, ``t`` those of the tree
    of subroots, ``a`` and ``b`` the proofs on their way up through both.
    """
    shown = ["CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END".format(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0})) || ':' || {0} END"
    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    digit = "ascii(substr(CAST(doc_id AS VARCHAR), i, 1))"
    bits = f"list_reduce(list_prepend(xor(crc, CAST({digit} AS BIGINT)), [CAST(0 AS BIGINT) FOR z IN range(8)]), LAMBDA y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    out = [f"""c(doc_id, crc, i) AS (
  SELECT doc_id, CAST(4294967295 AS BIGINT), 1 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, {bits}, i + 1 FROM c WHERE i <= length(CAST(doc_id AS VARCHAR))
), h AS MATERIALIZED (
  SELECT documents.*, coalesce(xor(crc, 4294967295) % 5 = 0, false) AS changed FROM documents LEFT JOIN c ON documents.doc_id = c.doc_id AND c.i = length(CAST(c.doc_id AS VARCHAR)) + 1
), d AS MATERIALIZED (
  SELECT doc_id, source, sha256(concat({", ".join(shown)}, {text.format("text")})) AS leaf,
         CASE WHEN changed THEN sha256(concat({", ".join(shown)}, {text.format(lower)})) ELSE sha256(concat({", ".join(shown)}, {text.format("text")})) END AS seen
  FROM h
), l0 AS MATERIALIZED (
  SELECT *, leaf AS g, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS i FROM d
), a0 AS (SELECT doc_id, leaf, s, i, n, '' AS proof, seen AS f FROM l0)"""]  # fmt: skip

    def rise(nodes: str, rows: str) -> None:
        for k in range(levels):
            out.append(f"{nodes}r{k} AS MATERIALIZED (SELECT s, n, i // 16 AS j, list(g ORDER BY i) AS gs FROM {nodes}{k} GROUP BY ALL)")
            out.append(f"{nodes}{k + 1} AS MATERIALIZED (SELECT s, (n + 15) // 16 AS n, j AS i, CASE WHEN n = 1 THEN gs[1] ELSE sha256(array_to_string(gs, '')) END AS g FROM {nodes}r{k})")
            left, right = "array_to_string(gs[1 : i % 16], '')", "array_to_string(gs[i % 16 + 2 :], '')"
            out.append(
                f"{rows}{k + 1} AS (SELECT p.* REPLACE (i // 16 AS i, (p.n + 15) // 16 AS n, proof || CASE WHEN p.n = 1 THEN '' ELSE {left} || {right} END AS proof, "
                f"CASE WHEN p.n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f) FROM {rows}{k} p JOIN {nodes}r{k} r ON p.s = r.s AND p.i // 16 = r.j)"
            )

    rise("l", "a")
    out.append(f"t0 AS MATERIALIZED (SELECT 0 AS s, count(*) OVER () AS n, s AS i, g FROM l{levels})")
    out.append(f"b0 AS (SELECT doc_id, leaf, u.g AS subroot, 0 AS s, u.s AS i, (SELECT count(*) FROM l{levels}) AS n, proof, f FROM a{levels} p JOIN l{levels} u ON p.s = u.s)")
    rise("t", "b")
    return f"""WITH RECURSIVE {", ".join(out)}
SELECT doc_id, leaf, subroot, g AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = g AS verified FROM b{levels}, t{levels}"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_quality_rules": op2_quality_rules,
    "op3_knn_quality": op3_knn_quality,
    "op4_html_blocks": op4_html_blocks,
    "op5_warc": op5_warc,
    "op6_string_tiling": op6_string_tiling,
    "op7_mixing": op7_mixing,
    "op8_repair_ids": op8_repair_ids,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op5_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
""",
}
