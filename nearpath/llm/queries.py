"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from nearpath.llm import bpe, centroid_clusters
from nearpath.llm.byte_dedup import LENGTH, without_repeats
from nearpath.llm.fingerprint import edited_fingerprints
from nearpath.llm.html_extract import extract_main_text
from nearpath.llm.jaccard_join import jaccard_classes
from nearpath.llm.language_id import identify
from nearpath.llm.lattice_lm import lattice_scores
from nearpath.llm.lexical_search import TOP, lexical_search
from nearpath.llm.license_scan import license_scan
from nearpath.llm.packing import pack_documents
from nearpath.llm.quality_rules import quality_rules
from nearpath.llm.substring_dedup import repeated_passages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(
        documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return encoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


@register
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_blank = F.regexp_replace("kept_text", "[\\x20\\x09-\\x0D]+", " ")
    return repeated_passages(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.trim(one_blank), 256).alias("kept_sha256"))


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


@register
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next", "edited_containment", "n_shingles",
    )


@register
def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), pages(spark, sf_dir))


@register
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(documents(spark, sf_dir), vocabulary, with_ids=False)


@register
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).drop("class", "node", "text_key")


@register
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(pages(spark, sf_dir))


@register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search(documents(spark, sf_dir), items).drop("item_number")


def _search_sql(k: int) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = (r"unnest(regexp_extract_all(" + lower +
             r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")
    return " ".join(f"""WITH
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    b AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
    t AS MATERIALIZED (SELECT r, term, count(*) AS tf
      FROM (SELECT r, {words.format("text")} AS term FROM d) GROUP BY r, term),
    q AS MATERIALIZED (SELECT i, term, count(*) AS n
      FROM (SELECT i, {words.format("text")} AS term FROM b) GROUP BY i, term),
    s AS MATERIALIZED (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY r),
    a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
    m AS (SELECT r, 25 + (75 * n * docs) // terms AS m FROM s, a),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM t, a GROUP BY term, docs),
    f AS (SELECT i, r, CAST(sum(q.n * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
      SELECT item_id, doc_id, score, row_number() OVER (
        PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM f JOIN d USING (r) JOIN b USING (i) WHERE score > 0)
    WHERE rank <= {k}""".split())


SQL["op11_lexical_search"] = _search_sql(TOP)


@register
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    clusters, centroids = centroid_clusters.centroid_clusters(embeddings)
    digests = spark.createDataFrame(
        list(enumerate(centroid_clusters.centroid_digests(centroids))),
        "cluster int, centroid_sha256 string")
    return clusters.join(F.broadcast(digests), "cluster")  # one row a centroid


def _clusters_sql(k: int, rounds: int, dimension: int, scale: int, seed: int) -> str:
    """Every round as two tables: who is nearest to which centroid, and the centroids."""
    squared = "list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    tables = [f"""w AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE len(embedding) = {dimension}
        AND len(list_filter(embedding, lambda x: isfinite(x))) = {dimension})""",
        f"""c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v
      FROM w WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        tables.append(f"""a{i} AS MATERIALIZED (
      SELECT r, min((d, c)) AS best FROM (SELECT r, c.c, CAST({squared} AS BIGINT) AS d FROM w, c{i} AS c)
      GROUP BY r)""")
        if i < rounds:
            tables.append(f"""c{i + 1} AS MATERIALIZED (
      SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN (
        SELECT c, list(x ORDER BY i) AS v FROM (
          SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
          FROM (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i
                FROM w JOIN a{i} USING (r))
          GROUP BY c, i) GROUP BY c) AS m ON m.c = c.c)""")
    return " ".join(f"""WITH {", ".join(tables)}
    SELECT w.vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
      CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
      CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM w JOIN a{rounds} USING (r) JOIN c{rounds} AS c ON c.c = best[2]""".split())


SQL["op12_centroid_clusters"] = _clusters_sql(
    centroid_clusters.K, centroid_clusters.ROUNDS, centroid_clusters.DIMENSION,
    centroid_clusters.SCALE, centroid_clusters.SEED)


@register
def op13_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def _repeats_sql(length: int) -> str:
    """All windows, by their digests; the texts as two hexadecimal digits a byte."""
    return " ".join(f"""WITH
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
      hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * length})) AS m
      FROM (SELECT r, h, unnest(range(len(h) // 2 - {length} + 1)) AS i FROM d)),
    x AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{length} - 1) + {length} AS new
      FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
    s AS (SELECT r, g, min(i) AS a, max(i) + {length} AS b
      FROM (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS g FROM x)
      GROUP BY r, g),
    p AS (SELECT r, g, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY g), 0) AS after FROM s),
    k AS (SELECT p.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
        string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY g) AS front
      FROM p JOIN d USING (r) GROUP BY p.r)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes,
      CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
      CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN k USING (r)""".split())


SQL["op13_byte_dedup"] = _repeats_sql(LENGTH)


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir).drop("ids")
