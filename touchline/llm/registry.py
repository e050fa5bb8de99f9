"""The operators as registered queries, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import language, pii, quality, toxicity
from touchline.llm.embeddings import embedding_groups
from touchline.llm.fingerprints import document_fingerprints
from touchline.llm.hard_negatives import hard_negatives
from touchline.llm.line_dedup import line_dedup
from touchline.llm.lm_score import cross_entropy_difference
from touchline.llm.minhash import minhash_groups
from touchline.llm.mixing import mix
from touchline.llm.packing import pack_documents
from touchline.llm.spelling import count_words, variants

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(_documents(spark, sf_dir), percent=85)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(_documents(spark, sf_dir))


def _fold(folds: int) -> Column:
    """Remainder of the id's CRC-32, which says which documents are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(4) != 2)
    scored = quality.score(docs, quality.train(docs, labels), keep=("doc_id",))
    return scored.select(
        "doc_id",
        F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(docs.filter(_fold(5) != 0))
    found = language.predict(docs, model, keep=("doc_id",))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir), pii.train(pii.labelled(spark)))


MIXTURE = {"lang": {"en": 3, "de": 2, "fr": 2, "es": 2}}  # equal domains, equal sources


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_documents(spark, sf_dir), weights=MIXTURE)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1 AND toxic = 0")
    return cross_entropy_difference(_documents(spark, sf_dir), good)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents teach nothing, not even as unlabelled text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(3) != 1)
    scored = toxicity.score(docs, toxicity.train(docs.filter(_fold(3) != 1), labels))
    return scored.select(
        "doc_id",
        F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(_documents(spark, sf_dir)))


QUERIES = [
    op1_line_dedup,
    op2_minhash_near_dedup,
    op3_packing,
    op4_document_fingerprints,
    op5_quality_classifier,
    op6_language_id,
    op7_personal_data,
    op8_mixing,
    op9_lm_score,
    op10_embedding_near_dedup,
    op11_toxicity,
    op12_hard_negatives,
    op13_spelling_variants,
]


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}


def _share_sql(nodes: str, parent: list[str], level: str, weight: str) -> str:
    """Quotas of the nodes of one level (columns: levels, capacity, budget)."""
    group = f"PARTITION BY {', '.join(parent)}" if parent else ""
    return f"""
      SELECT {', '.join([*parent, level])}, CASE WHEN filled THEN capacity ELSE CAST(w * (budget
          - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({group}), 0))
          // sum(CASE WHEN NOT filled THEN w END) OVER ({group}) AS BIGINT) END AS budget
      FROM (SELECT *, capacity * (sum(w) OVER ({group}) - coalesce(sum(w) OVER earlier, 0))
                <= w * (budget - coalesce(sum(capacity) OVER earlier, 0)) AS filled
            FROM (SELECT *, {weight} AS w FROM {nodes})
            WINDOW earlier AS ({group} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _mixing_sql() -> str:
    cases = " ".join(f"WHEN lang = '{name}' THEN {weight}" for name, weight in MIXTURE["lang"].items())
    levels = ["domain", "lang", "source"]
    parts = [
        """docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             'domain' || coalesce(CAST(CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS BIGINT) % 4
               AS VARCHAR), '') AS domain, CAST((length(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens FROM documents)""",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM docs GROUP BY ALL)",
        "whole AS (SELECT least(CAST(floor(sum(supply) * 0.8) AS BIGINT), 2 * sum(supply)) AS budget FROM leaves)",
    ]
    for depth, level in enumerate(levels):
        known = ", ".join(levels[: depth + 1])
        parent = levels[:depth]
        given = f"JOIN given{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN whole"
        weight = f"CASE {cases} ELSE 1 END" if level == "lang" else "1"
        parts.append(
            f"nodes{depth} AS (SELECT * FROM (SELECT {known}, 2 * sum(supply) AS capacity FROM leaves GROUP BY ALL) {given})"
        )
        parts.append(f"given{depth} AS ({_share_sql(f'nodes{depth}', parent, level, weight)})")
    parts += [
        """plan AS (SELECT *, CASE WHEN supply > 0 THEN CAST(budget // supply AS BIGINT) ELSE 0 END AS whole_epochs
             FROM leaves JOIN given2 USING (domain, lang, source))""",
        """keyed AS (SELECT d.*, whole_epochs, budget - whole_epochs * supply AS rest,
             CAST('0x' || substr(md5('7:' || whole_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
             FROM docs d JOIN plan USING (domain, lang, source))""",
        """placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key)
             - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS upto FROM keyed)""",
    ]
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, domain, lang, source, n_tokens, whole_epochs + CASE WHEN upto < rest THEN 1 ELSE 0 END AS copies
        FROM placed"""


_NEGATIVES_SQL = """
    WITH part AS (
      SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM part a JOIN part b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
    positive AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": _mixing_sql(), "op12_hard_negatives": _NEGATIVES_SQL}
