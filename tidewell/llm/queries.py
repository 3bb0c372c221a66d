"""The queries opN_<name>, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, new_path
from tidewell.llm.decontaminate import contaminated
from tidewell.llm.exact_dedup import exact_groups
from tidewell.llm.language_id import identify
from tidewell.llm.mixing import mixing_rates
from tidewell.llm.near_dedup import near_groups
from tidewell.llm.quality import quality_scores
from tidewell.llm.secrets import BASE_RULES, RULES, joined, secret_spans
from tidewell.llm.suffix_dedup import repeated_passages
from tidewell.llm.token_counts import token_counts
from tidewell.llm.warc import archive, archived


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # A row without an id has no remainder and is not held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    marked = docs.withColumn("held_out", held_out)
    return identify(marked, docs.filter(~held_out), keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


#: Target weights of the domains (languages) in the mixture.
MIXTURE = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), MIXTURE)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = documents(spark, sf_dir, "pages"), new_path(spark, "warc")
    archive(pages, path)
    return archived(spark, path, pages.schema["page_id"].dataType.simpleString()).withColumnRenamed("id", "page_id")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["k"] < len(BASE_RULES))

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _secrets_sql() -> str:
    quoted = [r.pattern.replace("'", "''") for r in RULES]
    hits = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(t, '{q}') AS m, regexp_split_to_array(t, '{q}') AS p FROM d" for i, (r, q) in enumerate(zip(RULES, quoted)))
    held = " ".join(f"WHEN {i} THEN length({f"regexp_extract(x, '{q}', {r.group})" if r.group else 'x'}) >= {r.least}" for i, (r, q) in enumerate(zip(RULES, quoted)))
    counts = ", ".join(f"count(s.k) FILTER (s.k = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    span = "s.kind || ':' || s.a || ':' || s.e"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        hits AS ({hits}),
        each AS (SELECT doc_id, k, kind, unnest(m) AS x, unnest(p[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM hits WHERE len(m) > 0),
        ends AS (SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM each),
        s AS (SELECT doc_id, k, kind, e - length(x) AS a, e FROM ends WHERE CASE k {held} END)
        SELECT d.doc_id, {counts},
               sha256(coalesce(string_agg({span}, ',' ORDER BY s.a, s.k) FILTER (s.k < {len(BASE_RULES)}), '')) AS base_sha256,
               coalesce(string_agg({span}, ',' ORDER BY s.a, s.k), '') AS spans
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
    """


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), words=2, ratio=(80, 100))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_secret_scans": op9_secret_scans,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES = {
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT page_id, h, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op9_secret_scans": _secrets_sql(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # Windows of 200 bytes (400 hexadecimal digits), taken from pieces of 512 windows.
    "op4_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
        part AS (SELECT doc_id, c, substr(h, CAST(1024 * c + 1 AS BIGINT), 1424) AS h FROM (SELECT doc_id, h, unnest(range(0, (greatest(octet_length(raw) - 199, 0) + 511) // 512)) AS c FROM d)),
        win AS (SELECT doc_id, 512 * c + i AS s, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM (SELECT doc_id, c, h, unnest(range(0, least(512, length(h) // 2 - 199))) AS i FROM part)),
        twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
        hit AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM win WHERE m IN (SELECT m FROM twice) WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
        run AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM hit),
        span AS (SELECT doc_id, r, min(s) AS a, max(s) + 200 AS e FROM run GROUP BY doc_id, r),
        gap AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
        cut AS (SELECT gap.doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS kept FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id)
        SELECT d.doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN n_spans IS NULL THEN raw ELSE unhex(kept || substr(h, CAST(2 * last + 1 AS BIGINT))) END) AS kept_sha256
        FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
    """,
    # Sets that are similar enough have one of their rarest shingles in common: front.
    "op10_minhash_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
        sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY sh) AS f FROM s),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, sh) AS r FROM sized),
        front AS (SELECT doc_id, sh, n FROM ranked WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
        cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM front x JOIN front y ON x.sh = y.sh AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
        common AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS i FROM cand JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.sh = p.sh GROUP BY a, b),
        link AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
        least_ AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
        size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(least_.c, d.doc_id) AS component_id, coalesce(least_.c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least_ ON least_.a = d.doc_id
    """,
}
