"""The registered queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyload.llm import (
    centroids,
    exact_dedup,
    html_text,
    mixing,
    packing,
    prefix_trie,
    quality,
    secrets,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file: in the folder that TOKENIZER_DIR names, else in the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


# The patterns once more, for the SQL: (kind, pattern, group whose length counts, its least length).
SECRET_PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("bearer", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)


def secret_sql() -> str:
    kinds = []
    for nth, (kind, pattern, group, least) in enumerate(SECRET_PATTERNS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        kinds.append(
            f"""SELECT doc_id, '{kind}' AS kind, {nth} AS nth, start_at, start_at + length(found) AS end_at FROM (
                SELECT doc_id, m[i] AS found, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start_at
                FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {quoted}) AS m,
                string_split_regex(text, {quoted}) AS s FROM d))) WHERE length(regexp_extract(found, {quoted}, {group})) >= {least}"""
        )
    span = "kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({' UNION ALL '.join(kinds)}),
        listed AS (SELECT doc_id, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
        coalesce(string_agg({span}, ',' ORDER BY start_at, nth) FILTER (WHERE nth < 3), '') AS base, string_agg({span}, ',' ORDER BY start_at, nth) AS spans
        FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN listed USING (doc_id)"""


@query("op2_secret_scan", secret_sql())
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_paths(table(spark, folder, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")
    spans = F.col("spans")
    kinds = F.transform(spans, lambda span: span["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select(
        "row.doc_id", *counts, F.sha2(secrets.span_text(spans, base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"), "blob"
    )


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query("op4_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, folder, "documents"), keep=["doc_id"])
    counts = [F.col(f"c.{name}") for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("row.doc_id", *counts, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


@query("op6_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op9_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
        FROM documents
    ), ranked AS (
        SELECT doc_id, n, normal,
               first_value(doc_id) OVER best AS keep_id, first_value(n) OVER best AS keep_n,
               count(*) OVER (PARTITION BY normal) AS group_size
        FROM t WINDOW best AS (PARTITION BY normal ORDER BY n DESC, doc_id ASC NULLS LAST)
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = keep_n AS kept, sha256(normal) AS text_sha256
    FROM ranked
    """,
)
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_classes(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op10_substring_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    ), numbered AS (
        SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS nth FROM lines
    ), placed AS (
        SELECT doc_id, nth, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
        FROM numbered
    ), split AS (
        SELECT *, CASE WHEN length(line) >= 200 THEN string_split_regex(line, '[.!?]+[ \t]+|[。！？]+') ELSE [line] END AS texts,
               CASE WHEN length(line) >= 200 THEN regexp_extract_all(line, '[.!?]+[ \t]+|[。！？]+') ELSE [] END AS ends
        FROM placed
    ), sentences AS (
        SELECT doc_id, nth, start_at, i, texts[i] || coalesce(ends[i], '') AS sentence FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM split)
    ), joined AS (
        SELECT *, coalesce(sum(CASE WHEN length(sentence) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, nth ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
        FROM sentences
    ), parts AS (
        SELECT doc_id, nth, part, any_value(start_at) AS line_at, string_agg(sentence, '' ORDER BY i) AS unit FROM joined GROUP BY doc_id, nth, part
    ), units AS (
        SELECT doc_id, nth, part, unit, length(unit) AS size,
               CAST(line_at + coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, nth ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at,
               trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS normal
        FROM parts
    ), judged AS (
        SELECT *, normal <> '' AND row_number() OVER (PARTITION BY normal ORDER BY doc_id, start_at) > 1 AS repeated FROM units
    ), gone AS (
        SELECT *, start_at - lag(start_at + size, 1, -9) OVER (PARTITION BY doc_id ORDER BY start_at) > 1 AS fresh FROM judged WHERE repeated
    ), runs AS (
        SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_at) AS run FROM gone
    ), passages AS (
        SELECT doc_id, sum(length) AS passage_chars FROM (SELECT doc_id, max(start_at + size) - min(start_at) AS length FROM runs GROUP BY doc_id, run)
        WHERE length >= 100 GROUP BY doc_id
    ), removed AS (
        SELECT doc_id, count(*) AS n_removed, sum(size) AS removed_chars,
               string_agg(start_at || ':' || (start_at + size), ',' ORDER BY start_at) AS spans
        FROM gone GROUP BY doc_id
    ), kept_lines AS (
        SELECT doc_id, nth, string_agg(CASE WHEN repeated THEN '' ELSE unit END, '' ORDER BY part) AS line FROM judged GROUP BY doc_id, nth
    ), kept AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY nth) AS kept_text FROM kept_lines GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(r.removed_chars, 0) AS BIGINT) AS removed_chars, CAST(coalesce(l.passage_chars, 0) AS BIGINT) AS passage_chars,
           coalesce(r.spans, '') AS removed_spans, k.kept_text
    FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id LEFT JOIN passages l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def substring_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    spans = F.array_join(F.transform("removed", lambda cut: F.concat_ws(":", cut["start"], cut["end"])), ",")
    return found.select("doc_id", "n_chars", "n_removed", "removed_chars", "passage_chars", spans.alias("removed_spans"), "kept_text")


@query("op1_toxicity")
def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), digest=True)


URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


@query("op11_url_filter")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)


def centroid_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after another, on one row per vector and component."""
    steps = [
        """WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), x AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(64)) AS i FROM kept)""",
        f"""c0 AS MATERIALIZED (
            SELECT k, unnest(v) AS c, unnest(range(64)) AS i FROM (
                SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v FROM kept
            ) WHERE k < {clusters}
        )""",
    ]
    for nth in range(rounds + 1):
        steps.append(
            f"""a{nth} AS MATERIALIZED (
                SELECT r, min({{'d': d, 'k': k}}) AS best FROM (
                    SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{nth} USING (i) GROUP BY r, k
                ) GROUP BY r
            )"""
        )
        if nth < rounds:
            steps.append(
                f"""c{nth + 1} AS MATERIALIZED (
                    SELECT o.k, o.i, coalesce(m.c, o.c) AS c FROM c{nth} o LEFT JOIN (
                        SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c FROM (
                            SELECT a.best.k AS k, i, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{nth} a JOIN x USING (r) GROUP BY a.best.k, i
                        )
                    ) m ON m.k = o.k AND m.i = o.i
                )"""
            )
    return ", ".join(steps) + f"""
        , named AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k),
        found AS (SELECT vec_id, a.best.k AS k, a.best.d AS d FROM a{rounds} a JOIN kept USING (r))
        SELECT vec_id, CAST(f.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM found f JOIN named USING (k)"""


@query("op12_centroid_clustering", centroid_sql())
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))


@query(
    "op13_prefix_trie",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns
        FROM t GROUP BY conv_id
    ), hashed AS (  -- CRC-32, bit by bit
        SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
            lambda state, byte: list_reduce(list_prepend(xor(state, byte), range(8)), lambda c, bit: xor(c // 2, (c % 2) * 3988292384))), 4294967295) % 4 AS h
        FROM own
    ), built AS (
        SELECT c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
        FROM hashed c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20
    ), prefix AS (
        SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends
        FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM built)
    ), node AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM prefix GROUP BY path, depth
    ), children AS (
        SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
    ), facts AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children,
               CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[depth].text, '[^ 	-
]+')) END AS saved
        FROM node n LEFT JOIN children c ON c.path = n.path
    ), subtree AS (
        SELECT path[1:above] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
        FROM (SELECT path, saved, n_children, unnest(range(depth + 1)) AS above FROM facts) GROUP BY 1
    )
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
    FROM facts f JOIN subtree s ON s.path = f.path LEFT JOIN node p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
    """,
)
def conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations"))
