"""Queries of the corpus operators, one thin ``opN_<name>`` each, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrashift.llm import byte_bpe, clusters, minhash, mixing, packing, quality, runs, secrets, suffix_dedup, tokens, url_filter, warc, webp
from terrashift.llm.common import load, materialize, workspace


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    warc.write_archive(load(spark, sf_dir, "pages"), path)
    return warc.archive_index(spark, path)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_and_decode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(quality.ledger(load(spark, sf_dir, "documents")), "quality-ledger")
    return quality.apply_policy(scored, quality.PRODUCTION).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.failed(quality.BASE).alias("base_failed"), "kept", "fail_bits",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_columns(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), length=200))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = load(spark, sf_dir, "documents"), workspace(spark, "secrets")
    secrets.scan(docs, ledger)
    return secrets.digest_columns(secrets.report(docs, ledger))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024, end_id=0)
    return packing.digest_columns(pieces)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(materialize(webp.store(load(spark, sf_dir, "documents")), "media"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), words=3, threshold=85)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    docs = docs.withColumn("text", runs.stretched(docs["doc_id"], docs["text"]))
    return runs.digest_columns(runs.periodic_runs(docs, least_length=24, least_exponent=3))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_inertia(*clusters.assign(load(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, size=64, seed=2))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest_columns(mixing.plan(load(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_archive": op2_warc_archive,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_packing": op7_packing,
    "op8_media_columns": op8_media_columns,
    "op9_url_filters": op9_url_filters,
    "op10_minhash": op10_minhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_source_mix": op13_source_mix,
}


def _either_case(word: str) -> str:
    """Letters of either case without a flag: case folding of some engines reaches beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _for_sql(rule: secrets.Rule) -> str:
    words = "password|passwd|secret|token|api_?key"
    plain = re.sub(r"(?<=[*+}])\+", "", rule.pattern)  # an engine that doesn't go back has no possessive signs
    return plain.replace(f"(?i:{words})", f"(?:{_either_case(words)})").replace("'", "''")


def _matches_sql(i: int, rule: secrets.Rule) -> str:
    p = _for_sql(rule)
    return f"""
        SELECT doc_id, '{rule.name}' AS kind, {i} AS rank, {rule.least} AS least, k, glen, mlen, vlen FROM (
          SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS glen,
                 unnest(list_transform(m, lambda x: length(x))) AS mlen, unnest(list_transform(v, lambda x: length(x))) AS vlen
          FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m,
                       regexp_extract_all(text, '{p}', {rule.group}) AS v FROM d WHERE regexp_matches(text, '{p}')))"""


def _spans_sql(only: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE {only}), '')"


_MEASURES_SQL = r"""
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1)
          GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                   + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                   + CASE WHEN word_chars > 15 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
                   + CASE WHEN 100 * n_upper_words > 60 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)"""



def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Every round is a table of centroids (c, j, m) and one of the nearest of each vector."""
    parts = [
        """e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "p AS MATERIALIZED (SELECT r, j, floor(256 * embedding[j]::DOUBLE)::BIGINT AS x FROM e, range(1, 65) AS g(j))",
        f"""f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) - 1 AS c
              FROM e QUALIFY c < {k})""",
        "c0 AS MATERIALIZED (SELECT c, j, x AS m FROM f JOIN p ON p.r = f.r)",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT r, c, sum((x - m) * (x - m))::BIGINT AS d FROM p JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, c{i}.j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{i} LEFT JOIN (
                SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN p USING (r) GROUP BY c, j) q ON q.c = c{i}.c AND q.j = c{i}.j)""")
    return f"""WITH {", ".join(parts)},
        h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} a JOIN e ON e.r = a.r JOIN h ON h.c = a.c"""


_MIX_SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    k AS (SELECT *, substr(md5('13:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size), 1, 16) AS key FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
    -- in order of the level at which sources reach their limit, each is full if the level of those not yet full is above its own
    o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(w) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM s WINDOW v AS (ORDER BY cap / w::DOUBLE, source NULLS LAST)),
    f AS (SELECT source, source_size, cap, w, source_size = 0 OR rest * w > cap * shares AS full_ FROM o),
    t AS (SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE full_) OVER (), 0))::DOUBLE * w
                                                                   / sum(w) FILTER (WHERE NOT full_) OVER () END AS target FROM f),
    b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    e AS (SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size)::BIGINT ELSE 0 END AS whole FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken FROM e"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES: dict[str, str] = {
    "op2_warc_archive": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT html, min(page_id) AS first_id, sha1(html) AS hexed,
                     strlen(html)::BIGINT AS payload_bytes FROM p GROUP BY html),
        b AS (SELECT html, first_id, payload_bytes,
                     list_aggregate(list_transform(range(0, 32), lambda i:
                       substr('{_B32}', 1 + (((('0x' || substr(hexed, (i // 4) * 5 + 1, 5))::BIGINT) >> (5 * (3 - i % 4))) & 31)::INT, 1)),
                       'string_agg', '') AS payload_digest FROM d)
        SELECT p.page_id, b.payload_bytes, b.payload_digest,
               CASE WHEN p.page_id = b.first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id = b.first_id THEN NULL ELSE b.first_id END AS refers_to
        FROM p JOIN b ON p.html = b.html""",
    "op9_url_filters": """
        WITH p AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (
          SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.rverdict,
                 row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
          FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op4_quality_rules": f"""WITH {_MEASURES_SQL}
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b""",
    "op6_secret_scans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({" UNION ALL ".join(_matches_sql(i, r) for i, r in enumerate(secrets.RULES))}),
        p AS (SELECT *, sum(glen + mlen) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS e FROM m),
        f AS (SELECT doc_id, kind, rank, e - mlen AS s, e FROM p WHERE vlen >= least)
        SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({_spans_sql("rank < 3")}) AS base_sha256, {_spans_sql("rank >= 0")} AS spans
        FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
    "op12_centroid_clusters": _clusters_sql(),
    "op13_source_mix": _MIX_SQL,
    "op10_minhash": """
        WITH RECURSIVE w AS (
          SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (
                SELECT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
                FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS MATERIALIZED (
              SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id
                                    GROUP BY p.doc_id, q.doc_id) x
              JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.both >= 85 * (na.n + nb.n - x.both)),
        r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
               coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
        FROM documents w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id""",
}
