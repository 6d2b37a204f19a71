"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, fim, flac, lines, mixing, pii, rules, simhash, suffixes, tokens, toxicity, trie, warc
from loomwork.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file; LOOMWORK_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("LOOMWORK_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.col("_copy").cast("long").alias("copy_no"), F.col("_copies").cast("long").alias("n_copies"), F.col("_mix").alias("mix_key"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_trie": op1_simhash_trie,
    "op3_flac_media": op3_flac_media,
    "op4_quality_rules": op4_quality_rules,
    "op2_pii_bilstm_crf": op2_pii_bilstm_crf,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_arc_to_warc": op11_arc_to_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

STRIPPED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule_sql() -> str:
    return " AND ".join(f"{r.metric} {op} {v}" for r in rules.RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)


ORACLES: dict[str, str] = {
    "op4_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        win AS (SELECT rn, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') AS s
                FROM (SELECT rn, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) AS i FROM w)),
        rep AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, s) AS n FROM win) WHERE n > 1),
        cov AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + {rules.WINDOW})) AS p FROM rep) GROUP BY rn),
        m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                     coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
                     len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(rules.STOP_WORDS)))}))) AS n_stop,
                     len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_alpha
              FROM w LEFT JOIN cov USING (rn)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                     CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
                     CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
                     CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
                     CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
                     CASE WHEN n_words > 0 THEN n_alpha / n_words ELSE 0 END AS alpha_ratio,
                     CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM m)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND {_rule_sql()} AS kept FROM f""",
    "op6_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT rn, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {STRIPPED}), {LOWERED}) AS key FROM l),
        hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= {lines.LEAST_DOCS}),
        f AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM f GROUP BY rn""",
    "op9_source_mixing": f"""
        WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, pow(n, {mixing.POWER}) / (SELECT sum(pow(n, {mixing.POWER})) FROM n) * (SELECT sum(n) FROM n) / n AS mean FROM n),
        q AS (SELECT source, greatest(ceil(mean / {mixing.PART}), 1)::BIGINT AS parts, mean / greatest(ceil(mean / {mixing.PART}), 1) AS m FROM r),
        c AS (SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
              FROM (SELECT source, m, unnest(range(0, {mixing.TERMS})) AS k FROM q)),
        cdf AS (SELECT source, list(upto ORDER BY k) AS steps FROM c GROUP BY source),
        u AS (SELECT d.*, steps, list_transform(range(1, parts + 1),
                     lambda j: ('0x' || substr(md5('{mixing.SEED}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || j::VARCHAR), 1, 13))::BIGINT / {1 << 52}) AS us
              FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
        x AS (SELECT * EXCLUDE (steps, us), list_sum(list_transform(us, lambda v: len(list_filter(steps, lambda s: s <= v))))::BIGINT AS n_copies FROM u),
        e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM x WHERE n_copies > 0)
        SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
               md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR || '|mix') AS mix_key FROM e""",
    "op11_arc_to_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
        h AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha1(raw) AS x, row_number() OVER (PARTITION BY raw ORDER BY page_id NULLS LAST) AS n,
                     first_value(page_id) OVER (PARTITION BY raw ORDER BY page_id NULLS LAST) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(x, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to FROM h""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
                     sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                     lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda v, z: xor(v >> 1, 3988292384 * (v & z)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
        r AS (SELECT k.c, 0 AS side, b.i, b.x, b.chars FROM k JOIN t b ON b.c = k.c - k.c % 100 AND b.i < k.h
              UNION ALL SELECT k.c, 1, t.i, t.x, t.chars FROM k JOIN t ON t.c = k.c AND t.i >= k.h),
        p AS (SELECT c, list(x ORDER BY side, i) AS xs, list(chars ORDER BY side, i) AS cs FROM r GROUP BY c),
        f AS (SELECT k.c, coalesce(xs, []) AS xs, coalesce(cs, []) AS cs FROM k LEFT JOIN p USING (c)),
        m AS (SELECT c, d, array_to_string(xs[1:d], '') AS path, array_to_string(xs[1:d - 1], '') AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars, len(xs) = d AS ends
              FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM f)),
        n AS (SELECT path, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(chars) AS chars,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path),
        kids AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
        s AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens FROM w a JOIN w b ON starts_with(b.path, a.path) GROUP BY a.path)
        SELECT w.conv_id, w.depth::BIGINT AS depth, CASE WHEN w.depth > 0 THEN up.conv_id END AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
        FROM w JOIN s USING (path) LEFT JOIN n up ON up.path = w.up""",
    "op13_fill_in_middle": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        u AS (SELECT doc_id, t, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h,
                     regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM d),
        c AS (SELECT *, len(k)::BIGINT AS n, least(h[1] % (len(k) + 1), h[2] % (len(k) + 1)) AS a, greatest(h[1] % (len(k) + 1), h[2] % (len(k) + 1)) AS b FROM u),
        p AS (SELECT doc_id, t, n, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m, array_to_string(k[b + 1:n], '') AS s,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {fim.RATE} THEN 'plain'
                          WHEN h[4] % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p""",
}
