"""The registered queries of this subpackage: each applies an operator to its
whole table with production parameters. ORACLE holds DuckDB SQL where SQL can
express the result."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import decontaminate, fim, langid, line_dedup, packing, repeats, secretscan, sharding, simhash, tokenfile, topk, urlfilter, whitening


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


def op2_substring_dedup(spark, sf_dir):
    out = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The rules of op3: fixed values.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op4_exact_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_simhash(spark, sf_dir):
    out = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"))


def op7_best_fit_packing(spark, sf_dir):
    out = packing.sequences(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_files(spark, sf_dir):
    return tokenfile.token_table(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = langid.predict(docs, langid.fit(docs, ~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_secret_scan(spark, sf_dir):
    out = secretscan.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in secretscan.BASE]
    return out.select(
        "doc_id", *[secretscan.count_of(k).alias(f"n_{k}") for k in base],
        F.sha2(secretscan.written_out(base), 256).alias("base_sha256"), secretscan.written_out().alias("spans"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_fill_in_middle(spark, sf_dir):
    out = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    hashes = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fim.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op9_language_id": op9_language_id,
    "op6_sharding": op6_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_line_dedup": op5_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_secret_scan": op11_secret_scan,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def either_case(pattern: str) -> str:
    """(?i:...) written out for ASCII letters alone: SQL's flag would also fold others to them."""
    return re.sub(r"\(\?i:(.*?)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def matches_sql(k: int, rule: secretscan.Rule) -> str:
    """All matches of a rule with what stands before each and its value."""
    p = either_case(f"(?:{rule.head})({rule.value})").replace("'", "''")
    return f"SELECT r, doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', 1) AS val, string_split_regex(t, '{p}') AS gap FROM d"


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
x AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS hs FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM x),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.h = f.h WHERE f.first < s.doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g),
j AS (SELECT k.doc_id, k.p, k.word, r.p IS NOT NULL AS gone FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.p = r.p),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(o.n, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op11_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(matches_sql(k, rule) for k, rule in enumerate(secretscan.RULES))}),
u AS (SELECT r, k, kind, least, unnest(hit) AS h, unnest(val) AS v, unnest(gap[:len(hit)]) AS g, generate_subscripts(hit, 1) AS i FROM m WHERE len(hit) > 0),
p AS (SELECT r, k, kind, least, h, v, (sum(length(g) + length(h)) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS z FROM u),
s AS (SELECT r, k, kind || ':' || (z - length(h)) || ':' || z AS span, z - length(h) AS a FROM p WHERE length(v) >= least),
o AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON d.r = o.r""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(w) AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS hs FROM d),
c AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s""",
}
