"""Registered queries of phrases and key phrases, over all words of all texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import phrases
from weftline.queries import registered, table

PHRASES_SQL = r"""
s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\x20\x09]+')) AS seg FROM documents),
w AS (SELECT doc_id, regexp_extract_all(seg, '[\p{L}\p{N}]+') AS w FROM s),
g AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) r(n))),
c AS (SELECT n, gram, count(*)::DOUBLE AS c FROM g GROUP BY ALL),
t AS (SELECT n, sum(c) AS total FROM c GROUP BY 1),
x AS (SELECT n, gram, c, string_split(gram, ' ') AS w, unnest(range(1, n)) AS i FROM c WHERE n > 1 AND c >= 5),
y AS (SELECT x.gram, x.n, x.c, a.c AS ca, b.c AS cb, tn.total AS nn, x.c / tn.total AS p, a.c / ta.total AS pa, b.c / tb.total AS pb, greatest(0, tn.total - a.c - b.c + x.c) AS d
  FROM x JOIN c a ON a.gram = array_to_string(w[1:i], ' ') JOIN c b ON b.gram = array_to_string(w[i + 1:], ' ') JOIN t tn ON tn.n = x.n JOIN t ta ON ta.n = i JOIN t tb ON tb.n = x.n - i),
z AS (SELECT *, ca + cb - c + d AS total, ca - c AS l, cb - c AS r FROM y),
m AS (SELECT gram AS phrase, n AS words, c::BIGINT AS count, min(ln(p / (pa * pb)) / -ln(p)) AS npmi,
  min(2 * (c * ln(c * total / (ca * cb)) + CASE WHEN l > 0 THEN l * ln(l * total / (ca * (l + d))) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(r * total / ((r + d) * cb)) ELSE 0 END
    + CASE WHEN d > 0 THEN d * ln(d * total / ((r + d) * (l + d))) ELSE 0 END)) AS g2 FROM z GROUP BY ALL),
mined AS (SELECT * FROM m WHERE npmi >= 0.3 AND g2 >= 10.83)"""


@registered(f"WITH {PHRASES_SQL} SELECT phrase, words::INTEGER AS words, count, round(npmi, 6) AS npmi, round(g2, 3) AS g2 FROM mined")
def mined_phrases(spark, sf_dir):
    """Phrases of two and three words, with how strongly and how surely they hold together."""
    p = phrases.phrases(table(spark, sf_dir, "documents"), id_col="doc_id")
    return p.select("phrase", "words", "count", F.round("npmi", 6).alias("npmi"), F.round("g2", 3).alias("g2"))


@registered(f"""
WITH {PHRASES_SQL}, f AS (SELECT doc_id, gram AS phrase, count(*) AS tf FROM g WHERE gram IN (SELECT phrase FROM mined) GROUP BY ALL), d AS (SELECT phrase, count(*) AS df FROM f GROUP BY 1),
k AS (SELECT doc_id, phrase, tf, df, round(tf * ln((SELECT count(DISTINCT doc_id) FROM documents)::DOUBLE / df), 9) AS weight FROM f JOIN d USING (phrase)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase) AS rank FROM k)
SELECT doc_id AS document_id, rank::INTEGER AS rank, phrase, tf, df, weight FROM r WHERE rank <= 5""")
def document_key_phrases(spark, sf_dir):
    """The five phrases of each document with the greatest TF-IDF."""
    docs = table(spark, sf_dir, "documents")
    return phrases.key_phrases(docs, phrases.phrases(docs, id_col="doc_id"), id_col="doc_id")
