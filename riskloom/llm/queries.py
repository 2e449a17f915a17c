"""The registered queries of the corpus operators."""

from __future__ import annotations

from riskloom.llm.clusters import op11_centroid_clustering
from riskloom.llm.html import op6_html_extraction
from riskloom.llm.jaccard import op13_ngram_jaccard
from riskloom.llm.langid import op9_language_id
from riskloom.llm.leaks import op5_benchmark_decontamination
from riskloom.llm.mixing import op3_lm_scoring
from riskloom.llm.negatives import op12_hard_negatives
from riskloom.llm.pieces import op4_sentencepiece
from riskloom.llm.quality import op8_quality_classifier
from riskloom.llm.simhash import op1_simhash_near_dedup
from riskloom.llm.suffixes import op10_suffix_array_dedup
from riskloom.llm.topk import op7_exact_top_k
from riskloom.llm.tokens import op2_token_counts

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.w, v.w) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
 SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 5"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
 s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS alike, CAST(list_inner_product(a.w, v.w) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
 n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS place
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
 SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 5"""

_ROUNDS = "".join(
    f""",
 a{r} AS MATERIALIZED (SELECT v.n, v.vec_id, v.w, min({{'d': list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS m
  FROM v, c{r} c GROUP BY ALL)"""
    + (
        ""
        if r == 10
        else f""",
 c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(s.w, c{r}.w) AS w FROM c{r} LEFT JOIN
  (SELECT c, list(CAST((t - ((t % k) + k) % k) // k AS BIGINT) ORDER BY i) AS w FROM
   (SELECT m.c AS c, i, sum(w[i])::BIGINT AS t, count(*) AS k FROM a{r}, range(1, 65) u(i) GROUP BY ALL) GROUP BY c) s ON s.c = c{r}.c)"""
    )
    for r in range(11)
)

_CLUSTERS = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), w) - 1 AS c, w FROM v QUALIFY c < 8){_ROUNDS}
 SELECT vec_id, CAST(m.c AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
 FROM a10 JOIN c10 c ON c.c = m.c"""

_JACCARD = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
 x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 l AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.other)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

#: Inner products, rounds over centroids, and joins of shingles are plain SQL; the other operators have no form in it
#: that is exact on whole tables in reasonable time, and tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op7_exact_top_k": _TOP_K, "op11_centroid_clustering": _CLUSTERS, "op12_hard_negatives": _NEGATIVES, "op13_ngram_jaccard": _JACCARD}
