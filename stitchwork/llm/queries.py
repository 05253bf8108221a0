"""The queries of the operators, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import (bit_clusters, exact_dedup, hierarchical_packing, language_id, main_text, piece_encoding,
                            quality_model, quality_rules, secret_scan, simhash, suffix_dedup, token_matrix, vector_codes)
from stitchwork.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.matrices(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.coalesce(F.col("_full"), F.sha2(F.col("_text"), 256))
    return exact_dedup.decide(table(spark, sf_dir, "documents"), extra={"text_sha256": digest})


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_encoding.encode(table(spark, sf_dir, "documents"))
    decoded = piece_encoding.decode(encoded, keep_ids=True)
    return decoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical_packing.digest(hierarchical_packing.pack(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents")))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def op12_bit_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bit_clusters.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_simhash, op3_token_matrices, op4_exact_dedup, op5_piece_encoding, op6_suffix_dedup, op7_packing,
    op8_secrets, op9_quality_model, op10_quality_rules, op11_vector_codes, op12_bit_clusters, op13_main_text)}

#: The character classes of the quality rules as patterns; what none of them holds is a class of its own.
_CLASS_PATTERNS = (r"[\p{Ll}\p{Lo}\p{Lm}]", r"[\p{Lu}\p{Lt}]", r"\p{Nd}", r"[\p{Z}\x09-\x0D]", r"[#*$%&|<>]", r"[.,;:]",
                   r"[\p{Mn}\p{Mc}]", r"[\p{P}\p{S}]")


def _divergence(p: str, q: str) -> str:
    """One bin's share of twice the Jensen-Shannon divergence."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"{part(p)} + {part(q)}"


def _rules_sql() -> str:
    found = [f"len(regexp_extract_all(t, '{x}'))" for x in _CLASS_PATTERNS[:-1]]
    signs = f"len(regexp_extract_all(t, '{_CLASS_PATTERNS[-1]}')) - {found[4]} - {found[5]}"
    bins = [*found, signs]
    classes = ", ".join(f"{x} AS c{i}" for i, x in enumerate(bins))
    rest = " - ".join(["length(t)", *(f"c{i}" for i in range(len(bins)))])
    n = len(bins) + 1
    sums = ", ".join(f"sum(c{i}) AS s{i}" for i in range(n))
    spread = " + ".join(_divergence(f"(c{i}::DOUBLE / length(t))", f"(s{i}::DOUBLE / chars)") for i in range(n))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS ps FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
  FROM w WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, t, ps, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
plain AS (SELECT doc_id, lang, unnest(ps) AS word FROM failed),
total AS (SELECT lang, count(*) AS words FROM plain GROUP BY lang),
common AS (SELECT lang, word, count(*) AS n, any_value(words) AS words FROM plain JOIN total USING (lang) GROUP BY lang, word HAVING count(*) >= any_value(words) / 500.0),
classes AS (SELECT doc_id, lang, t, {classes} FROM failed),
full_classes AS (SELECT *, {rest} AS c{n - 1} FROM classes),
ref AS (SELECT lang, sum(length(t)) AS chars, {sums} FROM full_classes GROUP BY lang),
by_class AS (SELECT doc_id, sqrt(greatest(0, ({spread}) / 2)) AS class_distance FROM full_classes JOIN ref USING (lang) WHERE length(t) > 0),
own AS (SELECT doc_id, lang, word, count(*) AS k FROM plain GROUP BY ALL),
bins AS (SELECT f.doc_id, c.word, coalesce(k, 0)::DOUBLE / len(ps) AS p, c.n::DOUBLE / c.words AS q FROM failed f JOIN common c USING (lang)
  LEFT JOIN own o ON o.doc_id = f.doc_id AND o.word = c.word WHERE len(ps) >= 100),
others AS (SELECT doc_id, 1 - sum(p) AS p, 1 - sum(q) AS q, sum({_divergence('p', 'q')}) AS js FROM bins GROUP BY doc_id),
by_word AS (SELECT doc_id, sqrt(greatest(0, (js + CASE WHEN p > 1e-12 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 1e-12 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS word_distance FROM others)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (coalesce(words, 0) >= 2000 AND (coalesce(n_words >= 50 AND class_distance >= 0.32, false) OR coalesce(word_distance >= 0.45, false)))) AS kept
FROM failed LEFT JOIN total USING (lang) LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id)"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 2) -> str:
    """K-means of 16 parts of four components, every part against every entry."""
    squares = " + ".join(f"(p.{c} - e.{c}) * (p.{c} - e.{c})" for c in "abcd")
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT i, part, min(({squares}) * 64 + entry) % 64 AS entry, min(({squares}) * 64 + entry) // 64 AS error
  FROM p JOIN e{k} e USING (part) GROUP BY i, part)""")
        if k < rounds:
            means = ", ".join(f"coalesce(floor(sum(p.{c}) / count(p.{c})::DOUBLE)::BIGINT, any_value(e.{c})) AS {c}" for c in "abcd")
            steps.append(f"""e{k + 1} AS (SELECT e.part, e.entry, {means} FROM e{k} e LEFT JOIN (near{k} JOIN p USING (i, part)) p
  ON p.part = e.part AND p.entry = e.entry GROUP BY e.part, e.entry)""")
    numbers = ", ".join(f"floor(256 * embedding[4 * part + {k + 1}]::DOUBLE)::BIGINT AS {c}" for k, c in enumerate("abcd"))
    return f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings WHERE {_FINITE}),
p AS (SELECT i, part, {numbers} FROM kept, (SELECT unnest(range(16)) AS part)),
e0 AS (SELECT part, i AS entry, a, b, c, d FROM p WHERE i < 64),
{", ".join(steps)},
codes AS (SELECT i, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{rounds} GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) FROM e{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (i)"""


def _clusters_sql(rounds: int = 3) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT p.i, c.k, sum((p.v - c.v) * (p.v - c.v)) AS d FROM p JOIN c{k} c USING (j) GROUP BY p.i, c.k),
near{k} AS (SELECT i, (min(d * 16 + k) % 16)::INTEGER AS k, min(d)::BIGINT AS d FROM d{k} GROUP BY i)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS (SELECT c.k, c.j, coalesce(floor(sum(p.v) / count(p.v)::DOUBLE)::BIGINT, any_value(c.v)) AS v
  FROM c{k} c LEFT JOIN (near{k} JOIN p USING (i)) p ON p.k = c.k AND p.j = c.j GROUP BY c.k, c.j)""")
    return f"""
WITH kept AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS i FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
p AS (SELECT i, j, floor(64 * embedding[j]::DOUBLE)::BIGINT AS v FROM kept, (SELECT unnest(range(1, 65)) AS j)),
c0 AS (SELECT i AS k, j, v FROM p WHERE i < 16),
{", ".join(steps)},
digests AS (SELECT k, sha256(string_agg(v, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, near{rounds}.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY near{rounds}.k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{rounds} USING (i) JOIN digests ON digests.k = near{rounds}.k"""


ORACLES = {
    "op11_vector_codes": _codes_sql(),
    "op12_bit_clusters": _clusters_sql(),
    "op10_quality_rules": _rules_sql(),
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
