"""The queries op1 to op10 and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, exact_dedup, language_model, license_scan, packing, quality_classifier, quality_rules, simhash, substring_dedup, toxicity
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 for low quality, 1 for good but toxic, 2 for good and clean."""
    grade = F.col("quality") * (2 - F.col("toxic"))
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade, levels=3)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), digests=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(table(spark, sf_dir, "documents"), digests=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in license_scan.TEMPLATES.items() for text in texts)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, name, body FROM (VALUES {quoted}) AS v(name, body)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT row_number() OVER () AS lid, rid, line FROM ln),
tw AS (SELECT k, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM t),
lw AS (SELECT lid, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM l),
tb AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] AS b FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM tw)),
lb AS (SELECT DISTINCT lid, w[i] || ' ' || w[i + 1] AS b FROM (SELECT lid, w, unnest(range(1, len(w))) AS i FROM lw)),
tn AS (SELECT k, count(*) AS m FROM tb GROUP BY k),
ls AS (SELECT lid, count(*) AS n FROM lb GROUP BY lid),
both_ AS (SELECT lid, k, count(*) AS c FROM lb JOIN tb USING (b) GROUP BY lid, k),
m AS (SELECT lid, name, CAST(2 * c AS DOUBLE) / (n + m) AS dice FROM both_ JOIN ls USING (lid) JOIN tn USING (k) JOIN t USING (k) WHERE 2 * c >= 0.8 * (n + m)),
best AS (SELECT lid, name, dice, row_number() OVER (PARTITION BY lid ORDER BY dice DESC, name) AS r FROM m),
per AS (SELECT rid, count(*) AS c, string_agg(DISTINCT name, ',' ORDER BY name) AS names,
               arg_min(name, struct_pack(a := -dice, b := name)) AS bn, max(dice) AS bd
        FROM best JOIN l USING (lid) WHERE r = 1 GROUP BY rid)
SELECT doc_id, coalesce(c, 0) AS n_license_lines, coalesce(names, '') AS licenses, bn AS best_license, bd AS best_dice
FROM d LEFT JOIN per USING (rid)
"""


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') AS host FROM documents),
w AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM r) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
ln AS (SELECT rid, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS k FROM raw),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln WHERE k <> '' GROUP BY rid),
hl AS (SELECT host, k, count(DISTINCT text) AS n FROM ln JOIN d USING (rid) WHERE k <> '' GROUP BY host, k),
hd AS (SELECT host, count(DISTINCT text) AS n FROM d WHERE rid IN (SELECT rid FROM ln WHERE k <> '') GROUP BY host),
f AS (SELECT hl.host, hl.k FROM hl JOIN hd USING (host) WHERE hl.n > 20 AND hl.n > 0.005::DOUBLE * hd.n),
gone AS (SELECT rid, sum(len(string_split(ln.k, ' '))) AS n FROM ln JOIN d USING (rid) JOIN f ON f.host = d.host AND f.k = ln.k GROUP BY rid),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
      FROM d JOIN w USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_frequent_words > 0 AND (n_words - n_frequent_words < 20 OR 100 * (n_words - n_frequent_words) < 50 * n_words) AS depleted FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept, n_frequent_words, depleted FROM v
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def queries() -> dict:
    every = (op1_quality_classifier, op2_license_scan, op3_quality_rules, op4_bpe_automaton, op5_best_fit_packing)
    every += (op6_substring_dedup, op7_simhash, op8_exact_dedup, op9_lm_scoring, op10_toxicity)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op3_quality_rules": OP3_SQL, "op8_exact_dedup": OP8_SQL}
