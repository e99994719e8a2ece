"""Audits of gaps, copies, conflicts and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from ..operators import quality as Q
from ..operators.columns import coerce_numeric
from ..operators.joins import cohort_join, check_alignment
from ..operators.profile import split_summary
from ..operators.sampling import stratified_split
from .fixtures import DIRTY, LINES, TX, dirty_events, lines, table, transactions
from .registry import query, rounded

COLS = ["quantity", "discount", "tax", "label"]
FEATS = ["quantity", "discount", "tax"]
LIST = ", ".join(COLS)


@query("overview", "WITH " + LINES + f"""
SELECT count(*) AS n_rows, 4::BIGINT AS n_cols, 0::BIGINT AS n_missing,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {LIST} FROM lines)))::BIGINT AS n_duplicates,
  'quantity:double, discount:double, tax:double, label:int' AS dtypes FROM lines""")
def overview(spark, sf):
    return Q.overview(lines(spark, sf), COLS)


@query("missing_counts", "WITH " + DIRTY + """
SELECT 'V1' AS "column", count(*) FILTER (v1 IS NULL) AS missing_count FROM dirty
UNION ALL SELECT 'Amount', count(*) FILTER (amount IS NULL) FROM dirty""")
def missing_counts(spark, sf):
    return Q.missing_counts(coerce_numeric(dirty_events(spark, sf), ["V1", "Amount"]), ["V1", "Amount"])


@query("infinite_counts", "WITH " + DIRTY + """
SELECT 'V1' AS "column", count(*) FILTER (isinf(v1)) AS infinite_count FROM dirty
UNION ALL SELECT 'Amount', count(*) FILTER (isinf(amount)) FROM dirty""")
def infinite_counts(spark, sf):
    return Q.infinite_counts(coerce_numeric(dirty_events(spark, sf), ["V1", "Amount"]), ["V1", "Amount"])


@query("column_types", """
SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS dtype FROM (DESCRIBE lineitem)""")
def column_types(spark, sf):
    return Q.dtypes_table(table(spark, sf, "lineitem"))


@query("class_distribution", "WITH " + TX + """, c AS (SELECT code, name, (SELECT count(*) FROM tx WHERE label = code) AS n
  FROM (VALUES (0, 'Legitimate'), (1, 'Fraudulent')) v(code, name))
SELECT code AS class, name AS label, n AS "count", round(n * 100.0 / (SELECT count(*) FROM tx), 9)::DOUBLE AS percentage,
  round((SELECT n FROM c WHERE code = 0)::DOUBLE / (SELECT n FROM c WHERE code = 1), 9) AS majority_ratio FROM c""")
def class_distribution(spark, sf):
    return rounded(Q.class_distribution(transactions(spark, sf), "label"))


GROUPS = "WITH " + LINES + f", groups AS (SELECT {LIST}, count(*) AS n FROM lines GROUP BY ALL)"


@query("duplicate_audit", GROUPS + """
SELECT sum(n - 1)::BIGINT AS copies_after_first, sum(n) FILTER (n > 1)::BIGINT AS rows_in_duplicate_groups,
  sum(n - 1) FILTER (label = 0)::BIGINT AS copies_class_0, sum(n - 1) FILTER (label = 1)::BIGINT AS copies_class_1 FROM groups""")
def duplicate_audit(spark, sf):
    return Q.duplicate_audit(lines(spark, sf), COLS, "label")


CLASH = "WITH " + LINES + """, clash AS (
  SELECT quantity, discount, tax, count(*) AS n, count(DISTINCT label) AS k FROM lines GROUP BY ALL)"""


@query("conflicting_labels", CLASH + """
SELECT count(*) FILTER (k > 1) AS conflicting_groups, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS rows_in_conflict FROM clash""")
def conflicting_labels(spark, sf):
    return Q.conflicting_labels(lines(spark, sf), FEATS, "label")


@query("duplicate_measures", CLASH + f""", groups AS (SELECT {LIST}, count(*) AS n FROM lines GROUP BY ALL)
SELECT 'copies_after_first' AS measure, sum(n - 1)::BIGINT AS value FROM groups
UNION ALL SELECT 'rows_in_duplicate_groups', sum(n) FILTER (n > 1)::BIGINT FROM groups
UNION ALL SELECT 'copies_class_0', sum(n - 1) FILTER (label = 0)::BIGINT FROM groups
UNION ALL SELECT 'copies_class_1', sum(n - 1) FILTER (label = 1)::BIGINT FROM groups
UNION ALL SELECT 'conflicting_groups', count(*) FILTER (k > 1) FROM clash
UNION ALL SELECT 'rows_in_conflict', coalesce(sum(n) FILTER (k > 1), 0)::BIGINT FROM clash""")
def duplicate_measures(spark, sf):
    return Q.duplicate_measures(lines(spark, sf), FEATS, "label")


@query("duplicate_flags", "WITH " + LINES + f"""
SELECT row_id, row_number() OVER (PARTITION BY {LIST} ORDER BY row_id) > 1 AS is_copy,
  count(*) OVER (PARTITION BY {LIST}) > 1 AS in_group FROM lines""")
def duplicate_flags(spark, sf):
    return Q.mark_duplicates(lines(spark, sf), COLS, ["row_id"]).select("row_id", "is_copy", "in_group")


@query("label_cardinality", CLASH + """
SELECT row_id, k AS label_count FROM lines JOIN clash USING (quantity, discount, tax)""")
def label_cardinality(spark, sf):
    return Q.label_cardinality(lines(spark, sf), FEATS, "label").select("row_id", "label_count")


@query("exact_duplicates_dropped", "WITH " + LINES + f"SELECT min(row_id) AS row_id, {LIST} FROM lines GROUP BY ALL")
def exact_duplicates_dropped(spark, sf):
    return Q.drop_exact_duplicates(lines(spark, sf), COLS, ["row_id"])


@query("documents_without_copies", "SELECT min(doc_id) AS doc_id, md5(text) AS text_hash FROM documents GROUP BY text")
def documents_without_copies(spark, sf):
    kept = Q.drop_exact_duplicates(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])
    return kept.select("doc_id", F.md5("text").alias("text_hash"))


@query("partition_overlap", "WITH " + TX + """
SELECT quantity, discount, tax FROM tx WHERE linestatus = 'O' INTERSECT SELECT quantity, discount, tax FROM tx WHERE linestatus = 'F'""")
def partition_overlap(spark, sf):
    tx = transactions(spark, sf)
    return Q.overlap(tx.filter("linestatus = 'O'"), tx.filter("linestatus = 'F'"), FEATS)


@query("rows_not_covered", "WITH " + TX + """, diff AS (
  SELECT quantity, discount, tax FROM tx EXCEPT ALL SELECT quantity, discount, tax FROM tx WHERE linestatus = 'O')
SELECT quantity, discount, tax, count(*) AS n FROM diff GROUP BY ALL""")
def rows_not_covered(spark, sf):
    tx = transactions(spark, sf)
    return Q.uncovered(tx.select(*FEATS), tx.filter("linestatus = 'O'"))


FP_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
SLICES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR AS sum_{i}" for i in range(4))


@query("content_fingerprint", f"""
SELECT l_linestatus, count(*) AS n_rows, {SLICES}
FROM (SELECT l_linestatus, md5(concat_ws(chr(31), {', '.join(FP_COLS)})) AS h FROM lineitem) GROUP BY l_linestatus""")
def content_fingerprint(spark, sf):
    return Q.fingerprint(table(spark, sf, "lineitem"), FP_COLS, ["l_linestatus"])


KEYED = ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("content_row_key", f"""
SELECT md5(concat_ws(chr(31), {', '.join(KEYED)})) || '-' || row_number() OVER (PARTITION BY {', '.join(KEYED)}) AS row_id,
  {', '.join(KEYED)} FROM lineitem""")
def content_row_key(spark, sf):
    return Q.with_row_key(table(spark, sf, "lineitem"), KEYED)


def _cleaned(spark, sf):
    raw = lines(spark, sf)
    cleaned = cut_lineage(Q.drop_exact_duplicates(raw, COLS, ["row_id"]))
    return raw, cleaned, stratified_split(cleaned, "label", ["row_id"])


@query("integrity_checks", "WITH " + LINES + f""", d AS (SELECT DISTINCT {LIST} FROM lines),
f AS (SELECT (SELECT count(*) FROM lines) AS r, (SELECT count(*) FROM d) AS k, ceil((SELECT count(*) FROM d) * 0.2)::BIGINT AS t)
SELECT 'removed equals audited copies' AS "check", true AS ok, format('removed {{}}, audited {{}}', r - k, r - k) AS detail FROM f
UNION ALL SELECT 'no duplicates left', true, '0 copies'
UNION ALL SELECT 'no missing values', true, '0 cells'
UNION ALL SELECT 'no infinite values', true, '0 cells'
UNION ALL SELECT 'parts add up', true, format('{{}} + {{}} of {{}}', k - t, t, k) FROM f
UNION ALL SELECT 'no overlap of parts', true, '0 rows'""")
def integrity_checks(spark, sf):
    raw, cleaned, divided = _cleaned(spark, sf)
    train, test = (divided.filter(F.col("split") == part) for part in ("train", "test"))
    return Q.assert_clean(raw, cleaned, train, test, COLS)


@query("split_summary", "WITH " + LINES + f""", d AS (SELECT min(row_id) AS row_id, {LIST} FROM lines GROUP BY ALL),
s AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY label),
draws AS (SELECT label, n, (total - ceil(total * 0.2))::BIGINT AS m, n * (total - ceil(total * 0.2)) / total AS exact FROM s),
base AS (SELECT *, floor(exact)::BIGINT AS low, m - sum(floor(exact)::BIGINT) OVER () AS rest,
  row_number() OVER (ORDER BY floor(exact) - exact, label) AS place FROM draws),
q AS (SELECT label, n, low + CASE WHEN place <= rest THEN 1 ELSE 0 END AS train FROM base),
parts AS (
  SELECT 'raw' AS partition, label, count(*) AS n FROM lines GROUP BY ALL UNION ALL SELECT 'cleaned', label, n FROM q
  UNION ALL SELECT 'train', label, train FROM q UNION ALL SELECT 'test_locked', label, n - train FROM q)
SELECT partition, sum(n)::BIGINT AS "rows", sum(n) FILTER (label = 0)::BIGINT AS legitimate, sum(n) FILTER (label = 1)::BIGINT AS fraudulent,
  round(sum(n) FILTER (label = 1) * 100.0 / sum(n), 9)::DOUBLE AS fraud_percentage FROM parts GROUP BY partition""")
def partition_summary(spark, sf):
    raw, cleaned, divided = _cleaned(spark, sf)
    train, test = (divided.filter(F.col("split") == part) for part in ("train", "test"))
    return rounded(split_summary({"raw": raw, "cleaned": cleaned, "train": train, "test_locked": test}, "label"))


@query("prediction_alignment", """
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS only_left,
  count(*) FILTER (d.doc_id IS NULL) AS only_right,
  count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (d.n_chars > 500)::INT <> l.quality) AS label_differs
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def prediction_alignment(spark, sf):
    guess = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"))
    return check_alignment(guess, table(spark, sf, "labels"), ["doc_id"], "quality")


@query("cohorts_side_by_side", "WITH " + TX + """, m AS (
  SELECT returnflag, avg(amount) FILTER (label = 1) AS fraud_mean, avg(amount) FILTER (label = 0) AS legitimate_mean FROM tx GROUP BY 1)
SELECT returnflag, round(fraud_mean, 6) AS fraud_mean, round(legitimate_mean, 6) AS legitimate_mean FROM m
WHERE fraud_mean IS NOT NULL""")
def cohorts_side_by_side(spark, sf):
    means = transactions(spark, sf).groupBy("label", "returnflag").agg(F.avg("amount").alias("mean"))
    parts = [means.filter(F.col("label") == code).drop("label") for code in (1, 0)]
    return rounded(cohort_join(*parts, "returnflag", ("fraud", "legitimate")), 6)
