"""Naming, typing and row checks on events read as an upload; scoring by a fixed rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import direction, is_close, round_to, safe_div
from ..operators import columns as C
from ..operators.joins import align, lookup
from ..operators.metrics import classify
from ..operators.scoring import evaluate_labelled, ranked_scores, score_summary
from .fixtures import DIRTY, TX, dirty_events, table, transactions
from .registry import query, rounded


@query("columns_normalised", 'SELECT event_id AS "Time", user_id AS "V1", value AS "Amount", event_type AS merchant FROM events')
def columns_normalised(spark, sf):
    ev = table(spark, sf, "events")
    named = ev.select(F.col("event_id").alias(" time "), F.col("user_id").alias("PCA_1"), F.col("value").alias("AMOUNT"), F.col("event_type").alias("merchant"))
    return C.normalise_columns(named)


@query("columns_by_position", "SELECT event_id AS column_1, value AS column_2 FROM events")
def columns_by_position(spark, sf):
    return C.name_positional(table(spark, sf, "events").select("event_id", "value"))


@query("numbers_from_text", "WITH " + DIRTY + 'SELECT event_id, v1 AS "V1", amount AS "Amount" FROM dirty')
def numbers_from_text(spark, sf):
    return C.coerce_numeric(dirty_events(spark, sf), ["V1", "Amount"]).select("event_id", "V1", "Amount")


REASON = """CASE WHEN v1 IS NULL AND amount IS NULL THEN 'missing or non-numeric: V1, Amount'
  WHEN v1 IS NULL THEN 'missing or non-numeric: V1' WHEN amount IS NULL THEN 'missing or non-numeric: Amount'
  WHEN isinf(v1) OR isinf(amount) THEN 'infinite value' WHEN amount < 0 THEN 'negative Amount' END"""


@query("row_problems", "WITH " + DIRTY + f"SELECT event_id, {REASON} AS reason FROM dirty")
def row_problems(spark, sf):
    return C.row_problems(dirty_events(spark, sf), ["V1", "Amount"]).select("event_id", "reason")


@query("quarantined_rows", "WITH " + DIRTY + f"""
SELECT event_id, v1_text AS "V1", amount_text AS "Amount", {REASON} AS reason FROM dirty WHERE {REASON} IS NOT NULL""")
def quarantined_rows(spark, sf):
    _, rejected = C.quarantine(dirty_events(spark, sf), ["V1", "Amount"])
    return rejected.select("event_id", "V1", "Amount", "reason")


def _scored(spark, sf):
    """Valid events with a rule score in place of a model's."""
    valid, rejected = C.quarantine(dirty_events(spark, sf), ["V1", "Amount"])
    numeric = C.coerce_numeric(valid, ["V1", "Amount"])
    scored = numeric.withColumn("fraud_probability", F.col("Amount") / 500)
    return classify(scored, 0.485, "ge", "fraud_probability", "predicted_class"), rejected


SCORED = "WITH " + DIRTY + f", scored AS (SELECT *, amount / 500 AS s FROM dirty WHERE {REASON} IS NULL)"


@query("upload_summary", SCORED + """
SELECT (SELECT count(*) FROM scored) AS scored, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM scored) AS rejected,
  (SELECT count(*) FROM scored WHERE s >= 0.485) AS flagged,
  round((SELECT count(*) FROM scored WHERE s >= 0.485)::DOUBLE / (SELECT count(*) FROM scored), 9) AS flag_rate""")
def upload_summary(spark, sf):
    return rounded(score_summary(*_scored(spark, sf)))


@query("upload_ranked", SCORED + "SELECT event_id, round(s, 9) AS fraud_probability, (s >= 0.485)::TINYINT AS predicted_class FROM scored ORDER BY s DESC, event_id")
def upload_ranked(spark, sf):
    scored, _ = _scored(spark, sf)
    ranked = ranked_scores(scored, key=["event_id"])
    return rounded(ranked.select("event_id", "fraud_probability", "predicted_class"))


@query("upload_metrics", SCORED + """, cm AS (
  SELECT count(*) FILTER (class = 0 AND s < 0.485) AS tn, count(*) FILTER (class = 0 AND s >= 0.485) AS fp,
    count(*) FILTER (class = 1 AND s < 0.485) AS fn, count(*) FILTER (class = 1 AND s >= 0.485) AS tp FROM scored),
per AS (SELECT s, sum(class) AS pos, count(*) AS c FROM scored GROUP BY s),
run AS (SELECT pos, sum(pos) OVER w AS tp, sum(c) OVER w AS flagged, sum(pos) OVER () AS p FROM per WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9)::DOUBLE AS f1,
  (SELECT round(sum(pos::DOUBLE / p * tp / flagged), 9) FROM run) AS pr_auc, tn, fp, fn, tp FROM cm""")
def upload_metrics(spark, sf):
    scored, _ = _scored(spark, sf)
    return rounded(evaluate_labelled(scored, "Class"))


@query("frame_validated", "WITH " + TX + "SELECT days, quantity, amount, discount, tax FROM tx")
def frame_validated(spark, sf):
    cols = ["days", "quantity", "amount", "discount", "tax"]
    return C.validate_frame(transactions(spark, sf).select(*cols), cols, "amount")


@query("labels_checked", "SELECT doc_id, quality FROM labels")
def labels_checked(spark, sf):
    return C.require_binary(table(spark, sf, "labels").select("doc_id", "quality"), "quality")


@query("class_names", "WITH " + TX + "SELECT row_id, CASE label WHEN 0 THEN 'Legitimate' ELSE 'Fraudulent' END AS class_label, 'line items' AS source FROM tx")
def class_names(spark, sf):
    named = C.label_names(transactions(spark, sf), "label", {0: "Legitimate", 1: "Fraudulent"}, "class_label")
    return C.tag(named, source="line items").select("row_id", "class_label", "source")


@query("features_without_label", "WITH " + TX + "SELECT tax, quantity FROM tx")
def features_without_label(spark, sf):
    return C.select_features(C.drop_label(transactions(spark, sf), "label"), ["tax", "quantity"])


@query("candidate_lookup", """
SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'partly' END AS state
FROM orders""")
def candidate_lookup(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    states = orders.select("o_orderstatus").distinct().withColumn(
        "state", F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("partly"))
    return lookup(orders, states, ["o_orderstatus"])


@query("labels_aligned", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def labels_aligned(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "n_chars")
    return align(documents, table(spark, sf, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("scalar_functions", """
SELECT event_id, round(ln(1 + value), 9) AS logged, round_even(value, 0) AS whole, CASE WHEN value - 250 > 0 THEN 'toward fraud' ELSE 'toward legitimate' END AS direction,
  coalesce(value / nullif(user_id % 2, 0), 0)::DOUBLE AS divided, abs(value - 250) <= 50 AS close,
  array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM events""")
def scalar_functions(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id", F.round(F.log1p("value"), 9).alias("logged"), round_to("value", 0).alias("whole"),
        direction(F.col("value") - 250).alias("direction"),
        safe_div(F.col("value"), F.col("user_id") % 2).alias("divided"),
        is_close(F.col("value"), F.lit(250.0), 50.0).alias("close"), text.display_name(F.col("event_type")).alias("title"),
    )
