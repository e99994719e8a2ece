import csv

import pytest
from pyspark.sql import functions as F

from riskframe.functions.text import canonical_name
from riskframe.operators import columns as C
from riskframe.operators.scoring import evaluate_labelled
from riskframe.schema import FEATURE_COLS, LABEL_COL, transaction_schema
from riskframe.sources import first_existing, guarded_write, read_meta, read_split, read_table, read_upload, write_meta, write_split
from riskframe.sources.documents import meta_frame


def write_csv(path, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(rows)
    return str(path)


def sample(n=5, width=31):
    return [[str(i + j / 100) for j in range(width)] for i in range(n)]


def test_spellings():
    assert [canonical_name(c) for c in ("time", "V_1", "pca2", " AMOUNT ", "is_fraud", "merchant")] == [
        "Time", "V1", "V2", "Amount", LABEL_COL, None]
    assert [canonical_name(c) for c in ("v0", "v29", "PC 28", "v007", "Target", "vv1")] == [None, None, "V28", None, LABEL_COL, None]


def test_conflicting_columns_are_refused(spark):
    with pytest.raises(ValueError, match="V1 and v_1"):
        C.normalise_columns(spark.createDataFrame([(1, 2)], "V1 int, v_1 int"))


def test_reader(spark, tmp_path):
    names = [*FEATURE_COLS, LABEL_COL]
    with_header = C.normalise_columns(read_upload(spark, write_csv(tmp_path / "a.csv", [names, *sample()])))
    assert with_header.columns == names and with_header.count() == 5
    for width, want in ((30, FEATURE_COLS), (31, names), (3, ["column_1", "column_2", "column_3"])):
        df = read_upload(spark, write_csv(tmp_path / f"b{width}.csv", sample(width=width)))
        assert df.columns == want and df.count() == 5
    with pytest.raises(ValueError, match="format"):
        read_upload(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError, match="no rows"):
        read_upload(spark, write_csv(tmp_path / "c.csv", [["Time", "Amount"]]))
    with pytest.raises(ValueError, match="more than 4"):
        read_upload(spark, str(tmp_path / "a.csv"), max_rows=4)
    with_header.write.parquet(str(tmp_path / "d.parquet"))
    assert read_upload(spark, str(tmp_path / "d.parquet")).count() == 5


def test_repeated_values_in_a_headerless_first_line(spark, tmp_path):
    rows = [["1.5"] * 30] * 2
    df = read_upload(spark, write_csv(tmp_path / "r.csv", rows))
    assert df.columns == FEATURE_COLS and df.count() == 2


def test_quoted_ragged_and_repeated(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('name,a,b\n"Joe ""J"", Inc",2,3\n"two\nlines",4,5\n,"",6\n')
    rows = read_upload(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('Joe "J", Inc', "2", "3"), ("two\nlines", "4", "5"), (None, None, "6")]
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(ValueError, match="2 rows have another number"):
        read_upload(spark, str(path))
    kept = read_upload(spark, str(path), keep_malformed=True)
    assert kept.filter("_malformed IS NULL").count() == 1 and kept.filter("_malformed IS NOT NULL").count() == 2
    path = tmp_path / "twice.csv"
    path.write_text("V1,V1,Amount\n1,2,3\n")
    with pytest.raises(ValueError, match="V1 .2 times"):
        read_upload(spark, str(path))


def test_schema_kinds(spark):
    full = spark.createDataFrame([], transaction_schema())
    assert C.detect_schema(full) == ("pca", [])
    assert C.detect_schema(full.drop("V3", "V28")) == ("partial", ["V3", "V28"])
    kind, missing = C.detect_schema(C.normalise_columns(spark.createDataFrame([], "timestamp string, amount double, merchant string")))
    assert kind == "everyday" and "V14" in missing and "Amount" not in missing


def broken(spark):
    rows = [[0.0] * 30 for _ in range(6)]
    df = spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], "row int, " + ", ".join(f"{c} string" for c in FEATURE_COLS))
    at = F.col("row")
    return df.withColumns({
        "V1": F.when(at == 1, "abc").otherwise(F.col("V1")), "V2": F.when(at == 2, "NaN").otherwise(F.col("V2")),
        "V5": F.when(at == 3, "inf").otherwise(F.col("V5")), "Amount": F.when(at == 4, "-5").otherwise(F.col("Amount")),
    })


def test_quarantine_gives_first_reason(spark):
    valid, rejected = C.quarantine(broken(spark), FEATURE_COLS)
    assert sorted(r["row"] for r in valid.collect()) == [0, 5]
    assert {r["row"]: r["reason"] for r in rejected.collect()} == {
        1: "missing or non-numeric: V1", 2: "missing or non-numeric: V2", 3: "infinite value", 4: "negative Amount"}


def test_strict_validation(spark):
    rows = broken(spark)
    good = rows.filter("row = 0").drop("row")
    assert C.validate_frame(good.select(*reversed(FEATURE_COLS))).columns == FEATURE_COLS
    for row, text in ((1, "non-numeric"), (3, "infinite"), (4, "below zero")):
        with pytest.raises(ValueError, match=text):
            C.validate_frame(rows.filter(F.col("row") == row).drop("row"))
    with pytest.raises(ValueError, match="without V1"):
        C.validate_frame(good.drop("V1"))
    with pytest.raises(ValueError, match="unknown extra"):
        C.validate_frame(good.withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="without rows"):
        C.validate_frame(good.limit(0))


@pytest.mark.parametrize("text, value", [
    ("1", 1.0), (" 2.5 ", 2.5), ("1e3", 1000.0), ("+5", 5.0), (".5", 0.5), ("-inf", float("-inf")), ("1d", None), ("1_000", None), ("", None), ("abc", None),
])
def test_text_to_number(spark, text, value):
    assert C.coerce_numeric(spark.createDataFrame([(text,)], "x string"), ["x"]).first()["x"] == value


def test_labels_must_be_binary(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (2, 0.9, 1)], "Class int, fraud_probability double, predicted_class int")
    with pytest.raises(ValueError, match="1 rows"):
        evaluate_labelled(df, "Class")
    none = evaluate_labelled(df.filter("Class = 0"), "Class").first()
    assert none["pr_auc"] is None and none["tn"] == 1


def test_split_folder_prunes(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    write_split(df, str(tmp_path / "s"))
    assert [read_split(spark, str(tmp_path / "s"), p).count() for p in ("train", "test", "both")] == [8, 2, 10]
    plan = read_split(spark, str(tmp_path / "s"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        read_split(spark, str(tmp_path / "s"), "dev")


def test_documents_and_guards(spark, tmp_path):
    write_meta(spark, {"a": {"b": [1, 2]}, "t": 0.485}, str(tmp_path / "m"))
    assert read_meta(spark, str(tmp_path / "m"))["a"] == {"b": [1, 2]}
    assert meta_frame(spark, str(tmp_path / "m")).select("a.b", "t").first()["t"] == 0.485
    guarded_write(spark.range(1), str(tmp_path / "once"))
    with pytest.raises(RuntimeError, match="only once"):
        guarded_write(spark.range(1), str(tmp_path / "once"))
    assert first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "once")]).count() == 1
    assert first_existing(spark, [str(tmp_path / "no")]) is None
    path = write_csv(tmp_path / "t.csv", [["id", "x"], ["1", "2.5"]])
    assert read_table(spark, path).first()["x"] == 2.5


def test_cells_are_read_once_for_each_use_of_the_reason(spark):
    """A filter on the reason took every cell's pattern again for each of its tests."""
    from riskframe.operators.columns import quarantine

    rows = spark.createDataFrame([("1", "2")], "V1 string, Amount string")
    for part in quarantine(rows.filter("V1 is not null"), ["V1", "Amount"]):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("infinity|nan") <= 4  # a column is read by the filter and for the reason at most


def test_numbers_are_the_same_as_text_and_as_columns(spark):
    from riskframe.functions.values import NUMBER_TEXT, number_of, to_double

    texts = ["1", "-1.5", "+.5", "1.", ".", "", "-", "1-2", "1e5", "1.0E-7", "inf", "-Infinity", "NaN", "1d", "1f", "0x1p3", " 2 ", "2\n", "2\u0085", " 2", "true", "--1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.when(F.col("t").rlike(NUMBER_TEXT), F.col("t").try_cast("double"))
    assert df.filter(~plain.eqNullSafe(to_double("t"))).collect() == []
    numbers = spark.createDataFrame([(0.1, 2**53 + 1), (float("nan"), -1), (float("-inf"), 0), (-0.0, None), (None, 7)], "d double, l long")
    assert numbers.filter(~(to_double("d").eqNullSafe(number_of(numbers, "d")) & to_double("l").eqNullSafe(number_of(numbers, "l")))).collect() == []
    assert "rlike" not in numbers.select(number_of(numbers, "d").alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
