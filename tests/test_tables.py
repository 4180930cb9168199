import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import align, joins, training_set
from ledgerlens.operators.quality import Roles, quality_checks, validate, validation_report
from ledgerlens.scratch import shared_dir
from ledgerlens.sources import contract, tables

VALID = "TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, card2 long, card3 long, card4 string, card5 long, card6 string, P_emaildomain string, R_emaildomain string"


@pytest.fixture(scope="module")
def valid(spark):
    rows = [
        (i + 1, int(i == 4), 100 * (i + 1), 10.0 * (i + 1), "WHCSR"[i], 1000 + i, 1, 1, "visa", 1, "debit", "gmail.com", None)
        for i in range(5)
    ]
    return spark.createDataFrame(rows, VALID)


def test_valid_table_passes_with_a_warning(valid):
    assert validate(valid)
    levels = {r.check: r.level for r in quality_checks(valid).collect()}
    assert levels["label_rate"] == "warning"
    assert {c for c, level in levels.items() if level != "ok"} == {"label_rate"}


@pytest.mark.parametrize("change, message", [
    (lambda d: d.drop("TransactionAmt"), "Missing required columns: \\['TransactionAmt'\\]"),
    (lambda d: d.withColumn("TransactionID", F.least("TransactionID", F.lit(4))), "Found 1 duplicate TransactionIDs"),
    (lambda d: d.withColumn("isFraud", F.when(F.col("TransactionID") == 1, 5).otherwise(F.col("isFraud"))), "values other than 0 and 1"),
    (lambda d: d.withColumn("isFraud", F.when(F.col("TransactionID") > 1, F.col("isFraud"))), "values other than 0 and 1"),
    (lambda d: d.withColumn("TransactionAmt", F.when(F.col("TransactionID") == 1, -10.0).otherwise(10.0)), "Found 1 negative TransactionAmt values"),
    (lambda d: d.limit(0), "Dataset is empty"),
    (lambda d: d.withColumn("TransactionDT", -F.col("TransactionDT")), "TransactionDT contains negative values"),
    (lambda d: d.withColumn("id_01", F.lit(None).cast("double")), "Identity match rate 0.0000"),
    (lambda d: d.drop("TransactionID"), "Missing required columns"),
])
def test_broken_tables_fail(valid, change, message):
    with pytest.raises(ValueError, match=message):
        validate(change(valid))


def test_report(valid, folder, spark):
    validate(valid, report_path=f"{folder}/report")
    report = spark.read.json(f"{folder}/report")
    assert report.where("level = 'null_rate' and check = 'R_emaildomain'").first()["value"] == 1.0
    assert validation_report(valid, Roles(), top=2).where("level = 'null_rate'").count() == 2


def test_contract(spark):
    rows = [(1, 10, 5.0), (None, 10, 5.0), (3, None, 5.0), (4, 10, None), (5, 10, 0.0), (6, -1, 5.0), (7, 0, 1e9)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double").withColumn("V1", F.lit(1.0))
    valid, rejected = contract.split_valid(df)
    assert sorted(r.TransactionID for r in valid.collect()) == [1, 7]
    reasons = {r.TransactionID: r.reason for r in rejected.collect()}
    assert reasons[None] == "TransactionID missing" and reasons[5] == "TransactionAmt must be positive"
    assert reasons[6] == "TransactionDT must be non-negative" and "V1" in valid.columns
    assert not contract.check_batch(df.limit(0)).first()["accepted"]
    assert contract.check_batch(df).first()["accepted"]
    assert not contract.check_batch(df.unionAll(df)).first()["accepted"]
    assert not contract.check_batch(df, limit=3).first()["accepted"]


def test_record_schemas():
    wide = contract.transaction_schema()
    assert wide.fieldNames()[:4] == ["TransactionID", "isFraud", "TransactionDT", "TransactionAmt"]
    assert len(wide) == 394 and wide.fieldNames()[-1] == "V339"
    assert len(contract.identity_schema()) == 41


def test_files(spark, frame, folder):
    for suffix in (".parquet", ".csv"):
        path = f"{folder}/out{suffix}"
        tables.write_any(frame, path)
        assert tables.read_any(spark, path, frame.schema).count() == 6
    csv = spark.createDataFrame([("1", "NaN"), ("2", "")], "a string, b string")
    tables.write_any(csv, f"{folder}/nan.csv")
    assert [r.b for r in tables.read_csv(spark, f"{folder}/nan.csv", "a long, b double").collect()] == [None, None]
    with pytest.raises(ValueError):
        tables.read_any(spark, f"{folder}/nan.csv")


def test_json_lines_keep_corrupt_records(spark, folder):
    spark.createDataFrame([('{"a": 1}',), ("{broken",)], "value string").coalesce(1).write.text(f"{folder}/j")
    schema = spark.createDataFrame([], "a long").schema
    rows = tables.read_json_lines(spark, f"{folder}/j", schema).collect()
    assert sorted((r.a or 0, r._corrupt_record) for r in rows) == [(0, "{broken"), (1, None)]


def test_append_log_and_retention(spark, frame, folder):
    path = f"{folder}/log"
    tables.append_log(frame.where("TransactionID < 4"), path)
    tables.append_log(frame.where("TransactionID >= 4"), path)
    assert spark.read.parquet(path).count() == 6
    kept = training_set.retire_days(spark, path, span=5 * 86400)
    assert sorted(r.TransactionID for r in kept.collect()) == [4, 5, 6]
    boundary = training_set.append_with_retention(frame.where("TransactionID < 6"), frame.where("TransactionID = 6"), 604800 - 86400)
    assert boundary.count() == 6


def test_alignment(frame, spark):
    out = align.align_to_columns(frame, ["TransactionAmt", "nowhere", "card1"])
    assert out.columns == ["TransactionAmt", "nowhere", "card1"] and set(dict(out.dtypes).values()) == {"double"}
    assert out.where("nowhere is not null").count() == 0
    assert align.feature_columns(frame, drop=["TransactionID"]) == ["isFraud", "TransactionDT", "TransactionAmt", "card1"]
    nulls = frame.withColumn("n90", F.when(F.col("TransactionID") > 5, 1.0)).withColumn("n100", F.lit(None).cast("double"))
    assert "n90" in align.feature_columns(nulls) and "n100" not in align.feature_columns(nulls)
    nan = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert [r.x for r in align.normalise_nan(nan).collect()] == [None, 1.0]


def test_feature_list_roundtrip(spark, frame, folder):
    align.write_feature_list(frame, ["b", "a"], f"{folder}/list")
    assert align.read_feature_list(spark, f"{folder}/list") == ["b", "a"]
    with open(f"{folder}/list.txt", "w") as f:
        f.write("x\n\ny\n")
    assert align.read_feature_list(spark, f"{folder}/list.txt") == ["x", "y"]


def test_join_with_a_repeated_side_is_refused(spark, frame):
    side = spark.createDataFrame([(1, 5.0), (1, 6.0)], "TransactionID long, id_01 double")
    with pytest.raises(ValueError):
        joins.load_joined(frame, side)
    assert joins.load_joined(frame, side.limit(1)).count() == 6


def test_labels(spark, frame):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (9, 1, 1)], "TransactionID long, isFraud int, at int")
    assert joins.attach_labels(frame, labels).count() == 2
    assert [r.isFraud for r in joins.attach_labels(frame, labels, dedupe_by="at").collect()] == [1]


def test_training_set_refresh(spark, frame):
    base = frame.select("TransactionID", "TransactionDT", "isFraud", "card1")
    late = spark.createDataFrame([(50, 86400 + 180 * 86400, 3)], "TransactionID long, TransactionDT long, extra int")
    labels = spark.createDataFrame([(50, 1)], "TransactionID long, isFraud int")
    out = training_set.refresh_training_set(base, late, labels)
    assert out.columns == base.columns and out.count() == 7
    assert training_set.refresh_training_set(base, late, labels, span=86400).count() == 1
    assert training_set.refresh_training_set(base, None, labels) is base
    assert training_set.refresh_training_set(base, late, None) is base
    assert training_set.refresh_training_set(base, late, labels.drop("isFraud")) is base
    assert training_set.refresh_training_set(base, late, labels.where("isFraud = 0")) is base


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
