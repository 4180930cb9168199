import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.encoding import apply_encoding, encoding_table, fold_encode
from ledgerlens.operators.history import expanding_history, recency
from ledgerlens.operators.joins import last_seen, point_in_time
from ledgerlens.operators.keyed import Keyed
from ledgerlens.operators.time_features import time_features
from ledgerlens.operators.velocity import velocity, velocity_columns
from ledgerlens.plans.pipeline import FeaturePlan, build_features
from ledgerlens.skew import slice_count

CARD, EMAIL = Keyed("card1"), Keyed("P_emaildomain")
# plain windows, and every key cut into slices of a few rows
TUNINGS = [{}, {"frame_rows": 1, "hot_rows": 1, "rows_per_slice": 2}]


def by_id(df, *columns):
    rows = df.select("TransactionID", *columns).collect()
    return {r[0]: tuple(round(v, 6) if isinstance(v, float) else v for v in r[1:]) for r in rows}


@pytest.mark.parametrize("tuning", TUNINGS)
def test_time_features(frame, tuning):
    got = by_id(
        time_features(frame, CARD, **tuning), "hour_of_day", "day_of_week", "days_since_start",
        "time_since_last_txn_card1", "days_since_card_first_seen", "is_night_transaction", "is_weekend",
    )
    assert got == {
        1: (0, 1, 0.0, -1, 0.0, 1, 0), 2: (1, 1, 0.041667, 3600, 0.041667, 1, 0),
        3: (2, 1, 0.083333, 3600, 0.083333, 1, 0), 4: (2, 2, 1.083333, -1, 0.0, 1, 0),
        5: (2, 3, 2.083333, 86400, 1.0, 1, 0), 6: (0, 0, 6.0, 511200, 6.0, 1, 0),
    }


@pytest.mark.parametrize("tuning", TUNINGS)
def test_velocity(frame, tuning):
    got = by_id(velocity(frame, CARD, **tuning), *velocity_columns("card1"))
    assert got == {
        1: (0, 0.0, 0, 0.0, 0, 0.0), 2: (1, 10.0, 1, 10.0, 1, 10.0), 3: (1, 20.0, 2, 30.0, 2, 30.0),
        4: (0, 0.0, 0, 0.0, 0, 0.0), 5: (0, 0.0, 1, 15.0, 1, 15.0), 6: (0, 0.0, 0, 0.0, 3, 230.0),
    }
    got = by_id(velocity(frame, EMAIL, **tuning), *velocity_columns("P_emaildomain"))
    assert got[4] == (0, 0.0, 0, 0.0, 2, 30.0)
    assert got[5] == (None,) * 6
    assert got[6] == (0, 0.0, 0, 0.0, 1, 200.0)


def test_null_key_as_zero(frame):
    got = by_id(velocity(frame, EMAIL, null_key="zero"), *velocity_columns("P_emaildomain"))
    assert got[5] == (0, 0.0, 0, 0.0, 0, 0.0)


@pytest.mark.parametrize("tuning", TUNINGS)
def test_history(frame, tuning):
    got = by_id(
        expanding_history(frame, CARD, "a", "n", **tuning), "n", "a_mean", "a_std", "a_deviation", "a_zscore"
    )
    assert got == {
        1: (0, None, None, None, 0.0), 2: (1, 10.0, None, 10.0, 0.0), 3: (2, 15.0, 7.071068, 185.0, 26.162951),
        4: (0, None, None, None, 0.0), 5: (1, 15.0, None, 10.0, 0.0),
        6: (3, 76.666667, 106.926766, 223.333333, 2.088657),
    }
    got = by_id(expanding_history(frame, EMAIL, "a", **tuning), "a_mean", "a_std", "a_deviation", "a_zscore")
    assert got[4] == (15.0, 7.071068, 0.0, 0.0)
    assert got[5] == (None, None, None, 0.0)
    assert got[6] == (200.0, None, 100.0, 0.0)


def test_amounts_may_be_missing(spark):
    rows = [(1, 0, 5.0), (2, 10, None), (3, 20, 7.0)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double").withColumn("card1", F.lit(1))
    for tuning in TUNINGS:
        got = by_id(velocity(df, CARD, **tuning), "card1_count_1hr", "card1_amt_sum_1hr")
        assert got[3] == (2, 5.0)
        assert by_id(expanding_history(df, CARD, "a", "n", **tuning), "n", "a_mean")[3] == (1, 5.0)


def test_null_times_and_extreme_amounts_are_alike_on_both_sides(spark):
    inf = float("inf")
    rows = [
        (1, 0, 1e30, 1), (2, 10, 0.1, 1), (3, 4000, 0.2, 1), (4, 4100, None, 1), (5, 5000, 1e-12, 1), (6, 9000, 5.0, 1),
        (7, None, 3.0, 1), (8, None, 4.0, 1), (9, None, 5.0, 1), (10, 12_000, -1e300, 1), (11, 16_000, 1e-300, 1),
        (12, 20_000, 5e-324, 1), (13, 23_700, 1.0, 1), (14, 23_701, 1.5e308, 1), (15, 30_000, 0.0, 1),
        (16, 5, 1e30, 2), (17, 6, 1.0, 2), (18, 7, -1e30, 2), (19, 8, 1.0, 2), (20, None, 1.0, None),
        (21, 1, inf, 3), (22, 2, 1.0, 3), (23, 3, -inf, 3), (24, 9000, 1.0, 3), (25, 9001, 2.0, 3),
    ]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")
    for tuning in TUNINGS:
        got = {r[0]: r[1:] for r in velocity(df, CARD, windows={"w": 3_600}, **tuning).select(
            "TransactionID", "card1_count_w", "card1_amt_sum_w").collect()}
        assert {i: got[i] for i in range(1, 16)} == {
            1: (0, 0.0), 2: (1, 1e30), 3: (0, 0.0), 4: (1, 0.2), 5: (2, 0.2), 6: (0, 0.0), 7: (0, 0.0), 8: (0, 0.0),
            9: (0, 0.0), 10: (1, 5.0), 11: (0, 0.0), 12: (0, 0.0), 13: (0, 0.0), 14: (1, 1.0), 15: (0, 0.0)}
        assert got[19] == (3, 1.0) and got[20] == (None, None)
        assert got[22] == (1, inf) and got[25] == (1, 1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """Three hot keys, null keys, and many rows of the same instant."""
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        key = draw.choice([1, 1, 1, 2, 2, 3, None, 100 + draw.randrange(50)])
        t = 500_000 if draw.random() < 0.2 else draw.randrange(0, 900_000)
        rows.append((i, t, round(draw.uniform(1, 100), 2), key))
    return spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")


@pytest.mark.parametrize("tuning", [
    {"frame_rows": 30, "hot_rows": 30, "rows_per_slice": 100}, {"frame_rows": 30, "rows_per_slice": 100},
    {"hot_rows": 200, "rows_per_slice": 50},
])
def test_slices_change_nothing(skewed, tuning):
    def all_features(**options):
        df = recency(velocity(expanding_history(skewed, CARD, "a", "n", **options), CARD, **options), CARD, "last", "first", **options)
        return by_id(df, "n", "a_mean", "a_std", "a_deviation", "last", "first", *velocity_columns("card1"))

    plain, sliced = all_features(), all_features(**tuning)
    assert plain.keys() == sliced.keys()
    for key, expected in plain.items():
        assert sliced[key] == pytest.approx(expected, abs=1e-5), key


@pytest.mark.parametrize("tuning", [{}, {"frame_rows": 30, "hot_rows": 30, "rows_per_slice": 100}])
def test_velocity_by_brute_force(skewed, tuning):
    rows = skewed.collect()
    got = by_id(velocity(skewed, CARD, **tuning), "card1_count_24hr", "card1_amt_sum_24hr")
    for r in rows:
        if r.card1 is None:
            assert got[r.TransactionID] == (None, None)
            continue
        past = [
            q.TransactionAmt for q in rows
            if q.card1 == r.card1 and r.TransactionDT - 86400 <= q.TransactionDT < r.TransactionDT
        ]
        assert got[r.TransactionID] == (len(past), pytest.approx(sum(past), abs=1e-5))


@pytest.mark.parametrize("tuning", [{}, {"frame_rows": 30, "hot_rows": 30, "rows_per_slice": 100}])
def test_point_in_time_of_itself_equals_windows(skewed, tuning):
    own = by_id(velocity(skewed, CARD), *velocity_columns("card1"))
    asked = by_id(point_in_time(skewed, skewed, CARD, "card1", **tuning), *velocity_columns("card1"))
    for key, expected in own.items():
        assert asked[key] == pytest.approx(expected, abs=1e-5)


def test_requests_that_are_not_in_the_history(spark, frame):
    asked = spark.createDataFrame(
        [(90, 93601, 5.0, 1001), (91, 93601, 5.0, 77), (92, 86400, 1.0, 1001), (93, 93601, 5.0, None)],
        "TransactionID long, TransactionDT long, TransactionAmt double, card1 long",
    )
    got = by_id(point_in_time(asked, frame, CARD, "card1"), "card1_count_24hr", "card1_amt_sum_24hr", "card1_txn_count", "card1_since_last")
    assert got == {90: (3, 230.0, 3, 1), 91: (0, 0.0, 0, -1), 92: (0, 0.0, 0, -1), 93: (None, None, None, -1)}
    assert by_id(last_seen(asked, frame, CARD), "since_last") == {90: (1,), 91: (-1,), 92: (-1,), 93: (-1,)}


def test_out_of_fold_and_serving_encodings(frame):
    encoded, table = fold_encode(frame, ["ProductCD", "R_emaildomain", "missing_column"], rows_per_slice=2)
    assert by_id(encoded, "ProductCD_encoded") == {
        1: (0.166667,), 2: (0.166667,), 3: (0.666667,), 4: (0.111111,), 5: (0.333333,), 6: (0.666667,),
    }
    assert by_id(encoded, "R_emaildomain_encoded") == {i: (0.333333,) for i in range(1, 7)}
    served = apply_encoding(frame, table, ["ProductCD", "R_emaildomain"])
    assert by_id(served, "ProductCD_encoded", "R_emaildomain_encoded") == {
        1: (0.083333, 0.333333), 2: (0.083333, 0.333333), 3: (0.777778, 0.333333), 4: (0.083333, 0.333333),
        5: (0.166667, 0.333333), 6: (0.777778, 0.333333),
    }


def test_out_of_fold_equals_fold_by_fold(spark):
    draw = random.Random(3)
    rows = [(i, i * 10, draw.choice("abcdef") if draw.random() > 0.1 else None, int(draw.random() < 0.3)) for i in range(203)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, c string, isFraud int")
    mean = sum(r[3] for r in rows) / len(rows)
    bounds = [0, 41, 82, 123, 163, 203]
    expected = {}
    for low, high in zip(bounds, bounds[1:]):
        rest = rows[:low] + rows[high:]
        for r in rows[low:high]:
            same = [q[3] for q in rest if q[2] == r[2] and r[2] is not None]
            expected[r[0]] = (sum(same) + mean) / (len(same) + 1) if same else mean
    for broadcast_rows in (1000, 0):
        encoded, _ = fold_encode(df, ["c"], rows_per_slice=40, broadcast_rows=broadcast_rows)
        got = {r.TransactionID: r.c_encoded for r in encoded.collect()}
        assert got == pytest.approx(expected)


def test_unseen_category_gets_the_global_mean(spark, frame):
    table = encoding_table(frame, ["ProductCD"])
    other = spark.createDataFrame([(9, "NEW")], "TransactionID long, ProductCD string")
    assert by_id(apply_encoding(other, table, ["ProductCD"]), "ProductCD_encoded") == {9: (0.333333,)}


def test_pipeline_fit_and_apply_have_the_same_columns(frame):
    plan = FeaturePlan(categories=["ProductCD", "card4"])
    before = frame.columns
    fitted, table = build_features(frame, plan, fit=True)
    served, _ = build_features(frame.drop("isFraud"), plan, encodings=table)
    assert set(fitted.columns) - {"isFraud"} == set(served.columns)
    assert frame.columns == before and fitted.count() == 6
    with pytest.raises(ValueError):
        build_features(frame.drop("isFraud"), plan, fit=True)
    plain, none = build_features(frame, plan)
    assert none is None and "ProductCD_encoded" not in plain.columns


def test_one_exchange_per_key(frame):
    plan = build_features(frame, FeaturePlan())[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan


def test_later_rows_never_matter(frame):
    early = frame.where("TransactionDT < 200000")
    full = by_id(velocity(expanding_history(frame, CARD, "a"), CARD), "a_mean", *velocity_columns("card1"))
    part = by_id(velocity(expanding_history(early, CARD, "a"), CARD), "a_mean", *velocity_columns("card1"))
    assert all(full[k] == v for k, v in part.items())


def test_busy_keys_need_no_join_on_instants(skewed):
    """Rows meet the sums of their bucket in one exchange; joins are with tables of buckets only."""
    plan = velocity(skewed, CARD, frame_rows=30, rows_per_slice=100)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search(r"\bJoin\b", line)]
    assert not any("TransactionDT" in line for line in joins)
    assert "RepartitionByExpression" not in plan


@pytest.mark.parametrize("rows_per_slice", [2, 10**6])
def test_busy_instants_and_negative_times(spark, rows_per_slice):
    """Many rows of one instant are dealt over several tasks; times before zero and windows that share no unit."""
    draw = random.Random(9)
    rows = [(i, draw.choice([-7201, -3600, -1, 0, 5, 5, 5, 5, 3599, 3600, 9000, draw.randrange(-20_000, 20_000)]), float(i), draw.choice([1, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")
    windows = {"a": 3_600, "b": 5_000, "c": 17}
    got = by_id(velocity(df, CARD, windows=windows, frame_rows=1, rows_per_slice=rows_per_slice), *velocity_columns("card1", windows))
    for i, t, _, key in rows:
        want = ()
        for width in windows.values():
            past = [x for _, u, x, k in rows if k == key and t - width <= u < t]
            want += (len(past), sum(past))
        assert got[i] == want


def test_range_frames_only_grow(spark):
    """A sliding frame is summed again for every row, so its cost is rows times frame length; one that only grows is summed once."""
    df = spark.createDataFrame([(1, 0, 5.0, 1), (2, 10, 6.0, 1)], "TransactionID long, TransactionDT long, TransactionAmt double, card1 long")
    out = velocity(df, CARD, frame_rows=1 << 40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,)]*)", plan)
    assert frames and all(f .startswith("unboundedpreceding") for f in frames)
    assert by_id(out, "card1_count_1hr", "card1_amt_sum_1hr") == {1: (0, 0.0), 2: (1, 5.0)}


def test_fine_slices_do_not_grow_with_the_rows(spark):
    """Slices of 250 rows would be 24,000 range partitions of a micro-batch with six million rows."""
    frame, cores = spark.range(1), spark.sparkContext.defaultParallelism
    assert slice_count(frame, 250, rows=1_000) == 4
    assert slice_count(frame, 250, rows=6_000_000) == max(6, 16 * cores)
    assert slice_count(frame, 1_000_000, rows=500_000_000) == 500
    assert slice_count(frame, 250, rows=5_000_000_000) == max(5_000, 16 * cores)
