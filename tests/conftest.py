import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FRAME = "TransactionID long, isFraud int, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, card4 string, card6 string, P_emaildomain string, R_emaildomain string"
ROWS = [
    (1, 0, 86400, 10.0, "W", 1001, "visa", "debit", "gmail.com", None),
    (2, 0, 90000, 20.0, "W", 1001, "visa", "debit", "gmail.com", None),
    (3, 1, 93600, 200.0, "H", 1001, "mastercard", "credit", "yahoo.com", None),
    (4, 0, 180000, 15.0, "W", 2001, "visa", "debit", "gmail.com", None),
    (5, 0, 266400, 25.0, "C", 2001, "visa", "debit", None, None),
    (6, 1, 604800, 300.0, "H", 1001, "mastercard", "credit", "yahoo.com", None),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerlens-tests-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    return spark.createDataFrame(ROWS, FRAME)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="ledgerlens-")
