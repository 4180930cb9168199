"""Fixed values and tuning defaults."""

# --- fixed values: they must equal the published behaviour for results to match ---

HOUR = 3_600
DAY = 86_400
WEEK = 7 * DAY

# trailing windows, in seconds: column suffix -> width
VELOCITY_WINDOWS = {"1hr": HOUR, "24hr": DAY, "7day": WEEK}

# first value of the relative event clock
CLOCK_START = 86_400

STATE_RETENTION = WEEK
STATE_TTL_MS = 90 * DAY * 1000
DRIFT_LOG_RETENTION = 30 * DAY
TRAINING_RETENTION = 180 * DAY

ID, TIME, AMOUNT, LABEL = "TransactionID", "TransactionDT", "TransactionAmt", "isFraud"

CATEGORICAL_COLUMNS = [
    "ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain",
    "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9",
]

REQUIRED_COLUMNS = [
    "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD",
    "card1", "card2", "card3", "card4", "card5", "card6", "P_emaildomain", "R_emaildomain",
]

# identifiers, label, clock and raw strings never used as model input
NON_FEATURE_COLUMNS = [
    "TransactionID", "isFraud", "TransactionDT", *CATEGORICAL_COLUMNS,
    "id_12", "id_15", "id_16", "id_28", "id_29", "id_30", "id_31", "id_33",
    "id_34", "id_35", "id_36", "id_37", "id_38", "DeviceType", "DeviceInfo",
]
MAX_NULL_RATE = 0.90
TRAIN_RATIO = 0.80

QUALITY_GATES = {"auc_roc": 0.85, "auc_pr": 0.40, "recall": 0.60, "precision": 0.30}
MIN_RECALL = 0.60
SWEEP_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]

# upper bounds (exclusive) of the risk bands; everything above is CRITICAL
RISK_BANDS = [(0.3, "LOW"), (0.5, "MEDIUM"), (0.8, "HIGH")]

PSI_BINS = 10
PSI_MIN_VALUES = 10
PSI_FLOOR = 1e-4
PSI_WARNING = 0.10
PSI_CRITICAL = 0.25
DRIFT_FRACTION = 0.20
LABEL_DRIFT = 0.05
DRIFT_MIN_ROWS = 500
MONITORED_FEATURES = [
    "C13", "C14", "card6_encoded", "V70", "C1", "TransactionAmt", "D1", "D15", "C2", "C11",
    "card1_count_1hr", "card1_count_24hr", "card1_amt_mean", "card1_amt_zscore", "hour_of_day",
    "is_night_transaction", "is_weekend", "ProductCD_encoded", "P_emaildomain_encoded",
]

BATCH_LIMIT = 10_000
ATTRIBUTION_ROWS = 2_000
EXAMPLES_PER_CLASS = 5

LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
SCORE_BUCKETS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
BATCH_SIZE_BUCKETS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000, 10000]

# --- tuning defaults: any value gives the same results ---

# a key with more rows than this gets its trailing windows from prefix sums instead of range frames
FRAME_ROWS = 4_000
# a key with more rows than this is split over several tasks
HOT_ROWS = 1_000_000
# rows of a hot key, or of a global order, that one task handles
ROWS_PER_SLICE = 1_000_000
# slices with fewer rows than that: at most so many for each core
SLICES_PER_CORE = 16
# parts over which a shuffled lookup deals the rows of a hot key
SALTS = 32
# at most this many rows are ever sent to every executor
BROADCAST_ROWS = 100_000
# quantiles of so many values or fewer, over all columns, come from one aggregation that holds them
HELD_VALUES = 2_000_000
# exact positions of more rows than this first narrow down to the values near the wanted ranks
NARROW_ROWS = 5_000_000
# accuracy of the sketch that finds these values
SKETCH_ACCURACY = 10_000
# candidates with more training rows than this are fitted one after the other
FIT_ALONE_ROWS = 5_000_000
