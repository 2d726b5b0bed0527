"""The fixed values of the data contract: schema, rule bounds, thresholds, scenarios, run matrix."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names, bounds and thresholds that results depend on. ---

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("promotion_flag", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("inventory_level", T.DoubleType()),
        T.StructField("competitor_price", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("previous_day_sales", T.DoubleType()),
        T.StructField("sales_demand", T.DoubleType()),
    ]
)
SALES_COLUMNS = SALES_SCHEMA.fieldNames()
TARGET = "sales_demand"
DATE = "date"

STORE_PATTERN = "^store_[0-9]{3}$"
CATEGORIES = ["Electronics", "Clothing", "Food", "Home", "Sports"]

CATEGORICAL_FEATURES = ["store_id", "product_category", "day_of_week", "month"]
NUMERIC_FEATURES = [
    "promotion_flag",
    "price",
    "inventory_level",
    "competitor_price",
    "temperature",
    "previous_day_sales",
]
DERIVED_FEATURES = ["price_diff", "price_ratio"]
RATIO_EPSILON = 1e-5
MAPE_EPSILON = 1e-5

DATA_GATE = {"max_missing_ratio": 0.05, "max_duplicate_ratio": 0.01, "min_required_rows": 100}
MODEL_GATE = [
    ("rmse", "<=", 150.0),
    ("mape", "<=", 0.25),
    ("r2", ">=", 0.5),
    ("latency_ms", "<=", 100.0),
]
REPORTED_CASES = 20

SIGNIFICANCE = 0.05
DISTANCE_THRESHOLD = 0.1
DATASET_DRIFT_SHARE = 0.3
CONTINUE_MAX_SHARE = 0.20
INVESTIGATE_MAX_SHARE = 0.50
CRITICAL_FEATURES = ["price", "previous_day_sales", "promotion_flag"]
DRIFT_FEATURES = {
    "numerical": ["price", "inventory_level", "competitor_price", "temperature", "previous_day_sales"],
    "binary": ["promotion_flag"],
    "categorical": ["store_id", "product_category", "day_of_week", "month"],
}

METRIC_TOLERANCE = {"mae": 0.01, "rmse": 0.01, "r2": 0.001, "mape": 0.001}
DEFAULT_TOLERANCE = 0.01
PREDICTION_TOLERANCE = 1e-5
CI_Z = 1.96

INVALID_CATEGORY = "INVALID_CATEGORY_XYZ"
FAULT_COLUMNS = ["price", "inventory_level", "previous_day_sales"]
MAX_NULL_DATES = 50
NULL_DATE_DIVISOR = 20
CONCEPT_NOISE_STD = 20.0

SCENARIOS = {
    "clean": {"faults": {}, "drift": {}},
    "data_quality_failure": {
        "faults": {
            "missing_ratio": 0.15,
            "duplicate_ratio": 0.05,
            "negative_price_ratio": 0.08,
            "negative_inventory_ratio": 0.05,
            "invalid_category_ratio": 0.04,
            "impossible_dates": True,
        },
        "drift": {},
    },
    "mild_drift": {
        "faults": {},
        "drift": {
            "price_shift_factor": 1.15,
            "promotion_frequency_boost": 0.10,
            "temperature_shift": 3.0,
            "concept_drift_factor": 1.05,
        },
    },
    "severe_drift": {
        "faults": {},
        "drift": {
            "price_shift_factor": 1.60,
            "promotion_frequency_boost": 0.40,
            "category_mix_shift": True,
            "temperature_shift": 15.0,
            "concept_drift_factor": 1.50,
        },
    },
    "performance_degradation": {
        "faults": {},
        "drift": {
            "price_shift_factor": 1.20,
            "promotion_frequency_boost": 0.20,
            "category_mix_shift": True,
            "temperature_shift": 5.0,
            "concept_drift_factor": 2.20,
        },
    },
}

SPLIT_FRACTIONS = (0.70, 0.85)
RUN_SEEDS = [13, 42, 101, 202, 303, 401, 503, 607, 701, 809]
RUN_VARIANTS = [
    ("baseline", "baseline", ""),
    ("proposed", "proposed", ""),
    ("proposed_without_data_validation", "proposed", "data_gate"),
    ("proposed_without_model_gate", "proposed", "model_gate"),
    ("proposed_without_registry", "proposed", "registry"),
]

# Boosting settings that carry over to level-wise trees.
BOOSTING = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 20, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
DEFAULT_SEED = 42
# --- End of fixed values. ---
