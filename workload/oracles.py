"""Oracle SQL for the registered queries, written against the same tables."""

from __future__ import annotations

import math

from sluicegate import contract
from workload import sqltext
from workload.sqltext import COLUMNS, SALES, SALES_TEXT, fingerprint_of, scenario, unpivot

ORACLES: dict[str, str] = {}

BAD = f"WITH {SALES},\n{scenario('data_quality_failure')}"
CELLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in COLUMNS)
ALL = ", ".join(COLUMNS)

# (column, check, SQL condition that holds on a violation), in rule order.
CHECKS = (
    [(c, "not_null", f"{c} IS NULL") for c in COLUMNS]
    + [(c, f"is_{sqltext.KINDS[c]}", "false") for c in COLUMNS if c not in ("store_id", "product_category")]
    + [
        ("store_id", "matches", "NOT regexp_matches(store_id, '^store_[0-9]{3}$')"),
        ("product_category", "one_of", "product_category NOT IN ('Electronics','Clothing','Food','Home','Sports')"),
        ("promotion_flag", "one_of", "promotion_flag NOT IN (0, 1)"),
        ("price", "gt_0", "price <= 0"),
        ("price", "lt_10000", "price >= 10000"),
        ("inventory_level", "ge_0", "inventory_level < 0"),
        ("inventory_level", "lt_10000", "inventory_level >= 10000"),
        ("competitor_price", "gt_0", "competitor_price <= 0"),
        ("temperature", "in_-30_50", "temperature NOT BETWEEN -30 AND 50"),
        ("day_of_week", "in_0_6", "day_of_week NOT BETWEEN 0 AND 6"),
        ("month", "in_1_12", "month NOT BETWEEN 1 AND 12"),
        ("previous_day_sales", "ge_0", "previous_day_sales < 0"),
        ("sales_demand", "ge_0", "sales_demand < 0"),
    ]
)

def rule_rows(checks, t: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}:{k}' AS rule, '{c}' AS column_name, '{k}' AS check_name, count_if({cond})::BIGINT AS n_violations, "
        f"round(count_if({cond}) / count(*)::DOUBLE, 6) AS ratio FROM {t}"
        for c, k, cond in checks
    )


ORACLES["validate_rules"] = f"{BAD}\n{rule_rows(CHECKS, 'data_quality_failure')}"
ORACLES["saved_report"] = ORACLES["saved_table"] = ORACLES["validate_rules"]
OTHERS = [check for check in CHECKS if check[0] != "temperature"]
ORACLES["missing_column"] = f"""{BAD}
{rule_rows(OTHERS, 'data_quality_failure')}
UNION ALL SELECT 'temperature:column_present', 'temperature', 'column_present', 1::BIGINT, round(1 / count(*)::DOUBLE, 6) FROM data_quality_failure"""

GARBLED = {
    "price": "day_of_week = 6 AND month = 2",
    "inventory_level": "day_of_week = 5 AND month = 3",
    "date": "day_of_week = 0 AND month = 12",
    "promotion_flag": "day_of_week = 1 AND month = 1",
}
TYPED = ", ".join(f"CASE WHEN {GARBLED[c]} THEN NULL ELSE {c} END AS {c}" if c in GARBLED else c for c in COLUMNS)


def text_check(column: str, check: str, condition: str) -> tuple[str, str, str]:
    if column in GARBLED and check == "not_null":
        condition = f"({condition}) AND NOT ({GARBLED[column]})"
    if column in GARBLED and check.startswith("is_"):
        condition = GARBLED[column]
    return column, check, condition


LOADED = f"{BAD}, typed AS (SELECT {TYPED} FROM data_quality_failure)"
ORACLES["validate_text"] = f"{LOADED}\n{rule_rows([text_check(*check) for check in CHECKS], 'typed')}"
ORACLES["conform_text"] = f"""{LOADED}
SELECT count(*) AS n_rows, {fingerprint_of('d')} AS fingerprint FROM (SELECT sha256({SALES_TEXT}) AS d FROM typed)"""

DUPLICATES = "(SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_surplus FROM (SELECT count(*) AS n FROM {t} GROUP BY {cols}))"
ORACLES["duplicate_ratio"] = f"""{BAD}
SELECT n_rows, n_surplus, round(n_surplus / n_rows::DOUBLE, 6) AS duplicate_ratio
FROM {DUPLICATES.format(t='data_quality_failure', cols=ALL)}"""


def gate_values(t: str) -> str:
    return (
        f"(SELECT (SELECT count(*) FROM {t})::DOUBLE AS n_rows, (SELECT sum({CELLS}) / (count(*)*{len(COLUMNS)})::DOUBLE FROM {t}) AS missing_ratio, "
        f"(SELECT n_surplus / n_rows::DOUBLE FROM {DUPLICATES.format(t=t, cols=ALL)}) AS duplicate_ratio)"
    )


ORACLES["quality_gate"] = f"""{BAD}, v AS (SELECT * FROM {gate_values('data_quality_failure')})
SELECT 'data_quality_gate' AS gate, 'min_required_rows' AS rule, 100.0::DOUBLE AS threshold, n_rows AS actual, n_rows >= 100 AS passed FROM v
UNION ALL SELECT 'data_quality_gate', 'max_missing_ratio', 0.05::DOUBLE, round(missing_ratio, 6), missing_ratio <= 0.05::DOUBLE FROM v
UNION ALL SELECT 'data_quality_gate', 'max_duplicate_ratio', 0.01::DOUBLE, round(duplicate_ratio, 6), duplicate_ratio <= 0.01::DOUBLE FROM v"""


def report(t: str, label: str) -> str:
    errors = " + ".join(f"count_if({cond})" for _, _, cond in CHECKS)
    broken = " + ".join(f"(CASE WHEN count_if({cond}) > 0 THEN 1 ELSE 0 END)" for _, _, cond in CHECKS)
    gate = "n_rows >= 100 AND missing_ratio <= 0.05::DOUBLE AND duplicate_ratio <= 0.01::DOUBLE"
    return f"""SELECT '{label}' AS scenario, n_rows::BIGINT AS n_rows, 12 AS n_columns, fingerprint, error_count, rules_broken,
  round(missing_ratio, 6) AS missing_ratio, round(duplicate_ratio, 6) AS duplicate_ratio,
  CASE WHEN error_count = 0 THEN 'PASS' ELSE 'FAIL' END AS schema_status,
  CASE WHEN {gate} THEN 'PASS' ELSE 'FAIL' END AS gate_status,
  CASE WHEN error_count = 0 AND {gate} THEN 'PASS' ELSE 'FAIL' END AS overall_status
FROM {gate_values(t)},
  (SELECT {fingerprint_of('d')} AS fingerprint, ({errors})::BIGINT AS error_count, ({broken})::INTEGER AS rules_broken
   FROM (SELECT *, sha256({SALES_TEXT}) AS d FROM {t}))"""


ORACLES["validation_report"] = f"{BAD}\n{report('sales', 'clean')}\nUNION ALL\n{report('data_quality_failure', 'data_quality_failure')}"


# --- row-level verdicts, loading, logs ---

KEYED = f"{BAD}, keyed AS (SELECT * FROM data_quality_failure)"


def named_violations(checks) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{c}:{k}' END" for c, k, cond in checks) + ")"


def case_text(c: str) -> str:
    kind = sqltext.KINDS[c]
    if kind == "double":
        return f"cast(cast(round({c}, 6) AS decimal(18,6)) AS varchar)"
    if kind == "int":
        return f"cast(cast({c} AS decimal(18,6)) AS varchar)"
    return f"cast({c} AS varchar)"


ORACLES["violation_cases"] = (
    KEYED
    + ", cases AS ("
    + " UNION ALL ".join(
        f"SELECT row_key, copy_no, '{c}:{k}' AS rule, '{c}' AS column_name, '{k}' AS check_name, {case_text(c)} AS failure_case FROM keyed WHERE {cond}"
        for c, k, cond in CHECKS
    )
    + ") SELECT * FROM cases ORDER BY rule, row_key, copy_no LIMIT 20"
)
ORACLES["quarantine"] = f"""{KEYED}
SELECT row_key, copy_no, coalesce(v, '') AS violations, CASE WHEN coalesce(v, '') = '' THEN 'accepted' ELSE 'rejected' END AS verdict
FROM (SELECT row_key, copy_no, {named_violations(CHECKS)} AS v FROM keyed)"""

FEATURES = [c for c in COLUMNS if c not in ("date", "sales_demand")]
REQUEST_CONDITION = " OR ".join(
    [f"{c} IS NULL" for c in FEATURES]
    + [
        f"coalesce({cond}, false)"
        for cond in (
            "promotion_flag NOT BETWEEN 0 AND 1",
            "price <= 0",
            "inventory_level < 0",
            "competitor_price <= 0",
            "temperature NOT BETWEEN -50 AND 60",
            "day_of_week NOT BETWEEN 0 AND 6",
            "month NOT BETWEEN 1 AND 12",
            "previous_day_sales < 0",
        )
    ]
)
ORACLES["validate_requests"] = f"""{KEYED}
SELECT store_id, count_if(NOT bad) AS accepted, count_if(bad) AS rejected
FROM (SELECT store_id, ({REQUEST_CONDITION}) AS bad FROM keyed) GROUP BY store_id"""

SALES_PRINT = f"(SELECT count(*) AS n_rows, {fingerprint_of('d')} AS fingerprint FROM (SELECT sha256({SALES_TEXT}) AS d FROM sales))"
ORACLES["load_profile"] = f"WITH {SALES} SELECT 'sales' AS source, n_rows, 12 AS n_columns, '{','.join(COLUMNS)}' AS column_names, fingerprint FROM {SALES_PRINT}"
ORACLES["load_saved"] = ORACLES["load_profile"]
ORACLES["verify_load"] = f"""{BAD}, p AS (SELECT fingerprint AS expected FROM {SALES_PRINT}),
q AS (SELECT fingerprint AS actual FROM (SELECT {fingerprint_of('d')} AS fingerprint FROM (SELECT sha256({SALES_TEXT}) AS d FROM data_quality_failure)))
SELECT 'reordered' AS dataset, expected, expected AS actual, true AS matches FROM p
UNION ALL SELECT 'faulty', expected, actual, expected = actual FROM p, q"""
ORACLES["log_range"] = """SELECT event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') AS integer) AS k
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"""
ORACLES["log_quarantine"] = """SELECT strftime(ts, '%Y-%m-%d') AS log_day, concat('{"event_id": ', event_id, ', broken') AS line
FROM events WHERE event_id % 100 = 0 AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20'"""

# --- fingerprints, profile, splits, adapters ---

ORACLES["table_fingerprint"] = f"WITH {SALES} SELECT n_rows, fingerprint FROM {SALES_PRINT}"
ORACLES["fingerprint_by_month"] = f"""WITH {SALES}
SELECT month, count(*) AS n_rows, {fingerprint_of('d')} AS fingerprint FROM (SELECT month, sha256({SALES_TEXT}) AS d FROM sales) GROUP BY month"""

NUMBERS = [c for c in COLUMNS if sqltext.KINDS[c] in ("double", "int")]
ORACLES["profile_numeric"] = f"""{BAD}, t AS (SELECT count(*) AS n_rows, sum({CELLS})::BIGINT AS null_cells, {fingerprint_of('d')} AS fingerprint
  FROM (SELECT *, sha256({SALES_TEXT}) AS d FROM data_quality_failure))
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}::DOUBLE), 5) AS mean, round(stddev_samp({c}::DOUBLE), 5) AS std, round(min({c}::DOUBLE), 5) AS min, "
    f"round(max({c}::DOUBLE), 5) AS max, any_value(n_rows) AS n_rows, any_value(null_cells) AS null_cells, any_value(fingerprint) AS fingerprint FROM data_quality_failure, t"
    for c in NUMBERS
)


def split_case(date: str = "date") -> str:
    return (
        f"CASE WHEN {date} <= TIMESTAMP '1999-06-30' THEN 'train' WHEN {date} <= TIMESTAMP '2000-06-30' THEN 'validation' "
        f"WHEN {date} <= TIMESTAMP '2001-12-31' THEN 'test' END"
    )


TYPES = ",".join(f"{c}:{sqltext.KINDS[c]}" for c in COLUMNS)
ORACLES["manifest"] = f"""WITH {SALES}
SELECT 'sales' AS dataset, count(*) AS n_rows, 12 AS n_columns, '{TYPES}' AS column_types, strftime(min(date), '%Y-%m-%d') AS first_date,
  strftime(max(date), '%Y-%m-%d') AS last_date, {fingerprint_of('d')} AS fingerprint, count_if(s = 'train') AS train_rows,
  count_if(s = 'validation') AS validation_rows, count_if(s = 'test') AS test_rows
FROM (SELECT date, {split_case()} AS s, sha256({SALES_TEXT}) AS d FROM sales)"""
ORACLES["chrono_split"] = f"""{BAD}
SELECT coalesce({split_case()}, 'unassigned') AS split, count(*) AS n_rows, strftime(min(date), '%Y-%m-%d') AS first_date,
  strftime(max(date), '%Y-%m-%d') AS last_date, round(sum(sales_demand), 3) AS demand FROM data_quality_failure GROUP BY 1"""
ORACLES["quantile_split"] = f"""WITH {SALES}, p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM sales)
SELECT CASE WHEN i < floor(n*0.7::DOUBLE) THEN 'train' WHEN i < floor(n*0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split,
  count(*) AS n_rows, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM p GROUP BY 1"""
ORACLES["reference_baseline"] = f"""WITH {SALES}
SELECT product_category, count(*) AS n_rows, round(avg(price), 6) AS price, round(avg(sales_demand), 6) AS demand
FROM sales WHERE {split_case()} IN ('train', 'validation') GROUP BY 1"""
ORACLES["calendar_features"] = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, cast(isodow(ts) - 1 AS integer) AS day_of_week,
  cast(month(ts) AS integer) AS month FROM events"""
ORACLES["adapt_daily"] = """WITH t AS (
  SELECT date_trunc('day', l_shipdate) AS d, n_name, l_quantity AS q, l_extendedprice / nullif(l_quantity, 0) AS u
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT d, n_name, sum(q*u) AS demand, avg(u) AS price, sum(q) AS stock FROM t WHERE q > 0 AND u > 0 GROUP BY d, n_name)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS date, n_name AS store_id, 'retail' AS product_category, 0 AS promotion_flag, round(price + 3e-7::DOUBLE, 4) AS price,
  round(stock + 3e-7::DOUBLE, 4) AS inventory_level, round(price + 3e-7::DOUBLE, 4) AS competitor_price, 0.0::DOUBLE AS temperature, cast(isodow(d) - 1 AS integer) AS day_of_week,
  cast(month(d) AS integer) AS month, round(coalesce(lag(demand) OVER (PARTITION BY n_name ORDER BY d), 0.0) + 3e-7::DOUBLE, 4) AS previous_day_sales,
  round(demand + 3e-7::DOUBLE, 4) AS sales_demand FROM g"""
ORACLES["adapt_hourly"] = """WITH h AS (SELECT date_trunc('hour', ts) AS d, count(*)::DOUBLE AS c, avg(value) AS v FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS date, 'hourly' AS store_id, cast(quarter(d) AS varchar) AS product_category,
  cast(isodow(d) >= 6 AS integer) AS promotion_flag, 1.0::DOUBLE AS price, c AS inventory_level, 1.0::DOUBLE AS competitor_price, round(v + 3e-7::DOUBLE, 4) AS temperature,
  cast(isodow(d) - 1 AS integer) AS day_of_week, cast(month(d) AS integer) AS month, coalesce(lag(c) OVER (ORDER BY d), 0.0) AS previous_day_sales,
  c AS sales_demand FROM h"""
ORACLES["lag_by_store"] = f"""WITH {SALES}, g AS (SELECT store_id, date, sum(sales_demand) AS demand FROM sales GROUP BY 1, 2)
SELECT store_id, strftime(date, '%Y-%m-%d') AS date, round(demand, 4) AS demand,
  round(coalesce(lag(demand) OVER (PARTITION BY store_id ORDER BY date), 0.0), 4) AS previous FROM g"""
ORACLES["lag_hourly"] = "SELECT event_id, round(value, 6) AS value, round(coalesce(lag(value) OVER (ORDER BY ts), 0.0), 6) AS previous FROM events"

# --- injection ---

ORACLES["inject_faults"] = f"""{BAD}
SELECT store_id, count(*) AS n_rows, count_if(price IS NULL) AS null_price, count_if(inventory_level IS NULL) AS null_inventory,
  count_if(previous_day_sales IS NULL) AS null_previous, count_if(date IS NULL) AS null_date, count_if(price < 0) AS negative_price,
  count_if(inventory_level < 0) AS negative_inventory, count_if(product_category = 'INVALID_CATEGORY_XYZ') AS invalid_category,
  round(sum(CASE WHEN price < 0 THEN price END), 4) AS negative_price_sum FROM data_quality_failure GROUP BY store_id"""
ORACLES["inject_drift"] = f"""WITH {SALES}, {scenario('severe_drift')}
SELECT product_category, promotion_flag, count(*) AS n_rows, round(avg(price), 6) AS price, round(avg(competitor_price), 6) AS competitor_price,
  round(avg(temperature), 6) AS temperature, round(avg(sales_demand), 6) AS demand FROM severe_drift GROUP BY 1, 2"""
ALL_SCENARIOS = ",\n".join(scenario(name) for name in contract.SCENARIOS)
ORACLES["scenario_gate_matrix"] = f"WITH {SALES},\n{ALL_SCENARIOS}\n" + "\nUNION ALL\n".join(report(n, n) for n in contract.SCENARIOS)

# --- drift ---

SIDES = f"""WITH {SALES}, ref AS (SELECT * FROM sales WHERE {split_case()} IN ('train', 'validation')),
cur AS (SELECT * FROM sales WHERE {split_case()} = 'test')"""
NUMERICAL = contract.DRIFT_FEATURES["numerical"]
CATEGORICAL = contract.DRIFT_FEATURES["categorical"]


def distances(t: str, label: str = "") -> str:
    """CTEs ending in dist<label>(feature, n, m, ks, w) for ref against table t."""
    x = label
    return f"""vals{x} AS (SELECT 0 AS side, * FROM ({unpivot('ref', NUMERICAL)}) UNION ALL SELECT 1, * FROM ({unpivot(t, NUMERICAL)})),
cnt{x} AS (SELECT feature, value, count_if(side = 0) AS r, count_if(side = 1) AS c FROM vals{x} GROUP BY 1, 2),
cum{x} AS (SELECT feature, value, sum(r) OVER w / (sum(r) OVER p)::DOUBLE AS fr, sum(c) OVER w / (sum(c) OVER p)::DOUBLE AS fc, lead(value) OVER w AS nxt,
  sum(r) OVER p AS n, sum(c) OVER p AS m FROM cnt{x} WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
dist{x} AS (SELECT d.feature, n, m, ks, area / greatest(s, 0.001::DOUBLE) AS w FROM (SELECT feature, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m, max(abs(fr - fc)) AS ks,
  coalesce(sum(abs(fr - fc)*(nxt - value)), 0.0) AS area FROM cum{x} GROUP BY feature) d
  JOIN (SELECT feature, stddev_pop(value) AS s FROM vals{x} WHERE side = 0 GROUP BY feature) v ON d.feature = v.feature)"""


def ks_p(table: str = "dist") -> str:
    lam2 = "(ks*ks*(n*m/(n+m)))"
    return (
        f"CASE WHEN {lam2} < 0.04::DOUBLE THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_sum(list_transform(range(1, 101), "
        f"lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0::DOUBLE*k*k*{lam2}))))) END"
    )


def gamma_tail(a: str, x: str) -> str:
    return (
        f"CASE WHEN {a} <= 0 OR {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > {a} + 60.0::DOUBLE + 20.0::DOUBLE*sqrt({a}) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform("
        f"range(0, 600), lambda k: exp(-({x}) + ({a} + k)*ln({x}) - lgamma({a} + k + 1.0::DOUBLE))))) END"
    )


def categories(t: str, label: str = "") -> str:
    x = label

    def long(source):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS feature, cast({c} AS varchar) AS category FROM {source} WHERE {c} IS NOT NULL" for c in CATEGORICAL
        )

    return f"""cat{x} AS (SELECT feature, category, count_if(side = 0)::DOUBLE AS r, count_if(side = 1)::DOUBLE AS c
  FROM (SELECT 0 AS side, * FROM ({long('ref')}) UNION ALL SELECT 1, * FROM ({long(t)})) GROUP BY 1, 2),
tot{x} AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS tr, sum(c) OVER (PARTITION BY feature) AS tc FROM cat{x}),
chi{x} AS (SELECT feature, coalesce(sum(CASE WHEN r > 0 THEN (c - tc*r/tr)*(c - tc*r/tr)/(tc*r/tr) END), 0.0)::DOUBLE AS score, count(*) - 1 AS df,
  bool_or(r = 0 AND c > 0) AS unseen FROM tot{x} GROUP BY feature)"""


CHI_P = f"CASE WHEN unseen THEN 0.0::DOUBLE ELSE {gamma_tail('(df/2.0::DOUBLE)', '(score/2.0::DOUBLE)')} END"


def ztest(t: str, label: str = "") -> str:
    x = label
    return f"""z{x} AS (SELECT 'promotion_flag' AS feature, coalesce((x/n - y/m)/nullif(sqrt((x+y)/(n+m)*(1 - (x+y)/(n+m))*(1/n + 1/m)), 0), 0.0)::DOUBLE AS score
  FROM (SELECT (SELECT count(promotion_flag)::DOUBLE FROM ref) AS n, (SELECT count(promotion_flag)::DOUBLE FROM {t}) AS m,
    (SELECT sum(promotion_flag)::DOUBLE FROM ref) AS x, (SELECT sum(promotion_flag)::DOUBLE FROM {t}) AS y))"""


Z_P = gamma_tail("0.5::DOUBLE", "(score*score/2.0::DOUBLE)")


def by_column(t: str, label: str = "") -> str:
    """CTEs ending in scored<label>: one row per feature."""
    x = label
    return f"""{distances(t, x)}, {categories(t, x)}, {ztest(t, x)},
scored{x} AS (SELECT feature, 'numerical' AS kind, 'ks' AS test, ks AS score, {ks_p()} AS p_value FROM dist{x}
  UNION ALL SELECT feature, 'categorical', 'chisquare', score, {CHI_P} FROM chi{x}
  UNION ALL SELECT feature, 'binary', 'z', score, {Z_P} FROM z{x})"""


def current(name: str) -> str:
    return f"{SIDES},\n{scenario(name, 'cur')}"


ORACLES["drift_ks"] = f"""{current('mild_drift')}, {distances('mild_drift')}
SELECT feature, 'numerical' AS kind, 'ks' AS test, round(ks, 6) AS score, round({ks_p()}, 6) AS p_value, {ks_p()} < 0.05::DOUBLE AS drifted FROM dist"""
ORACLES["drift_wasserstein"] = f"""{current('mild_drift')}, {distances('mild_drift')}
SELECT feature, 'numerical' AS kind, 'wasserstein' AS test, round(w, 5) AS score, cast(NULL AS double) AS p_value, w >= 0.1::DOUBLE AS drifted FROM dist"""
ORACLES["drift_chi2"] = f"""{current('severe_drift')}, {categories('severe_drift')}
SELECT feature, 'categorical' AS kind, 'chisquare' AS test, round(score, 6) AS score, round({CHI_P}, 6) AS p_value, {CHI_P} < 0.05::DOUBLE AS drifted, df FROM chi"""
ORACLES["drift_js"] = f"""{current('severe_drift')}, {categories('severe_drift')},
js AS (SELECT feature, sqrt(greatest(0.0::DOUBLE, sum(CASE WHEN r > 0 THEN r/tr*log2(r/tr/((r/tr + c/tc)/2)) ELSE 0 END)/2
  + sum(CASE WHEN c > 0 THEN c/tc*log2(c/tc/((r/tr + c/tc)/2)) ELSE 0 END)/2)) AS s FROM tot GROUP BY feature)
SELECT feature, 'categorical' AS kind, 'jensenshannon' AS test, round(s, 6) AS score, cast(NULL AS double) AS p_value, s >= 0.1::DOUBLE AS drifted FROM js"""
ORACLES["drift_ztest"] = f"""{current('mild_drift')}, {ztest('mild_drift')}
SELECT feature, 'binary' AS kind, 'z' AS test, round(score, 6) AS score, round({Z_P}, 6) AS p_value, {Z_P} < 0.05::DOUBLE AS drifted FROM z"""


def summary(x: str = "", lead: str = "") -> str:
    return (
        f"SELECT {lead}count(*) AS n_columns, count_if(p_value < 0.05::DOUBLE) AS n_drifted, count_if(p_value < 0.05::DOUBLE) / count(*)::DOUBLE AS drift_share, "
        f"coalesce(string_agg(CASE WHEN p_value < 0.05::DOUBLE THEN feature END, ',' ORDER BY feature), '') AS drifted_columns, "
        f"coalesce(string_agg(CASE WHEN p_value < 0.05::DOUBLE AND feature IN ('price', 'previous_day_sales', 'promotion_flag') THEN feature END, ',' ORDER BY feature), '') AS critical_drifted "
        f"FROM scored{x}"
    )


DECISION = """round(drift_share, 6) AS drift_share, drifted_columns, drift_share >= 0.3::DOUBLE AS dataset_drift"""
DECIDED = """critical_drifted, CASE WHEN drift_share <= 0.2::DOUBLE AND critical_drifted = '' THEN 'CONTINUE' WHEN drift_share <= 0.5::DOUBLE THEN 'INVESTIGATE' ELSE 'RETRAIN_REQUIRED' END AS decision,
  CASE WHEN drift_share <= 0.2::DOUBLE AND critical_drifted = '' THEN printf('%.1f%% of columns drifted, at most 20%%', drift_share * 100)
    WHEN drift_share <= 0.2::DOUBLE THEN concat('critical columns drifted: ', replace(critical_drifted, ',', ', '))
    WHEN drift_share <= 0.5::DOUBLE THEN printf('%.1f%% of columns drifted, above 20%% and at most 50%%', drift_share * 100)
    ELSE printf('%.1f%% of columns drifted, above 50%%', drift_share * 100) END AS reason"""
SEVERE = f"{current('severe_drift')}, {by_column('severe_drift')}"
ORACLES["drift_summary"] = f"{SEVERE} SELECT n_columns, n_drifted, {DECISION} FROM ({summary()})"
ORACLES["drift_decision"] = f"{SEVERE} SELECT n_columns, n_drifted, {DECISION}, {DECIDED} FROM ({summary()})"
ORACLES["drift_report"] = f"""{current('mild_drift')}, {by_column('mild_drift')}
SELECT feature, kind, test, round(score, 5) AS score, round(p_value, 5) AS p_value, p_value < 0.05::DOUBLE AS drifted FROM scored"""
DRIFT_CTES = (
    SIDES[len(f"WITH {SALES}, ") :]
    + ",\n"
    + ",\n".join(
        f"{scenario('cur_' + n, 'cur', settings)},\n{by_column('cur_' + n, '_' + n)}" for n, settings in contract.SCENARIOS.items()
    )
    + ", summaries AS ("
    + " UNION ALL ".join(summary("_" + n, f"'{n}' AS scenario, ") for n in contract.SCENARIOS)
    + f"), decisions AS (SELECT scenario, n_columns, n_drifted, {DECISION}, {DECIDED} FROM summaries)"
)
DRIFT_MATRIX = f"WITH {SALES}, {DRIFT_CTES}"
ORACLES["scenario_drift_matrix"] = f"{DRIFT_MATRIX} SELECT * FROM decisions"
ORACLES["retrain_requests"] = f"""{DRIFT_MATRIX} SELECT scenario, drift_share, drifted_columns, 'drift above the acceptable share' AS reason,
  'PENDING' AS status, false AS auto_trigger FROM decisions WHERE decision = 'RETRAIN_REQUIRED'"""


# --- features ---

PARTS = f"""{BAD}, tr AS (SELECT * FROM data_quality_failure WHERE {split_case()} = 'train'),
pt AS (SELECT {split_case()} AS split, * FROM data_quality_failure WHERE {split_case()} IS NOT NULL)"""
NUMERIC = contract.NUMERIC_FEATURES
VOCABULARY = "voc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast(v AS varchar) AS category, cast(row_number() OVER (ORDER BY v) AS integer) AS code FROM (SELECT DISTINCT {c} AS v FROM tr WHERE {c} IS NOT NULL)"
    for c in CATEGORICAL
) + ")"
MEDIANS = "med AS (SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS {c}" for c in NUMERIC) + " FROM tr)"
ORACLES["fit_categories"] = f"{PARTS}, {VOCABULARY} SELECT * FROM voc"
ORACLES["fit_medians"] = f"{PARTS}, {MEDIANS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round({c}, 9) AS median FROM med" for c in NUMERIC
)
ORACLES["impute"] = f"{PARTS}, {MEDIANS} SELECT split, row_key, copy_no, " + ", ".join(
    f"round(coalesce(pt.{c}::DOUBLE, med.{c}), 9) AS {c}" for c in NUMERIC
) + " FROM pt, med"


def code(c: str, t: str) -> str:
    return f"coalesce((SELECT any_value(code) FROM voc WHERE column_name = '{c}' AND category = cast({t}.{c} AS varchar)), 0)"


ORACLES["encode"] = f"{PARTS}, {VOCABULARY} SELECT split, row_key, copy_no, " + ", ".join(f"{code(c, 'pt')} AS {c}" for c in CATEGORICAL) + " FROM pt"
ORACLES["derive_features"] = f"""{KEYED} SELECT row_key, copy_no, round(price - competitor_price, 9) AS price_diff,
  round(price / (competitor_price + 1e-5::DOUBLE), 9) AS price_ratio FROM keyed"""
FILLED = ", ".join(f"coalesce({c}::DOUBLE, (SELECT {c} FROM med)) AS {c}" for c in NUMERIC)
ORACLES["feature_matrix"] = f"""{PARTS}, {VOCABULARY}, {MEDIANS},
f AS (SELECT split, {', '.join(f'{code(c, "pt")} AS {c}' for c in CATEGORICAL)}, {FILLED}, coalesce(sales_demand, 0.0) AS sales_demand FROM pt)
SELECT split, count(*) AS n_rows, {', '.join(f'round(avg({c}), 5) AS {c}' for c in CATEGORICAL + NUMERIC + ['sales_demand'])},
  round(avg(price - competitor_price), 5) AS price_diff, round(avg(price / (competitor_price + 1e-5::DOUBLE)), 5) AS price_ratio FROM f GROUP BY split"""

# --- metrics, gates, readiness ---

PREDICTION = "(100 + 30*promotion_flag + 0.1::DOUBLE*previous_day_sales)"
UNGATED = "(107.5::DOUBLE + 0.1::DOUBLE*previous_day_sales)"


def measures(y: str, p: str) -> str:
    return (
        f"avg(abs({y} - {p})) AS mae, sqrt(avg(({y} - {p})*({y} - {p}))) AS rmse, "
        f"1.0::DOUBLE - sum(({y} - {p})*({y} - {p})) / (var_pop({y})*count({y})) AS r2, "
        f"avg(abs(({y} - {p})/({y} + 1e-5::DOUBLE))) AS mape, sum(abs({y} - {p}))/sum(abs({y})) AS wmape"
    )


def shown(names, digits=6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


FIVE = ["mae", "rmse", "r2", "mape", "wmape"]
ORACLES["regression_metrics"] = f"WITH {SALES} SELECT n, {shown(FIVE)} FROM (SELECT count(*) AS n, {measures('sales_demand', PREDICTION)} FROM sales)"
ORACLES["metrics_by_segment"] = f"""WITH {SALES} SELECT product_category, store_id, n, {shown(FIVE)} FROM (
  SELECT product_category, store_id, count(*) AS n, {measures('sales_demand', UNGATED)} FROM sales GROUP BY 1, 2)"""
ORACLES["latency_summary"] = """SELECT count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value)/100, 6) AS per_record FROM events"""

LATENCY = "(SELECT avg(value)/100 FROM events)"
FILLED = "(SELECT * REPLACE (coalesce(previous_day_sales, (SELECT median(previous_day_sales) FROM sales WHERE date <= TIMESTAMP '1999-06-30')) AS previous_day_sales) FROM {n})"
SCENARIO_METRICS = "scn AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, {measures('sales_demand', PREDICTION)} FROM {FILLED.format(n=n)}" for n in contract.SCENARIOS
) + ")"
GATED = f"""WITH {SALES},
{ALL_SCENARIOS}, {SCENARIO_METRICS},
mg AS (SELECT scenario, 'model_quality_gate' AS gate, rule, op, threshold, actual, CASE WHEN op = '<=' THEN actual <= threshold ELSE actual >= threshold END AS passed FROM (
  SELECT scenario, 'rmse' AS rule, '<=' AS op, 150.0::DOUBLE AS threshold, rmse AS actual FROM scn
  UNION ALL SELECT scenario, 'mape', '<=', 0.25::DOUBLE, mape FROM scn UNION ALL SELECT scenario, 'r2', '>=', 0.5::DOUBLE, r2 FROM scn
  UNION ALL SELECT scenario, 'latency_ms', '<=', 100.0::DOUBLE, {LATENCY} FROM scn)),
mv AS (SELECT scenario, bool_and(passed) AS model_ok, coalesce(string_agg(CASE WHEN NOT passed THEN rule END, ',' ORDER BY rule), '') AS failed FROM mg GROUP BY scenario),
rep AS ({" UNION ALL ".join(report(n, n) for n in contract.SCENARIOS)}),
ready AS (SELECT rep.scenario, overall_status = 'PASS' AS data_validation_passed, model_ok AS model_quality_passed, overall_status = 'PASS' AND model_ok AS deployable,
  CASE WHEN overall_status = 'PASS' AND model_ok THEN 'APPROVED' ELSE 'REJECTED' END AS status,
  concat_ws('; ', CASE WHEN overall_status <> 'PASS' THEN 'data validation failed' END, CASE WHEN NOT model_ok THEN concat('model gate failed: ', failed) END) AS blocking_reasons
  FROM rep JOIN mv ON rep.scenario = mv.scenario)"""
ORACLES["model_gate"] = f"{GATED} SELECT scenario, gate, rule, op, threshold, round(actual, 6) AS actual, passed FROM mg"
ORACLES["deployment_readiness"] = f"{GATED} SELECT * FROM ready"
ORACLES["check_scores"] = f"""{GATED} SELECT scenario, count_if(passed) AS n_passed, count(*) AS n_checks,
  round(count_if(passed)/count(*)::DOUBLE, 6) AS score FROM mg GROUP BY scenario"""

# --- ledger, statistics, comparison ---

VARIANTS = "(VALUES " + ", ".join(f"('{v}', '{p}', '{d}')" for v, p, d in contract.RUN_VARIANTS) + ") AS v(variant, pipeline, disabled)"
SEEDS = "(VALUES " + ", ".join(f"({s})" for s in contract.RUN_SEEDS) + ") AS s(seed)"
HASH_TEXT = """concat('{"disabled": "', disabled, '", "seed": ', seed, ', "variant": "', variant, '"}')"""
ORACLES["experiment_matrix"] = f"""WITH {SALES}
SELECT variant, pipeline, disabled, cast(seed AS integer) AS seed, sha256({HASH_TEXT}) AS config_hash, n_rows, fingerprint FROM {VARIANTS}, {SEEDS}, {SALES_PRINT}"""
NOISE = "((inventory_level*seed) % 101 - 50)/25"
LEDGER = f"""WITH {SALES}, runs AS (
  SELECT 'baseline' AS pipeline, seed, {measures('sales_demand', f'({UNGATED} + {NOISE})')} FROM sales, {SEEDS} GROUP BY seed
  UNION ALL SELECT 'proposed', seed, {measures('sales_demand', f'({PREDICTION} + {NOISE})')} FROM sales, {SEEDS} GROUP BY seed),
ledger AS (SELECT variant, v.pipeline, cast(seed AS integer) AS seed, mae, rmse, r2, mape FROM {VARIANTS} JOIN runs ON runs.pipeline = v.pipeline),
long AS (SELECT variant, seed, metric, value FROM ledger UNPIVOT (value FOR metric IN (mae, rmse, r2, mape)))"""
ORACLES["run_aggregate"] = f"""{LEDGER}
SELECT variant, metric, count(*) AS n, 0::BIGINT AS n_failed, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, string_agg(cast(cast(round(value, 6) AS decimal(18,6)) AS varchar), ',' ORDER BY seed) AS values,
  round(avg(value) - 1.96::DOUBLE*stddev_samp(value)/sqrt(count(*)), 6) AS ci95_low, round(avg(value) + 1.96::DOUBLE*stddev_samp(value)/sqrt(count(*)), 6) AS ci95_high
FROM long GROUP BY variant, metric"""
ORACLES["run_wide"] = f"{LEDGER} SELECT variant, pipeline, seed, 'COMPLETED' AS status, {shown(['mae', 'mape', 'r2', 'rmse'])} FROM ledger"
ORACLES["champion"] = f"""WITH {SALES}, g AS (SELECT product_category, date_trunc('month', date) AS ym, {measures('sales_demand', PREDICTION)} FROM sales GROUP BY 1, 2)
SELECT product_category, cast(arg_max(year(ym)*100 + month(ym), ym) AS integer) AS version, strftime(max(ym), '%Y-%m-%d') AS registered_at
FROM g WHERE rmse <= 14.4::DOUBLE AND r2 >= 0.5::DOUBLE GROUP BY product_category"""


def segment_rows(p: str) -> str:
    return f"""(SELECT * FROM (SELECT product_category, {measures('sales_demand', p)} FROM sales GROUP BY product_category)
      UNPIVOT (value FOR metric IN (mae, rmse, r2, mape)))"""


TOLERANCE = "(CASE WHEN a.metric IN ('r2', 'mape') THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END)"
ORACLES["metric_diff"] = f"""WITH {SALES}
SELECT a.product_category, a.metric, round(a.value, 6) AS run1, round(b.value, 6) AS run2, round(abs(a.value - b.value), 6) AS diff, {TOLERANCE} AS tolerance,
  abs(a.value - b.value) <= {TOLERANCE} AS matches
FROM {segment_rows(PREDICTION)} a JOIN {segment_rows(f'({PREDICTION} + temperature*1e-2::DOUBLE)')} b ON a.product_category = b.product_category AND a.metric = b.metric"""


def pair(name: str, step: str) -> str:
    gap = f"abs({PREDICTION} - ({PREDICTION} + temperature*{step}::DOUBLE))"
    return f"""SELECT count(*) AS n_run1, count(*) AS n_run2, count(*) AS n_matched, round(max({gap}), 9) AS max_diff, round(avg({gap}), 9) AS mean_diff,
  true AS shape_matches, max({gap}) <= 1e-5::DOUBLE AS matches, '{name}' AS pair FROM sales"""


ORACLES["prediction_diff"] = f"WITH {SALES} {pair('near', '1e-7')} UNION ALL {pair('far', '1e-3')}"
FEATURE_SETS = f"""WITH {SALES}, x AS (SELECT DISTINCT store_id, product_category FROM sales WHERE {split_case()} = 'train'),
y AS (SELECT DISTINCT store_id, product_category FROM sales WHERE {split_case()} = 'test' AND date >= TIMESTAMP '2001-11-01'),
fd AS (SELECT st.store_id, (SELECT count(*) FROM x WHERE x.store_id = st.store_id) AS run1_count, (SELECT count(*) FROM y WHERE y.store_id = st.store_id) AS run2_count,
  coalesce((SELECT string_agg(product_category, ',' ORDER BY product_category) FROM x WHERE x.store_id = st.store_id
    AND NOT EXISTS (SELECT 1 FROM y WHERE y.store_id = x.store_id AND y.product_category = x.product_category)), '') AS missing_in_run2,
  coalesce((SELECT string_agg(product_category, ',' ORDER BY product_category) FROM y WHERE y.store_id = st.store_id
    AND NOT EXISTS (SELECT 1 FROM x WHERE y.store_id = x.store_id AND y.product_category = x.product_category)), '') AS extra_in_run2
  FROM (SELECT DISTINCT store_id FROM sales) st)"""
ORACLES["feature_diff"] = f"""{FEATURE_SETS} SELECT store_id, run1_count::INTEGER AS run1_count, run2_count::INTEGER AS run2_count, missing_in_run2, extra_in_run2,
  missing_in_run2 = '' AND extra_in_run2 = '' AS matches FROM fd"""
ORACLES["repro_report"] = f"""{FEATURE_SETS}, c AS (SELECT 'dataset_fingerprint' AS check_name, true AS passed
  UNION ALL SELECT 'features', bool_and(missing_in_run2 = '' AND extra_in_run2 = '') FROM fd
  UNION ALL SELECT 'metrics', bool_and(abs(a.value - b.value) <= {TOLERANCE}) FROM {segment_rows(PREDICTION)} a
    JOIN {segment_rows(f'({PREDICTION} + temperature*1e-7::DOUBLE)')} b ON a.product_category = b.product_category AND a.metric = b.metric
  UNION ALL SELECT 'predictions', max(abs(temperature*1e-7::DOUBLE)) <= 1e-5::DOUBLE FROM sales)
SELECT check_name, passed, (SELECT bool_and(passed) FROM c) AS reproducible FROM c"""

COMPARED = f"{GATED}, {DRIFT_CTES}"
ORACLES["release_comparison"] = f"""{COMPARED}
SELECT CASE WHEN gated THEN 'gated' ELSE 'baseline' END AS pipeline_type, r.scenario,
  CASE WHEN gated THEN CASE WHEN data_validation_passed THEN 'PASS' ELSE 'FAIL' END ELSE 'NOT_CHECKED' END AS data_quality_gate_status,
  CASE WHEN gated THEN CASE WHEN model_quality_passed THEN 'PASS' ELSE 'FAIL' END ELSE 'NOT_CHECKED' END AS model_quality_gate_status,
  CASE WHEN gated AND deployable THEN 'Yes' ELSE 'No' END AS model_registered,
  CASE WHEN NOT gated THEN 'Yes (Unverified)' WHEN deployable THEN 'Yes (Verified)' ELSE 'No (Blocked)' END AS deployable,
  CASE WHEN NOT gated THEN 'Not Monitored' WHEN dataset_drift THEN 'Yes' ELSE 'No' END AS drift_detected,
  CASE WHEN gated THEN decision ELSE 'N/A' END AS decision, {shown(['mae', 'rmse', 'r2', 'mape'], 5)},
  0.0::DOUBLE AS train_duration_s, 0.0::DOUBLE AS total_duration_s, round({LATENCY}, 5) AS inference_latency_ms,
  CASE WHEN gated THEN 'Yes' ELSE 'No' END AS dataset_fingerprint_tracked, CASE WHEN gated THEN 'Yes' ELSE 'No' END AS experiment_tracking_present,
  CASE WHEN gated THEN 'Yes' ELSE 'No' END AS reproducibility_verified,
  CASE WHEN NOT gated THEN 'No (Gates absent)' WHEN NOT deployable THEN 'Yes' ELSE 'N/A (Valid run)' END AS invalid_release_prevented
FROM ready r JOIN decisions d ON r.scenario = d.scenario JOIN scn ON r.scenario = scn.scenario, (VALUES (true), (false)) AS g(gated)"""
ORACLES["release_confusion"] = f"""{GATED}, l AS (SELECT p AS pipeline, scenario IN ('clean', 'mild_drift') AS valid, p = 'baseline' OR deployable AS released
  FROM ready, (VALUES ('baseline'), ('proposed')) AS x(p))
SELECT pipeline, count(*) AS n, round(count_if(NOT valid AND NOT released)/nullif(count_if(NOT valid), 0)::DOUBLE, 6) AS blocked_invalid_rate,
  round(count_if(valid AND NOT released)/nullif(count_if(valid), 0)::DOUBLE, 6) AS false_block_rate,
  round(count_if(valid = released)/count(*)::DOUBLE, 6) AS decision_accuracy FROM l GROUP BY pipeline"""
ORACLES["drift_confusion"] = f"""{DRIFT_MATRIX}, a AS (SELECT scenario IN ('mild_drift', 'severe_drift', 'performance_degradation') AS drifted, decision <> 'CONTINUE' AS alerted FROM decisions),
r AS (SELECT count(*) AS n, count_if(drifted AND alerted)/nullif(count_if(alerted), 0)::DOUBLE AS precision, count_if(drifted AND alerted)/nullif(count_if(drifted), 0)::DOUBLE AS recall,
  count_if(NOT drifted AND alerted)/nullif(count_if(NOT drifted), 0)::DOUBLE AS false_alarm_rate, count_if(drifted AND NOT alerted)/nullif(count_if(drifted), 0)::DOUBLE AS missed_rate FROM a)
SELECT n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(false_alarm_rate, 6) AS false_alarm_rate, round(missed_rate, 6) AS missed_rate,
  round(2*precision*recall/nullif(precision + recall, 0), 6) AS f1 FROM r"""
ORACLES["overhead"] = """WITH p AS (SELECT user_id, cast(isodow(ts) - 1 AS integer) AS day, avg(CASE WHEN event_type = 'view' THEN value END) AS a,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS b FROM events GROUP BY 1, 2)
SELECT day, count((b - a)/nullif(a, 0)) AS n, round(avg((b - a)/nullif(a, 0)), 6) AS mean_ratio, round(median((b - a)/nullif(a, 0)), 6) AS median_ratio FROM p GROUP BY day"""


ORACLES["overhead_by_user"] = """WITH p AS (SELECT user_id, isodow(ts) AS day, avg(CASE WHEN event_type = 'view' THEN value END) AS a,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS b FROM events GROUP BY 1, 2), r AS (SELECT user_id, (b - a)/nullif(a, 0) AS v FROM p)
SELECT user_id, count(v) AS n, round(avg(v), 6) AS mean_ratio, round(median(v), 6) AS median_ratio FROM r WHERE v IS NOT NULL GROUP BY user_id"""

ORACLES["row_difference"] = """WITH l AS (SELECT l_suppkey, l_quantity, l_returnflag FROM lineitem),
r AS (SELECT l_suppkey, l_quantity, CASE WHEN l_quantity >= 50 THEN 'R' ELSE l_returnflag END AS l_returnflag FROM lineitem)
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)"""


def errors(period: str) -> str:
    return f"""WITH {SALES}, e AS (SELECT concat_ws('~', store_id, strftime(date_trunc('{period}', date), '%Y%m%d')) AS pair,
  avg(abs(sales_demand - {UNGATED})) - avg(abs(sales_demand - {PREDICTION})) AS gain FROM sales GROUP BY 1)"""


def draw(salt: str) -> str:
    return f"((cast(concat('0x', substr(md5(concat_ws('~', pair, cast(r AS varchar), '{salt}', '42')), 1, 15)) AS bigint) + 1.0::DOUBLE)/1152921504606846976.0::DOUBLE)"


ORACLES["paired_permutation"] = f"""{errors('month')}, o AS (SELECT count(gain) AS n, avg(gain) AS m, stddev_samp(gain) AS s FROM e),
rep AS (SELECT r, avg(CASE WHEN {draw('sign')} < 0.5::DOUBLE THEN -gain ELSE gain END) AS rm FROM e, range(1, 201) AS t(r) GROUP BY r),
x AS (SELECT count_if(abs(rm) >= abs(m) - 1e-12::DOUBLE) AS c FROM rep, o)
SELECT n, round(m, 6) AS mean_difference, round(m/s, 6) AS effect_size, c AS n_extreme, round((c + 1)/201.0::DOUBLE, 6) AS p_value FROM o, x"""
POISSON = []
_total = 0.0
for _k in range(20):
    _total += math.exp(-1) / math.factorial(_k)
    POISSON.append(f"(CASE WHEN u > {_total!r}::DOUBLE THEN 1 ELSE 0 END)")
ORACLES["bootstrap_ci"] = f"""{errors('week')}, d AS (SELECT r, gain, {draw('weight')} AS u FROM e, range(1, 201) AS t(r)),
rep AS (SELECT r, sum(w*gain)/sum(w) AS rm FROM (SELECT r, gain, {' + '.join(POISSON)} AS w FROM d) GROUP BY r)
SELECT (SELECT count(gain) FROM e) AS n, (SELECT round(avg(gain), 6) FROM e) AS mean, round(quantile_cont(rm, 0.025), 6) AS ci_low, round(quantile_cont(rm, 0.975), 6) AS ci_high FROM rep"""
ORACLES["detection_delay"] = """WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, avg(value) AS m FROM events GROUP BY 1, 2),
b AS (SELECT event_type, min(m) AS lo, max(m) AS hi FROM d WHERE day < TIMESTAMP '2024-01-10' GROUP BY 1),
a AS (SELECT d.event_type, day, m < lo OR m > hi AS alert FROM d JOIN b ON d.event_type = b.event_type WHERE day >= TIMESTAMP '2024-01-10'),
f AS (SELECT event_type, min(CASE WHEN alert THEN day END) AS first_alert FROM a GROUP BY 1)
SELECT f.event_type, strftime(first_alert, '%Y-%m-%d') AS first_alert, first_alert IS NOT NULL AS detected,
  cast(epoch(first_alert) - epoch(TIMESTAMP '2024-01-10') AS bigint) AS delay_seconds,
  CASE WHEN first_alert IS NOT NULL THEN (SELECT count(*) FROM a WHERE a.event_type = f.event_type AND day <= first_alert) END AS delay_observations FROM f"""

# --- streams ---

STREAMED = contract.SCENARIOS["data_quality_failure"]["faults"]
REQUEST_CHECKS = [(c, "not_null", f"{c} IS NULL") for c in FEATURES] + [
    ("promotion_flag", "in_0_1", "promotion_flag NOT BETWEEN 0 AND 1"),
    ("price", "gt_0", "price <= 0"),
    ("inventory_level", "ge_0", "inventory_level < 0"),
    ("competitor_price", "gt_0", "competitor_price <= 0"),
    ("temperature", "in_-50_60", "temperature NOT BETWEEN -50 AND 60"),
    ("day_of_week", "in_0_6", "day_of_week NOT BETWEEN 0 AND 6"),
    ("month", "in_1_12", "month NOT BETWEEN 1 AND 12"),
    ("previous_day_sales", "ge_0", "previous_day_sales < 0"),
]
ORACLES["stream_quarantine"] = f"""WITH {SALES}, {scenario('streamed', settings={'faults': STREAMED, 'drift': {}})}
SELECT row_key, copy_no, v AS violations, CASE WHEN v = '' THEN 'accepted' ELSE 'rejected' END AS verdict
FROM (SELECT row_key, copy_no, coalesce({named_violations(REQUEST_CHECKS)}, '') AS v FROM streamed)"""
EVENT_CELLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))
ORACLES["window_monitor"] = f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n_rows, sum({EVENT_CELLS})::BIGINT AS null_cells,
  round(sum({EVENT_CELLS})/(count(*)*6)::DOUBLE, 6) AS missing_ratio, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY 1, 2"""
ORACLES["window_drift"] = f"""WITH b AS (SELECT event_type, count(*)::DOUBLE AS r FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1),
w AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events),
c AS (SELECT date_trunc('day', ts) AS day, event_type, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2),
j AS (SELECT w.day, b.event_type, r, coalesce(c.c, 0) AS c, sum(r) OVER (PARTITION BY w.day) AS tr, sum(coalesce(c.c, 0)) OVER (PARTITION BY w.day) AS tc
  FROM w CROSS JOIN b LEFT JOIN c ON c.day = w.day AND c.event_type = b.event_type),
s AS (SELECT day, sum((c - tc*r/tr)*(c - tc*r/tr)/(tc*r/tr)) AS score, count(*) - 1 AS df FROM j GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS window_start, round(score, 6) AS score, df, round({gamma_tail('(df/2.0::DOUBLE)', '(score/2.0::DOUBLE)')}, 6) AS p_value,
  {gamma_tail('(df/2.0::DOUBLE)', '(score/2.0::DOUBLE)')} < 0.05::DOUBLE AS drifted FROM s"""

# --- training: what SQL can decide of a model's output ---

KEYED = f"{SALES}, keyed AS (SELECT *, md5({SALES_TEXT}) AS row_key FROM sales)"
TEST = "date > TIMESTAMP '2000-06-30' AND date <= TIMESTAMP '2001-12-31'"
ORACLES["train_score"] = f"WITH {SALES} SELECT count(*) AS n, true AS beats_mean FROM sales WHERE {TEST}"
ORACLES["score_batch"] = f"WITH {KEYED} SELECT row_key, store_id, product_category, true AS valid FROM keyed WHERE {TEST}"
LOGGED = "row_key AS request_id, 'v1' AS model_version, store_id, product_category, promotion_flag, month, true AS valid"
ORACLES["score_log"] = f"WITH {KEYED} SELECT {LOGGED}, strftime(date, '%Y-%m-%d') AS \"timestamp\" FROM keyed WHERE {TEST}"
ORACLES["stream_score"] = f"WITH {KEYED} SELECT {LOGGED} FROM keyed"
ORACLES["run_experiments"] = f"""SELECT v.variant, v.pipeline, s.seed::INTEGER AS seed, 'COMPLETED' AS status, m.metric, '' AS error, true AS measured
FROM (VALUES {', '.join(f"('{name}', '{kind}')" for name, kind, _ in contract.RUN_VARIANTS)}) AS v(variant, pipeline),
  (VALUES {', '.join(f"({seed})" for seed in contract.RUN_SEEDS)}) AS s(seed),
  (VALUES ('mae'), ('rmse'), ('r2'), ('mape'), ('validation_mae'), ('validation_rmse'), ('validation_r2'), ('validation_mape')) AS m(metric)"""

POINTS = ", ".join(f"{i / 32!r}" for i in range(33))
NUMBERS = f"""WITH e AS (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, hour(ts)::DOUBLE AS hour, user_id::DOUBLE AS "user" FROM events),
v AS ({unpivot('e', ['value', 'k', 'hour', '"user"'], 'ts').replace("""'"user"'""", "'user'")}), r AS (SELECT feature, value FROM v WHERE ts < TIMESTAMP '2024-01-10'),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{POINTS}]))) AS cuts, stddev_pop(value) AS spread, count(*) AS nr FROM r GROUP BY feature),
rb AS (SELECT feature, len(list_filter(cuts, lambda c: c < value)) AS b, count(*) AS n, sum(value) AS t FROM r JOIN q USING (feature) GROUP BY 1, 2),
wb AS (SELECT date_trunc('day', ts) AS w, feature, len(list_filter(cuts, lambda c: c < value)) AS b, count(*) AS n, sum(value) AS t FROM v JOIN q USING (feature) GROUP BY 1, 2, 3),
bins AS (SELECT feature, b, CASE WHEN b > 0 THEN cuts[b] END AS lo, CASE WHEN b < len(cuts) THEN cuts[b + 1] END AS hi, spread, nr
  FROM q, unnest(range(0, len(cuts) + 1)) AS x(b)),
filled AS (SELECT g.w, bins.*, coalesce(rb.n, 0) AS rn, coalesce(rb.t, 0.0) AS rt, coalesce(wb.n, 0) AS n, coalesce(wb.t, 0.0) AS t
  FROM (SELECT DISTINCT w, feature FROM wb) g JOIN bins ON g.feature = bins.feature
  LEFT JOIN rb ON rb.feature = bins.feature AND rb.b = bins.b LEFT JOIN wb ON wb.w = g.w AND wb.feature = bins.feature AND wb.b = bins.b),
cum AS (SELECT *, sum(n) OVER p AS m, sum(n) OVER o / (sum(n) OVER p)::DOUBLE AS f, sum(rn) OVER o / nr::DOUBLE AS fr FROM filled
  WINDOW p AS (PARTITION BY w, feature), o AS (PARTITION BY w, feature ORDER BY b ROWS UNBOUNDED PRECEDING)),
parts AS (SELECT *, f - n / m::DOUBLE AS f0, fr - rn / nr::DOUBLE AS fr0, hi - lo AS width FROM cum),
bounds AS (SELECT *, CASE WHEN lo IS NULL THEN f ELSE greatest(abs(fr - f0), abs(fr0 - f)) END AS inside,
  CASE WHEN lo IS NULL THEN (n * hi - t) / m WHEN hi IS NULL THEN (t - n * lo) / m ELSE abs(width * (fr0 - f0) + (rn * hi - rt) / nr - (n * hi - t) / m) END AS area FROM parts),
d AS (SELECT w, feature, max(m)::DOUBLE AS m, max(nr)::DOUBLE AS n, max(abs(fr - f)) AS ks, max(inside) AS inside, sum(area) AS area,
  sum(CASE WHEN width IS NULL THEN area ELSE greatest(area, width * inside) END) AS high, greatest(max(spread), 0.001::DOUBLE) AS norm FROM bounds GROUP BY 1, 2)"""
ORACLES["window_numeric_drift"] = f"""{NUMBERS} SELECT strftime(w, '%Y-%m-%d') AS window_start, feature, m::BIGINT AS n_cur, round(ks, 6) AS ks, round(greatest(ks, inside), 6) AS ks_high,
  round({ks_p()}, 6) AS p_value, {ks_p()} < 0.05::DOUBLE AS ks_drifted, round(area / norm, 6) AS wasserstein, round(high / norm, 6) AS wasserstein_high,
  area / norm >= 0.1::DOUBLE AS wasserstein_drifted FROM d"""
EVENT_KINDS = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
ORACLES["window_fingerprint"] = f"""WITH e AS (SELECT date_trunc('day', ts) AS w, sha256({sqltext.row_text(EVENT_KINDS)}) AS h FROM events)
SELECT strftime(w, '%Y-%m-%d') AS window_start, count(*) AS n_rows, {fingerprint_of('h')} AS fingerprint FROM e GROUP BY w"""

DIGESTED = f"sha256({SALES_TEXT})"
ORACLES["verify_files"] = f"""{BAD}, old AS (SELECT concat('month=', month) AS folder, {DIGESTED} AS h FROM sales),
new AS (SELECT * FROM old WHERE folder NOT IN ('month=3', 'month=12') UNION ALL SELECT 'month=3', {DIGESTED} FROM data_quality_failure WHERE month = 3),
o AS (SELECT folder, {fingerprint_of('h')} AS f FROM old GROUP BY 1 UNION ALL SELECT '', {fingerprint_of('h')} FROM old),
n AS (SELECT folder, {fingerprint_of('h')} AS f FROM new GROUP BY 1 UNION ALL SELECT '', {fingerprint_of('h')} FROM new)
SELECT o.folder, CASE WHEN n.f IS NULL THEN 'missing' WHEN n.f = o.f THEN 'same' ELSE 'changed' END AS status, o.f AS expected, n.f AS actual
FROM o LEFT JOIN n ON o.folder = n.folder"""
ORACLES["file_digests"] = """WITH t AS (SELECT p_brand AS brand, string_agg(concat(p_partkey, ':', p_name, chr(10)), '' ORDER BY p_partkey) AS content FROM part GROUP BY 1)
SELECT brand, strlen(content)::BIGINT AS n_bytes, sha256(content) AS fingerprint FROM t"""

SHIFTED = NUMBERS.replace("WITH e AS (SELECT ts,", "WITH e0 AS (SELECT ts,", 1).replace(
    " FROM events),",
    """ FROM events), e AS (SELECT ts, CASE WHEN day(ts) >= 20 THEN value * 2 + 50 ELSE value END AS value, CASE WHEN day(ts) >= 25 THEN k + 1000 ELSE k END AS k,
  hour, CASE WHEN day(ts) >= 20 THEN "user" + 100000 ELSE "user" END AS "user" FROM e0),""",
    1,
)
ORACLES["retrain_trigger"] = f"""{SHIFTED}, s AS (SELECT w, count_if({ks_p()} < 0.05::DOUBLE) / count(*)::DOUBLE AS share,
  string_agg(CASE WHEN {ks_p()} < 0.05::DOUBLE THEN feature END, ',' ORDER BY feature) AS drifted FROM d GROUP BY w)
SELECT 'events' AS scenario, strftime(w, '%Y-%m-%d') AS window_start, share AS drift_share, drifted AS drifted_columns,
  'drift above the acceptable share' AS reason, 'PENDING' AS status, false AS auto_trigger
FROM s WHERE share > 0.5 AND w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
