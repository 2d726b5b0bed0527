"""Pieces of oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from sluicegate import contract

SCALE = 6
COLUMNS = contract.SALES_COLUMNS
KINDS = {f.name: f.dataType.simpleString() for f in contract.SALES_SCHEMA}

SALES = """sales AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS date,
    concat('store_', lpad(cast(l_suppkey % 20 AS varchar), 3, '0')) AS store_id,
    CASE p_type WHEN 'PROMO' THEN 'Electronics' WHEN 'MEDIUM' THEN 'Clothing' WHEN 'ECONOMY' THEN 'Food'
      WHEN 'SMALL' THEN 'Sports' ELSE 'Home' END AS product_category,
    CASE WHEN l_discount >= 0.08::DOUBLE THEN 1 ELSE 0 END AS promotion_flag,
    p_retailprice AS price,
    cast((l_orderkey*7 + l_partkey*13 + l_linenumber*31) % 500 AS double) AS inventory_level,
    p_retailprice * (1 - l_discount) * (1 + l_tax) AS competitor_price,
    15 + 15*sin(2*pi()*dayofyear(l_shipdate)/365) + (l_quantity - 25.5::DOUBLE)/5 AS temperature,
    cast(isodow(l_shipdate) - 1 AS integer) AS day_of_week,
    cast(month(l_shipdate) AS integer) AS month,
    l_quantity*l_linenumber AS previous_day_sales,
    greatest(0.0::DOUBLE, 100 + 30*(CASE WHEN l_discount >= 0.08::DOUBLE THEN 1 ELSE 0 END)
      + (l_quantity - 25.5::DOUBLE) + 0.1::DOUBLE*(l_quantity*l_linenumber)) AS sales_demand
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cell(column: str, kind: str) -> str:
    if kind == "double":
        return f"cast(cast(floor({column}*1e{SCALE}::DOUBLE + 0.5::DOUBLE) AS bigint) AS varchar)"
    if kind == "timestamp":
        return f"cast(epoch_us({column}) AS varchar)"
    return f"cast({column} AS varchar)"


def row_text(kinds: dict[str, str]) -> str:
    cells = []
    for name in sorted(kinds):
        text = cell(name, kinds[name])
        tag = f"length({text}), ':', " if kinds[name] == "string" else ""
        cells.append(f"CASE WHEN {name} IS NULL THEN '{name}:~' ELSE concat('{name}:', {tag}{text}) END")
    return "concat_ws('|', " + ", ".join(cells) + ")"


SALES_TEXT = row_text(KINDS)


def lane(digest: str, i: int) -> str:
    return f"cast(concat('0x', substr({digest}, {15 * i + 1}, 15)) AS bigint)"


def fingerprint_of(digest: str) -> str:
    sums = ", ".join(f"cast(coalesce(sum({lane(digest, i)}), 0) AS varchar)" for i in range(4))
    return f"sha256(concat_ws('~', cast(count(*) AS varchar), {sums}))"


def uniform(key: str, salt: str, seed: int = contract.DEFAULT_SEED) -> str:
    hexed = f"substr(md5(concat_ws('~', {key}, '{salt}', '{seed}')), 1, 15)"
    return f"((cast(concat('0x', {hexed}) AS bigint) + 1.0::DOUBLE) / 1152921504606846976.0::DOUBLE)"


def normal(key: str, salt: str) -> str:
    return f"(sqrt(-2.0::DOUBLE*ln({uniform(key, salt + ':r')})) * cos(2.0::DOUBLE*pi()*{uniform(key, salt + ':a')}))"


def scenario(name: str, source: str = "sales", settings: dict | None = None) -> str:
    """CTEs ending in one called ``<name>``: ``source`` with the scenario's faults and drift."""
    settings = settings or contract.SCENARIOS[name]
    faults, drift = settings["faults"], settings["drift"]
    own = "concat_ws('~', row_key, cast(copy_no AS varchar))"
    steps = [f"{name}_k AS (SELECT *, md5({SALES_TEXT}) AS row_key FROM {source})"]
    at = f"{name}_k"
    if faults.get("missing_ratio"):
        share = repr(faults["missing_ratio"] / 3)
        changed = ", ".join(
            f"CASE WHEN {uniform('row_key', 'missing:' + c)} < {share}::DOUBLE THEN NULL ELSE {c} END AS {c}"
            for c in ("price", "inventory_level", "previous_day_sales")
        )
        steps.append(f"{name}_m AS (SELECT * REPLACE ({changed}) FROM {at})")
        at = f"{name}_m"
    copies = ""
    if faults.get("duplicate_ratio"):
        copies = (
            f" UNION ALL SELECT *, 1 AS copy_no FROM {at} "
            f"WHERE {uniform('row_key', 'duplicate')} < {faults['duplicate_ratio']}::DOUBLE"
        )
    steps.append(f"{name}_c AS (SELECT *, 0 AS copy_no FROM {at}{copies})")
    at = f"{name}_c"
    changed = []
    if faults.get("negative_price_ratio"):
        changed.append(
            f"CASE WHEN {uniform(own, 'price')} < {faults['negative_price_ratio']}::DOUBLE "
            f"THEN -(1.0::DOUBLE + 99.0::DOUBLE*{uniform(own, 'price:value')}) ELSE price END AS price"
        )
    if faults.get("negative_inventory_ratio"):
        changed.append(
            f"CASE WHEN {uniform(own, 'inventory')} < {faults['negative_inventory_ratio']}::DOUBLE "
            f"THEN -(1.0::DOUBLE + floor(48.999999::DOUBLE*{uniform(own, 'inventory:value')})) "
            "ELSE inventory_level END AS inventory_level"
        )
    if faults.get("invalid_category_ratio"):
        changed.append(
            f"CASE WHEN {uniform(own, 'category')} < {faults['invalid_category_ratio']}::DOUBLE "
            "THEN 'INVALID_CATEGORY_XYZ' ELSE product_category END AS product_category"
        )
    if faults.get("impossible_dates"):
        n = f"(SELECT count(*) FROM {source})"
        changed.append(
            f"CASE WHEN {uniform(own, 'date')} < least(50, {n}//20)::DOUBLE / {n} THEN NULL ELSE date END AS date"
        )
    if changed:
        steps.append(f"{name}_f AS (SELECT * REPLACE ({', '.join(changed)}) FROM {at})")
        at = f"{name}_f"
    changed = []
    if drift.get("price_shift_factor", 1.0) != 1.0:
        f = drift["price_shift_factor"]
        changed += [f"price * {f}::DOUBLE AS price", f"competitor_price * {f}::DOUBLE AS competitor_price"]
    if drift.get("promotion_frequency_boost"):
        b = drift["promotion_frequency_boost"]
        share = f"(SELECT least(1.0::DOUBLE, {b}::DOUBLE * count(*) / count_if(promotion_flag = 0)) FROM {at})"
        changed.append(
            f"CASE WHEN promotion_flag = 0 AND {uniform(own, 'promotion')} < {share} THEN 1 "
            "ELSE promotion_flag END AS promotion_flag"
        )
    if drift.get("category_mix_shift"):
        drawn = f"{uniform(own, 'mix')} < 0.3::DOUBLE"
        changed.append(
            f"CASE WHEN product_category = 'Clothing' AND {drawn} THEN 'Electronics' "
            f"WHEN product_category = 'Sports' AND {drawn} THEN 'Food' ELSE product_category END AS product_category"
        )
    if drift.get("temperature_shift"):
        changed.append(f"temperature + {drift['temperature_shift']}::DOUBLE AS temperature")
    if drift.get("concept_drift_factor", 1.0) != 1.0:
        f = drift["concept_drift_factor"]
        spread = repr(20.0 * (f - 1.0))
        changed.append(
            f"greatest(0.0::DOUBLE, sales_demand * {f}::DOUBLE + {spread}::DOUBLE * {normal(own, 'concept')}) AS sales_demand"
        )
    body = f"* REPLACE ({', '.join(changed)})" if changed else "*"
    steps.append(f"{name} AS (SELECT {body} FROM {at})")
    return ",\n".join(steps)


def unpivot(source: str, columns: list[str], extra: str = "") -> str:
    """UNION ALL of (extra, feature, value) with NULLs dropped."""
    lead = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS feature, cast({c} AS double) AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )
