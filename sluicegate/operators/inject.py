"""Deterministic fault and drift injection.

Whether a cell is hit depends only on the row's key, the fault and the seed, so results do not
change with partitioning, retries or the order scenarios are built in. Ratios are probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.hashing import drawn_below, row_text, standard_normal, uniform

KEY = "__row_key"
COPY = "__copy"


def with_row_key(df: DataFrame, float_scale: int | None = None) -> DataFrame:
    """The key is a digest of the row. Give a key column instead where equal rows must differ."""
    return df.withColumn(KEY, F.md5(row_text(df, float_scale=float_scale)))


def _copy_key(copy: str = f"cast({COPY} AS string)") -> str:
    """SQL for the key of one copy of a row."""
    return f"concat_ws('~', {KEY}, {copy})"


@dataclass(frozen=True)
class Step:
    """One change of one column. ``own`` steps draw per copy of a row, the others per row or not at all."""

    kind: str
    amount: float = 0.0
    own: bool = True


def fault_steps(column: str, faults: dict, null_share: float = 0.0) -> list[Step]:
    """What the faults do to a column, in order."""
    steps = []
    if column in contract.FAULT_COLUMNS and faults.get("missing_ratio", 0.0) > 0:
        steps.append(Step("missing", faults["missing_ratio"] / len(contract.FAULT_COLUMNS), own=False))
    for kind, target in (("negative_price", "price"), ("negative_inventory", "inventory_level"), ("invalid_category", "product_category")):
        if column == target and faults.get(f"{kind}_ratio", 0.0) > 0:
            steps.append(Step(kind, faults[f"{kind}_ratio"]))
    if column == contract.DATE and faults.get("impossible_dates", False):
        steps.append(Step("null_date", null_share))
    return steps


def drift_steps(column: str, drift: dict, promotion_share: float = 0.0) -> list[Step]:
    """What the drift does to a column."""
    factor, concept = drift.get("price_shift_factor", 1.0), drift.get("concept_drift_factor", 1.0)
    if column in ("price", "competitor_price") and factor != 1.0:
        return [Step("factor", factor, own=False)]
    if column == "promotion_flag" and drift.get("promotion_frequency_boost", 0.0) > 0:
        return [Step("promotion", promotion_share)]
    if column == "product_category" and drift.get("category_mix_shift", False):
        return [Step("mix")]
    if column == "temperature" and drift.get("temperature_shift", 0.0) != 0.0:
        return [Step("shift", drift["temperature_shift"], own=False)]
    if column == contract.TARGET and concept != 1.0:
        return [Step("concept", concept)]
    return []


def _stepped(column: str, steps: list[Step], seed: int, own: str) -> Column:
    """The column's value after its steps; ``own`` is SQL for the copy's key."""
    value = F.col(column)
    for step in steps:
        amount = step.amount
        if step.kind == "missing":
            value = F.when(drawn_below(KEY, f"missing:{column}", seed, amount), F.lit(None)).otherwise(value)
        elif step.kind == "negative_price":
            drawn = -(1.0 + 99.0 * uniform(own, "price:value", seed))
            value = F.when(drawn_below(own, "price", seed, amount), drawn).otherwise(value)
        elif step.kind == "negative_inventory":
            drawn = -(1.0 + F.floor(48.999999 * uniform(own, "inventory:value", seed)).cast("double"))
            value = F.when(drawn_below(own, "inventory", seed, amount), drawn).otherwise(value)
        elif step.kind == "invalid_category":
            value = F.when(drawn_below(own, "category", seed, amount), F.lit(contract.INVALID_CATEGORY)).otherwise(value)
        elif step.kind == "null_date":
            value = F.when(drawn_below(own, "date", seed, amount), F.lit(None).cast("timestamp")).otherwise(value)
        elif step.kind == "factor":
            value = value * F.lit(amount)
        elif step.kind == "shift":
            value = value + F.lit(amount)
        elif step.kind == "promotion":
            value = F.when((value == 0) & drawn_below(own, "promotion", seed, amount), F.lit(1)).otherwise(value)
        elif step.kind == "mix":
            drawn = drawn_below(own, "mix", seed, 0.3)
            value = F.when((value == "Clothing") & drawn, "Electronics").when((value == "Sports") & drawn, "Food").otherwise(value)
        elif step.kind == "concept":
            spread = contract.CONCEPT_NOISE_STD * (amount - 1.0)
            changed = value * F.lit(amount) + F.lit(spread) * standard_normal(own, "concept", seed)
            value = F.when(value.isNotNull(), F.greatest(F.lit(0.0), changed))
    return value


def _with_steps(df: DataFrame, steps: dict[str, list[Step]], seed: int) -> DataFrame:
    changed = {c: _stepped(c, found, seed, _copy_key()) for c, found in steps.items() if found}
    return df.withColumns(changed) if changed else df


def _null_share(n_rows: int) -> float:
    wanted = min(contract.MAX_NULL_DATES, n_rows // contract.NULL_DATE_DIVISOR)
    return wanted / n_rows if n_rows else 0.0


def _promotion_share(boost: float, n_rows: int, plain: int) -> float:
    return min(1.0, boost * n_rows / plain) if plain else 0.0


def inject_faults(
    keyed: DataFrame, faults: dict, seed: int = contract.DEFAULT_SEED, n_rows: int | None = None
) -> DataFrame:
    """Missing cells, appended copies, negative prices and stock, unknown categories, null dates.

    ``keyed`` carries KEY; the result also carries COPY (1 on appended rows). Faults after the
    copies are drawn per copy. ``n_rows`` (of ``keyed``) is only needed for null dates, and is counted
    if absent.
    """
    copies = faults.get("duplicate_ratio", 0.0)
    if copies > 0:
        # One pass: a picked row leaves as copies 0 and 1.
        picked = drawn_below(KEY, "duplicate", seed, copies)
        out = keyed.withColumn(COPY, F.explode(F.when(picked, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    else:
        out = keyed.withColumn(COPY, F.lit(0))
    share = 0.0
    if faults.get("impossible_dates", False):
        share = _null_share(keyed.count() if n_rows is None else n_rows)
    return _with_steps(out, {c: fault_steps(c, faults, share) for c in keyed.columns}, seed)


def inject_drift(faulty: DataFrame, drift: dict, seed: int = contract.DEFAULT_SEED) -> DataFrame:
    """Price factor, more promotions, category mix, warmer weather, changed demand."""
    share, boost = 0.0, drift.get("promotion_frequency_boost", 0.0)
    if boost > 0:
        share = _promotion_share(boost, *faulty.agg(F.count(F.lit(1)), F.count_if(F.col("promotion_flag") == 0)).first())
    return _with_steps(faulty, {c: drift_steps(c, drift, share) for c in faulty.columns}, seed)


def _picked(settings: dict, seed: int) -> Column | None:
    copies = settings["faults"].get("duplicate_ratio", 0.0)
    return drawn_below(KEY, "duplicate", seed, copies) if copies > 0 else None


def scenario_cells(
    df: DataFrame, numeric: list[str], categorical: list[str], scenarios: dict, sides: dict[str, str], seed: int = contract.DEFAULT_SEED, float_scale: int | None = None
) -> DataFrame:
    """The values that every row takes under each scenario, from one pass over ``df``.

    (feature, number, category, one count per scenario under its name in ``sides``). A row gives one cell per feature
    and distinct way to its value, so that scenarios which leave a column alone share a cell; the counts tell how
    many copies of the row have that value under each. The cells equal those of :func:`apply_scenario` on each scenario.
    Scenarios that add promotions need two totals of the table first, which are one aggregation for all of them.
    """
    keyed = with_row_key(df, float_scale)
    boosted = {name: s["drift"]["promotion_frequency_boost"] for name, s in scenarios.items() if s["drift"].get("promotion_frequency_boost", 0.0) > 0}
    shares: dict[str, float] = {}
    if boosted and "promotion_flag" in df.columns:
        totals = []
        for name in boosted:
            picked = _picked(scenarios[name], seed)
            copies = F.lit(1) if picked is None else 1 + picked.cast("int")
            totals += [F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.sum(F.when(F.col("promotion_flag") == 0, copies)), F.lit(0))]
        found = keyed.agg(*[t.alias(f"t{i}") for i, t in enumerate(totals)]).first()
        shares = {name: _promotion_share(boosted[name], found[2 * i], found[2 * i + 1]) for i, name in enumerate(boosted)}
    cells = []
    for feature in [*numeric, *categorical]:
        # Ways to a value: its steps, and the copy where they draw per copy. Each has a number of rows per scenario.
        ways: dict[tuple, dict[str, list[Column]]] = {}
        for name, settings in scenarios.items():
            steps = tuple(fault_steps(feature, settings["faults"]) + drift_steps(feature, settings["drift"], shares.get(name, 0.0)))
            apart = any(s.own for s in steps)
            picked = _picked(settings, seed)
            for copy, present in ((0, F.lit(1)), (1, None if picked is None else picked.cast("int"))):
                if present is not None:
                    ways.setdefault((steps, copy if apart else 0), {}).setdefault(name, []).append(present)
        for (steps, copy), rows in ways.items():
            value = _stepped(feature, list(steps), seed, _copy_key(f"'{copy}'"))
            counts = [sum(rows[name][1:], rows[name][0]) if name in rows else F.lit(0) for name in scenarios]
            cells.append(_cell(feature, value, feature in numeric, {sides[n]: c for n, c in zip(scenarios, counts, strict=True)}))
    return present_cells(keyed.select(F.inline(F.array(*cells))))


def _cell(feature: str, value: Column, is_number: bool, counts: dict[str, Column]) -> Column:
    number, text = value.cast("double"), value.cast("string")
    nothing = F.lit(None)
    return F.struct(
        F.lit(feature).alias("feature"),
        (F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number) if is_number else nothing.cast("double")).alias("number"),
        (nothing.cast("string") if is_number else text).alias("category"),
        *[c.cast("long").alias(name) for name, c in counts.items()],
    )


def plain_cells(df: DataFrame, numeric: list[str], categorical: list[str], counts: dict[str, int]) -> DataFrame:
    """The values of a table as they are, in the form of :func:`scenario_cells`."""
    cells = [_cell(c, F.col(f"`{c}`"), c in numeric, {n: F.lit(k) for n, k in counts.items()}) for c in [*numeric, *categorical]]
    return present_cells(df.select(F.inline(F.array(*cells))))


def present_cells(cells: DataFrame) -> DataFrame:
    """Without cells that hold no value: nulls, and numbers that are not finite."""
    return cells.where(F.col("number").isNotNull() | F.col("category").isNotNull())


def apply_scenario(
    df: DataFrame,
    scenario: str | dict,
    seed: int = contract.DEFAULT_SEED,
    float_scale: int | None = None,
    keep_keys: bool = False,
    n_rows: int | None = None,
) -> DataFrame:
    """Faults first, then drift, as the named (or given) scenario says."""
    settings = contract.SCENARIOS[scenario] if isinstance(scenario, str) else scenario
    columns = df.columns
    keyed = with_row_key(df, float_scale)
    out = inject_drift(inject_faults(keyed, settings["faults"], seed, n_rows), settings["drift"], seed)
    return out if keep_keys else out.select(*columns)
