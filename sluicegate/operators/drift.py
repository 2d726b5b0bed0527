"""Two-sample drift tests per column, their summary, and the decision drawn from it.

Both tables are brought to counts per (feature, value). Equal values are counted together before
any shuffle, so a value that holds a third of all rows is one row per task. Numeric tests then read
exact cumulative shares from bucketed prefix sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate import contract
from sluicegate.functions.tails import chi_square_p, kolmogorov_p, two_sided_normal_p
from sluicegate.operators.inject import plain_cells, scenario_cells
from sluicegate.operators.ordered import fit_cuts, prefix_sums, with_buckets
from sluicegate.session import settle

MIN_NORM = 0.001
SCORE_COLUMNS = ["feature", "kind", "test", "score", "p_value", "drifted"]


def common_features(reference: DataFrame, current: DataFrame, features: list[str] | None = None) -> list[str]:
    """Columns both tables have, without date and target, in name order (or as listed)."""
    shared = set(reference.columns) & set(current.columns) - {contract.DATE, contract.TARGET}
    return sorted(shared) if features is None else [f for f in features if f in shared]


def _drifted(found: Column) -> Column:
    """A column that has values on one side only has no score, and has drifted."""
    return F.coalesce(found, F.lit(True))


def counted_cells(cells: DataFrame, sides: list[str]) -> DataFrame:
    """(feature, number, category, sides...): equal cells counted together before the shuffle, and stored."""
    return settle(cells.groupBy("feature", "number", "category").agg(*[F.sum(s).alias(s) for s in sides]))


def _two_sides(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    parts = [plain_cells(df, numeric, categorical, {"n_ref": 1 - i, "n_cur": i}) for i, df in enumerate((reference, current))]
    return parts[0].unionByName(parts[1])


def _per_side(counts: DataFrame, sides: dict[str, str], *values: str) -> DataFrame:
    """(scenario, feature, values..., n_ref, n_cur): a row per side that has any of the counts."""
    told = [F.struct(F.lit(name).alias("scenario"), F.col(c).alias("n_cur")) for name, c in sides.items()]
    long = counts.select("feature", *values, "n_ref", F.inline(F.array(*told)))
    return long.where((F.col("n_ref") > 0) | (F.col("n_cur") > 0))


def distances_of(counts: DataFrame, sides: dict[str, str]) -> DataFrame:
    """(scenario, feature, n_ref, n_cur, ks, wasserstein) from (feature, value, n_ref, sides...).

    ``sides`` maps scenarios to their count columns. The prefix sums of all of them are one pass over the same
    ranks: where a scenario has no row, neither of its functions moves.
    """
    cuts = fit_cuts(counts)
    columns = ["n_ref", *sides.values()]
    ranked = prefix_sums(with_buckets(counts, cuts), ["feature"], "value", columns)
    share = {w: F.try_divide(F.col(f"before_{w}") + F.col(w), F.col(f"total_{w}")) for w in columns}
    middle = cuts.select("feature", F.element_at("cuts", F.greatest(F.lit(1), (F.size("cuts") / 2).cast("int"))).alias("centre"))
    away = F.col("value") - F.col("centre")
    found = []
    for i, column in enumerate(sides.values()):
        gap = F.abs(share["n_ref"] - share[column])
        found += [F.max(f"total_{column}").alias(f"size_{i}"), F.max(gap).alias(f"ks_{i}")]
        found.append(F.sum(gap * (F.col("next_order") - F.col("value"))).alias(f"area_{i}"))
    # The variance is taken around a central value, so large offsets do not cancel.
    per_feature = (
        ranked.join(F.broadcast(middle), "feature")
        .groupBy("feature")
        .agg(
            F.max("total_n_ref").alias("n_ref"),
            F.try_divide(F.sum(F.col("n_ref") * away), F.max("total_n_ref")).alias("m1"),
            F.try_divide(F.sum(F.col("n_ref") * away * away), F.max("total_n_ref")).alias("m2"),
            *found,
        )
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("m1") * F.col("m1")))
    told = [
        F.struct(F.lit(name).alias("scenario"), F.col(f"size_{i}").alias("n_cur"), F.col(f"ks_{i}").alias("ks"), F.col(f"area_{i}").alias("area"))
        for i, name in enumerate(sides)
    ]
    long = per_feature.select("feature", "n_ref", spread.alias("spread"), F.inline(F.array(*told)))
    both = (F.col("n_ref") > 0) & (F.col("n_cur") > 0)
    distance = F.when(both, F.coalesce("area", F.lit(0.0)) / F.greatest("spread", F.lit(MIN_NORM)))
    some = long.where((F.col("n_ref") > 0) | (F.col("n_cur") > 0))
    return some.select("scenario", "feature", "n_ref", "n_cur", F.when(both, F.col("ks")).alias("ks"), distance.alias("wasserstein"))


def numeric_distances(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_ref, n_cur, ks, wasserstein): exact KS distance, and Wasserstein-1 divided by the
    reference's standard deviation. Both are NULL where only one side has values; values that are not finite
    count as missing."""
    columns = common_features(reference, current, features)
    counts = counted_cells(_two_sides(reference, current, columns, []), ["n_ref", "n_cur"])
    return distances_of(counts.withColumnRenamed("number", "value"), {"current": "n_cur"}).drop("scenario")


def _keys(df: DataFrame) -> list[str]:
    """``scenario`` where the table has one, and the feature."""
    return [c for c in ("scenario", "feature") if c in df.columns]


def ks_test(distances: DataFrame, alpha: float = contract.SIGNIFICANCE) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov from :func:`numeric_distances` or :func:`distances_of`."""
    p = F.when(F.col("ks").isNotNull(), kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
    scored = distances.withColumn("p_value", p)
    return scored.select(
        *_keys(distances),
        F.lit("numerical").alias("kind"),
        F.lit("ks").alias("test"),
        F.col("ks").alias("score"),
        "p_value",
        _drifted(F.col("p_value") < alpha).alias("drifted"),
    )


def wasserstein_test(distances: DataFrame, threshold: float = contract.DISTANCE_THRESHOLD) -> DataFrame:
    return distances.select(
        *_keys(distances),
        F.lit("numerical").alias("kind"),
        F.lit("wasserstein").alias("test"),
        F.col("wasserstein").alias("score"),
        F.lit(None).cast("double").alias("p_value"),
        _drifted(F.col("wasserstein") >= threshold).alias("drifted"),
    )


def category_counts(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, category, n_ref, n_cur), NULLs dropped."""
    columns = common_features(reference, current, features)
    cells = _two_sides(reference, current, [], columns)
    return cells.groupBy("feature", "category").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def _with_totals(counts: DataFrame) -> DataFrame:
    keys = _keys(counts)
    totals = counts.groupBy(*keys).agg(
        F.sum("n_ref").alias("total_ref"), F.sum("n_cur").alias("total_cur"), F.count(F.lit(1)).alias("k")
    )
    # One row per feature and scenario.
    return counts.join(F.broadcast(totals), keys)


def _both_sides() -> Column:
    return (F.max("total_ref") > 0) & (F.max("total_cur") > 0)


def chi_square_test(counts: DataFrame, alpha: float = contract.SIGNIFICANCE) -> DataFrame:
    """Current counts against the reference's shares. A category the reference lacks is drift."""
    expected = F.try_divide(F.col("total_cur") * F.col("n_ref"), F.col("total_ref"))
    part = F.when(expected > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected)
    one = (
        _with_totals(counts)
        .groupBy(*_keys(counts))
        .agg(
            F.when(_both_sides(), F.coalesce(F.sum(part), F.lit(0.0))).alias("score"),
            (F.max("k") - 1).alias("df"),
            F.bool_or((F.col("n_ref") == 0) & (F.col("n_cur") > 0)).alias("unseen"),
        )
    )
    seen = F.when(F.col("unseen"), F.lit(0.0)).otherwise(chi_square_p(F.col("score"), F.col("df")))
    p = F.when(F.col("score").isNotNull(), seen)
    return one.withColumn("p_value", p).select(
        *_keys(counts),
        F.lit("categorical").alias("kind"),
        F.lit("chisquare").alias("test"),
        "score",
        "p_value",
        _drifted(F.col("p_value") < alpha).alias("drifted"),
        "df",
    )


def jensen_shannon_test(counts: DataFrame, threshold: float = contract.DISTANCE_THRESHOLD) -> DataFrame:
    """Jensen-Shannon distance (base 2) of the category shares."""
    r = F.try_divide(F.col("n_ref").cast("double"), F.col("total_ref"))
    c = F.try_divide(F.col("n_cur").cast("double"), F.col("total_cur"))
    half = (r + c) / 2

    def part(x):
        return F.when(x > 0, x * F.log2(x / half)).otherwise(F.lit(0.0))

    js2 = F.when(_both_sides(), F.sum(part(r)) / 2 + F.sum(part(c)) / 2)
    one = _with_totals(counts).groupBy(*_keys(counts)).agg(js2.alias("js2"))
    score = F.when(F.col("js2").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("js2"))))
    return one.select(
        *_keys(counts),
        F.lit("categorical").alias("kind"),
        F.lit("jensenshannon").alias("test"),
        score.alias("score"),
        F.lit(None).cast("double").alias("p_value"),
        _drifted(score >= threshold).alias("drifted"),
    )


def proportion_test(
    reference: DataFrame, current: DataFrame, features: list[str], alpha: float = contract.SIGNIFICANCE
) -> DataFrame:
    """Pooled two-proportion z-test for 0/1 columns."""
    columns = common_features(reference, current, features)
    return proportions_of(_two_sides(reference, current, columns, []).withColumnRenamed("number", "value"), alpha)


def proportions_of(counts: DataFrame, alpha: float = contract.SIGNIFICANCE) -> DataFrame:
    """The z-test from (scenario, feature, value, n_ref, n_cur), the first being optional."""
    one = counts.groupBy(*_keys(counts)).agg(
        F.sum("n_ref").alias("n"),
        F.sum("n_cur").alias("m"),
        F.sum(F.col("n_ref") * F.col("value")).alias("x"),
        F.sum(F.col("n_cur") * F.col("value")).alias("y"),
    )
    pooled = F.try_divide(F.col("x") + F.col("y"), F.col("n") + F.col("m"))
    shares = F.try_divide("x", "n"), F.try_divide("y", "m")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "n") + F.try_divide(F.lit(1), "m")))
    z = F.coalesce(F.try_divide(shares[0] - shares[1], error), F.lit(0.0))
    both = (F.col("n") > 0) & (F.col("m") > 0)
    scored = one.withColumn("score", F.when(both, z))
    return scored.withColumn("p_value", F.when(both, two_sided_normal_p(F.col("score")))).select(
        *_keys(counts),
        F.lit("binary").alias("kind"),
        F.lit("z").alias("test"),
        "score",
        "p_value",
        _drifted(F.col("p_value") < alpha).alias("drifted"),
    )


def _listed(scored: DataFrame, scenarios: list[str], features: list[str], kind: str, test: str) -> DataFrame:
    """A row for every scenario and feature: one without a value on either side has no score and has not drifted."""
    pairs = [(s, f) for s in scenarios for f in features]
    names = scored.sparkSession.createDataFrame(pairs, "scenario string, feature string")
    found = scored.select("scenario", *SCORE_COLUMNS)
    return names.join(found, ["scenario", "feature"], "left").select(
        "scenario",
        "feature",
        F.lit(kind).alias("kind"),
        F.lit(test).alias("test"),
        "score",
        "p_value",
        F.coalesce("drifted", F.lit(False)).alias("drifted"),
    )


def drift_of_counts(
    counts: DataFrame, kinds: dict[str, list[str]], sides: dict[str, str], numerical_test: str = "ks", categorical_test: str = "chisquare"
) -> DataFrame:
    """(scenario, feature, kind, test, score, p_value, drifted) from one table of :func:`counted_cells`.

    ``kinds`` lists the features of each kind, ``sides`` the count column of each scenario.
    """
    own = lambda columns: counts.where(F.col("feature").isin(columns))
    parts = []
    if kinds.get("numerical"):
        distances = distances_of(own(kinds["numerical"]).withColumnRenamed("number", "value").drop("category"), sides)
        scored = {"ks": ks_test, "wasserstein": wasserstein_test}[numerical_test](distances)
        parts.append(_listed(scored, list(sides), kinds["numerical"], "numerical", numerical_test))
    if kinds.get("categorical"):
        test = {"chisquare": chi_square_test, "jensenshannon": jensen_shannon_test}[categorical_test]
        scored = test(_per_side(own(kinds["categorical"]), sides, "category"))
        parts.append(_listed(scored, list(sides), kinds["categorical"], "categorical", categorical_test))
    if kinds.get("binary"):
        scored = proportions_of(_per_side(own(kinds["binary"]).withColumnRenamed("number", "value"), sides, "value"))
        parts.append(_listed(scored, list(sides), kinds["binary"], "binary", "z"))
    return reduce(DataFrame.unionByName, parts)


def _common_kinds(reference: DataFrame, current: DataFrame, features: dict[str, list[str]] | None) -> dict[str, list[str]]:
    return {k: common_features(reference, current, v) for k, v in (features or contract.DRIFT_FEATURES).items()}


def _split_kinds(kinds: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    return [*kinds.get("numerical", []), *kinds.get("binary", [])], list(kinds.get("categorical", []))


def drift_by_column(
    reference: DataFrame,
    current: DataFrame,
    features: dict[str, list[str]] | None = None,
    numerical_test: str = "ks",
    categorical_test: str = "chisquare",
) -> DataFrame:
    """One row per feature: (feature, kind, test, score, p_value, drifted).

    Each side is read once, into one stored table of counts for all tests. A feature with values on one side only has
    no score and has drifted; one without any has not.
    """
    kinds = _common_kinds(reference, current, features)
    counts = counted_cells(_two_sides(reference, current, *_split_kinds(kinds)), ["n_ref", "n_cur"])
    return drift_of_counts(counts, kinds, {"current": "n_cur"}, numerical_test, categorical_test).drop("scenario")


def scenario_cell_table(
    reference: DataFrame, current: DataFrame, scenarios: dict, kinds: dict[str, list[str]], sides: dict[str, str], seed: int, float_scale: int | None
) -> DataFrame:
    """The cells of both tables, each read once: reference rows as they are, current rows under every scenario."""
    numeric, categorical = _split_kinds(kinds)
    old = plain_cells(reference, numeric, categorical, {"n_ref": 1, **dict.fromkeys(sides.values(), 0)})
    new = scenario_cells(current, numeric, categorical, scenarios, sides, seed, float_scale).withColumn("n_ref", F.lit(0).cast("long"))
    return old.unionByName(new)


def drift_by_scenario(
    reference: DataFrame,
    current: DataFrame,
    scenarios: dict,
    features: dict[str, list[str]] | None = None,
    seed: int = contract.DEFAULT_SEED,
    float_scale: int | None = None,
    numerical_test: str = "ks",
    categorical_test: str = "chisquare",
) -> DataFrame:
    """The rows of :func:`drift_by_column` for the current table under each scenario, with ``scenario``.

    All scenarios and tests share one counted table, whatever their number, so both tables are read once (and the
    current one once more for two totals where a scenario adds promotions).
    """
    kinds = _common_kinds(reference, current, features)
    sides = {name: f"n_{i}" for i, name in enumerate(scenarios)}
    cells = scenario_cell_table(reference, current, scenarios, kinds, sides, seed, float_scale)
    return drift_of_counts(counted_cells(cells, ["n_ref", *sides.values()]), kinds, sides, numerical_test, categorical_test)


def drift_summary(
    by_column: DataFrame, by: list[str] | None = None, dataset_share: float = contract.DATASET_DRIFT_SHARE
) -> DataFrame:
    """(by..., n_columns, n_drifted, drift_share, drifted_columns, dataset_drift); the columns are an array."""
    one = by_column.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if("drifted").alias("n_drifted"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_columns"),
    )
    share = F.coalesce(F.try_divide(F.col("n_drifted").cast("double"), F.col("n_columns")), F.lit(0.0))
    return one.select(
        *(by or []),
        "n_columns",
        "n_drifted",
        share.alias("drift_share"),
        "drifted_columns",
        (share >= dataset_share).alias("dataset_drift"),
    )


def drift_decision(
    summary: DataFrame,
    critical: list[str] | None = None,
    continue_max: float = contract.CONTINUE_MAX_SHARE,
    investigate_max: float = contract.INVESTIGATE_MAX_SHARE,
) -> DataFrame:
    """Add ``critical_drifted``, ``decision`` and its ``reason`` with the limits; both limits are inclusive."""
    listed = F.array(*[F.lit(c) for c in (contract.CRITICAL_FEATURES if critical is None else critical)])
    hit = F.array_sort(F.array_intersect("drifted_columns", listed.cast("array<string>")))
    share = F.col("drift_share")
    decision = (
        F.when((share <= continue_max) & (F.size("critical_drifted") == 0), "CONTINUE")
        .when(share <= investigate_max, "INVESTIGATE")
        .otherwise("RETRAIN_REQUIRED")
    )
    percent = F.format_number(share * 100, 1)
    reason = (
        F.when(F.col("decision") == "CONTINUE", F.concat(percent, F.lit(f"% of columns drifted, at most {continue_max:.0%}")))
        .when((share <= continue_max) & (F.size("critical_drifted") > 0), F.concat(F.lit("critical columns drifted: "), F.array_join("critical_drifted", ", ")))
        .when(F.col("decision") == "INVESTIGATE", F.concat(percent, F.lit(f"% of columns drifted, above {continue_max:.0%} and at most {investigate_max:.0%}")))
        .otherwise(F.concat(percent, F.lit(f"% of columns drifted, above {investigate_max:.0%}")))
    )
    return summary.withColumn("critical_drifted", hit).withColumn("decision", decision).withColumn("reason", reason)


def retrain_requests(decisions: DataFrame, keep: list[str], auto_trigger: bool = False) -> DataFrame:
    """Pending requests for the decisions that require retraining."""
    return decisions.where(F.col("decision") == "RETRAIN_REQUIRED").select(
        *keep,
        "drift_share",
        "drifted_columns",
        F.lit("drift above the acceptable share").alias("reason"),
        F.lit("PENDING").alias("status"),
        F.lit(auto_trigger).alias("auto_trigger"),
    )
