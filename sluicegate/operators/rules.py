"""Declarative row rules. A rule compiles to one boolean column that is true on a violation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicegate import contract
from sluicegate.functions.hashing import literal, quoted

MISSING_COLUMN = "column_present"


@dataclass(frozen=True)
class Rule:
    """``holds`` is SQL over ``{v}``, the column converted to ``data_type``; NULLs are not asked."""

    column: str
    check: str
    data_type: str
    holds: str | None = None

    @property
    def name(self) -> str:
        return f"{self.column}:{self.check}"

    @property
    def violation(self) -> str:
        """The condition, as SQL, that is true on a violation and never NULL."""
        raw = quoted(self.column)
        value = f"try_cast({raw} AS {self.data_type})"
        if self.check == "not_null":
            return f"{raw} IS NULL"
        if self.holds is None:
            return f"({raw} IS NOT NULL AND {value} IS NULL)"
        return f"coalesce(NOT ({self.holds.format(v=value)}), false)"


def _literal(value) -> str:
    return literal(value) if isinstance(value, str) else repr(value)


def not_null(column: str) -> Rule:
    return Rule(column, "not_null", "string")


def has_type(column: str, data_type: str) -> Rule:
    return Rule(column, f"is_{data_type}", data_type)


def matches(column: str, pattern: str) -> Rule:
    text = _literal(pattern).replace("{", "{{").replace("}", "}}")
    return Rule(column, "matches", "string", "{v} RLIKE " + text)


def one_of(column: str, values: list, data_type: str = "string") -> Rule:
    listed = ", ".join(_literal(v) for v in values).replace("{", "{{").replace("}", "}}")
    return Rule(column, "one_of", data_type, "{v} IN (" + listed + ")")


def above(column: str, bound: float) -> Rule:
    return Rule(column, f"gt_{bound:g}", "double", f"{{v}} > {bound}")


def below(column: str, bound: float) -> Rule:
    return Rule(column, f"lt_{bound:g}", "double", f"{{v}} < {bound}")


def at_least(column: str, bound: float) -> Rule:
    return Rule(column, f"ge_{bound:g}", "double", f"{{v}} >= {bound}")


def within(column: str, low: float, high: float, data_type: str = "double") -> Rule:
    return Rule(column, f"in_{low:g}_{high:g}", data_type, f"{{v}} BETWEEN {low} AND {high}")


def sales_rules(allow_missing: bool = False) -> list[Rule]:
    """The rules of the canonical sales table."""
    always = ["date", "store_id", "product_category"]
    required = always if allow_missing else contract.SALES_COLUMNS
    typed = [has_type(f.name, f.dataType.simpleString()) for f in contract.SALES_SCHEMA if f.name not in always[1:]]
    return [
        *[not_null(c) for c in required],
        *typed,
        matches("store_id", contract.STORE_PATTERN),
        one_of("product_category", contract.CATEGORIES),
        one_of("promotion_flag", [0, 1], "int"),
        above("price", 0),
        below("price", 10000),
        at_least("inventory_level", 0),
        below("inventory_level", 10000),
        above("competitor_price", 0),
        within("temperature", -30, 50),
        within("day_of_week", 0, 6, "int"),
        within("month", 1, 12, "int"),
        at_least("previous_day_sales", 0),
        at_least("sales_demand", 0),
    ]


def request_rules() -> list[Rule]:
    """The rules of a scoring request: the features only, with the service's wider temperatures."""
    features = [f for f in contract.SALES_SCHEMA if f.name not in (contract.DATE, contract.TARGET)]
    typed = [has_type(f.name, f.dataType.simpleString()) for f in features if f.dataType != T.StringType()]
    return [
        *[not_null(f.name) for f in features],
        *typed,
        within("promotion_flag", 0, 1, "int"),
        above("price", 0),
        at_least("inventory_level", 0),
        above("competitor_price", 0),
        within("temperature", -50, 60),
        within("day_of_week", 0, 6, "int"),
        within("month", 1, 12, "int"),
        at_least("previous_day_sales", 0),
    ]


def _split_by_presence(df: DataFrame, rules: list[Rule]) -> tuple[list[Rule], list[str]]:
    present = [r for r in rules if r.column in df.columns]
    absent = sorted({r.column for r in rules} - set(df.columns))
    return present, absent


def count_expressions(df: DataFrame, rules: list[Rule]) -> list[Column]:
    """One counter per rule, for use inside any aggregation that scans ``df`` anyway."""
    present, _ = _split_by_presence(df, rules)
    return [F.expr(f"count_if({r.violation}) AS rule_{i}") for i, r in enumerate(present)]


def counts_to_rows(counted: DataFrame, df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """Turn the counters of :func:`count_expressions` (plus ``n_rows``) into one row per rule."""
    present, absent = _split_by_presence(df, rules)
    found = [(r.column, r.check, f"rule_{i}") for i, r in enumerate(present)]
    found += [(c, MISSING_COLUMN, "1L") for c in absent]
    rows = ", ".join(
        f"named_struct('rule', {literal(f'{c}:{k}')}, 'column_name', {literal(c)}, 'check_name', {literal(k)}, 'n_violations', {n})"
        for c, k, n in found
    )
    return counted.select(*keep, "n_rows", F.expr(f"inline(array({rows}))")).select(
        *keep,
        "rule",
        "column_name",
        "check_name",
        "n_violations",
        F.coalesce(F.try_divide(F.col("n_violations").cast("double"), F.col("n_rows")), F.lit(0.0)).alias("ratio"),
    )


def violation_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules in one scan and one aggregation: (rule, column_name, check_name, n_violations, ratio)."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *count_expressions(df, rules))
    return counts_to_rows(counted, df, rules, [])


def with_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``violations``: the names of the rules this row breaks, in rule order."""
    present, absent = _split_by_presence(df, rules)
    # Lists of one name or none: flatten is compiled, array_compact is not.
    checks = [f"CASE WHEN {r.violation} THEN array({literal(r.name)}) ELSE cast(array() AS array<string>) END" for r in present]
    checks += [f"array({literal(f'{c}:{MISSING_COLUMN}')})" for c in absent]
    listed = f"flatten(array({', '.join(checks)}))" if checks else "cast(array() AS array<string>)"
    return df.withColumn("violations", F.expr(listed))


def _evaluated(df: DataFrame) -> DataFrame:
    """The same rows, whose cells are evaluated once each: no later condition is moved below a generator, where it
    would repeat the expression of a column for every rule that reads it."""
    if not df.columns:
        return df
    return df.select(F.inline(F.array(F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]))))


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their ``violations``)."""
    judged = with_violations(_evaluated(df), rules)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def failure_cases(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """One row per broken rule and data row: key, rule, column_name, check_name, failure_case."""
    present, _ = _split_by_presence(df, rules)
    cases = ", ".join(
        f"CASE WHEN {r.violation} THEN named_struct('rule', {literal(r.name)}, 'column_name', {literal(r.column)}, "
        f"'check_name', {literal(r.check)}, 'failure_case', cast({quoted(r.column)} AS string)) END"
        for r in present
    )
    return df.select(*key, F.expr(f"inline(array_compact(array({cases})))"))


def first_cases(df: DataFrame, rules: list[Rule], key: list[str], n: int = contract.REPORTED_CASES) -> DataFrame:
    """The report's excerpt: the first ``n`` cases by rule, then key."""
    return failure_cases(df, rules, key).orderBy("rule", *key).limit(n)


def first_error(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """Fail-fast form: some one case, found without scanning on after it."""
    return failure_cases(df, rules, key).limit(1)
