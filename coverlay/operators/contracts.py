"""Table contracts: what a layer must look like, checked in one pass.

Structure (columns, types) is checked on the schema alone.  Content is checked by counting
every kind of violation in a single pass, so one run reports all problems at once, with a few
offending values of each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from coverlay.functions.values import count_where, digits_only, unit_interval

MAX_EXAMPLES = 10


class ContractViolation(ValueError):
    """Raised with every violation found, not only the first."""


@dataclass(frozen=True)
class Check:
    name: str
    holds: Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """One column: accepted types (any if empty), nullability and content checks."""

    column: str
    types: tuple[str, ...] = ()
    nullable: bool = True
    required: bool = True
    checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...]
    strict: bool = False


def digits(column: str, length: int, nullable: bool = False) -> Rule:
    """Fixed-length digit key; must already be text, since a number has lost its zeros."""
    check = Check(f"{length} digits", lambda c: digits_only(c, length))
    return Rule(column, ("string",), nullable, checks=(check,))


def text(column: str, nullable: bool = True, length: int | None = None) -> Rule:
    checks = () if length is None else (Check(f"length {length}", lambda c: F.length(c) == length),)
    return Rule(column, ("string",), nullable, checks=checks)


def share(column: str, placeholder: float | None = None) -> Rule:
    label = "in [0, 1]" if placeholder is None else f"in [0, 1] or {placeholder}"
    return Rule(column, ("double",), checks=(Check(label, lambda c: unit_interval(c, placeholder)),))


def non_negative(column: str, nullable: bool = True) -> Rule:
    return Rule(column, (), nullable, checks=(Check(">= 0", lambda c: c >= 0),))


def present(column: str, required: bool = True) -> Rule:
    return Rule(column, required=required)


def structural_violations(df: DataFrame, contract: Contract) -> list[str]:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = []
    for rule in contract.rules:
        if rule.column not in fields:
            if rule.required:
                found.append(f"{rule.column}: column missing")
        elif rule.types and fields[rule.column] not in rule.types:
            found.append(f"{rule.column}: type {fields[rule.column]}, expected {'/'.join(rule.types)}")
    if contract.strict:
        known = {r.column for r in contract.rules}
        found += [f"{name}: unexpected column" for name in fields if name not in known]
    return found


def _content_checks(df: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    """(column, check, violated) for everything the present, rightly typed columns allow."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for rule in contract.rules:
        if rule.column not in fields or (rule.types and fields[rule.column] not in rule.types):
            continue
        value = F.col(f"`{rule.column}`")
        if not rule.nullable:
            out.append((rule.column, "not null", value.isNull()))
        out += [(rule.column, c.name, value.isNotNull() & ~c.holds(value)) for c in rule.checks]
    return out


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """``column_name, check_name, violations`` for every content check, from one aggregate."""
    checks = _content_checks(df, contract)
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(column).alias("column_name"),
                    F.lit(check).alias("check_name"),
                    count_where(bad).alias("violations"),
                )
                for column, check, bad in checks
            ]
        ).alias("rows")
    )
    return counts.select(F.inline("rows"))


def violations(df: DataFrame, contract: Contract, by: Sequence[str] = (), examples: int = MAX_EXAMPLES) -> DataFrame:
    """``*by, column_name, check_name, violations, examples`` of every content check that fails
    (of every check at all where ``by`` is empty), from one pass.

    ``examples`` are the smallest offending values as text, one for each row.  Only offending
    rows leave the scan, equal values are counted before they move, and of a check no task
    hands on more than the wanted number of values, however many rows fail.
    """
    checks = _content_checks(df, contract)
    names = [(i, column, check) for i, (column, check, _) in enumerate(checks)]
    known = df.sparkSession.createDataFrame(names, "check_no int, column_name string, check_name string")
    failed = [
        F.when(bad, F.struct(F.lit(i).alias("check_no"), F.col(f"`{column}`").cast("string").alias("value")))
        for i, (column, _, bad) in enumerate(checks)
    ] or [F.lit(None).cast("struct<check_no:int,value:string>")]
    rows = df.select(*by, F.inline(F.array_compact(F.array(*failed))))
    values = rows.groupBy(*by, "check_no", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = values.groupBy(*by, "check_no").agg(F.sum("n").alias("violations"))
    place = F.row_number().over(Window.partitionBy(*by, "check_no").orderBy("value"))
    first = values.filter(F.col("value").isNotNull()).withColumn("place", place).filter(F.col("place") <= examples)
    ordered = F.array_sort(F.collect_list(F.struct("value", "n")))
    each = F.flatten(F.transform(ordered, lambda v: F.array_repeat(v["value"], F.least(v["n"], F.lit(examples)).cast("int"))))
    shown = first.groupBy(*by, "check_no").agg(F.slice(each, 1, examples).alias("examples"))
    same = [totals[c].eqNullSafe(shown[c]) for c in [*by, "check_no"]]
    found = totals.join(shown, same, "left").select(*[totals[c] for c in [*by, "check_no"]], "violations", "examples")
    return known.join(found, "check_no", "inner" if by else "left").select(
        *by,
        "column_name",
        "check_name",
        F.coalesce("violations", F.lit(0)).cast("long").alias("violations"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


def described(violation: Column, column: Column, check: Column, examples: Column) -> Column:
    """One violation as a line of text."""
    seen = F.when(F.size(examples) > 0, F.concat(F.lit(", e.g. "), F.array_join(examples, ", "))).otherwise("")
    return F.concat(column, F.lit(": "), violation.cast("string"), F.lit(" rows fail '"), check, F.lit("'"), seen)


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """Return ``df`` unchanged or raise with all violations and a few examples of each."""
    problems = structural_violations(df, contract)
    if _content_checks(df, contract):
        failing = violations(df, contract).filter(F.col("violations") > 0)
        line = described(*[F.col(c) for c in ("violations", "column_name", "check_name", "examples")])
        # A row per check at most.
        problems += sorted(r[0] for r in failing.select(line).collect())
    if problems:
        raise ContractViolation(f"{contract.name}: " + "; ".join(problems))
    return df


def require_text_key(df: DataFrame, key: str) -> DataFrame:
    """A key column, where present, must be text; a number has already lost leading zeros."""
    for field in df.schema.fields:
        if field.name == key and not isinstance(field.dataType, StringType):
            raise ContractViolation(f"{key}: type {field.dataType.simpleString()}, expected string")
    return df


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractViolation(f"{what}: missing column(s) {missing}, found {df.columns}")
    return df


def require_complete(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """No NULL may remain in the named columns (a left join that found no partner)."""
    row = df.agg(*[count_where(F.col(c).isNull()).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        some = df.filter(F.col(next(iter(bad))).isNull()).select(key).limit(MAX_EXAMPLES).collect()
        raise ContractViolation(f"null after join: {bad}, e.g. {[r[0] for r in some]}")
    return df


def unique_on(df: DataFrame, key: str, side: str) -> DataFrame:
    """The same rows, failing at run time if a key repeats.

    The check rides on an aggregate by the join key, so it adds no shuffle to the join.
    """
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others) if others else F.lit(1)).alias("_row")
    )
    repeated = F.raise_error(F.concat(F.lit(f"one-to-one join on {key}: repeated on the {side}: "), F.col(key).cast("string")))
    checked = grouped.select(key, F.when(F.col("_n") == 1, F.col("_row")).otherwise(repeated).alias("_row"))
    return checked.select(key, "_row.*") if others else checked.filter(F.col("_row").isNotNull()).select(key)


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join that refuses repeated keys on either side instead of multiplying rows."""
    return unique_on(left, key, "left").join(unique_on(right, key, "right"), key, how).select(
        *left.columns, *[c for c in right.columns if c != key]
    )


# --- column roles ---------------------------------------------------------------------------

ROLE = "feature_role"


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Record each column's role in its schema metadata."""
    return df.select(
        *[F.col(f"`{c}`").alias(c, metadata={ROLE: roles[c]}) if c in roles else F.col(f"`{c}`") for c in df.columns]
    )


def select_allowed(df: DataFrame, columns: Sequence[str], role: str, keys: Sequence[str] = ()) -> DataFrame:
    """Project to columns carrying an allowed role; anything else is refused by name.

    Fail-closed: a column without a recorded role is refused too.
    """
    roles = {f.name: (f.metadata or {}).get(ROLE) for f in df.schema.fields}
    refused = sorted(c for c in columns if roles.get(c) != role)
    if refused:
        raise ContractViolation(f"columns not allowed with role {role!r}: {refused}")
    return df.select(*keys, *columns)


# --- expectations ---------------------------------------------------------------------------


def against_expected(
    measured: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float = 0.0
) -> DataFrame:
    """Measured next to expected values: difference and whether it is within tolerance."""
    joined = measured.join(expected.select(key, F.col("expected")), key, "full")
    gap = F.col(value).cast("double") - F.col("expected").cast("double")
    return joined.select(
        key,
        F.col(value).alias("measured"),
        "expected",
        gap.alias("difference"),
        F.coalesce(F.abs(gap) <= tolerance, F.lit(False)).alias("passed"),
    )
