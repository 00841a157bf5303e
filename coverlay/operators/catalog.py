"""Column catalogue: schema inventories compared, attributed, classified and joined.

These tables hold one row per column, so they are small; they are still plain DataFrame
joins because their inputs (profiles, row counts) come from large tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from coverlay.functions.values import one_of
from coverlay.operators.contracts import one_to_one, require_complete
from coverlay.operators.sets import union_scopes

INVENTORY_TYPE = "source_table string, column_name string, position int, dtype string"


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (table, column) from the schemas alone; no data is read."""
    rows = [
        (table, f.name, i, f.dataType.simpleString())
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, INVENTORY_TYPE)


def _leaves(name: str, dtype: DataType) -> list[tuple[str, str]]:
    """Every field below ``name`` that holds no further fields, with its type."""
    if isinstance(dtype, StructType):
        return [leaf for f in dtype.fields for leaf in _leaves(f"{name}.{f.name}", f.dataType)]
    if isinstance(dtype, ArrayType):
        return _leaves(f"{name}[]", dtype.elementType)
    if isinstance(dtype, MapType):
        return _leaves(f"{name}{{key}}", dtype.keyType) + _leaves(f"{name}{{value}}", dtype.valueType)
    return [(name, dtype.simpleString())]


def nested_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """As ``schema_rows``, one row per innermost field: ``a.b`` of a struct, ``a[]`` of an
    array, ``a{key}`` and ``a{value}`` of a map, so that nested differences can be compared."""
    rows = [
        (table, path, i, dtype)
        for table, df in tables.items()
        for i, (path, dtype) in enumerate(leaf for f in df.schema.fields for leaf in _leaves(f.name, f.dataType))
    ]
    return spark.createDataFrame(rows, INVENTORY_TYPE)


def schema_inventory(spark: SparkSession, tables: Mapping[str, DataFrame], errors: Mapping[str, str] | None = None) -> DataFrame:
    """Schema rows with each table's row count; an unreadable table keeps one error row."""
    counts = union_scopes(
        [df.agg(F.count(F.lit(1)).alias("table_rows")).select(F.lit(t).alias("source_table"), "table_rows") for t, df in tables.items()]
    )
    rows = schema_rows(spark, tables).join(counts, "source_table").withColumn("error_message", F.lit(""))
    if not errors:
        return rows
    failed = spark.createDataFrame(list(errors.items()), "source_table string, error_message string")
    return union_scopes([rows, failed])


def schema_risks(inventory: DataFrame, key: str = "GEOID", hints: Sequence[str] = ("geoid", "fips")) -> DataFrame:
    """Per table: repeated column names, a missing key, likely aliases, an unsafe key type.

    A table with repeated names is reported for that alone.
    """
    named = inventory.filter(F.col("column_name").isNotNull())
    per_name = named.groupBy("source_table", "column_name").agg(F.count(F.lit(1)).alias("n"), F.max("dtype").alias("dtype"))
    lowered = F.lower("column_name")
    alias = one_of([(lowered.contains(h), F.lit(True)) for h in hints], F.lit(False))
    is_key = F.col("column_name") == key
    facts = per_name.groupBy("source_table").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("column_name")))), ";").alias("repeated"),
        F.max(is_key).alias("has_key"),
        F.max(F.when(is_key, F.col("dtype"))).alias("key_dtype"),
        F.array_join(F.array_sort(F.collect_list(F.when(alias & ~is_key, F.col("column_name")))), ";").alias("aliases"),
    )
    finding = one_of(
        [
            (F.col("repeated") != "", F.lit("duplicate_column_names")),
            (~F.col("has_key"), F.lit("missing_key")),
            (F.col("key_dtype") != "string", F.lit("unsafe_key_dtype")),
        ],
        None,
    )
    detail = one_of(
        [
            (F.col("repeated") != "", F.col("repeated")),
            (~F.col("has_key"), F.col("aliases")),
            (F.col("key_dtype") != "string", F.col("key_dtype")),
        ],
        None,
    )
    return facts.select("source_table", finding.alias("finding"), detail.alias("detail")).filter(F.col("finding").isNotNull())


def compare_schemas(national: DataFrame, regional: DataFrame) -> DataFrame:
    """Column-by-column comparison: presence, types and positions on both sides."""
    left = national.select("column_name", F.col("dtype").alias("national_dtype"), F.col("position").alias("national_position"))
    right = regional.select("column_name", F.col("dtype").alias("region_dtype"), F.col("position").alias("region_position"))
    joined = left.join(right, "column_name", "full")
    in_both = F.col("national_dtype").isNotNull() & F.col("region_dtype").isNotNull()
    return joined.select(
        "column_name",
        F.col("national_dtype").isNotNull().alias("in_national"),
        F.col("region_dtype").isNotNull().alias("in_region"),
        "national_dtype",
        "region_dtype",
        F.when(in_both, F.col("national_dtype") == F.col("region_dtype")).alias("dtype_match"),
        "national_position",
        "region_position",
    )


def schema_verdict(national: DataFrame, regional: DataFrame) -> DataFrame:
    """One row from both sides' schema rows: counts of each difference, whether shared columns
    keep their order, verdict.

    Names that occur more than once are counted per side and left out of the other checks.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        first = [F.count(F.lit(1)).alias(f"{name}_times"), F.min("dtype").alias(f"{name}_dtype"), F.min("position").alias(f"{name}_position")]
        return rows.groupBy("column_name").agg(*first)

    times = side(national, "national").join(side(regional, "region"), "column_name", "full")
    left, right = F.coalesce("national_times", F.lit(0)), F.coalesce("region_times", F.lit(0))
    shared = (left == 1) & (right == 1)
    # One entry per column of a schema: the places fit one array.
    places = F.array_sort(F.collect_list(F.when(shared, F.struct("national_position", "region_position"))))["region_position"]
    found = times.agg(
        F.count_if((left == 1) & (right == 0)).alias("missing_in_region"),
        F.count_if((left == 0) & (right == 1)).alias("extra_in_region"),
        F.count_if(shared & (F.col("national_dtype") != F.col("region_dtype"))).alias("dtype_mismatches"),
        F.count_if(left > 1).alias("duplicates_in_national"),
        F.count_if(right > 1).alias("duplicates_in_region"),
        (places == F.array_sort(places)).alias("order_matches"),
    )
    differences = [c for c in found.columns if c != "order_matches"]
    return found.withColumn("columns_match", F.greatest(*differences) == 0)


def attribute_columns(
    joined: DataFrame,
    sources: DataFrame,
    backbone: Sequence[str],
    backbone_table: str,
    domains: DataFrame,
    column_domains: DataFrame,
) -> DataFrame:
    """Source table and domain of every column of a joined table.

    ``attribution_method`` is shared-backbone, unambiguous, AMBIGUOUS or NOT_FOUND.
    ``domains`` maps tables, ``column_domains`` overrides single (table, column) pairs.
    """
    owners = (
        sources.select("column_name", "source_table")
        .distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("source_table")), "|").alias("owners"))
    )
    is_backbone = F.col("column_name").isin(list(backbone))
    table = one_of([(is_backbone, F.lit(backbone_table)), (F.col("n").isNotNull(), F.col("owners"))], F.lit("<none>"))
    method = one_of(
        [
            (is_backbone, F.lit("shared-backbone")),
            (F.col("n") == 1, F.lit("unambiguous")),
            (F.col("n") > 1, F.lit("AMBIGUOUS")),
        ],
        F.lit("NOT_FOUND"),
    )
    found = joined.join(owners, "column_name", "left").select(
        "column_name", "dtype", "position", table.alias("source_table"), method.alias("attribution_method")
    )
    return (
        found.join(domains.select("source_table", F.col("domain").alias("_table")), "source_table", "left")
        .join(
            column_domains.select("source_table", "column_name", F.col("domain").alias("_column")),
            ["source_table", "column_name"],
            "left",
        )
        .select(
            "column_name",
            "dtype",
            "source_table",
            "attribution_method",
            F.coalesce("_column", "_table", F.lit("UNCLASSIFIED")).alias("domain"),
            "position",
        )
    )


def unresolved(attribution: DataFrame, valid_domains: Sequence[str]) -> DataFrame:
    """Columns whose source or domain still needs a human decision."""
    clean = F.col("attribution_method").isin("unambiguous", "shared-backbone") & F.col("domain").isin(list(valid_domains))
    return attribution.filter(~clean)


RULES_TYPE = "priority int, kind string, pattern string, label string"


def classify_first_match(columns: DataFrame, rules: DataFrame, default: str, name: str = "role") -> DataFrame:
    """Label from the first rule (lowest priority number) whose pattern fits the column name.

    ``kind`` is ``exact`` or ``suffix``.  Rules are data, so a new rule is a new row.
    """
    fits = ((F.col("kind") == "exact") & (F.col("column_name") == F.col("pattern"))) | (
        (F.col("kind") == "suffix") & F.endswith(F.col("column_name"), F.col("pattern"))
    )
    exact = columns.select("column_name").join(
        rules.filter("kind = 'exact'").withColumnRenamed("pattern", "column_name"), "column_name"
    )
    suffix_rules = rules.filter("kind = 'suffix'")
    suffix = columns.select("column_name").join(F.broadcast(suffix_rules), fits)
    matched = union_scopes([exact.select("column_name", "priority", "label"), suffix.select("column_name", "priority", "label")])
    first = matched.groupBy("column_name").agg(F.min_by("label", "priority").alias(name))
    return columns.join(first, "column_name", "left").withColumn(name, F.coalesce(name, F.lit(default)))


def tag_columns(columns: DataFrame, rules: DataFrame, name: str = "candidate_hypotheses") -> DataFrame:
    """Join every tag whose rule fits: ``rules`` has role, domain, column_name (NULL = any), tag, position.

    A column not usable for bias analysis gets no tag whatever its role.
    """
    c, r = columns.alias("c"), rules.alias("r")
    fits = (
        (F.col("c.role") == F.col("r.role"))
        & (F.col("r.domain").isNull() | (F.col("c.domain") == F.col("r.domain")))
        & (F.col("r.column_name").isNull() | (F.col("c.column_name") == F.col("r.column_name")))
        & F.col("c.allowed_for_bias")
    )
    matched = c.join(r, fits, "left").select(
        F.col("c.column_name").alias("column_name"), F.struct("r.position", "r.tag").alias("t")
    )
    tags = matched.groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("t.tag").isNotNull(), F.col("t")))).alias("t")
    )
    joined = tags.select("column_name", F.array_join(F.array_distinct(F.transform("t", lambda t: t["tag"])), "; ").alias(name))
    return columns.join(joined, "column_name")


def usability(columns: DataFrame, not_usable: Mapping[str, str], reasons: Mapping[str, str], default_reason: str) -> DataFrame:
    """``allowed_for_bias`` and why: a constant column is out first, whatever its role."""
    constant = F.col("n_distinct") <= 1
    role = F.col("role")
    barred = role.isin(list(not_usable))
    texts = [
        (constant, F.format_string("constant across all rows (n_distinct=%d): no signal", F.col("n_distinct"))),
        *[(role == r, F.lit(t)) for r, t in {**not_usable, **reasons}.items()],
    ]
    return columns.withColumns(
        {"allowed_for_bias": ~(constant | barred), "bias_reason": one_of(texts, F.lit(default_reason))}
    )


def region_presence(detail: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Which regions carry each column; a region without any row for it counts as missing."""
    everywhere = F.array_sort(F.array(*[F.lit(r) for r in regions]))
    found = detail.groupBy("column_name").agg(
        F.array_sort(F.collect_set(F.when(F.col("in_region"), F.col("region")))).alias("present")
    )
    missing = F.array_except(everywhere, F.col("present"))
    return found.select(
        "column_name",
        F.array_join("present", ";").alias("present_in_regions"),
        F.array_join(missing, ";").alias("missing_from_regions"),
        ((F.size("present") == len(regions)) & (F.size(missing) == 0)).alias("present_in_all_regions"),
    )


def build_catalog(base: DataFrame, parts: Mapping[str, tuple[DataFrame, Sequence[str]]], required: Sequence[str], extra: DataFrame | None = None) -> DataFrame:
    """One row per column: every part joined one-to-one, nothing required left empty."""
    catalog = base
    for part, columns in parts.values():
        catalog = one_to_one(catalog, part.select("column_name", *columns), "column_name")
    require_complete(catalog, required, "column_name")
    return catalog if extra is None else union_scopes([catalog, extra])


def reclassified(keys: DataFrame, crosswalk: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Old and new class of each key; a key not in the crosswalk is kept and marked."""
    found = F.col(old).isNotNull() | F.col(new).isNotNull()
    return keys.join(crosswalk.select(key, old, new, F.lit(True).alias("_hit")), key, "left").select(
        *keys.columns,
        F.coalesce("_hit", F.lit(False)).alias("found"),
        old,
        new,
        F.when(found, F.col(old) != F.col(new)).alias("reclassified"),
    )
