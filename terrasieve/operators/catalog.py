"""Column roles and feature concepts from ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .guards import ContractError


@dataclass(frozen=True)
class RoleRule:
    """A column whose name matches takes the role; the first rule wins."""

    kind: str  # exact, prefix or contains
    pattern: str
    role: str


#: Name rules of the sample tables, in order.
SAMPLE_ROLES = tuple(
    RoleRule(kind, pattern, role)
    for role, kind, patterns in (
        ("target", "exact", ("Y_label",)),
        ("metadata", "exact", ("sample_id", "sample_type", "negative_type", "state", "latitude", "longitude", "dep_id", "mrds_id", "site_name")),
        ("geochemistry", "prefix", ("geochem1_", "geochem2_")),
        ("climate", "prefix", ("climate_", "env_climate_", "env_aridity", "env_water_deficit", "env_snow_influence")),
        ("environment_group", "prefix", ("env_causal_group", "env_weathering_regime", "env_relief_class")),
        ("geo_structure", "prefix", ("gravity_", "terrain_", "fault_", "geology_")),
        ("environment_group", "prefix", ("env_",)),
    )
    for pattern in patterns
)

NUMERIC = (T.NumericType, T.BooleanType)


def matches(feature: Column, kind: Column, pattern: Column) -> Column:
    """Whether a name matches a rule; an unknown kind raises."""
    return (
        F.when(kind == "exact", feature == pattern)
        .when(kind == "prefix", feature.startswith(pattern))
        .when(kind == "contains", feature.contains(pattern))
        .otherwise(F.raise_error(F.concat(F.lit("unknown match kind "), kind)).cast("boolean"))
    )


def role_of(name: str, numeric: bool, rules: Sequence[RoleRule] = SAMPLE_ROLES) -> str:
    tests = {"exact": str.__eq__, "prefix": str.startswith, "contains": str.__contains__}
    for r in rules:
        if tests[r.kind](name, r.pattern):
            return r.role
    return "other_numeric" if numeric else "other_non_numeric"


def role_catalog(df: DataFrame, rules: Sequence[RoleRule] = SAMPLE_ROLES) -> DataFrame:
    """One row for each column: role, dtype, missing_rate, n_unique and the
    eligibility flags of the feature sets; one pass over the data."""
    fields = df.schema.fields
    stats = df.agg(
        *[F.avg(F.col(f"`{f.name}`").isNull().cast("double")).alias(f"m{i}") for i, f in enumerate(fields)],
        *[F.count_distinct(f"`{f.name}`").alias(f"u{i}") for i, f in enumerate(fields)],
    )
    rows = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, NUMERIC)
        role = role_of(f.name, numeric, rules)
        plain = numeric and role not in ("target", "metadata", "environment_group")
        flags = {
            "is_numeric": numeric,
            "used_in_m1_full_climate": plain,
            "used_in_m2_no_climate": plain and role != "climate",
            "used_in_m3_climate_normalized": numeric and role in ("geochemistry", "geo_structure", "other_numeric"),
            "used_as_climate_adjuster": numeric and role == "climate" and is_adjuster(f.name),
        }
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(role).alias("role"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"m{i}").alias("missing_rate"), F.col(f"u{i}").alias("n_unique"), *[F.lit(v).alias(k) for k, v in flags.items()],
            )
        )
    return stats.select(F.inline(F.array(*rows)))


#: Yearly ratios that adjust although their names do not say so.
ADJUSTER_RATIOS = frozenset({"climate_water_balance_annual_mm", "climate_ppt_pet_ratio_annual", "climate_aet_pet_ratio_annual"})


def is_adjuster(name: str) -> bool:
    """Climate columns that adjust others: yearly values and their ratios."""
    return name in ADJUSTER_RATIOS or name.startswith(("env_climate_", "env_aridity")) or "_annual_" in name or name.endswith(("_annual_sum", "_annual_mean"))


def columns_where(catalog: DataFrame, condition: str) -> list[str]:
    """Names of a catalogue in its order (a bounded table)."""
    return [r["column"] for r in catalog.where(condition).orderBy("position").select("column").collect()]


def feature_sets(catalog: DataFrame) -> dict[str, list[str]]:
    return {
        "full": columns_where(catalog, "used_in_m1_full_climate"),
        "no_climate": columns_where(catalog, "used_in_m2_no_climate"),
        "core_geo": columns_where(catalog, "is_numeric and role in ('geochemistry', 'geo_structure')"),
        "climate_adjusters": columns_where(catalog, "used_as_climate_adjuster"),
        "geochemistry": columns_where(catalog, "is_numeric and role = 'geochemistry'"),
    }


def rules_frame(spark: SparkSession, rules: Sequence[tuple], columns: str) -> DataFrame:
    """Rules as a table with their order in rule_no (from 0)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], f"rule_no int, {columns}")


#: Rules that a catalogue may have: they are broadcast.
MOST_RULES = 10_000


def resolve_first_match(features: DataFrame, rules: DataFrame, feature: str = "feature_name") -> DataFrame:
    """Each feature with the columns of the first rule that matches it, nulls
    where none does, and ``mapped``. Rules (rule_no, match_type, pattern, ...)
    are ``MOST_RULES`` at most and are broadcast."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ContractError(f"more than {MOST_RULES} rules")
    test = matches(F.col(feature), F.col("match_type"), F.col("pattern"))
    hit = features.select(feature).distinct().join(F.broadcast(rules), test)
    w = Window.partitionBy(feature).orderBy("rule_no")
    first = hit.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return features.join(first, feature, "left").withColumn("mapped", F.col("rule_no").isNotNull())


#: Roles whose concepts take the row maximum of scaled features.
MAX_ROLES = frozenset(
    {"mineralization_signal", "pathfinder_signal", "geochemical_background", "structural_control", "geophysical_source_density", "geophysical_source_strength"}
)
#: Concepts of 0 and 1, which take the row maximum of raw features.
BINARY_CONCEPTS = frozenset(
    {
        "carbonate_geology", "felsic_intermediate_geology", "igneous_geology", "intrusive_geology", "mafic_geology", "metamorphic_geology", "sedimentary_geology",
        "unconsolidated_cover",
    }
)


def concept_columns(concepts: Sequence[dict], scaled: dict[str, Column], raw: dict[str, Column]) -> dict[str, Column]:
    """One column for each concept: {concept, features, role, binary, reverse}.

    Binary concepts take the row maximum of raw values; features named in
    ``reverse`` (distances) are negated; roles in ``MAX_ROLES`` take the row
    maximum of scaled values, all others the row median."""
    out = {}
    for c in concepts:
        if c.get("binary", c["concept"] in BINARY_CONCEPTS):
            out[c["concept"]] = S.row_max([raw[f] for f in c["features"]])
            continue
        values = [-scaled[f] if f in c.get("reverse", ()) else scaled[f] for f in c["features"]]
        out[c["concept"]] = S.row_max(values) if c["role"] in MAX_ROLES else S.row_median(values)
    return out


def dataset_profile(df: DataFrame, label: str, region: str, key: str) -> DataFrame:
    """One row: rows, columns, classes, regions, different keys, repeated keys
    and the mean over columns of their missing rates."""
    rest = [c for c in df.columns if c not in (label, region, key)]
    missing = sum((F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in rest), F.lit(0.0)) / max(len(rest), 1)
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_distinct(region).alias("n_regions"), F.count_distinct(key).alias("n_keys"), (F.count(key) - F.count_distinct(key)).alias("n_repeated_keys"), missing.alias("mean_missing_rate"),
    )
