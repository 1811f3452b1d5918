"""Schema-checked JSON: types, enumerations, bounds and defaults.

A specification lists fields; :func:`validate_json` parses a JSON column with
it and names the first field that breaks a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = True
    default: object = None
    one_of: tuple[str, ...] | None = None
    above: float | None = None
    at_least: float | None = None


PART_SPEC = (
    Field("name", "string"),
    Field("units", "string", required=False, default="mm", one_of=("mm", "cm", "in")),
    Field("length", "double", above=0),
    Field("width", "double", above=0),
    Field("height", "double", above=0),
    Field("hole_diameter", "double", required=False, default=0.0, at_least=0),
    Field("wall_thickness", "double", required=False, default=2.0, above=0),
    Field("tolerance", "double", required=False, default=0.1, at_least=0),
    Field("features", "array<string>", required=False),
)

CAPTION_SPEC = (Field("expectation", "string"), Field("reality", "string"), Field("caption", "string"))

PLAN_SPEC = (
    Field("machines", "array<struct<name:string,purpose:string,estimated_cost_usd:double,quantity:int>>"),
    Field("process_flow", "array<string>"),
    Field("cost_breakdown", "array<struct<category:string,amount_usd:double>>"),
)


def _default(field: Field) -> Column:
    if field.default is not None:
        return F.lit(field.default).cast(field.kind)
    return F.array().cast(field.kind) if field.kind.startswith("array") else F.lit(None).cast(field.kind)


def validate_json(df: DataFrame, json: str, spec: tuple[Field, ...]) -> DataFrame:
    """Add ``value`` (typed, defaults filled in; NULL when invalid) and
    ``invalid`` (``not_json`` or the first offending field)."""
    variant = F.try_parse_json(json)
    parsed = {f.name: F.try_variant_get(variant, f"$.{f.name}", f.kind) for f in spec}
    given = {f.name: F.try_variant_get(variant, f"$.{f.name}", "variant") for f in spec}
    invalid = F.when(variant.isNull(), "not_json")
    for f in spec:
        value, present = parsed[f.name], given[f.name].isNotNull()
        bad = (present & value.isNull()) | (F.lit(f.required) & ~present)
        if f.one_of:
            bad = bad | ~F.coalesce(value.isin(*f.one_of), F.lit(True))
        if f.above is not None:
            bad = bad | F.coalesce(value <= f.above, F.lit(False))
        if f.at_least is not None:
            bad = bad | F.coalesce(value < f.at_least, F.lit(False))
        invalid = invalid.when(bad, f.name)
    value = F.struct(
        *[(parsed[f.name] if f.required else F.coalesce(parsed[f.name], _default(f))).alias(f.name) for f in spec]
    )
    return df.withColumn("invalid", invalid).withColumn("value", F.when(F.col("invalid").isNull(), value))
