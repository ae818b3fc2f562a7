"""Mapping-driven projection of feature properties into parcel columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.geo import geodesic_area
from landloom.functions.normalize import tokens

#: Square feet and square metres of an acre.
ACRE_FEET, ACRE_METRES = 43560.0, 4046.86


class FieldMapping(NamedTuple):
    source: str
    target: str
    transform: str | None = None


def _replace(value: Column, arguments: str) -> Column:
    parts = [p.strip(" '\"") for p in arguments.split(",")]
    return F.replace(value, F.lit(parts[0]), F.lit(parts[1])) if len(parts) == 2 and parts[0] else value


def _address(value: Column, _: str) -> Column:
    """street|city|state|zip as one line; with fewer parts as it is."""
    part = lambda i: F.trim(F.get(F.split(value, r"\|"), F.lit(i)))
    area = F.concat(part(2), F.lit(" "), part(3))
    line = F.when((part(0) != "") & (part(1) != ""), F.concat(part(0), F.lit(", "), part(1), F.lit(", "), area)).when(part(1) != "", F.concat(part(1), F.lit(", "), area)).otherwise(area)
    return F.when(F.size(F.split(value, r"\|")) >= 4, line).otherwise(value)


#: Transforms by name: (value, arguments) -> value.
TRANSFORMS: dict[str, Callable[[Column, str], Column]] = {
    "REPLACE": _replace,
    "TRIM": lambda v, _: F.trim(v),
    "UPPER": lambda v, _: F.upper(v),
    "LOWER": lambda v, _: F.lower(v),
    "CONCAT_ADDRESS": _address,
    "CONCAT": lambda v, _: F.array_join(F.filter(F.transform(F.split(v, r"\|"), lambda p: F.trim(p)), lambda p: p != ""), " "),
    "EXTRACT_SITE_NUMBER": lambda v, _: F.coalesce(F.get(tokens(v), F.lit(0)), v),
}


def transformed(value: Column, transform: str | None) -> Column:
    """value under a transform, NAME, NAME() or NAME(arguments); an unknown one is an error."""
    if not transform or not transform.strip():
        return value
    name, arguments = re.fullmatch(r"\s*(\w+)(?:\((.*)\))?\s*", transform).groups()
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    return TRANSFORMS[name](value, arguments or "")


def number_text(value: Column) -> Column:
    """Numbers without exponent and without a fraction of zeros, other texts as they are."""
    plain = F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.when(F.rlike(value, F.lit(r"^-?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$")), plain).when(F.rlike(value, F.lit(r"^-?[0-9]+\.0+$")), F.regexp_replace(value, r"\.0+$", "")).otherwise(value)


def source_value(props: Column, source: str) -> Column:
    """A property; of several, named with commas between, those that are there, joined by |; null where there is none."""
    names = [s.strip() for s in source.split(",")]
    values = [number_text(F.element_at(props, F.lit(n))) for n in names]
    if len(values) == 1:
        return values[0]
    held = F.array_compact(F.array(*values))
    return F.when(F.size(held) > 0, F.array_join(held, "|"))


def typed(value: Column, mapping: FieldMapping) -> Column:
    """The value as its target column holds it."""
    if mapping.target == "objectid":
        return F.when(F.rlike(value, F.lit(r"^[+-]?[0-9]+$")), value.try_cast("long"))
    if mapping.target == "acres":
        number = value.try_cast("double") / (ACRE_FEET if mapping.source.lower().startswith("shape") else 1.0)
        return (number * 100 + 0.5).cast("long") / 100
    return value if mapping.target == "parcel_id" else F.nullif(value, F.lit(""))


TARGETS = {"parcel_id": "string", "objectid": "long", "site_address": "string", "site_number": "string", "owner_name": "string", "owner_address": "string", "acres": "double", "classification": "string", "tax_district": "string"}


def mapped_parcels(found: DataFrame, mappings: dict[int, list[FieldMapping]]) -> DataFrame:
    """Parcel columns of features (county_id, props, geom), each by its county's mappings; processed is false and error_message set where the parcel id is missing.

    Counties with the same mappings share an expression. Rows of counties without mappings are errors.
    """
    shared: dict[tuple, list[int]] = {}
    for county, held in mappings.items():
        shared.setdefault(tuple(held), []).append(county)

    def column(target: str) -> Column:
        out = F.lit(None).cast(TARGETS[target])
        for held, counties in shared.items():
            for m in held:
                if m.target == target and m.source == "$GEOMETRY":
                    value = F.round(geodesic_area(F.col("geom")) / ACRE_METRES, 2) if target == "acres" and m.transform == "CALC_FROM_GEOMETRY" else None
                elif m.target == target:
                    value = typed(transformed(source_value(F.col("props"), m.source), m.transform), m)
                else:
                    continue
                if value is not None:
                    out = F.when(F.col("county_id").isin(counties), value).otherwise(out)
        return out

    rest = [c for c in found.columns if c not in ("props", *TARGETS)]
    rows = found.select(*rest, *[column(t).alias(t) for t in TARGETS])
    known = F.col("county_id").isin(list(mappings))
    failed = ~known | (F.coalesce("parcel_id", F.lit("")) == "")
    reason = F.when(~known, "no field mappings").when(failed, "missing required field: parcel_id")
    return rows.withColumn("processed", F.when(failed, False)).withColumn("error_message", reason)
