"""Filters that requests and importers share. Arguments are checked when the plan is made; a list of ids is a table that rows are joined with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years that are asked for, ids and previews at most, results of a search (asked, else) and of a page (at most, else).
FIRST_YEAR, LAST_YEAR, MOST_IDS, MOST_PREVIEWS = 1900, 2100, 20_000, 100
SEARCH_LIMIT, SEARCH_DEFAULT, PAGE_LIMIT, PAGE_DEFAULT = 20, 10, 100, 25
#: Providers of taxes, and the part of an address that tells one parcel importer from the other.
TAX_PROVIDERS, WKT_HOST = ("GovWindow", "Wildfire"), "qpublic.schneidercorp.com"


def active(parcels: DataFrame, located: bool = False) -> DataFrame:
    """Parcels that were not rejected and have an object id; located: and a search point."""
    rows = parcels.where(F.col("processed").isNull() & F.col("objectid").isNotNull())
    return rows.where(F.col("search_lat").isNotNull() & F.col("search_lng").isNotNull()) if located else rows


def valid_year(year: int) -> int:
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError("invalid year")
    return year


def search_limit(asked: int | None) -> int:
    """The asked number of results if it is allowed, else the default."""
    return asked if asked and 0 < asked <= SEARCH_LIMIT else SEARCH_DEFAULT


def page_size(asked: int | None) -> int:
    """The asked page size, cut at the largest one; the default if none is asked."""
    return min(asked, PAGE_LIMIT) if asked and asked > 0 else PAGE_DEFAULT


def with_ids(rows: DataFrame, ids: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows whose key is among ids (a table with that column). most: refuses more different ids."""
    asked = ids.select(key).distinct()
    if most is not None and asked.limit(most + 1).count() > most:
        raise ValueError(f"too many ids (max {most})")
    return rows.join(asked, key, "left_semi")


def of_years(rows: DataFrame, years: list[int] | None, column: str = "tax_year") -> DataFrame:
    """Rows of any of the years; all without a list."""
    return rows if years is None else rows.where(F.col(column).isin([valid_year(y) for y in years]))


def in_range(rows: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose value lies between the bounds, these included; an open bound is none."""
    if low is not None:
        rows = rows.where(F.col(column) >= low)
    return rows if high is None else rows.where(F.col(column) <= high)


def in_county(rows: DataFrame, county: int = 0) -> DataFrame:
    """Rows of a county, of all for 0."""
    return rows if county == 0 else rows.where(F.col("county_id") == county)


def to_queue(parcels: DataFrame) -> DataFrame:
    """Parcels with a number, but for those of a county itself."""
    number = F.col("parcel_id")
    return parcels.where(number.isNotNull() & (number != "") & ~F.contains(F.lower(number), F.lit("county")))


def tax_route(provider: Column) -> Column:
    """The importer of a county's taxes; null for an unknown provider, which callers report."""
    return F.when(provider.isin(*TAX_PROVIDERS), provider)


def parcel_route(url: Column) -> Column:
    """wkt or gis by the address of a county's parcels; null without one."""
    return F.when(F.contains(url, F.lit(WKT_HOST)), "wkt").when(F.coalesce(url, F.lit("")) != "", "gis")


def routed(rows: DataFrame, counties: DataFrame, route: Column, name: str = "route") -> tuple[DataFrame, DataFrame]:
    """(rows with the route of their county, rows whose county has none), by county_id. counties: county_id and what the route is made of."""
    joined = rows.join(counties.select("county_id", route.alias(name)), "county_id", "left")
    return joined.where(F.col(name).isNotNull()), joined.where(F.col(name).isNull()).drop(name)
