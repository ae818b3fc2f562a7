"""Landloom: land-parcel and property-tax analytics as Spark DataFrame operators."""
