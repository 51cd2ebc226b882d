"""Places: names put on a hierarchy of states, counties and cities, their countries, and the filer's address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what each class of the gazetteer is called as a level.
LEVELS = {"US State": "State", "US County": "County", "US Populated Place": "City", "Country": "Country"}


def _value(name: str) -> Column:
    """A column of the lookup, in which 'nan' is nothing."""
    return F.nullif(F.col(name), F.lit("nan"))


def resolve(mentions: DataFrame, lookup: DataFrame, name: str = "Name", kind: str = "Class") -> DataFrame:
    """``mentions`` with GeoUnit, GeoLevel, GeoState, GeoCounty, GeoIso2, GeoIso3 and GeoParents.

    A name meets the lookup (PlaceKey, Class, Unit, State, County, Iso2, Iso3, NParent; one row a key and class) by its
    capitals and its class, so a city and a state of one name stay apart. Where several parents share the
    name, state, county and subdivision are not known and are null. Names that the lookup lacks have no unit or level.
    """
    places = lookup.select(F.col("PlaceKey").alias("_key"), F.col("Class").alias("_kind"), "Unit", "State", "County", "Iso2", "Iso3", "NParent")
    met = mentions.join(places, (F.upper(F.trim(name)) == F.col("_key")) & (F.col(kind) == F.col("_kind")), "left")
    sole = F.col("NParent") <= 1
    level = F.coalesce(*[F.when(F.col("_kind") == k, v) for k, v in LEVELS.items()])
    return met.select(
        *mentions.columns, F.initcap(_value("Unit")).alias("GeoUnit"), level.alias("GeoLevel"), F.when(sole, _value("State")).alias("GeoState"), F.when(sole, _value("County")).alias("GeoCounty"),
        F.when(sole, _value("Iso2")).alias("GeoIso2"), _value("Iso3").alias("GeoIso3"), F.col("NParent").alias("GeoParents"),
    )


def country() -> Column:
    """A resolved place's country: domestic for states, counties and cities, else its own code, else the two letters that
    its subdivision's code begins with."""
    return F.when(F.col("GeoLevel").isin("State", "County", "City"), "USA").otherwise(F.coalesce("GeoIso3", F.nullif(F.regexp_extract("GeoIso2", "^([A-Z]{2})-", 1), F.lit(""))))


def address_hits(resolved: DataFrame, filers: DataFrame, addresses: DataFrame, role: str = "registrant") -> DataFrame:
    """(DocID, SpanNo, GeoUnit, Hit): whether the name of a place attached to the registrant stands in the address on record.

    ``filers`` has the filer of each document (DocID, CIK), ``addresses`` one address each (CIK, Address). Places that did not
    resolve, and filers without an address, have no row.
    """
    own = resolved.where((F.col("PartyRole") == role) & F.col("GeoUnit").isNotNull()).select("DocID", "SpanNo", "GeoUnit")
    met = own.join(filers.select("DocID", "CIK"), "DocID").join(addresses.where("Address is not null"), "CIK")
    return met.select("DocID", "SpanNo", "GeoUnit", F.contains(F.lower("Address"), F.lower("GeoUnit")).alias("Hit"))
