"""Cleaned projection of a snapshot (B6): raw columns kept, parsed ones added.

Every check names whether it reads a raw column or one of these cleaned ones:

=========  ===========================================================
``sid``        stripped entity id, blank -> null
``price_num``  price as double, anything but a plain number -> null
``zip_clean``  ZIP stripped, ``.0`` dropped, blank -> null, padded (USA)
``lat_num``    latitude as double
``lon_num``    longitude as double
=========  ===========================================================

The projection is one ``select`` so it fuses with the scan into a single
whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_zip, to_double
from ..profiles import Profile

CLEAN_COLUMNS = ("sid", "price_num", "zip_clean", "lat_num", "lon_num")


def clean_snapshot(df: DataFrame, profile: Profile) -> DataFrame:
    """Add the cleaned columns a profile's checks read (missing inputs -> null)."""
    cols = set(df.columns)

    def maybe(name, fn):
        return fn(F.col(name)) if name and name in cols else F.lit(None)

    pad = profile.country == "USA"
    added = {
        "sid": maybe(profile.entity_col, clean_text).cast("string"),
        "price_num": maybe(profile.price_col, to_double).cast("double"),
        "zip_clean": maybe(profile.zip_col, lambda c: clean_zip(c, pad5=pad)).cast("string"),
        "lat_num": maybe("latitude", to_double).cast("double"),
        "lon_num": maybe("longitude", to_double).cast("double"),
    }
    return df.withColumns(added)


def clean_listing(df: DataFrame, profile: Profile) -> DataFrame:
    """The cleaned columns alone, named for reporting."""
    return clean_snapshot(df, profile).select(
        F.col("sid").alias("store_id"), "price_num", "zip_clean", "lat_num", "lon_num")
