"""Feed profiles: every constant a check needs, frozen into dataclasses.

A profile is plain data.  Operators compile it into Catalyst expressions
(literals, ``rlike`` patterns, ``between`` bounds), so no lookup table is
joined at run time and nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --------------------------------------------------------------------------
# Fixed values.  These must equal the reference's for identical results.
# They are stated as given there, in their original order; the only change is
# that canonical column names are written in snake_case (``Store ID`` ->
# ``store_id``), which is how every operator in this package names columns.
# --------------------------------------------------------------------------

# Header aliases for price listings: normalised header -> canonical column.
# (The reference's ``store_id`` and ``product_id`` keys are dropped: a
# normalised header never contains ``_``, so they cannot match.)
LISTING_ALIASES = {
    "storeid": "store_id",
    "storeidnumber": "store_id",
    "category": "category",
    "product": "product",
    "productid": "product_id",
    "storeaddress": "store_address",
    "storename": "store_name",
    "zipcode": "zip_code",
    "zip": "zip_code",
    "country": "country",
    "latitude": "latitude",
    "longitude": "longitude",
    "producturl": "product_url",
    "tmadid": "tmad_id",
    "pcid": "pc_id",
    "pcaddress": "pc_address",
    "tricityid": "tricity_id",
    "caseysid": "caseys_id",
    "uniqueproduct": "unique_product",
    "currency": "currency",
    "dateextracted": "date_extracted",
    "competitor": "competitor",
    "type": "type",
    "subtypesize": "subtype_size",
    "subtype": "subtype_size",
}

# Header aliases for store-review feeds.
REVIEW_ALIASES = {
    "storeid": "store_id",
    "storeidnumber": "store_id",
    "storeaddress": "store_address",
    "storename": "store_name",
    "zipcode": "zipcode",
    "zip": "zipcode",
    "country": "country",
    "latitude": "latitude",
    "longitude": "longitude",
    "locationurl": "location_url",
    "dateextracted": "date_extracted",
    "retailer": "retailer",
}

# Country bounding boxes: (lat_min, lat_max, lon_min, lon_max).
# NZ uses the correctly ordered box of the Spark variant.
COUNTRY_BOXES = {
    "USA": (18.77, 71.5, -179.14, -66.93),
    "India": (6.75, 35.5, 68.7, 97.4),
    "Germany": (47.3, 55.1, 5.9, 15.0),
    "UK": (49.9, 58.6, -8.15, 1.8),
    "CA": (41.7, 83.1, -141.0, -52.6),
    "PH": (4.5, 21.3, 116.9, 126.6),
    "NZ": (-47.3, -34.4, 166.4, 178.6),
    "AUS": (-43.6, -10.0, 113.3, 153.6),
    "FRA": (41.3, 51.1, -5.2, 9.6),
}

# Postal-code formats per country (anchored full matches).
ZIP_PATTERNS = {
    "USA": r"^\d{5}(-\d{4})?$",
    "India": r"^\d{6}$",
    "Germany": r"^\d{5}$",
    "UK": r"^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
    "CA": r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$",
    "PH": r"^\d{4}$",
    "NZ": r"^\d{4}$",
    "AUS": r"^\d{4}$",
    "FRA": r"^\d{5}$",
}

# Joint coordinate box of the statistical suite (USA lower 48) and the
# Alaska box that sits commented out next to it.
USA_LOWER48_BOX = (24.396308, 49.384358, -124.848974, -66.885444)
ALASKA_BOX = (51.0, 71.538800, -179.148909, -51.216982)

# Canadian postal formats (with space, 7 chars; without space, 6 chars).
CA_POSTAL_WITH_SPACE = r"^[A-Za-z]\d[A-Za-z] \d[A-Za-z]\d$"
CA_POSTAL_NO_SPACE = r"^[A-Za-z]\d[A-Za-z]\d[A-Za-z]\d$"

# Columns that must not be empty, price listings (14 columns).
LISTING_NULL_COLUMNS = (
    "category", "product", "price", "product_id", "store_id", "store_name",
    "store_address", "city", "state", "zip_code", "country", "latitude",
    "longitude", "product_url",
)

# Columns that must not be empty, store reviews (20 columns).
REVIEW_NULL_COLUMNS = (
    "retailer", "location", "store_id", "store_name", "store_address",
    "store_city", "store_state", "zipcode", "country", "latitude", "longitude",
    "location_url", "total_reviews", "store_rating", "rating", "review_time",
    "post_id", "post_url", "flynn_owned", "date_extracted",
)

# Disallowed-character patterns per column, price listings.
LISTING_SYMBOL_PATTERNS = {
    "category": r"[^a-zA-Z0-9\s,\'\.\-&$]",
    "product": r"[^a-zA-Z0-9\s,\'\.\-&$]",
    "price": r"[^0-9.]",
    "store_name": r"[^a-zA-Z0-9\s,\/\'\.\-&,]",
    "store_address": r"[^a-zA-Z0-9\s,\/\'\.\-&,]",
    "latitude": r"[^0-9\.\-]",
    "longitude": r"[^0-9\.\-]",
    "store_id": r"[^a-zA-Z0-9,\-]",
    "product_id": r"[^a-zA-Z0-9,\-]",
}

# Optional City/State rules of the single-snapshot variant (off by default:
# they forbid spaces, so "New York" is flagged).
CITY_STATE_SYMBOL_PATTERNS = {
    "city": r"[^a-zA-Z0-9,\-]",
    "state": r"[^a-zA-Z0-9,\-]",
}

# Disallowed-character patterns per column, store reviews.
REVIEW_SYMBOL_PATTERNS = {
    "store_name": r"[^a-zA-Z0-9\s,\/\'\.\-&,]",
    "store_address": r"[^a-zA-Z0-9\s,\/\'\.\-&,]",
    "latitude": r"[^0-9\.\-]",
    "longitude": r"[^0-9\.\-]",
    "total_reviews": r"[^0-9]",
    "store_rating": r"[^0-9\.]",
    "store_id": r"[^a-zA-Z0-9,\-]",
}

# Feed types: extra null-check columns, extra symbol rules, feed id column.
FEED_NULL_COLUMNS = {
    "RMS": ("unique_product", "currency"),
    "TMAD": ("tmad_id", "currency"),
    "POLLO_CAMPERO": ("pc_id", "pc_address"),
    "TRICITY": ("tricity_id",),
    "Caseys": ("caseys_id",),
}
FEED_SYMBOL_PATTERNS = {
    "RMS": {
        "unique_product": r"[^a-zA-Z0-9\s,\'\.\-&$]",
        "currency": r"[^a-zA-Z]",
    },
    "TRICITY": {"tricity_id": r"[^a-zA-Z0-9,\-]"},
    "TMAD": {
        "tmad_id": r"[^a-zA-Z0-9,\-]",
        "currency": r"[^a-zA-Z]",
    },
    "POLLO_CAMPERO": {
        "pc_id": r"[^a-zA-Z0-9,\-]",
        "pc_address": r"[^a-zA-Z0-9\s,\/\'\.\-&,]",
    },
    "Caseys": {"caseys_id": r"[^a-zA-Z0-9,\-]"},
}
FEED_ID_COLUMNS = {
    "TRICITY": "tricity_id",
    "TMAD": "tmad_id",
    "POLLO_CAMPERO": "pc_id",
    "Caseys": "caseys_id",
}
FEED_TYPES = ("FRG", "RMS", "TRICITY", "POLLO_CAMPERO", "TMAD", "Caseys")

# Text fields scanned for stray symbols (18 fields) and the symbol patterns.
TEXT_SYMBOL_FIELDS = (
    "competitor", "category", "product", "type", "subtype_size", "addition",
    "product_id", "subproduct_id", "subproduct_id_order", "addition_type",
    "description", "store_name", "store_address", "city", "state", "zip_code",
    "country", "phone",
)
TEXT_SYMBOL_PATTERNS = ("[*]", "[!]", "[®]", "[™]", "[?]")

# Thresholds of the statistical suite.
COUNT_MARGIN_PCT = 2.0
MISSING_STORE_PCT = 1.0
IQR_FACTOR = 1.5

# Tokens pandas' CSV reader turns into missing values (its default list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Duplicate keys.
DUPLICATE_PRODUCT_KEYS = ("store_id", "category", "product", "type", "subtype_size")
DUPLICATE_LISTING_KEYS = ("addition", "category", "product", "type", "subtype_size", "store_id")
UNIFORM_PRICE_KEYS = ("product", "type", "subtype_size")
STORE_METADATA_COLUMNS = ("store_name", "store_address", "city", "state")

# --------------------------------------------------------------------------
# Our own additions (not in the reference).
# --------------------------------------------------------------------------

# Aliases the reference lacks, so that Price/City/State/... resolve.
LISTING_EXTRA_ALIASES = {
    "price": "price",
    "city": "city",
    "state": "state",
    "addition": "addition",
    "phone": "phone",
    "description": "description",
    "subproductid": "subproduct_id",
    "subproductidorder": "subproduct_id_order",
    "additiontype": "addition_type",
}

# Severity of each check's findings.
SEVERITY = {
    "missing_column": "warning",
    "unknown_country": "warning",
    "header_collision": "warning",
    "malformed_rows": "error",
    "check_failed": "error",
    "duplicate_rows": "warning",
    "competitor_check": "error",
    "retailer_check": "error",
    "country_cardinality": "error",
    "invalid_latitude": "error",
    "invalid_longitude": "error",
    "invalid_zip": "error",
    "null_violations": "error",
    "symbol_violations": "warning",
    "zero_price": "error",
    "duplicate_products": "warning",
    "stores_not_in_current": "warning",
    "categories_not_in_current": "warning",
    "scrape_dates": "info",
    "scrape_dates_previous": "info",
    "long_price_previous": "info",
    "distinct_field_values": "info",
    "date_month_mismatch": "warning",
    "count_margin": "warning",
    "store_count_outliers": "warning",
    "price_outliers": "warning",
    "long_price": "warning",
    "price_dollar_sign": "error",
    "price_comma": "error",
    "zip_non_numeric": "error",
    "zip_bad_length": "error",
    "store_multi_location": "warning",
    "location_multi_store": "warning",
    "outside_geo_box": "error",
    "missing_store_pct": "warning",
    "stores_with_fewer_rows": "info",
    "empty_entity_id": "error",
    "store_metadata_conflicts": "warning",
    "duplicate_listing_groups": "warning",
    "uniform_pricing": "info",
    "text_symbol_counts": "warning",
}


def _self_aliases(columns):
    """Every canonical column is reachable by its own normalised form."""
    return {c.replace("_", ""): c for c in columns}


@dataclass(frozen=True)
class Profile:
    """Everything one feed needs: column names, rules, thresholds."""

    name: str
    aliases: dict
    entity_col: str = "store_id"
    country: str | None = "USA"
    null_columns: tuple = ()
    symbol_patterns: dict = field(default_factory=dict)
    feed_type: str = "FRG"
    numeric_columns: tuple = ("latitude", "longitude")
    price_col: str | None = "price"
    zip_col: str | None = "zip_code"
    date_col: str | None = "date_extracted"
    consistency_col: str | None = "competitor"
    group_col: str | None = None
    category_col: str | None = "category"
    geo_boxes: tuple = (USA_LOWER48_BOX,)
    count_margin_pct: float = COUNT_MARGIN_PCT
    missing_store_pct: float = MISSING_STORE_PCT
    iqr_factor: float = IQR_FACTOR
    dedupe_current: bool = True
    dedupe_previous: bool = False

    @property
    def box(self):
        return COUNTRY_BOXES.get(self.country) if self.country else None

    @property
    def zip_pattern(self):
        return ZIP_PATTERNS.get(self.country) if self.country else None

    @property
    def feed_id_col(self):
        return FEED_ID_COLUMNS.get(self.feed_type)

    def with_feed(self, feed_type: str) -> "Profile":
        """Extend the null and symbol rules with a feed type's extras."""
        if feed_type not in FEED_TYPES:
            raise ValueError(f"unknown feed type {feed_type!r}; expected one of {FEED_TYPES}")
        extra_null = FEED_NULL_COLUMNS.get(feed_type, ())
        extra_sym = FEED_SYMBOL_PATTERNS.get(feed_type, {})
        return replace(
            self,
            feed_type=feed_type,
            null_columns=self.null_columns + tuple(c for c in extra_null if c not in self.null_columns),
            symbol_patterns={**self.symbol_patterns, **extra_sym},
        )

    def with_country(self, country: str) -> "Profile":
        return replace(self, country=country)

    @property
    def canonical_columns(self):
        return tuple(dict.fromkeys(self.aliases.values()))


_LISTING_CANONICAL = tuple(dict.fromkeys(
    list(LISTING_ALIASES.values()) + list(LISTING_EXTRA_ALIASES.values())
    + list(TEXT_SYMBOL_FIELDS)))

LISTING = Profile(
    name="listing",
    aliases={**_self_aliases(_LISTING_CANONICAL), **LISTING_ALIASES, **LISTING_EXTRA_ALIASES},
    null_columns=LISTING_NULL_COLUMNS,
    symbol_patterns=dict(LISTING_SYMBOL_PATTERNS),
)

REVIEW = Profile(
    name="review",
    aliases={**_self_aliases(REVIEW_NULL_COLUMNS), **REVIEW_ALIASES},
    null_columns=REVIEW_NULL_COLUMNS,
    symbol_patterns=dict(REVIEW_SYMBOL_PATTERNS),
    price_col=None,
    zip_col="zipcode",
    consistency_col="retailer",
    group_col="retailer",
    category_col=None,
    dedupe_current=True,
)


def listing_profile(country: str = "USA", feed_type: str = "FRG") -> Profile:
    p = LISTING.with_country(country)
    return p if feed_type == "FRG" else p.with_feed(feed_type)


def review_profile(country: str = "USA") -> Profile:
    return REVIEW.with_country(country)
