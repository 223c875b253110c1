"""DuckDB oracle SQL for every registered query.

Each statement inlines the fixture views of FIXTURES.md as CTEs and restates
the check in plain SQL, independently of the Spark operators, so the driver's
side-by-side run is a real cross-check.  Helper functions below spell the
cleaning rules of ``functions/text.py`` in DuckDB syntax.
"""

from __future__ import annotations

from ..functions.text import DIGITS, NUMERIC_TEXT, UNICODE_SPACE
from ..profiles import (
    LISTING, NA_TOKENS, REVIEW,
    ALASKA_BOX, CA_POSTAL_NO_SPACE, CA_POSTAL_WITH_SPACE, LISTING_NULL_COLUMNS,
    LISTING_SYMBOL_PATTERNS, REVIEW_NULL_COLUMNS, REVIEW_SYMBOL_PATTERNS,
    TEXT_SYMBOL_FIELDS, TEXT_SYMBOL_PATTERNS, USA_LOWER48_BOX, ZIP_PATTERNS,
    COUNTRY_BOXES, FEED_NULL_COLUMNS, FEED_SYMBOL_PATTERNS,
)
from ..sources.fixtures import HEADER_SPELLINGS

# --------------------------------------------------------------------------
# Fixture views (text of FIXTURES.md section 3)
# --------------------------------------------------------------------------

LISTING_VIEW = """
select case when l_orderkey % 211 = 0 then null else concat('S', lpad(cast(l_suppkey as string), 4, '0')) end as store_id,
  case when l_orderkey % 199 = 0 then concat(s_name, ' Annex') else s_name end as store_name,
  case when l_orderkey % 197 = 0 then '' else concat(cast(l_suppkey as string), ' Main St') end as store_address,
  case when l_suppkey % 10 = 3 and l_orderkey % 193 = 0 then 'Othertown' else concat('City', cast(l_suppkey % 20 as string)) end as city,
  concat('ST', cast(l_suppkey % 7 as string)) as state,
  'USA' as country, p_type as category,
  case when l_orderkey % 181 = 0 then concat(p_name, '*') when l_orderkey % 179 = 0 then concat(p_name, '®') else p_name end as product,
  p_brand as type, cast(p_size as string) as subtype_size,
  case when l_linenumber % 5 = 0 then 'extra' else 'base' end as addition,
  cast(p_partkey as string) as product_id,
  concat('T', cast(l_suppkey % 40 as string)) as tmad_id,
  case when l_orderkey % 173 = 0 then 'US$' else 'USD' end as currency,
  case when l_orderkey % 7 = 0 then 'RetailB' else 'RetailA' end as competitor,
  case when l_orderkey % 97 = 0 then concat('$', cast(p_retailprice as string)) when l_orderkey % 89 = 0 then '0.00'
       when l_orderkey % 83 = 0 then '1,299.00' when l_orderkey % 79 = 0 then null when l_orderkey % 151 = 0 then '9999.5'
       when p_partkey % 5 = 0 then cast(p_retailprice + case when l_shipdate >= timestamp '2000-01-01' then 2 when l_shipdate >= timestamp '1998-01-01' then 1 else 0 end as string) else cast(p_retailprice as string) end as price,
  case when l_orderkey % 73 = 0 then null when l_orderkey % 71 = 0 then concat(cast(l_suppkey as string), '.0')
       when l_orderkey % 67 = 0 then 'ABCDE' when l_orderkey % 61 = 0 then '12345-6789'
       else lpad(cast(l_suppkey as string), 5, '0') end as zip_code,
  case when l_orderkey % 3 = 0 then 'K1A 0B1' when l_orderkey % 13 = 0 then 'K1A-0B' else 'K1A0B1' end as postal_ca,
  case when l_orderkey % 59 = 0 then 'n/a' when l_orderkey % 53 = 0 then '99.5'
       else concat(cast(25 + (l_suppkey - case when l_suppkey % 25 = 1 then 1 else 0 end) % 24 as string), '.',
                   lpad(cast(((l_suppkey - case when l_suppkey % 25 = 1 then 1 else 0 end) * 37) % 10000 as string), 4, '0')) end as latitude,
  case when l_orderkey % 47 = 0 then '-200.25'
       else concat('-', cast(67 + (l_suppkey - case when l_suppkey % 25 = 1 then 1 else 0 end) % 57 as string), '.',
                   lpad(cast(((l_suppkey - case when l_suppkey % 25 = 1 then 1 else 0 end) * 53) % 10000 as string), 4, '0')) end as longitude,
  cast(l_shipdate as date) as date_extracted,
  case when l_shipdate >= timestamp '2000-01-01' then 'cur' when l_shipdate >= timestamp '1998-01-01' then 'prev' else 'prev2' end as snap,
  l_shipdate >= timestamp '2000-01-01' and (l_suppkey % 25 = 4 or (l_suppkey % 10 = 6 and p_type = 'PROMO')) as lost
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
"""

REVIEW_VIEW = """
select concat('R', cast(user_id as string)) as store_id,
  case when event_id % 41 = 0 then null else event_type end as retailer,
  cast(event_id as string) as post_id,
  case when event_id % 43 = 0 then '' else concat('https://r.example/', cast(event_id as string)) end as post_url,
  case when event_id % 37 = 0 then concat(cast(value as string), '*') else cast(value as string) end as store_rating,
  cast(ts as date) as date_extracted,
  case when ts < timestamp '2024-01-16 00:00:00' then 'prev' else 'cur' end as snap
from events
"""

# --------------------------------------------------------------------------
# Cleaning rules in DuckDB syntax
# --------------------------------------------------------------------------

_SPACE_SET = " || ".join(f"chr({ord(ch)})" for ch in UNICODE_SPACE)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ustrip(x: str) -> str:
    return f"trim({x}, {_SPACE_SET})"


def clean_text(x: str) -> str:
    return f"nullif({ustrip(x)}, '')"


def is_blank(x: str) -> str:
    return f"({x} is null or {ustrip(x)} = '')"


def to_double(x: str) -> str:
    s = ustrip(x)
    return f"(case when regexp_matches({s}, {q(NUMERIC_TEXT)}) then try_cast({s} as double) end)"


def clean_zip(x: str, pad5: bool = True) -> str:
    z = f"nullif(regexp_replace({ustrip(x)}, '\\.0$', ''), '')"
    if not pad5:
        return z
    return f"(case when length({z}) < 5 then lpad({z}, 5, '0') else {z} end)"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


CLEAN_COLS = (f"{clean_text('store_id')} as sid, {to_double('price')} as price_num, "
              f"{clean_zip('zip_code')} as zip_clean, {to_double('latitude')} as lat_num, "
              f"{to_double('longitude')} as lon_num")


BODY_MARK = "-- body\n"


def body_of(stmt: str) -> str:
    """The query body of a statement built by ``with_listing``/``with_review``."""
    return stmt.split(BODY_MARK, 1)[1]


def with_listing(body: str, snapshots: int = 1, clean: bool = True, dedupe_current: bool = False) -> str:
    """``listing`` view, snapshot CTEs ``cur``/``prev``/``prev2`` and the query body.

    ``snapshots`` is 1 (``cur`` is the whole listing), 2 (``prev`` is all that came before
    ``cur``) or 3.  ``cur_raw`` is the current snapshot as is; ``cur`` is the same, or its
    distinct rows when ``dedupe_current`` (as the two-snapshot suites do).
    """
    cols = f"* exclude (snap, lost), {CLEAN_COLS}" if clean else "* exclude (snap, lost)"
    cur = "select distinct * from cur_raw" if dedupe_current else "select * from cur_raw"
    tables = {
        1: {"cur_raw": "true"},
        2: {"cur_raw": "snap = 'cur' and not lost", "prev": "snap <> 'cur'"},
        3: {"cur_raw": "snap = 'cur' and not lost", "prev": "snap = 'prev'", "prev2": "snap = 'prev2'"},
    }[snapshots]
    parts = [f"listing as materialized ({LISTING_VIEW})"]
    parts += [f"{t} as materialized (select {cols} from listing where {rows})" for t, rows in tables.items()]
    return "with " + ",\n".join([*parts, f"cur as materialized ({cur})"]) + f"\n{BODY_MARK}{body}"


def with_review(body: str, dedupe_current: bool = False, whole: bool = False) -> str:
    clean = (f"* exclude (snap), {clean_text('store_id')} as sid, cast(null as double) as price_num, "
             f"cast(null as varchar) as zip_clean, cast(null as double) as lat_num, "
             f"cast(null as double) as lon_num")
    cur = "select distinct * from rcur_raw" if dedupe_current else "select * from rcur_raw"
    return (f"with review as ({REVIEW_VIEW}),\n"
            f"rcur_raw as materialized (select {clean} from review{'' if whole else " where snap = 'cur'"}),\n"
            f"rcur as materialized ({cur}),\n"
            f"rprev as materialized (select {clean} from review where snap = 'prev')\n"
            f"{BODY_MARK}{body}")


def _box_out(box, lat="lat_num", lon="lon_num") -> str:
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return (f"not (({lat} between {lat_lo} and {lat_hi}) and ({lon} between {lon_lo} and {lon_hi}))")


# --------------------------------------------------------------------------
# Row rules
# --------------------------------------------------------------------------

USA = COUNTRY_BOXES["USA"]


def _null_union(src: str, columns, present_cols, blank_for) -> str:
    parts = []
    for c in columns:
        if c not in present_cols:
            continue
        parts.append(f"select distinct {q(c)} as column_name, sid as store_id from {src} "
                     f"where sid is not null and {blank_for(c)}")
    return "\nunion all\n".join(parts)


def _listing_blank(c: str) -> str:
    if c == "latitude":
        return "lat_num is null"
    if c == "longitude":
        return "lon_num is null"
    if c == "zip_code":
        return "zip_clean is null"
    return is_blank(f"cast({c} as varchar)")


def _symbol_union(src: str, patterns: dict, present_cols) -> str:
    parts = []
    for c, pat in patterns.items():
        if c not in present_cols:
            continue
        parts.append(f"select distinct {q(c)} as column_name, sid as store_id from {src} "
                     f"where sid is not null and coalesce({rlike(ustrip(f'cast({c} as varchar)'), pat)}, false)")
    return "\nunion all\n".join(parts)


LISTING_COLUMNS = ("store_id", "store_name", "store_address", "city", "state", "country",
                   "category", "product", "type", "subtype_size", "addition", "product_id",
                   "tmad_id", "currency", "competitor", "price", "zip_code", "postal_ca",
                   "latitude", "longitude", "date_extracted")
REVIEW_COLUMNS = ("store_id", "retailer", "post_id", "post_url", "store_rating", "date_extracted")


def _text_hit(cols, ch) -> str:
    return "(" + " or ".join(f"coalesce(contains({c}, {q(ch)}), false)" for c in cols) + ")"


_LISTING_TEXT = [c for c in TEXT_SYMBOL_FIELDS if c in LISTING_COLUMNS]


def _symbol_counts(src: str, cols, source: str) -> str:
    parts = []
    for pat in TEXT_SYMBOL_PATTERNS:
        parts.append(f"select {q(source)} as source, {q(pat)} as symbol, "
                     f"cast(count(*) filter (where {_text_hit(cols, pat[1:-1])}) as bigint) as n from {src}")
    return "\nunion all\n".join(parts)


ROW_SQL = {
    "clean_listing": with_listing(
        "select sid as store_id, price_num, zip_clean, lat_num, lon_num from cur"),
    "invalid_latitude": with_listing(
        f"select distinct sid as store_id, lat_num as value from cur "
        f"where lat_num < {USA[0]} or lat_num > {USA[1]}"),
    "invalid_longitude": with_listing(
        f"select distinct sid as store_id, lon_num as value from cur "
        f"where lon_num < {USA[2]} or lon_num > {USA[3]}"),
    "outside_geo_box": with_listing(
        f"select distinct sid as store_id, lat_num as latitude, lon_num as longitude from cur "
        f"where {_box_out(USA_LOWER48_BOX)}"),
    "outside_any_geo_box": with_listing(
        f"select distinct sid as store_id, lat_num as latitude, lon_num as longitude from cur "
        f"where {_box_out(USA_LOWER48_BOX)} and {_box_out(ALASKA_BOX)}"),
    "invalid_zip": with_listing(
        f"select distinct sid as store_id, zip_clean as zip_code from cur "
        f"where zip_clean is null or not {rlike('zip_clean', ZIP_PATTERNS['USA'])}"),
    "zip_non_numeric": with_listing(
        f"select distinct zip_code from cur where not {rlike('zip_code', DIGITS)}"),
    "zip_numeric_count": with_listing(
        f"select cast(count(*) filter (where {rlike('zip_code', DIGITS)}) as bigint) as n from cur"),
    "zip_bad_length": with_listing(
        "select distinct zip_code from cur where length(zip_code) <> 5"),
    "postal_format_mix": with_listing(
        f"select case when length(postal_ca) = 7 and {rlike('postal_ca', CA_POSTAL_WITH_SPACE)} then 'with_space' "
        f"when length(postal_ca) = 6 and {rlike('postal_ca', CA_POSTAL_NO_SPACE)} then 'no_space' "
        f"else 'invalid' end as postal_format, count(*) as n from cur where postal_ca is not null group by 1"),
    "null_violations": with_listing(
        _null_union("cur", LISTING_NULL_COLUMNS, LISTING_COLUMNS, _listing_blank)),
    "null_violations_feed": with_listing(
        _null_union("cur", LISTING_NULL_COLUMNS + FEED_NULL_COLUMNS["TMAD"], LISTING_COLUMNS, _listing_blank)),
    "review_null_violations": with_review(
        _null_union("rcur", REVIEW_NULL_COLUMNS, REVIEW_COLUMNS,
                    lambda c: is_blank(f"cast({c} as varchar)")), whole=True),
    "zero_price": with_listing(
        "select distinct sid as store_id from cur where price_num = 0 and sid is not null"),
    "symbol_violations": with_listing(
        _symbol_union("cur", LISTING_SYMBOL_PATTERNS, LISTING_COLUMNS)),
    "feed_symbol_violations": with_listing(
        _symbol_union("cur", {**LISTING_SYMBOL_PATTERNS, **FEED_SYMBOL_PATTERNS["TMAD"]}, LISTING_COLUMNS)),
    "review_symbol_violations": with_review(
        _symbol_union("rcur", REVIEW_SYMBOL_PATTERNS, REVIEW_COLUMNS), whole=True),
    "text_symbol_counts": with_listing(
        _symbol_counts("cur", _LISTING_TEXT, "listing") + "\nunion all\n"
        + _symbol_counts("documents", ["text"], "documents")),
    "text_symbol_rows": "\nunion all\n".join(
        f"select doc_id, {q(pat)} as symbol from documents where coalesce(contains(text, {q(pat[1:-1])}), false)"
        for pat in TEXT_SYMBOL_PATTERNS),
    "long_price": with_listing("select distinct price from cur where length(price) > 5"),
    "price_dollar_sign": with_listing("select distinct price from cur where contains(price, '$')"),
    "price_comma": with_listing("select distinct price from cur where contains(price, ',')"),
    "date_month_mismatch": with_listing(
        "select try_cast(cast(date_extracted as varchar) as date) as date_extracted, count(*) as n from cur "
        "where date_trunc('month', try_cast(cast(date_extracted as varchar) as date)) <> date '2000-07-01' "
        "group by 1"),
    "empty_entity_id": with_listing(
        f"select cast(count(*) filter (where {is_blank('store_id')}) as bigint) as n from cur"),
}


# --------------------------------------------------------------------------
# Group, statistics, duplicate, comparison and top-k rules
# --------------------------------------------------------------------------

LISTING_COLUMN_COUNT = len(LISTING_COLUMNS)


def _quartile(expr: str, p: float) -> str:
    return f"percentile_disc({p}) within group (order by {expr})"


def _fences(q1: str, q3: str, f: float = 1.5) -> tuple:
    return f"({q1} - {f} * ({q3} - {q1}))", f"({q3} + {f} * ({q3} - {q1}))"


_lo_n, _hi_n = _fences("q.q1", "q.q3")

_PRICE_KEYS_WITH = ("store_id", "product_id")
_PRICE_KEYS_WITHOUT = ("store_id", "category", "product", "type", "subtype_size", "addition")


def _price_change(keys) -> str:
    sel = ", ".join("sid as store_id" if k == "store_id" else k for k in keys)
    nn = " and ".join(f"{'sid' if k == 'store_id' else k} is not null" for k in keys)
    grp = ", ".join(str(i + 1) for i in range(len(keys)))
    using = ", ".join(keys)
    outk = ", ".join(f"c.{k}" for k in keys)

    def snap(src):
        return (f"(select {sel}, min(price_num) as price from {src} "
                f"where {nn} and price_num is not null group by {grp})")

    return with_listing(
        f"select {outk}, c.price as current_price, l.price as last_price, l2.price as last2_price "
        f"from {snap('cur')} c join {snap('prev')} l using ({using}) join {snap('prev2')} l2 using ({using}) "
        f"where c.price <> l.price or c.price <> l2.price", snapshots=3)


GROUP_SQL = {
    "snapshot_counts": with_listing(
        f"select 'current' as snapshot, count(*) as row_count, cast({LISTING_COLUMN_COUNT} as bigint) as column_count, "
        f"count(distinct sid) as store_count from (select distinct * from cur) "
        f"union all select 'previous', count(*), {LISTING_COLUMN_COUNT}, count(distinct sid) from prev", snapshots=2),
    "size_change_pct": with_listing(
        "select c as current_count, p as previous_count, "
        "case when c + p > 0 then (c - p) / (c + p) * 100.0 end as pct, "
        "case when c + p = 0 then 'empty' when c > p then 'increased' when c < p then 'decreased' "
        "else 'unchanged' end as status "
        "from (select (select count(*) from (select distinct * from cur)) as c, (select count(*) from prev) as p)",
        snapshots=2),
    "count_margin": with_listing(
        "select c as current_count, p as previous_count, abs(c - p) / greatest(c, p) * 100.0 as pct, "
        "case when greatest(c, p) = 0 then 'empty' when abs(c - p) / greatest(c, p) * 100.0 > 2.0 then 'flag' "
        "else 'ok' end as status "
        "from (select (select count(*) from cur) as c, (select count(*) from prev) as p)", snapshots=2),
    "feed_id_counts": with_listing(
        "select 'current' as snapshot, count(distinct tmad_id) as id_count from cur "
        "union all select 'previous', count(distinct tmad_id) from prev", snapshots=2),
    "retailer_counts": with_review(
        "select c.retailer, c.current_rows, c.current_stores, "
        "cast(coalesce(p.previous_rows, 0) as bigint) as previous_rows, "
        "cast(coalesce(p.previous_stores, 0) as bigint) as previous_stores "
        "from (select retailer, count(*) as current_rows, count(distinct sid) as current_stores "
        "      from (select distinct * from rcur) where retailer is not null group by retailer) c "
        "left join (select retailer, count(*) as previous_rows, count(distinct sid) as previous_stores "
        "      from rprev where retailer is not null group by retailer) p on c.retailer = p.retailer"),
    "competitor_check": with_listing(
        "select cv as current_values, pv as previous_values, "
        "case when cv = 1 and pv = 1 and cm = pm then 'ok' else 'mismatch' end as status "
        "from (select (select count(distinct competitor) from cur) as cv, "
        "(select count(distinct competitor) from prev) as pv, "
        "(select min(competitor) from cur) as cm, (select min(competitor) from prev) as pm)", snapshots=2),
    "competitor_values": with_listing("select distinct competitor from cur"),
    "country_cardinality": with_listing(
        "select count(distinct country) as country_count, "
        "case when count(distinct country) > 1 then 'multiple' else 'ok' end as status from cur"),
    "store_row_counts": with_listing("select sid as store_id, count(*) as n from cur group by sid"),
    "price_quartiles": with_listing(
        f"select {_quartile('price_num', 0.25)} as q1, {_quartile('price_num', 0.75)} as q3 "
        f"from cur where price_num is not null"),
    "store_count_outliers": with_listing(
        f"select s.store_id, s.n from (select sid as store_id, count(*) as n from cur group by sid) s, "
        f"(select {_quartile('n', 0.25)} as q1, {_quartile('n', 0.75)} as q3 "
        f" from (select count(*) as n from cur group by sid)) q "
        f"where s.n < {_lo_n} or s.n > {_hi_n}"),
    "price_outliers": with_listing(
        f"select sid as store_id, price_num from cur, "
        f"(select {_quartile('price_num', 0.25)} as q1, {_quartile('price_num', 0.75)} as q3 "
        f" from cur where price_num is not null) q "
        f"where price_num < {_lo_n} or price_num > {_hi_n}"),
    "store_multi_location": with_listing(
        "select sid as store_id, count(distinct (round(lat_num, 4), round(lon_num, 4))) as unique_locations "
        "from cur where lat_num is not null and lon_num is not null group by sid "
        "having count(distinct (round(lat_num, 4), round(lon_num, 4))) > 1"),
    "location_multi_store": with_listing(
        "select round(lat_num, 4) as lat4, round(lon_num, 4) as lon4, count(distinct sid) as store_count "
        "from cur group by 1, 2 having count(distinct sid) > 1"),
    "store_metadata_conflicts": with_listing(
        "select sid as store_id, count(distinct store_name) as name_count, "
        "count(distinct store_address) as address_count, count(distinct city) as city_count, "
        "count(distinct state) as state_count from cur group by sid "
        "having count(distinct store_name) > 1 or count(distinct store_address) > 1 "
        "or count(distinct city) > 1 or count(distinct state) > 1"),
    "duplicate_listing_groups": with_listing(
        "select addition, category, product, type, subtype_size, sid as store_id, count(*) as n "
        "from cur group by 1, 2, 3, 4, 5, 6 having count(*) > 1"),
    "duplicate_products": with_listing(
        "select distinct store_id from (select sid as store_id, category, product, type, subtype_size "
        "from (select distinct * from cur) group by 1, 2, 3, 4, 5 having count(*) > 1) "
        "where store_id is not null"),
    "uniform_pricing": with_listing(
        "select product, type, subtype_size, count(distinct price_num) as distinct_prices "
        "from cur group by 1, 2, 3 having count(distinct price_num) = 1"),
    "categories_per_product_store": with_listing(
        "select product, sid as store_id, count(distinct category) as category_count from cur group by 1, 2"),
    "scrape_dates": with_listing(
        f"select distinct regexp_split_to_array({ustrip('cast(date_extracted as varchar)')}, '\\s+')[1] "
        f"as date_extracted from cur where date_extracted is not null"),
    "distinct_field_values": with_listing(
        "select distinct 'current' as snapshot, 'competitor' as field, cast(competitor as varchar) as value from cur "
        "union select distinct 'previous', 'competitor', cast(competitor as varchar) from prev", snapshots=2),
    "duplicate_row_count":
        "select cast(coalesce(sum(n - 1), 0) as bigint) as surplus "
        "from (select text, count(*) as n from documents group by text having count(*) > 1)",
    "duplicate_rows":
        "select text, count(*) - 1 as surplus from documents group by text having count(*) > 1",
    "dedupe_rows": "select distinct text from documents",
    "stores_not_in_current": with_listing(
        "select distinct sid as store_id from prev p where not exists (select 1 from cur c where c.sid = p.sid)",
        snapshots=2),
    "missing_store_pct": with_listing(
        "select m as missing_count, t as previous_total, "
        "case when t > 0 then m / t * 100.0 else 0.0 end as pct_missing, "
        "case when (case when t > 0 then m / t * 100.0 else 0.0 end) > 1.0 then 'flag' else 'ok' end as status "
        "from (select (select count(*) from (select sid from prev except select sid from cur)) as m, "
        "(select count(*) from (select distinct sid from prev)) as t)", snapshots=2),
    "stores_with_fewer_rows": with_listing(
        "select distinct sid as store_id from (select sid from prev except all select sid from cur)", snapshots=2),
    "categories_not_in_current": with_listing(
        "select distinct p.sid as store_id, p.category from prev p "
        "where p.sid is not null and p.sid in (select sid from cur where sid is not null) "
        "and not exists (select 1 from cur c where c.sid = p.sid and c.category is not distinct from p.category)",
        snapshots=2),
    "price_change_with_product_id": _price_change(_PRICE_KEYS_WITH),
    "price_change_without_product_id": _price_change(_PRICE_KEYS_WITHOUT),
    "top_prices": with_listing(
        "select distinct price_num from cur where price_num is not null order by price_num desc limit 5"),
}


# --------------------------------------------------------------------------
# Readers and headers (of the delivered files, see fixtures)
# --------------------------------------------------------------------------


def _header_cells() -> str:
    cells = []
    for i, spelled in enumerate(HEADER_SPELLINGS):
        names = ", ".join(q(x) for x in spelled)
        cells.append(f"case when (o_orderkey * {i + 3} + {i}) % 13 <> 0 then [{names}][(o_orderkey // 7) % {len(spelled)} + 1] end")
    return ",\n".join(cells)


_HEADER_CTES = (
    f"with h as (select o_orderkey as file_id, list_filter([{_header_cells()}], lambda x: x is not null) as names, "
    "['|', chr(9), ','][o_orderkey % 3 + 1] as sep from orders),\n"
    "d as (select file_id, replace(array_to_string(names, chr(1)), chr(1), sep) as line from h),\n"
    "dl as (select file_id, line, case when contains(line, '|') then '|' when contains(line, chr(9)) then chr(9) "
    "else ',' end as delim from d),\n"
    "t as (select file_id, unnest(string_split(line, delim)) as field, "
    "generate_subscripts(string_split(line, delim), 1) as position from dl)")


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _aliases(profile) -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in profile.aliases.items())
    return f"(select * from (values {rows}) a(k, v))"


def _standardize(profile) -> str:
    return (f"{_HEADER_CTES}\n"
            f"select t.file_id, t.position, {ustrip('t.field')} as header, "
            f"coalesce(a.v, {ustrip('t.field')}) as canonical "
            f"from t left join {_aliases(profile)} a on a.k = {_norm('t.field')}")


def _na(x: str) -> str:
    toks = ", ".join(q(t) for t in NA_TOKENS)
    return f"(case when {x} in ({toks}) then null else {x} end)"


_REQ = ", ".join(f"({q(c)})" for c in LISTING.null_columns)

HEADER_SQL = {
    "detect_delimiter": f"{_HEADER_CTES}\nselect file_id, delim as delimiter from dl",
    "normalize_headers": (f"{_HEADER_CTES}\nselect file_id, position, {ustrip('field')} as header, "
                          f"{_norm('field')} as normalized from t"),
    "standardize_listing": _standardize(LISTING),
    "standardize_review": _standardize(REVIEW),
    "missing_columns": (
        f"{_HEADER_CTES},\n"
        f"canon as (select distinct t.file_id, coalesce(a.v, {ustrip('t.field')}) as canonical "
        f"from t left join {_aliases(LISTING)} a on a.k = {_norm('t.field')})\n"
        f"select dl.file_id, r.c as column_name from dl, (select * from (values {_REQ}) r(c)) r "
        f"where not exists (select 1 from canon where canon.file_id = dl.file_id and canon.canonical = r.c)"),
    "read_listing_csv": with_listing(
        f"select {_na('store_id')} as store_id, {_na('product_id')} as product_id, "
        f"{_na('price')} as price, {_na('zip_code')} as zip_code from cur"),
    "read_quoted_csv": f"select doc_id, {_na('text')} as text from documents",
}


# --------------------------------------------------------------------------
# Suites: findings per check, as the union of the checks' own SQL
# --------------------------------------------------------------------------

from ..profiles import SEVERITY, STORE_METADATA_COLUMNS  # noqa: E402


def _count_union(parts) -> str:
    """``(check_id, n)`` for every part with at least one finding row."""
    union = "\nunion all\n".join(
        f"select {q(cid)} as check_id, count(*) as n from ({body}) x" for cid, body in parts)
    return f"select check_id, n from ({union}) u where n > 0"


def _with_severity(parts) -> str:
    union = "\nunion all\n".join(
        f"select {q(SEVERITY[cid])} as severity, {q(cid)} as check_id, count(*) as n from ({body}) x"
        for cid, body in parts)
    return f"select severity, check_id, n from ({union}) u where n > 0"


def _absent(required, present) -> list:
    return [c for c in dict.fromkeys(required) if c and c not in present]


def _missing_rows(required, present) -> str:
    miss = _absent(required, present)
    if not miss:
        return "select 1 where false"
    return " union all ".join(f"select {q(c)} as column_name" for c in miss)


def _b(key: str) -> str:
    stmt = ROW_SQL.get(key) or GROUP_SQL.get(key)
    return body_of(stmt)


_LISTING_REQUIRED = (list(LISTING.null_columns) + list(LISTING.symbol_patterns)
                     + ["store_id", "competitor", "date_extracted"] + ["store_id", "category", "product",
                                                                       "type", "subtype_size"]
                     + ["latitude", "longitude", "zip_code"])

_LISTING_SUITE_PARTS = [
    ("missing_column", _missing_rows(_LISTING_REQUIRED, LISTING_COLUMNS)),
    ("duplicate_rows", f"select 1 from cur_raw group by {', '.join(LISTING_COLUMNS)} having count(*) > 1"),
    ("competitor_check", f"select * from ({_b('competitor_check')}) z where status = 'mismatch'"),
    ("country_cardinality", f"select * from ({_b('country_cardinality')}) z where status = 'multiple'"),
    ("invalid_latitude", _b("invalid_latitude")),
    ("invalid_longitude", _b("invalid_longitude")),
    ("invalid_zip", _b("invalid_zip")),
    ("null_violations", _b("null_violations")),
    ("symbol_violations", _b("symbol_violations")),
    ("zero_price", _b("zero_price")),
    ("duplicate_products", _b("duplicate_products")),
    ("stores_not_in_current", _b("stores_not_in_current")),
    ("categories_not_in_current", _b("categories_not_in_current")),
    ("scrape_dates", _b("scrape_dates")),
]

_REVIEW_REQUIRED = (list(REVIEW.null_columns) + list(REVIEW.symbol_patterns)
                    + ["store_id", "retailer", "date_extracted", "latitude", "longitude", "zipcode"])

_REVIEW_SUITE_PARTS = [
    ("missing_column", _missing_rows(_REVIEW_REQUIRED, REVIEW_COLUMNS)),
    ("duplicate_rows", f"select 1 from rcur_raw group by {', '.join(REVIEW_COLUMNS)} having count(*) > 1"),
    ("retailer_check",
     "select 1 from (select (select count(distinct retailer) from rcur) as cv, "
     "(select count(distinct retailer) from rprev) as pv, (select min(retailer) from rcur) as cm, "
     "(select min(retailer) from rprev) as pm) z where not (cv = 1 and pv = 1 and cm = pm)"),
    ("null_violations", body_of(ROW_SQL["review_null_violations"])),
    ("symbol_violations", body_of(ROW_SQL["review_symbol_violations"])),
    ("stores_not_in_current",
     "select distinct sid from rprev p where not exists (select 1 from rcur c where c.sid = p.sid)"),
    ("scrape_dates",
     f"select distinct regexp_split_to_array({ustrip('cast(date_extracted as varchar)')}, '\\s+')[1] "
     f"from rcur where date_extracted is not null"),
]

_STAT_REQUIRED = (["store_id", "price", "zip_code", "date_extracted", "latitude", "longitude", "competitor"]
                  + list(STORE_METADATA_COLUMNS) + ["addition", "category", "product", "type", "subtype_size"]
                  + list(TEXT_SYMBOL_FIELDS))

_STAT_SUITE_PARTS = [
    ("missing_column", _missing_rows(_STAT_REQUIRED, LISTING_COLUMNS)),
    ("date_month_mismatch", _b("date_month_mismatch")),
    ("scrape_dates", _b("scrape_dates")),
    ("scrape_dates_previous", _b("scrape_dates").replace("from cur", "from prev")),
    ("distinct_field_values", _b("distinct_field_values")),
    ("count_margin", f"select * from ({_b('count_margin')}) z where status = 'flag'"),
    ("store_count_outliers", _b("store_count_outliers")),
    ("price_outliers", _b("price_outliers")),
    ("long_price", _b("long_price")),
    ("long_price_previous", _b("long_price").replace("from cur", "from prev")),
    ("price_dollar_sign", _b("price_dollar_sign")),
    ("price_comma", _b("price_comma")),
    ("zip_non_numeric", _b("zip_non_numeric")),
    ("zip_bad_length", _b("zip_bad_length")),
    ("store_multi_location", _b("store_multi_location")),
    ("location_multi_store", _b("location_multi_store")),
    ("outside_geo_box", _b("outside_geo_box")),
    ("missing_store_pct", f"select * from ({_b('missing_store_pct')}) z where status = 'flag'"),
    ("stores_with_fewer_rows", _b("stores_with_fewer_rows")),
    ("empty_entity_id", f"select * from ({_b('empty_entity_id')}) z where n > 0"),
    ("store_metadata_conflicts", _b("store_metadata_conflicts")),
    ("duplicate_listing_groups", _b("duplicate_listing_groups")),
    ("uniform_pricing", _b("uniform_pricing")),
    ("text_symbol_counts", f"select * from ({_symbol_counts('cur', _LISTING_TEXT, 'listing')}) z where n > 0"),
]

def _found(check_id, body, column="null", entity="null", value="null", detail="null") -> str:
    cols = ", ".join(f"cast({x} as varchar) as {n}" for x, n in
                     ((column, "column_name"), (entity, "entity_id"), (value, "value"), (detail, "detail")))
    return f"select {q(check_id)} as check_id, {q(SEVERITY[check_id])} as severity, {cols} from ({body}) f"


_LISTING_BODY = dict(_LISTING_SUITE_PARTS)
_SURPLUS = f"select count(*) - 1 as surplus from cur_raw group by {', '.join(LISTING_COLUMNS)} having count(*) > 1"

#: The listing suite's checks in order, with what each writes into the findings.
_LISTING_FINDINGS = [
    ("duplicate_rows", _SURPLUS, {"value": "surplus"}),
    ("missing_column", _missing_rows(_LISTING_REQUIRED, LISTING_COLUMNS).replace("select 1 where", "select null as column_name where"),
     {"column": "column_name"}),
    ("competitor_check", None, {"column": "'competitor'", "detail": "printf('current=%d previous=%d', current_values, previous_values)"}),
    ("country_cardinality", None, {"column": "'country'", "value": "country_count"}),
    ("invalid_latitude", None, {"column": "'latitude'", "entity": "store_id", "value": "value"}),
    ("invalid_longitude", None, {"column": "'longitude'", "entity": "store_id", "value": "value"}),
    ("invalid_zip", None, {"column": "'zip_code'", "entity": "store_id", "value": "zip_code"}),
    ("null_violations", None, {"column": "column_name", "entity": "store_id"}),
    ("symbol_violations", None, {"column": "column_name", "entity": "store_id"}),
    ("zero_price", None, {"column": "'price'", "entity": "store_id"}),
    ("duplicate_products", None, {"entity": "store_id"}),
    ("categories_not_in_current", None, {"column": "'category'", "entity": "store_id", "value": "category"}),
    ("stores_not_in_current", None, {"entity": "store_id"}),
    ("scrape_dates", None, {"value": "date_extracted"}),
]
_FINDINGS = "\nunion all\n".join(_found(c, body or _LISTING_BODY[c], **cols) for c, body, cols in _LISTING_FINDINGS)


def _label(name, label):
    return f"coalesce(' {label}=' || {name}, '')"


_FINDING_LINE = (f"'[' || upper(severity) || '] ' || check_id || {_label('column_name', 'column')} || {_label('entity_id', 'entity')} || "
                 f"{_label('value', 'value')} || coalesce(' ' || detail, '')")


def _measured(check_id, metric, body, current="null", previous="null", measured="null", status="null") -> str:
    def num(x, label):
        return f"coalesce(' {label}=' || printf('%.2f', cast({x} as double)), '')"

    line = (f"'[METRIC] ' || {metric} || {num(current, 'current')} || {num(previous, 'previous')} || {num(measured, 'measured')} || "
            f"coalesce(' status=' || {status}, '')")
    return f"select {q(check_id)} as check_id, {line} as line from ({body}) m"


_METRIC_LINES = "\nunion all\n".join([
    _measured("duplicate_rows", "'surplus_rows'", f"select coalesce(sum(surplus), 0) as n from ({_SURPLUS}) s", measured="n"),
    _measured("competitor_check", "'distinct_values'", _b("competitor_check"), "current_values", "previous_values", status="status"),
    *[_measured("snapshot_counts", f"snapshot || '_{what}s'", _b("snapshot_counts"), measured=f"{what}_count")
      for what in ("row", "store", "column")],
    _measured("size_change_pct", "'pct'", _b("size_change_pct"), "current_count", "previous_count", "pct", "status"),
])
_REPORT_CHECKS = ["duplicate_rows", *(["missing_column"] if _absent(_LISTING_REQUIRED, LISTING_COLUMNS) else []), "competitor_check", "snapshot_counts", "size_change_pct", "country_cardinality", "invalid_latitude",
                  "invalid_longitude", "invalid_zip", "null_violations", "symbol_violations", "zero_price", "duplicate_products",
                  "categories_not_in_current", "stores_not_in_current", "scrape_dates"]
_REPORT = (
    f"select * from (with f as (select *, {_FINDING_LINE} as line from ({_FINDINGS}) x), m as ({_METRIC_LINES}),\n"
    f"s as (select check_id, cast(i as integer) as section from (values {', '.join(f'({q(c)}, {i})' for i, c in enumerate(_REPORT_CHECKS, 1))}) "
    "v(check_id, i)),\n"
    "n as (select s.check_id, s.section, count(f.check_id) as n, max(f.severity) as severity from s left join f using (check_id) group by 1, 2)\n"
    "select section, 0 as part, '----- Start: ' || check_id || ' -----' as line from n\n"
    "union all select section, 1, case when n = 0 then '[PASS] ' || check_id || ': nothing found' "
    "else '[' || upper(severity) || '] ' || check_id || ': ' || n || ' found' end from n\n"
    "union all select section, 2, m.line from m join s using (check_id)\n"
    "union all select section, 3, f.line from f join s using (check_id)\n"
    "union all select section, 4, '----- End: ' || check_id || ' -----' from n\n"
    "union all select 0, 0, '===== STARTING VALIDATION ====='\n"
    "union all select 1000000, 4, '===== VALIDATION COMPLETE =====') r")


def _state_facts() -> str:
    """Rows of each store, of each (store, value) of the store fields, and of the single values kept."""
    pairs = "".join(f"union all select {q(x)}, sid, cast({x} as varchar), count(*) from cur group by sid, {x}\n"
                    for x in ("category", "competitor", "tmad_id"))
    day = f"regexp_split_to_array({ustrip('cast(date_extracted as varchar)')}, '\\s+')[1]"
    return ("select 'store' as field, sid as store_id, cast(null as varchar) as value, count(*) as n from cur group by sid\n"
            f"{pairs}union all select 'date_extracted', null, {day}, count(*) from cur where date_extracted is not null group by 3\n"
            "union all select 'price', null, price, count(*) from cur where length(price) > 5 group by price")


SUITE_SQL = {
    "snapshot_state": with_listing(_state_facts()),
    "listing_suite_from_state": with_listing(_count_union(_LISTING_SUITE_PARTS), snapshots=2, dedupe_current=True),
    "stat_suite_from_state": with_listing(_count_union(_STAT_SUITE_PARTS), snapshots=2),
    "listing_suite_summary": with_listing(_count_union(_LISTING_SUITE_PARTS), snapshots=2, dedupe_current=True),
    "findings_by_severity": with_listing(_with_severity(_LISTING_SUITE_PARTS), snapshots=2, dedupe_current=True),
    "review_suite_summary": with_review(_count_union(_REVIEW_SUITE_PARTS), dedupe_current=True),
    "stat_suite_summary": with_listing(_count_union(_STAT_SUITE_PARTS), snapshots=2),
    "findings_sample": with_listing(
        "select check_id, severity, column_name, entity_id, value, detail from (select *, row_number() over (partition by check_id "
        "order by entity_id nulls first, value nulls first, column_name nulls first, detail nulls first) as rn "
        f"from ({_FINDINGS}) x) y where rn <= 5", snapshots=2, dedupe_current=True),
    "report_lines": with_listing(f"select {_FINDING_LINE} as line from ({_FINDINGS}) x", snapshots=2, dedupe_current=True),
    "listing_report": with_listing(_REPORT, snapshots=2, dedupe_current=True),
}
