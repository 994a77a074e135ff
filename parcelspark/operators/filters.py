"""Filters, search, suggestions, facets, sorting and paging of listings, and rules on URLs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_all

RANGES = {"price": "price", "area": "area_sqm", "ppsqm": "price_per_sqm", "beds": "bedrooms", "baths": "bathrooms"}
SETS = {"quota": "quota", "deal": "deal_type", "source": "source", "khet": "khet"}


def matches(filters: dict) -> Column:
    """A predicate from {"priceMin": 1, "bedsMax": 2, "khet": {...}}: unknown values pass ranges, but bedrooms and
    bathrooms count as 0 where unknown; sets want a known member."""
    parts = [F.lit(True)]
    for name, column in RANGES.items():
        value = F.coalesce(F.col(column), F.lit(0)) if name in ("beds", "baths") else F.col(column)
        for end, op in (("Min", "__ge__"), ("Max", "__le__")):
            if filters.get(name + end) is not None:
                parts.append(value.isNull() | getattr(value, op)(F.lit(filters[name + end])))
    for name, column in SETS.items():
        if filters.get(name):
            parts.append(F.coalesce(F.col(column).isin(sorted(filters[name])), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def to_query_string(filters: dict) -> str:
    """Filters as a query string: sets as comma-joined sorted members, absent ones left out."""
    out = {k: ",".join(sorted(v)) if k in SETS else f"{v:g}" for k, v in filters.items() if v not in (None, set(), "")}
    return urlencode(sorted(out.items()))


def from_query_string(text: str) -> dict:
    """The filters of a query string; what is no number or no filter is left out."""
    out: dict = {}
    for key, values in parse_qs(text).items():
        if key in SETS:
            out[key] = {x for x in values[-1].split(",") if x}
        elif key[:-3] in RANGES and key[-3:] in ("Min", "Max"):
            try:
                out[key] = float(values[-1])
            except ValueError:
                continue
    return out


def map_matches(price_min: float = 0, price_max: float = float("inf"), beds: int | None = None, metro_max: float | None = None) -> Column:
    """The map's filter: an unknown price is 0, unknown bedrooms match no number, an unknown distance is too far."""
    p = F.coalesce(F.col("price"), F.lit(0.0))
    out = (p >= price_min) & (p <= price_max)
    if beds is not None:
        out = out & (F.coalesce(F.col("bedrooms"), F.lit(-1)) == beds)
    return out if metro_max is None else out & (F.coalesce(F.col("metro_m"), F.lit(float("inf"))) <= metro_max)


def search(rows: DataFrame, text: str, fields: tuple[str, ...] = ("condo_name", "khet", "street", "source")) -> DataFrame:
    """Rows that hold every word of `text` in their fields."""
    return rows.where(contains_all([F.col(c) for c in fields], F.lit(text)))


def suggestions(rows: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Distinct (kind, value) that hold `text`, streets before buildings before districts, then by value; values that
    differ in case alone are one, the least of them. A blank text suggests nothing."""
    wanted = text.strip().lower()
    kinds = {"street": "street", "condo": "condo_name", "district": "khet"}
    stacked = ", ".join(f"{i}, '{k}', {c}" for i, (k, c) in enumerate(kinds.items()))
    long = rows.select(F.expr(f"stack({len(kinds)}, {stacked}) as (place, kind, value)"))
    hit = long.where(F.contains(F.lower("value"), F.lit(wanted)) & F.lit(wanted != ""))
    hit = hit.groupBy("place", "kind", F.lower("value").alias("low")).agg(F.min("value").alias("value"))
    return hit.orderBy("place", "value").limit(limit).select("kind", "value")


def in_scope(deals: DataFrame, khet: str | None = None, price_min: str = "", price_max: str = "", text: str = "") -> DataFrame:
    """Deals of a district, between prices typed in millions, whose name holds `text`; what is blank or no number is
    no bound."""
    out = deals.where(F.col("khet") == khet) if khet else deals
    for typed, op in ((price_min, "__ge__"), (price_max, "__le__")):
        if (bound := millions(typed)) is not None:
            out = out.where(getattr(F.col("price"), op)(bound))
    wanted = text.strip().lower()
    return out.where(F.contains(F.lower(F.coalesce("condo_name", F.lit(""))), F.lit(wanted))) if wanted else out


def millions(typed: str) -> float | None:
    """A number typed in millions, a comma for a point; null if it is none or not over zero."""
    try:
        value = float(typed.replace(",", ".").strip())
    except ValueError:
        return None
    return value * 1e6 if value > 0 else None


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value): the distinct districts and sources."""
    kinds = "stack(2, 'khet', khet, 'source', source) as (facet, value)"
    return rows.select(F.expr(kinds)).where("value is not null").distinct()


def slider_bounds(rows: DataFrame) -> DataFrame:
    """Least and most of the columns that have a range filter, in one pass."""
    return rows.agg(*[f(c).alias(f"{c}_{n}") for c in RANGES.values() for n, f in (("min", F.min), ("max", F.max))])


def sorted_page(rows: DataFrame, column: str, descending: bool, page: int, size: int = 200, key: str = "id") -> DataFrame:
    """A page of the rows in the order of a column; nulls are below all values, ties in the order of the key."""
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return rows.orderBy(by, key).offset(page * size).limit(size)


def rule_pattern(rule: Column) -> Column:
    """A robots.txt path rule as a regular expression: * is anything, a closing $ the end, all else literal."""
    open_end = F.when(F.endswith(rule, F.lit("$")), F.substr(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    literal = F.regexp_replace(open_end, r"([.+?^$()\[\]{}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(F.endswith(rule, F.lit("$")), "$").otherwise(""))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rule, allow) that hold for an agent, from whole robots.txt files (host, text).

    Groups of user-agent lines share the rules behind them. The first group that names the agent holds, else that of *.
    """
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(F.split_part(x, F.lit("#"), F.lit(1))))
    rows = files.select("host", F.posexplode(F.filter(lines, lambda x: F.contains(x, F.lit(":")))).alias("at", "line"))
    key = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    value = F.regexp_replace(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1), r"(?U)^\s+|\s+$", "")
    rows = rows.select("host", "at", key.alias("key"), value.alias("value")).where("key in ('user-agent', 'allow', 'disallow')")
    order = W.partitionBy("host").orderBy("at")
    is_agent = F.col("key") == "user-agent"
    first = is_agent & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    rows = rows.withColumn("group", F.sum(first.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("group > 0")
    names = rows.where(is_agent).select("host", "group", "at", F.lower("value").alias("name"))
    short = agent.split("/")[0].strip().lower()
    named = (F.col("name") != "*") & (F.col("name") != "") & (F.contains(F.lit(short), F.col("name")) | F.contains(F.col("name"), F.lit(short)))
    aimed = names.groupBy("host").agg(F.min_by(F.when(named, F.col("name")), F.when(named, F.col("at"))).alias("aim"))
    held = names.join(aimed, "host").where(F.col("name") == F.coalesce("aim", F.lit("*"))).select("host", "group").distinct()
    return rows.where(~is_agent).join(held, ["host", "group"]).select("host", F.col("value").alias("rule"), (F.col("key") == "allow").alias("allow"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): the matching rule with the most characters but * and $ decides, allow before disallow; no
    rule allows, and an empty rule is none.

    rules: (host, rule, allow); urls: (host, path). They meet on the host, whose rules are few.
    """
    own = rules.where("rule <> ''").withColumn("pattern", rule_pattern(F.col("rule")))
    hit = urls.distinct().join(own, "host").where(F.expr("path rlike pattern"))
    weight = F.struct(F.length(F.regexp_replace("rule", r"[*$]", "")), F.col("allow").cast("int"))
    best = hit.groupBy("host", "path").agg(F.max_by("allow", weight).alias("allowed"))
    return urls.distinct().join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def without_fragments(rows: DataFrame, fields: list[str], fragments: list[str]) -> DataFrame:
    """Rows none of whose fields holds a fragment, in any case."""
    blob = F.lower(F.concat_ws(" ", *fields))
    hit = reduce(lambda a, b: a | b, [F.contains(blob, F.lit(f.lower())) for f in fragments], F.lit(False))
    return rows.where(~hit)


def sample_balanced(rows: DataFrame, label: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each label in the order of a seeded hash: the same rows each time."""
    w = W.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
