"""Rosters of many shapes: ragged lists, duplicates, rankings, verdicts on places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, cascade

#: Labels of a ranking's details, the column of each and the scale to whole units.
DETAILS = {"team assets": ("team_assets_bil", 1e9), "typical account": ("typical_account_mil", 1e6), "typical net worth": ("typical_net_worth_mil", 1e6)}
#: Kinds of result that are an area, not an address; kinds that are a business; states filed as countries.
AREAS = ["locality", "sublocality", "postal_code", "postal_code_prefix", "administrative_area_level_1", "administrative_area_level_2", "administrative_area_level_3", "country", "political", "neighborhood"]
BUSINESSES = ["establishment", "point_of_interest"]
TERRITORIES = ["PR", "VI", "GU", "MP", "AS"]


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _common_prefix(a: Column, b: Column, most: int = 40) -> Column:
    same = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)) & (F.length(a) >= i) & (F.length(b) >= i))
    return F.size(F.filter(same, lambda x: x))


def best_site_name(url: Column, candidates: Column) -> Column:
    """Which of several names belongs to a site: one contains the other, or five letters agree; the last of equals, the last of all if none."""
    slug = _key(F.element_at(F.split(url, "/"), -1))
    rated = F.transform(F.filter(candidates, lambda n: _key(n) != ""), lambda n, i: F.struct(
        F.when(F.contains(_key(n), slug) | F.contains(slug, _key(n)), 3).when(_common_prefix(slug, _key(n)) >= 5, 2).otherwise(0).alias("hit"), i.alias("i"), n.alias("n"),
    ))
    best = F.array_max(rated)
    return F.when((slug == "") | (F.size(rated) == 0) | (best["hit"] == 0), F.try_element_at(candidates, F.lit(-1))).otherwise(best["n"])


def team_sites(df: DataFrame, order: str, names: str, urls: str, mark: str = "!") -> DataFrame:
    """(url, name): the team of each site from two lists in one cell each.

    Rows whose lists are of one length decide, the earliest first; only sites that none of them
    covers are named by rows of unequal lists, by likeness to the site.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), mark), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = df.select(F.col(order).alias("__at"), split(names).alias("n"), split(urls).alias("u")).filter(F.size("u") > 0)
    even = rows.filter(F.size("n") == F.size("u")).select("__at", F.posexplode(F.arrays_zip("n", "u")).alias("i", "x"))
    sure = even.groupBy(F.col("x.u").alias("url")).agg(F.min_by("x.n", F.struct("__at", "i")).alias("name"))
    single = F.filter("n", lambda x, i: (i == 0) | (x != F.coalesce(F.get("n", i - 1), F.lit(""))))
    odd = rows.filter(F.size("n") != F.size("u")).select("__at", single.alias("n"), F.posexplode("u").alias("i", "url"))
    odd = odd.join(sure.select("url"), "url", "left_anti").withColumn("name", best_site_name(F.col("url"), F.col("n"))).filter("name is not null")
    return sure.unionByName(odd.groupBy("url").agg(F.min_by("name", F.struct("__at", "i")).alias("name")))


def merged(df: DataFrame, order: str, keys: list[Column], fields: list[str]) -> DataFrame:
    """One row for each identity: the first of ``keys`` that a row has; each field is the first that is filled."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    identity = F.coalesce(*[F.when(blank(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.lower(F.trim(k)))) for i, k in enumerate(keys)])
    rows = df.withColumn("identity", identity).filter("identity is not null")
    first = [F.min_by(blank(F.col(f)), F.when(blank(F.col(f)).isNotNull(), F.col(order))).alias(f) for f in fields]
    return rows.groupBy("identity").agg(F.count("*").alias("rows"), *first)


def detail_columns(detail: Column, fields: dict[str, tuple[str, float]] = DETAILS) -> dict[str, Column]:
    """Columns from a map of labelled details: labels go by how they begin, numbers by their digits, units by the label."""
    stem = lambda label: F.lower(F.trim(F.regexp_replace(label, r"\(.*?\)", "")))
    pick = lambda test: F.try_element_at(F.map_values(F.map_filter(F.coalesce(detail, F.create_map().cast("map<string,string>")), lambda k, v: test(stem(k)))), F.lit(-1))
    number = lambda v: F.nullif(F.regexp_replace(v, "[^0-9.]", ""), F.lit("")).try_cast("double")
    out: dict[str, Column] = {}
    for label, (column, scale) in fields.items():
        out[column] = number(pick(_begins(label)))
        out[column.rsplit("_", 1)[0] + "_usd"] = out[column] * F.lit(scale)
    out["client_types"] = F.trim(pick(_begins("client type")))
    out["prior_rank"] = number(pick(lambda s: s.rlike(r"^\d{4} rank$")))
    return out


def _begins(label: str):
    return lambda s: s.startswith(label)


def place_verdict(answer: Column, filed: Column) -> dict[str, Column]:
    """lat, lon, precision, check and note of a geocoder's answer against the address as filed.

    ``answer`` has (status, types, number, state, country, city, postal, lat, lon, location_type),
    ``filed`` (number, state, city, postal). Areas and other states are refused; so are a wrong ZIP
    and city together. A wrong house number or a mere business match keeps its place and loses the
    claim of a rooftop.
    """
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    want = up(filed["state"])
    got = F.when(want.isin(*TERRITORIES), up(answer["country"])).otherwise(up(answer["state"]))
    got_zip, filed_zip = F.substring(F.coalesce(answer["postal"], F.lit("")), 1, 5), F.coalesce(filed["postal"], F.lit(""))
    got_city = up(answer["city"])
    types = F.coalesce(answer["types"], F.array().cast("array<string>"))
    refused = cascade([
        Rule("no answer", F.coalesce(answer["status"], F.lit("")) != "OK"),
        Rule("centroid", (F.size(types) > 0) & (F.size(F.array_except(types, F.array(*map(F.lit, AREAS)))) == 0)),
        Rule("state mismatch", (got != "") & (got != want)),
        Rule("zip and city mismatch", (got_zip != "") & (filed_zip != "") & (got_zip != filed_zip) & ((got_city == "") | (got_city != up(filed["city"])))),
        Rule("no geometry", answer["lat"].isNull() | answer["lon"].isNull()),
    ])
    bare = lambda c: F.replace(up(c), F.lit(" "), F.lit(""))
    ours, theirs = bare(filed["number"]), bare(answer["number"])
    doubt = cascade([
        Rule("STREET LEVEL", (ours != "") & (theirs == "")),
        Rule("HOUSE NUMBER MISMATCH", (ours != "") & (theirs != ours) & ~F.array_contains(F.split(theirs, "-"), ours)),
        Rule("POI MATCH", (ours == "") & F.arrays_overlap(types, F.array(*map(F.lit, BUSINESSES)))),
    ])
    fine = refused.isNull()
    precision = F.when(doubt.isNull() & (answer["location_type"] == "ROOFTOP"), "rooftop").otherwise("approximate")
    return {
        "lat": F.when(fine, F.bround(answer["lat"], 6)), "lon": F.when(fine, F.bround(answer["lon"], 6)), "precision": F.when(fine, precision),
        "check": F.when(fine, F.coalesce(doubt, F.lit(""))).otherwise("REJECTED"), "note": refused,
    }


def nearest_of(points: DataFrame, bases: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Each point with its nearest base (base, b_lat, b_lon), by flat distance, the lesser name among equals.

    Bases are a fixed list of places and few; each point is compared with all of them in one array.
    """
    listed = bases.agg(F.collect_list(F.struct("base", "b_lat", "b_lon")).alias("__bases"))
    far = lambda b: F.pow(b["b_lat"] - F.col(lat), F.lit(2.0)) + F.pow((b["b_lon"] - F.col(lon)) * F.cos(F.radians(F.col(lat))), F.lit(2.0))
    best = F.array_min(F.transform("__bases", lambda b: F.struct(far(b).alias("d"), b["base"].alias("base"))))
    return points.crossJoin(F.broadcast(listed)).select(key, best["base"].alias("base"))


def drop_label_columns(df: DataFrame, roster: str, column: str, city: str, least: int = 50, variety: float = 0.15, echo: float = 0.5) -> DataFrame:
    """``df`` with ``column`` emptied in rosters where it lists departments or repeats the city.

    A roster's column goes if at least ``least`` rows fill it and its values are fewer than ``variety``
    of them, or more than ``echo`` of them equal the city in letters and digits.
    """
    filled = df.filter(F.trim(F.col(column)) != "")
    # values are folded first, so a large roster is not one task's work
    values = filled.groupBy(roster, column).agg(F.count("*").alias("n"), F.count_if(_key(F.col(column)) == _key(F.coalesce(F.col(city), F.lit("")))).alias("same"))
    sizes = values.groupBy(roster).agg(F.sum("n").alias("__n"), F.count("*").alias("__values"), F.sum("same").alias("__same"))
    poor = sizes.filter((F.col("__n") >= least) & ((F.col("__values") < F.col("__n") * variety) | (F.col("__same") > F.col("__n") * echo))).select(roster, F.lit(True).alias("__poor"))
    out = df.join(poor, roster, "left")
    return out.withColumn(column, F.when(F.col("__poor"), F.lit("")).otherwise(F.col(column))).drop("__poor")
