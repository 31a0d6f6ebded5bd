"""Entity resolution: blocking, scoring, deciding, merging, calibrating."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts, display, names
from .relational import cut
from .rivals import ANY, boxes, cells, name_pairs, two_best


@dataclass(frozen=True)
class MatchConfig:
    """Weights of the evidence, and the gates of a decision."""

    name: float = 0.42
    firm: float = 0.30
    city: float = 0.13
    state: float = 0.15
    generation: float = 0.18
    accept: float = 0.72
    margin: float = 0.12
    namesakes: int = 3
    near_name: float = 0.8


def candidates(published: DataFrame, index: DataFrame, key: str = "last_key") -> DataFrame:
    """Pairs that share a surname key; keys come exploded on both sides."""
    return published.join(index, key)


def score(name: Column, firm: Column, city: Column, state: Column, generation: Column, config: MatchConfig = MatchConfig()) -> Column:
    """Weighted evidence; without firm evidence (null) the other weights are scaled up."""
    rest = name * config.name + city * config.city + state * config.state
    scaled = rest / F.lit(config.name + config.city + config.state)
    return F.when(firm.isNull(), scaled).otherwise(rest + firm * config.firm) + generation * config.generation


def decide(scored: DataFrame, key: str, candidate: str, config: MatchConfig = MatchConfig(), copies: str | None = None) -> DataFrame:
    """The best candidate per key with gap, namesakes and tier (high, review or none).

    Candidates whose names disagree outright are none. Any best candidate that does not pass is for
    review; a key without candidates keeps a row of its own. ``copies``: a column that says for how
    many candidates a row stands, ``candidate`` being the least.
    """
    n = F.col(copies) if copies else F.lit(1)
    able = F.col("name_score") > 0
    rated = scored.withColumn("__able", able).withColumn("score", F.when(able, F.col("score")))
    w = Window.partitionBy(key).orderBy(F.desc("__able"), F.desc("score"), F.asc(candidate))
    whole = Window.partitionBy(key)
    out = rated.withColumn("namesakes", F.sum(F.when(F.col("name_score") >= config.near_name, n).otherwise(0)).over(whole).cast("long"))
    following = F.when(n > 1, F.col("score")).otherwise(F.lead("score").over(w))
    out = out.withColumn("gap", F.col("score") - F.coalesce(following, F.lit(0.0))).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    passed = (F.col("score") >= config.accept) & (F.col("gap") >= config.margin) & (F.col("namesakes") <= config.namesakes)
    tier = F.when(~F.col("__able"), "none").when(passed, "high").otherwise("review")
    out = out.withColumn("tier", tier).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("gap", F.coalesce("gap", F.lit(0.0)))
    return out.withColumn(candidate, F.when(F.col("__able"), F.col(candidate))).drop("__rn", "__able")


def confirm(decided: DataFrame, truth: DataFrame, key: str, candidate: str) -> DataFrame:
    """Keys whose id is known take it, with tier confirmed and score 1; ``inferred`` is what was found without."""
    known = truth.select(F.col(key), F.col(candidate).alias("__known"))
    out = decided.join(known, key, "left").withColumn("inferred", F.col(candidate)).withColumn("inferred_score", F.col("score"))
    sure = F.col("__known").isNotNull()
    return out.withColumns({candidate: F.coalesce("__known", candidate), "tier": F.when(sure, "confirmed").otherwise(F.col("tier")), "score": F.when(sure, 1.0).otherwise(F.col("score"))}).drop("__known")


#: Contacts: their firm is known exactly, and namesakes count for less.
CONTACT = MatchConfig(name=0.45, firm=0.30, city=0.10, state=0.15, namesakes=25)
#: The name score of a person whose surname is in the address and whose firm agrees.
BY_ADDRESS = 0.60
#: Contact rows or candidates of one task: their names are parsed before any shuffle, and take few bytes but long.
CONTACT_ROWS = 20_000


def resolved_names(people: DataFrame, index: DataFrame, key: str, name: str = "name", surname: str = "last_key") -> DataFrame:
    """``people`` with ``last_key`` and ``given``: the parse of the name whose surname the index has.

    Up to two trailing comma parts may go for that; a name without such a parse is taken as it is.
    """
    parts = F.split(name, ",")
    tries = [F.col(name), *[F.when(F.size(parts) > cut, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - cut, F.lit(1))), ",")) for cut in (1, 2)]]
    rows = people.select(F.col(key), F.posexplode(F.array(*tries)).alias("at", "said")).filter("said is not null")
    bare = contacts.without_credentials(F.col("said"))
    rows = rows.select(key, "at", F.coalesce(names.surname(bare), F.lit("")).alias("last"), names.given(bare).alias("given"))
    known = index.select(F.col(surname).alias("last")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "last", "left").withColumn("known", F.coalesce("known", F.lit(False)) & (F.col("last") != ""))
    # a known surname first, then any where the whole name gives none, then the whole name
    rank = F.when(F.col("known"), 0).when((F.col("at") > 0) & (F.col("last") != ""), 2).when((F.col("at") == 0) & (F.col("last") != ""), 1).otherwise(3)
    best = rows.groupBy(key).agg(F.min_by(F.struct("last", "given"), F.struct(rank, F.col("at"))).alias("b"))
    return people.join(best.select(key, F.col("b.last").alias(surname), F.col("b.given").alias("given")), key, "left")


def match_contacts(people: DataFrame, index: DataFrame, key: str = "contact", candidate: str = "id", config: MatchConfig = CONTACT) -> DataFrame:
    """The person behind each contact row: (key, candidate, tier, score, gap, namesakes).

    ``people`` has (key, name, email, firm, city, state, given_id), ``index`` (last_key, candidate,
    forms, firms, cities, states, suffix) with one row for each candidate and surname. An id that the
    row states is taken if the index has it. Else candidates of the surname are scored; where the names
    disagree, an address with that surname at a firm of the candidate still counts a little. Rows look
    their candidates up in cells (``rivals``), so that a surname costs its rows, not their pairs.
    """
    people, index = (df.repartition(max(1, -(-df.count() // CONTACT_ROWS)), k) for df, k in ((people, key), (index, candidate)))
    index = cut(index)
    ids = index.select(F.col(candidate).alias("given_id")).distinct().withColumn("__stated", F.lit(True))
    rows = cut(resolved_names(people, index, key).join(ids, "given_id", "left"))
    addressed = F.coalesce(contacts.email_surname(F.col("email")) == F.col("last_key"), F.lit(False)) & F.col("firm").isNotNull()
    open_ = rows.filter("__stated is null and last_key is not null").select(
        F.col(key).alias("row_id"), "last_key", "given", "firm", F.regexp_replace(F.lower("city"), "[^a-z]", "").alias("city"), "state",
        names.generation(F.col("name")).alias("suffix"), (F.coalesce("firm", F.lit("")) != "").alias("tells"), addressed.alias("addressed"),
    )
    index = index.select(F.col(candidate).alias("id"), "last_key", F.array_sort(F.array_distinct("forms")).alias("forms"), F.array_distinct(F.array_compact(F.coalesce("firms", F.array().cast("array<string>")))).alias("firms"), "cities", "states", "suffix")
    known = cut(index.groupBy("last_key", "forms").agg(F.count("*").alias("n")).withColumn("forms_id", F.monotonically_increasing_id()))
    keyed = index.join(known.drop("n"), ["last_key", "forms"]).withColumn("firm_key", F.explode(F.concat(F.array(F.lit(ANY)), F.transform("firms", lambda x: F.concat(F.lit("="), x)))))
    folded = cut(cells(keyed))
    held = boxes(folded.withColumns({"part": F.col("firm_key"), "f": F.when(F.col("firm_key") == ANY, 0.0).otherwise(1.0)}))
    named = name_pairs(open_.select("last_key", F.col("given").alias("said")).distinct(), known.select("last_key", "forms")).withColumn("name_score", names.best_given_score(F.col("said"), F.col("forms"))).filter("name_score > 0")
    named = named.join(known, ["last_key", "forms"]).withColumnRenamed("said", "given").drop("forms")
    at_firm = F.concat(F.lit("="), "firm")
    by_name = open_.join(named, ["last_key", "given"]).withColumn("parts", F.array_compact(F.array(F.lit(ANY), at_firm)))
    # those of the firm whose names disagree: distinct names of the row's firm and surname
    asked = open_.filter("addressed").select("last_key", "given", "firm").distinct()
    there = folded.filter((F.col("firm_key") != ANY) & (F.col("city_key") == ANY) & (F.col("state_key") == ANY)).select("forms_id", F.expr("substring(firm_key, 2)").alias("firm")).distinct()
    others = asked.join(known.join(there, "forms_id"), ["last_key", "firm"]).filter(names.best_given_score(F.col("given"), F.col("forms")) <= 0)
    others = others.select("last_key", "given", "firm", "forms_id").withColumn("name_score", F.lit(BY_ADDRESS))
    by_mail = open_.filter("addressed").join(others, ["last_key", "given", "firm"]).withColumn("parts", F.array(at_firm))
    columns = ["row_id", "forms_id", "name_score", "tells", "parts", "city", "state", "suffix"]
    placed = by_name.select(*columns).unionAll(by_mail.select(*columns))

    def total(f: Column, city: Column, state: Column, ending: Column) -> Column:
        return score(F.col("name_score"), f, city, state, names.same_generation(F.col("suffix"), ending), config)

    near = by_name.filter(F.col("name_score") >= config.near_name).select("row_id", "n")
    if BY_ADDRESS >= config.near_name:
        at = keyed.filter(F.col("firm_key") != ANY).groupBy("forms_id", F.expr("substring(firm_key, 2)").alias("firm")).agg(F.count("*").alias("n"))
        near = near.unionAll(by_mail.join(at, ["forms_id", "firm"]).select("row_id", "n"))
    best = two_best(placed, held, total).join(near.groupBy("row_id").agg(F.sum("n").alias("namesakes")), "row_id", "left")
    best = best.withColumns({"gap": F.col("score") - F.col("following"), "namesakes": F.coalesce("namesakes", F.lit(0))})
    passed = (F.col("score") >= config.accept) & (F.col("gap") >= config.margin) & (F.col("namesakes") <= config.namesakes)
    best = best.select(F.col("row_id").alias(key), F.col("id").alias(candidate), F.when(passed, "high").otherwise("review").alias("tier"), "score", "gap", "namesakes")
    out = rows.select(key, "given_id", "__stated").join(best, key, "left")
    sure = F.col("__stated").isNotNull()
    return out.select(
        key, F.when(sure, F.col("given_id")).otherwise(F.col(candidate)).alias(candidate), F.when(sure, "confirmed").otherwise(F.coalesce("tier", F.lit("none"))).alias("tier"),
        F.when(sure, 1.0).otherwise(F.bround(F.coalesce("score", F.lit(0.0)).cast("decimal(28,8)"), 3).cast("double")).alias("score"),
        F.when(sure, 1.0).otherwise(F.bround(F.coalesce("gap", F.lit(0.0)).cast("decimal(28,8)"), 3).cast("double")).alias("gap"), F.when(sure, 0).otherwise(F.coalesce("namesakes", F.lit(0))).cast("long").alias("namesakes"),
    )


def safe_lookup(decided: DataFrame, filed: DataFrame, key: str, candidate: str, sure_gap: float = 0.30) -> DataFrame:
    """(candidate, key) of high matches that can be written to without further thought.

    A candidate that two rows match is dropped, and so is a match whose names disagree if it was
    close or if both addresses name other people. ``decided`` has (key, candidate, tier, gap, name,
    email), ``filed`` (candidate, filed_name, filed_email).
    """
    high = decided.filter("tier = 'high'")
    alone = high.groupBy(candidate).agg(F.count("*").alias("__n")).filter("__n = 1").select(candidate)
    rows = high.join(alone, candidate).join(filed, candidate, "left")
    agrees = F.coalesce(display.any_name_agrees(F.col("name"), F.col("filed_name")), F.lit(True)) | (F.coalesce("filed_name", F.lit("")) == "")
    firm = (F.col("gap") >= sure_gap) & ~contacts.given_names_disagree(F.col("filed_name"), F.col("filed_email"), F.col("email"))
    return rows.filter(agrees | F.coalesce(firm, F.lit(False))).select(candidate, key)


def address_book(rows: DataFrame, person: str, address: str, firm: str, internal: list[str]) -> tuple[DataFrame, DataFrame]:
    """(addresses with their person or as ambiguous, domains that point to one firm alone).

    Addresses of internal domains are left out of both.
    """
    ours = rows.select(F.col(person), contacts.email(F.col(address)).alias(address), F.col(firm)).filter(F.col(address).isNotNull())
    ours = ours.withColumn("domain", F.element_at(F.split(address, "@"), -1)).filter(~F.col("domain").isin(*internal))
    domains = ours.filter(F.coalesce(F.col(firm), F.lit("")) != "").groupBy("domain").agg(F.min(firm).alias(firm), F.max(firm).alias("__other"), F.count("*").alias("n"))
    return split_by_owners(ours, address, person), domains.filter((F.col(firm) == F.col("__other")) & (F.col("n") >= 2)).select("domain", firm)


def classify_addresses(df: DataFrame, book: DataFrame, domains: DataFrame, address: str, person: str, firm: str, internal: list[str]) -> DataFrame:
    """``df`` with ``kind`` (internal, advisor, ambiguous, firm or unknown) and the person or firm of an address."""
    said = df.withColumn("__a", contacts.email(F.col(address))).withColumn("__d", F.element_at(F.split("__a", "@"), -1))
    out = said.join(book.select(F.col(address).alias("__a"), F.col(person).alias("__p"), "status"), "__a", "left").join(domains.select(F.col("domain").alias("__d"), F.col(firm).alias("__f")), "__d", "left")
    kind = F.when(F.col("__d").isin(*internal), "internal").when(F.col("status") == "resolved", "advisor").when(F.col("status") == "ambiguous", "ambiguous").when(F.col("__f").isNotNull(), "firm").otherwise("unknown")
    out = out.withColumn("kind", kind).withColumn(person, F.when(F.col("kind") == "advisor", F.col("__p"))).withColumn(firm, F.when(F.col("kind") == "firm", F.col("__f")))
    return out.drop("__a", "__d", "__p", "__f", "status")


def single_hits(people: DataFrame, roster: DataFrame, key: str, candidate: str, firm: str, least: float = 0.8) -> DataFrame:
    """(key, candidate, status): inside one firm, exactly one person of the surname whose given name agrees.

    ``people`` has (key, firm, name), ``roster`` (firm, candidate, last_key, forms). Equal names of a
    firm are compared once on either side.
    """
    said = people.select(key, firm, names.surname(F.col("name")).alias("last_key"), names.given(F.col("name")).alias("__given"))
    held = roster.groupBy(firm, "last_key", "forms").agg(F.count("*").alias("__n"), F.min(candidate).alias("__one"))
    name = [firm, "last_key", "__given"]
    pairs = said.select(*name).distinct().join(held, [firm, "last_key"]).filter(names.best_given_score(F.col("__given"), F.col("forms")) >= least)
    found = pairs.groupBy(*name).agg(F.sum("__n").alias("__n"), F.min("__one").alias("__one"))
    hits = said.join(found, name).groupBy(key).agg(F.sum("__n").alias("__n"), F.min("__one").alias("__one"))
    out = people.select(key, firm).join(hits, key, "left")
    status = F.when(F.col("__n").isNull(), "unmatched").when(F.col("__n") == 1, "matched").otherwise("ambiguous")
    return out.select(key, firm, F.when(F.col("__n") == 1, F.col("__one")).alias(candidate), status.alias("status"))


def demote(decided: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    """High falls to review where the given names disagree outright; absent names do not disagree."""
    disagree = F.coalesce(names.best_given_score(ours, theirs) == 0, F.lit(False)) & (F.size(ours) > 0) & (F.size(theirs) > 0)
    out = decided.withColumn("demoted", disagree & (F.col("tier") == "high"))
    return out.withColumn("tier", F.when(F.col("demoted"), "review").otherwise(F.col("tier")))


def best_record(df: DataFrame, key: str, score_column: str, margin: float, *preference: Column) -> DataFrame:
    """Per key, the preferred row among those within ``margin`` of the best score."""
    near = df.withColumn("__top", F.max(score_column).over(Window.partitionBy(key))).filter(F.col(score_column) >= F.col("__top") - margin)
    return near.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*preference))).filter("__rn = 1").drop("__rn", "__top")


def donate(df: DataFrame, key: str, fields: list[str], *order: Column) -> DataFrame:
    """Each blank field filled from the best-ordered row of the key that has it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.first(F.nullif(F.col(f), F.lit("")), ignorenulls=True).over(w)) for f in fields}
    return df.withColumns(filled)


def split_by_owners(df: DataFrame, address: str, owner: str) -> DataFrame:
    """(address, owner or null, resolved or ambiguous)."""
    out = df.filter(F.col(address).isNotNull()).groupBy(address).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("one"))
    return out.select(address, F.when(F.col("owners") == 1, F.col("one")).alias(owner), F.when(F.col("owners") == 1, "resolved").otherwise("ambiguous").alias("status"))


def calibrate(df: DataFrame, score_column: Column, truth: Column, thresholds: list[float]) -> DataFrame:
    """Precision and recall counts at each threshold, in one pass over the rows."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = df.select(score_column.alias("s"), truth.alias("t"), grid)
    return rows.groupBy("threshold").agg(
        F.count_if(F.col("s") >= F.col("threshold")).alias("accepted"),
        F.count_if((F.col("s") >= F.col("threshold")) & F.col("t")).alias("correct"),
        F.count_if(F.col("t")).alias("positives"),
    )
