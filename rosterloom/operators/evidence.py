"""Who a published name is, without comparing it with everyone of that surname.

Candidates are scored by name, firm, city, state and generation. The scores have few levels, so they
are found in meetings of distinct values instead of over pairs of people:

1. Given names meet name forms of the same surname in a deletion neighbourhood: both sides are keyed
   by each form and each form less one letter, initials by their letter. Two forms within one edit
   share a key, so only spellings that can agree are compared, and each spelling once.
2. The parts of published firms meet known firm names on a shared word, each wording once.
3. Candidates are folded into cells and looked up (``rivals``): by each part of the firm, by any firm,
   with the city or any, with the state or any.

So the work follows the people and the published rows, not their product, however many share a
name; equal published rows are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .matching import MatchConfig, score
from .relational import cut
from .rivals import ANY, boxes, cells, name_pairs, two_best

#: A candidate of whose firm nothing is known.
UNKNOWN = "?"
_PROFILE = ["last_key", "said", "firm", "city", "state", "suffix"]


def _firm_words(firm_names: Column) -> Column:
    """The word sets of an array of firm names, each as words in order, in order."""
    words = F.transform(F.coalesce(firm_names, F.array().cast("array<string>")), lambda n: F.array_join(F.array_sort(names.firm_words(F.coalesce(n, F.lit("")))), " "))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def _shares(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """(part, words, f): published firm parts and known firm names that share words, and the share of the shorter one."""
    split = lambda c: F.split(c, " ")
    ours = parts.select("part").distinct().withColumn("word", F.explode(split("part")))
    theirs = sets.select("words").distinct().withColumn("word", F.explode(split("words")))
    met = ours.join(theirs, "word").groupBy("part", "words").agg(F.count("*").alias("common"))
    return met.select("part", "words", (F.col("common") / F.least(F.size(split("part")), F.size(split("words")))).alias("f"))


def best_candidates(published: DataFrame, index: DataFrame, config: MatchConfig = MatchConfig(), places: int = 4) -> DataFrame:
    """(last_key, said, firm, city, state, suffix, id, score, gap, namesakes), one row for each distinct published row with a candidate.

    ``published`` holds the first six columns (``said`` an array of given names), ``index`` (id,
    last_key, forms, firms, cities, states, suffix) with one row for each id and surname key. Scores
    are rounded to ``places``; among equal scores the least id is taken and the gap is zero.
    """
    # both sides are read by several of the meetings below; each is made and numbered once
    rows = cut(published.select(*_PROFILE).distinct().withColumn("row_id", F.monotonically_increasing_id()))
    index = index.select("id", "last_key", F.array_sort(F.array_distinct("forms")).alias("forms"), _firm_words(F.col("firms")).alias("firm_words"), "cities", "states", F.nullif("suffix", F.lit("")).alias("suffix"))
    known = cut(index.groupBy("last_key", "forms").agg(F.count("*").alias("n")).withColumn("forms_id", F.monotonically_increasing_id()))
    keys = F.when(F.size("firm_words") == 0, F.array(F.lit(UNKNOWN))).otherwise(F.concat(F.array(F.lit(ANY)), F.transform("firm_words", lambda w: F.concat(F.lit("="), w))))
    folded = cut(cells(index.join(known, ["last_key", "forms"]).withColumn("firm_key", F.explode(keys))))
    named = name_pairs(rows.select("last_key", "said").distinct(), known.select("last_key", "forms")).withColumn("name_score", names.best_given_score(F.col("said"), F.col("forms"))).filter("name_score > 0")
    named = named.join(known, ["last_key", "forms"]).drop("forms")
    told = rows.withColumn("words", _firm_words(F.split("firm", r"\|"))).withColumn("tells", F.size("words") > 0)
    placed = cut(told.join(named, ["last_key", "said"]).select("row_id", "forms_id", "n", "name_score", "words", "tells", "city", "state", "suffix"))
    # of the firms that agree, only those that some candidate of these name forms has
    asked = placed.select("forms_id", F.explode("words").alias("part")).distinct()
    sets = folded.filter(~F.col("firm_key").isin(ANY, UNKNOWN)).select("forms_id", F.expr("substring(firm_key, 2)").alias("words")).distinct()
    met = asked.join(_shares(asked, sets), "part").join(sets, ["forms_id", "words"])
    met = met.select("forms_id", F.concat(F.lit("="), "words").alias("firm_key"), F.concat(F.lit("="), "part").alias("part"), "f")
    other = folded.filter(F.col("firm_key").isin(ANY, UNKNOWN)).withColumns({"part": F.lit(ANY), "f": F.when(F.col("firm_key") == ANY, 0.0).otherwise(names.UNKNOWN_FIRM)})
    held = boxes(folded.join(met, ["forms_id", "firm_key"]).unionByName(other))
    parts = F.concat(F.array(F.lit(ANY)), F.transform("words", lambda w: F.concat(F.lit("="), w)))

    def total(f: Column, city: Column, state: Column, ending: Column) -> Column:
        whole = score(F.col("name_score"), f, city, state, names.same_generation(F.col("suffix"), ending), config)
        return F.bround(whole.cast("decimal(28,8)"), places).cast("double")

    best = two_best(placed.withColumn("parts", parts).drop("words", "n"), held, total)
    near = placed.groupBy("row_id").agg(F.sum(F.when(F.col("name_score") >= config.near_name, F.col("n")).otherwise(0)).alias("namesakes"))
    gap = F.bround((F.col("score") - F.col("following")).cast("decimal(28,8)"), places).cast("double")
    return rows.join(best.select("row_id", "id", "score", gap.alias("gap")), "row_id").join(near, "row_id").drop("row_id")


def match_published(published: DataFrame, index: DataFrame, key: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(key, id, score, gap, namesakes, tier): one row for each published row; tier high, review or none."""
    best = best_candidates(published, index, config).select(*[F.col(c).alias(f"of_{c}") for c in _PROFILE], "id", "score", "gap", "namesakes")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in _PROFILE]
    out = published.select(key, *_PROFILE).join(best, same, "left")
    passed = (F.col("score") >= config.accept) & (F.col("gap") >= config.margin) & (F.col("namesakes") <= config.namesakes)
    tier = F.when(F.col("id").isNull(), "none").when(passed, "high").otherwise("review")
    zero = F.lit(0.0)
    return out.select(key, "id", F.coalesce("score", zero).alias("score"), F.coalesce("gap", zero).alias("gap"), F.coalesce("namesakes", F.lit(0).cast("long")).alias("namesakes"), tier.alias("tier"))
