"""The two best candidates of a row, looked up by what they agree on instead of over pairs of people.

Given names meet name forms of the same surname in a deletion neighbourhood. Candidates are folded into
cells (name forms, firm key or any, city or any, state or any, generation), of which the least and the
greatest id are kept. A row looks up the cells of what it says. A candidate of a cell agrees on its marks
at least, so the cell's score is never above the candidate's own, and it is the candidate's own in one of
its cells. So the best candidate is the least id at the best score that is found, and two ids a cell are
enough to know the next best: if a cell hides a second candidate behind its two, those are two that are
as good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Any firm.
ANY = "*"


def spelling_keys(form: Column, published: bool) -> Column:
    """The keys under which a given name meets others that agree with it.

    Longer names: the name and all names with one letter less. A single letter meets every name that
    begins with it; the sides mark that differently, so that longer names do not meet by it.
    """
    size, first = F.length(form), F.substring(form, 1, 1)
    less = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.concat(F.lit("="), F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, size)))
    near = F.when(size > 1, F.concat(F.array(F.concat(F.lit("="), form)), less)).otherwise(F.array().cast("array<string>"))
    if published:
        by_letter = F.when(size == 1, F.array(F.concat(F.lit("any "), first))).otherwise(F.array(F.concat(F.lit("one "), first)))
    else:
        by_letter = F.when(size == 1, F.array(F.concat(F.lit("any "), first), F.concat(F.lit("one "), first))).otherwise(F.array(F.concat(F.lit("any "), first)))
    return F.array_distinct(F.concat(near, by_letter))


def _keys(forms: Column, published: bool) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda w: w != ""), lambda w: spelling_keys(w, published))))


def name_pairs(said: DataFrame, known: DataFrame) -> DataFrame:
    """(last_key, said, forms): the given names and sets of forms that meet; most of them agree."""
    ours = said.select("last_key", "said", F.explode(_keys(F.col("said"), True)).alias("key"))
    theirs = known.select("last_key", "forms", F.explode(_keys(F.col("forms"), False)).alias("key"))
    return ours.join(theirs, ["last_key", "key"]).select("last_key", "said", "forms").distinct()


def cells(index: DataFrame) -> DataFrame:
    """(forms_id, firm_key, city_key, state_key, ending, least, most): the least and the greatest candidate by what they agree on.

    ``index`` has one row for each candidate and firm key, with ``ANY`` among the keys.
    """
    any_or = lambda array: F.concat(F.array(F.lit(ANY)), F.transform(F.array_distinct(F.array_compact(F.coalesce(array, F.array().cast("array<string>")))), lambda x: F.concat(F.lit("="), x)))
    rows = index.select("forms_id", "firm_key", F.col("suffix").alias("ending"), "id", any_or(F.col("cities")).alias("c"), any_or(F.col("states")).alias("s"))
    rows = rows.withColumn("city_key", F.explode("c")).withColumn("state_key", F.explode("s"))
    return rows.groupBy("forms_id", "firm_key", "city_key", "state_key", "ending").agg(F.min("id").alias("least"), F.max("id").alias("most"))


def boxes(placed: DataFrame) -> DataFrame:
    """(forms_id, part, city_key, state_key, held): cells by the firm part that finds them, as an array of (f, ending, least, most)."""
    place = ["forms_id", "part", "city_key", "state_key"]
    levels = placed.groupBy(*place, "f", "ending").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return levels.groupBy(*place).agg(F.collect_list(F.struct("f", "ending", "least", "most")).alias("held"))


def two_best(rows: DataFrame, held: DataFrame, total: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """(row_id, id, score, following): the best candidate of each row, and the score of the next best (0: none).

    ``rows`` has (row_id, forms_id, name_score, tells, parts, city, state, suffix), ``parts`` being the
    keys of the boxes; ``total`` gives the score by (f, city, state, ending).
    """
    marks = lambda c: F.array_compact(F.array(F.lit(ANY), F.concat(F.lit("="), F.col(c))))
    looked = rows.withColumn("part", F.explode("parts")).withColumn("city_key", F.explode(marks("city"))).withColumn("state_key", F.explode(marks("state")))
    found = looked.drop("parts", "city", "state").join(held, ["forms_id", "part", "city_key", "state_key"])
    agreed = lambda c: F.when(F.col(c) != ANY, 1.0).otherwise(0.0)
    rate = lambda x: F.struct((-total(F.when(F.col("tells"), x["f"]), agreed("city_key"), agreed("state_key"), x["ending"])).alias("less"), x["least"].alias("least"), x["most"].alias("most"))
    both = lambda x: F.array(F.struct(x["less"].alias("less"), x["least"].alias("id")), F.struct(x["less"].alias("less"), x["most"].alias("id")))
    rated = found.select("row_id", F.transform("held", rate).alias("rated"))
    ordered = rated.select("row_id", F.array_sort(F.flatten(F.transform("rated", both))).alias("ordered"))
    first = ordered.select("row_id", F.get("ordered", F.lit(0)).alias("one"), "ordered")
    two = F.array_compact(F.array(F.col("one"), F.get(F.filter("ordered", lambda x: x["id"] != F.col("one.id")), F.lit(0))))
    # one exchange by row for both of the next steps
    each = first.select("row_id", F.inline(two)).repartition("row_id").groupBy("row_id", "id").agg((-F.min("less")).alias("score"))
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), F.asc("id"))
    return each.select("row_id", "id", "score", F.coalesce(F.lead("score").over(w), F.lit(0.0)).alias("following"), F.row_number().over(w).alias("at")).filter("at = 1").drop("at")
