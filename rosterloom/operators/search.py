"""Searches as joins: many terms at once against an index that is keyed by prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .relational import top_n

#: Words of a name that nobody is searched by.
NOT_NAMES = ["jr", "sr", "ii", "iii", "iv", "and", "the", "of", "de", "la"]


def places(terms: DataFrame, states: DataFrame, zips: DataFrame, cities: DataFrame, most: int = 10) -> DataFrame:
    """(q, place, kind, label, state): the first ``most`` places for each term.

    States come first (their code, or a name that begins with the term), then ZIP codes for digits or,
    for two characters and more, the ten cities of most people. ``terms`` has (q, term), ``states``
    (code, name), ``zips`` (zip, state), ``cities`` (city, state, n). A term meets only those that
    share its first character (states, ZIP codes) or two (cities), and each term is searched once,
    however many ask for it.
    """
    asked = terms.select("q", F.upper(F.trim("term")).alias("t")).filter("t <> ''")
    said = asked.select("t").distinct()
    one, two = F.substring("t", 1, 1), F.substring("t", 1, 2)
    begins = lambda c: F.col(c).startswith(F.col("t"))
    # a code and a name may begin with different characters, and a state is one place
    names = states.select("code", F.upper("name").alias("upper"), F.col("name").alias("label"))
    keyed = names.withColumn("k", F.explode(F.array_distinct(F.array(F.substring("code", 1, 1), F.substring("upper", 1, 1)))))
    by_state = said.withColumn("k", one).join(keyed, "k").filter((F.col("code") == F.col("t")) | begins("upper"))
    by_state = by_state.select("t", F.lit(1).alias("kind_no"), F.lit("state").alias("kind"), F.lit(0).cast("long").alias("n"), "label", F.col("code").alias("state")).distinct()
    digits = said.filter(F.col("t").rlike("^[0-9]+$")).withColumn("k", one)
    by_zip = digits.join(zips.withColumn("k", F.substring("zip", 1, 1)), "k").filter(begins("zip"))
    by_zip = by_zip.select("t", F.lit(2).alias("kind_no"), F.lit("zip").alias("kind"), F.lit(0).cast("long").alias("n"), F.col("zip").alias("label"), "state")
    letters = said.filter((F.length("t") >= 2) & ~F.col("t").rlike("^[0-9]+$")).withColumn("k", two)
    held = cities.select(F.upper("city").alias("upper"), F.col("city").alias("label"), "state", F.col("n").cast("long").alias("n"))
    by_city = letters.join(held.withColumn("k", F.substring("upper", 1, 2)), "k").filter(begins("upper"))
    by_city = by_city.select("t", F.lit(2).alias("kind_no"), F.lit("city").alias("kind"), "n", "label", "state")
    found = by_state.unionByName(by_zip).unionByName(by_city)
    out = top_n(found.withColumn("place", F.lit(0)), ["t"], most, F.asc("kind_no"), F.desc("n"), F.asc("label"), F.asc("state"))
    return asked.join(out, "t").select("q", "kind", "label", "state", "n")


def field(terms: DataFrame, index: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(q, id, source): people for whom every word of a query is found.

    ``index`` has (id, name, alternates) and answers for the country: a person is filed under the first
    two letters of each word of the name and of each alternate, and a query meets those filed under its
    first word; each of its words must then lie in the name or begin an alternate. ``near`` has (id,
    text), the people at hand with all their fields as one text; they are found by any field and come
    once. Queries (q, term) of fewer than two characters find nothing.

    Queries that ask the same and people of the same names and texts are searched once each; only
    what is found is written out for every one of them.
    """
    said = terms.select("q", F.lower(F.trim("term")).alias("t")).filter(F.length("t") >= 2).select("q", F.split("t", r"\s+").alias("words"))
    rows = index.select("id", F.lower("name").alias("name"), F.coalesce("alternates", F.array().cast("array<string>")).alias("alternates"))
    told = rows.select("id", F.struct("name", "alternates").alias("called"), F.lit(None).cast("string").alias("text"))
    if near is not None:
        told = told.unionByName(near.select("id", F.lit(None).cast(told.schema["called"].dataType).alias("called"), F.lower("text").alias("text")))
    kept = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    people = told.groupBy("id").agg(kept("called"), kept("text"))
    asked = said.groupBy("q").agg(kept("words"))
    # each set of names and texts, and each set of questions, once
    entries = people.groupBy("called", "text").agg(F.min("id").alias("entry"))
    asks = asked.groupBy("words").agg(F.min("q").alias("ask"))
    ask = asks.select("ask", F.explode("words").alias("words"))
    named = entries.select("entry", F.inline("called"))
    filed = F.array_distinct(F.transform(F.concat(F.split("name", r"\s+"), "alternates"), lambda w: F.substring(w, 1, 2)))
    met = ask.withColumn("k", F.substring(F.get("words", F.lit(0)), 1, 2)).join(named.withColumn("k", F.explode(filed)), "k")
    hit = F.forall("words", lambda w: F.contains(F.col("name"), w) | F.exists("alternates", lambda a: a.startswith(w)))
    found = met.filter(hit).select("ask", "entry", F.lit("index").alias("source"))
    if near is not None:
        # a text is filed under every letter and pair of letters that it holds, as a word may lie anywhere
        texts = entries.select("entry", F.explode("text").alias("text"))
        pairs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.array(F.substring(F.col("text"), i, F.lit(1)), F.substring(F.col("text"), i, F.lit(2))))))
        first = F.substring(F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], 1, 2)
        close = ask.withColumn("k", first).join(texts.withColumn("k", F.explode(pairs)), "k").filter(F.forall("words", lambda w: F.contains(F.col("text"), w)))
        found = found.unionByName(close.select("ask", "entry", F.lit("near").alias("source")))
    # "near" is the greater of the two words
    found = found.groupBy("ask", "entry").agg(F.max("source").alias("source"))
    asking = asked.join(asks, "words").select("q", "ask").join(found, "ask").select("q", "entry", "source")
    return asking.join(people.join(entries, ["called", "text"]).select("id", "entry"), "entry").select("q", "id", "source")


def name_shards(df: DataFrame, key: str, name: str, split_above: int = 2500) -> DataFrame:
    """(prefix, key, name, alt): each person once under every prefix that a search for them may begin with.

    Words of a name and what they are short for are filed by two letters; a prefix of more than
    ``split_above`` people gives way to its three-letter ones. ``alt`` holds the words that the name
    itself does not contain. Prefixes of two letters are at most 676, which bounds the broadcast.
    """
    plain = F.lower(F.col(name))
    words = F.transform(F.split(plain, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*NOT_NAMES))
    tokens = F.filter(names.with_nicknames(words), lambda w: F.length(w) >= 2)
    alt = F.array_join(F.array_sort(F.filter(tokens, lambda w: ~F.contains(plain, w))), " ")
    filed = df.select(key, name, alt.alias("alt"), F.explode(tokens).alias("token")).withColumn("two", F.substring("token", 1, 2))
    heavy = filed.groupBy("two").agg(F.count_distinct(key).alias("n")).filter(F.col("n") > split_above).select("two", F.lit(3).alias("letters"))
    filed = filed.join(F.broadcast(heavy), "two", "left").withColumn("prefix", F.when(F.col("letters").isNull(), F.col("two")).when(F.length("token") >= 3, F.substring("token", 1, 3)))
    return filed.filter(F.col("prefix").isNotNull()).select("prefix", key, name, "alt").distinct()
