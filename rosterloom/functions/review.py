"""A reviewer's questions about a proposed match: same firm, same given name, same place, and what to do."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import let

#: Words of firm names that say nothing about whether two firms are the same.
NOISE = (
    "llc inc incorporated llp lp corp corporation co company ltd plc pc pa the and of group financial services service "
    "securities advisors advisers advisory wealth management capital partners associates investments investment planning brokerage"
).split()
#: A short form and the name it stands for. Not complete, and narrower than ``names.NICKNAMES``.
SHORT_FORMS = """
bob robert, rob robert, bobby robert, bill william, will william, billy william, jim james, jimmy james, mike michael, dave david,
dan daniel, danny daniel, tom thomas, tommy thomas, steve stephen, chris christopher, chuck charles, charlie charles, rick richard,
dick richard, rich richard, ted edward, ed edward, eddie edward, tony anthony, joe joseph, joey joseph, ken kenneth, greg gregory,
jeff jeffrey, matt matthew, nick nicholas, pat patrick, sam samuel, andy andrew, drew andrew, ben benjamin, alex alexander,
tim timothy, ron ronald, don donald, doug douglas, larry lawrence, gerry gerald, jerry gerald, fred frederick, art arthur,
phil philip, ray raymond, walt walter, vic victor, cathy catherine, kathy katherine, sue susan, liz elizabeth, beth elizabeth,
peggy margaret, meg margaret, maggie margaret, jen jennifer, jenny jennifer, becky rebecca, debbie deborah, deb deborah
"""


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", "")


def firms_agree(ours: Column, theirs: Column) -> Column:
    """'yes' if one name's telling words hold the other's, 'partial' if any are shared, 'no', or 'unknown'."""

    def words(name: Column) -> Column:
        parts = F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+")
        return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE)))

    def told(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        both = F.size(F.array_intersect(a, b))
        unknown = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when(unknown, "unknown").when(both == F.least(F.size(a), F.size(b)), "yes").when(both > 0, "partial").otherwise("no")

    return let(F.struct(words(ours).alias("a"), words(theirs).alias("b")), told)


def _leading(name: Column) -> Column:
    """The first word of a name in letters, its short form written out; empty if there is none."""
    whole = F.create_map(*[F.lit(w) for w in chain.from_iterable(p.split() for p in SHORT_FORMS.replace("\n", " ").split(","))])
    word = _letters(F.try_element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), F.lit(1)))
    return let(word, lambda w: F.coalesce(F.try_element_at(whole, w), w))


def first_names_agree(ours: Column, *theirs: Column) -> Column:
    """'yes', 'initial' (a letter stands for the name on one side), 'no' or 'unknown'; only leading words count."""

    def told(sides: Column) -> Column:
        a, known = sides["a"], F.filter(sides["known"], lambda k: k != "")
        initial = F.exists(known, lambda k: ((F.length(a) == 1) & k.startswith(a)) | ((F.length(k) == 1) & a.startswith(k)))
        return F.when((a == "") | (F.size(known) == 0), "unknown").when(F.array_contains(known, a), "yes").when(initial, "initial").otherwise("no")

    return let(F.struct(_leading(ours).alias("a"), F.array(*map(_leading, theirs)).alias("known")), told)


def postals_agree(a: Column, b: Column) -> Column:
    """The first five digits compared; 'unknown' with fewer on a side."""
    five = lambda c: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), 1, 5)
    return let(F.struct(five(a).alias("a"), five(b).alias("b")), lambda s: F.when((F.length(s["a"]) < 5) | (F.length(s["b"]) < 5), "unknown").when(s["a"] == s["b"], "yes").otherwise("no"))


def cities_agree(a: Column, b: Column) -> Column:
    """Letters compared; one may begin with the other."""
    told = lambda s: F.when((s["a"] == "") | (s["b"] == ""), "unknown").when(s["a"].startswith(s["b"]) | s["b"].startswith(s["a"]), "yes").otherwise("no")
    return let(F.struct(_letters(a).alias("a"), _letters(b).alias("b")), told)


def suggestion(firms: Column, first_names: Column, postals: Column, cities: Column) -> Column:
    """REJECT another given name unless the postal code agrees; ACCEPT a name with a place or a firm; else CHECK."""
    near = (postals == "yes") | (firms == "yes") | (cities == "yes")
    return F.when((first_names == "no") & (postals != "yes"), "REJECT").when(first_names.isin("yes", "initial") & near, "ACCEPT").otherwise("CHECK")
