"""Person names: parts, forms, suffixes, agreement scores."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import let

#: Name endings that are no surname.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v", "md", "cfp", "cfa", "cpa", "phd"]
GENERATIONS = ["jr", "sr", "ii", "iii", "iv", "v", "vi"]
#: Given names that stand for each other, a group to a line; a name may be in two groups.
NICKNAMES = """
andrew andy drew
james jim jimmy jamie jay
robert rob bob bobby robbie
william bill will billy willie
richard rick dick rich richie
michael mike mickey
thomas tom tommy
charles charlie chuck chip
joseph joe joey
edward ed eddie ted ned
john jack johnny jon
daniel dan danny
matthew matt
christopher chris
anthony tony
kenneth ken kenny
stephen steven steve
gregory greg
benjamin ben benny
samuel sam sammy
nicholas nick
alexander alex
patrick pat
timothy tim
frederick fred freddie
lawrence larry
gerald jerry
donald don donnie
ronald ron ronnie
jeffrey jeff
douglas doug
peter pete
harold hal harry
walter walt
albert al
arthur art
raymond ray
eugene gene
francis frank frankie
theodore ted teddy
philip phillip phil
leonard len lenny
rodney rod
roderick rod
jonathan jon
joshua josh
nathaniel nathan nate
elizabeth liz beth betsy libby
katherine catherine kathy kate katie cathy
margaret maggie meg peggy
patricia patty trish tricia
jennifer jen jenny
deborah debra deb debbie
rebecca becky becca
susan sue susie
cynthia cindy
victoria vicki vicky
christine christina christy chrissy
theresa teresa terry terri
charlotte charlie
"""
#: Words of firm names that tell no firms apart.
FIRM_NOISE = (
    "llc l.l.c inc incorporated corp corporation co company lp llp ltd the and of group wealth management advisors advisers advisory "
    "financial services capital partners private investment investments securities planning associates network consulting"
).split()
UNKNOWN_FIRM = 0.30


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def tokens(name: Column) -> Column:
    """The words of a name in letters, without suffixes and credentials; a hyphen does not part a word."""
    parts = F.filter(F.split(F.regexp_replace(name, "[.,]", " "), r"\s+"), lambda t: t != "")
    return F.filter(F.transform(parts, _letters), lambda t: ~t.isin(*SUFFIXES))


def surname(name: Column) -> Column:
    return F.try_element_at(tokens(name), F.lit(-1))


def given(name: Column) -> Column:
    parts = tokens(name)
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: t != "")


def generation(name: Column) -> Column:
    """The generation that a name ends with; null where its last word is none."""
    words = F.filter(F.transform(F.split(name, r"[\s.,]+"), _letters), lambda t: t != "")
    last = F.try_element_at(words, F.lit(-1))
    return F.when(last.isin(*GENERATIONS), last)


def generation_agrees(a: Column, b: Column) -> Column:
    """Of two names: 1 both give the same generation, -1 they differ, 0 one or none is given."""
    return same_generation(generation(a), generation(b))


def same_generation(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), 0).when(x == y, 1).otherwise(-1)


def nickname_table(groups: str = NICKNAMES) -> dict[str, list[str]]:
    """Each name with all names that it can stand for, its own included."""
    table: dict[str, set[str]] = {}
    for group in filter(None, map(str.split, groups.splitlines())):
        for name in group:
            table.setdefault(name, set()).update(group)
    return {k: sorted(v) for k, v in sorted(table.items())}


def _nick_map(groups: str = NICKNAMES) -> Column:
    return F.from_json(F.lit(json.dumps(nickname_table(groups))), "map<string,array<string>>")  # one constant in the plan


def with_nicknames(words: Column, groups: str = NICKNAMES) -> Column:
    """An array of given names together with all that they can stand for."""
    table = _nick_map(groups)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))))))


def forms(first: Column) -> Column:
    """A given name with its nicknames or the names it is short for."""
    return with_nicknames(F.array(F.lower(F.trim(first))))


def given_forms(first: Column, middle: Column, used: Column, last: Column) -> Column:
    """Every given name that a person may be published under: filed, used, bracketed, and their nicknames."""
    bracketed = F.array_join(F.regexp_extract_all(F.coalesce(last, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1)), " ")
    whole = F.concat_ws(" ", first, middle, used, bracketed)
    words = F.filter(F.transform(F.split(whole, r"[\s()/,]+"), _letters), lambda t: t != "")
    return with_nicknames(words)


def firm_words(name: Column) -> Column:
    """The words of a firm name that tell it apart."""
    noise = "|".join(sorted((w.replace(".", r"\.") for w in FIRM_NOISE), key=len, reverse=True))
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(name), rf"\b({noise})\b", " "), "[^a-z]+")), lambda w: F.length(w) >= 2)


def firm_agreement(published: Column, known: Column) -> Column:
    """Of a published firm ("Team | House") and an array of names: the best share of words in common.

    Null where the published name tells nothing, which holds for every candidate alike; a weak
    prior where nothing is known of this candidate's firm.
    """
    told = lambda parts: F.filter(F.transform(parts, firm_words), lambda w: F.size(w) > 0)
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))

    def compare(sides: Column) -> Column:
        ours, theirs = sides["ours"], sides["theirs"]
        best = F.array_max(F.flatten(F.transform(ours, lambda a: F.transform(theirs, lambda b: share(a, b)))))
        return F.when(ours.isNull() | (F.size(ours) == 0), F.lit(None)).when(F.coalesce(F.size(theirs), F.lit(0)) < 1, F.lit(UNKNOWN_FIRM)).otherwise(F.least(best, F.lit(1.0)))

    return let(F.struct(told(F.split(published, r"\|")).alias("ours"), told(known).alias("theirs")), compare)


def given_score(a: Column, b: Column) -> Column:
    """Of two given names: 1 equal, 0.8 one edit apart, 0.45 initial, else 0."""
    near = (F.length(a) > 1) & (F.length(b) > 1) & (F.levenshtein(a, b) <= 1)
    initial = ((F.length(a) == 1) | (F.length(b) == 1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return F.when(a == b, 1.0).when(near, 0.8).when(initial, 0.45).otherwise(0.0)


def best_given_score(ours: Column, theirs: Column) -> Column:
    """The best agreement between two arrays of name forms."""
    pairs = F.flatten(F.transform(ours, lambda x: F.transform(theirs, lambda y: given_score(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; null where either set is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller)
