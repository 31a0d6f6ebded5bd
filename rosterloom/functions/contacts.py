"""Contact rows: mail addresses, links, places, credentials, dates, ranks, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names
from .rules import let

#: Credentials that may trail a published name.
CREDENTIALS = (
    "cfa cfp cpa cima chfc clu aif aifa cdfa cpfa cpwa crpc crps crpsi aams accredited citp qka qpa qpfc cebs cfs cltc cmfc cpc crc csa caia cbe cfe "
    "chsnc ea jd llm ll m mba ms msa msf mst phd ricp wmcp bfa cap afc shrmscp shrmcp sphr phr cpm clf fpqp iaccp cippus cipp cams frm abv pfs cva "
    "cexp cep ctfa cwsi cws aep rma awma wms apma planner"
).split()
#: What is left of a trademark sign after a credential.
MARKS = ["tm", "sm", "r"]
#: Area codes that reach a queue, and labels of numbers from the best.
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]
LABELS = ["direct", "local", "office", "main", "branch"]
_PHONE = r"(?<!\d)(?:\+?1[\s.\- ]?)?\(?\d{3}\)?[\s.\-]*\d{3}[\s.\-]*\d{4}(?!\d)"
#: Subject lines of machines.
AUTO_SUBJECT = r"(?i)^\s*(automatic reply|out of office|autoreply|auto:)"
AUTO_PRECEDENCE = ["auto_reply", "bulk", "list", "junk"]
_SHAPE = r"^[a-z0-9!#$%&'*+/=?^_`{|}~.-]+@[a-z0-9.-]+\.[a-z]{2,}$"
_INVISIBLE = "[​‌‍⁠﻿]"


def email(text: Column) -> Column:
    """An address without invisible characters and entities, lower-cased; null if it has no address's shape."""
    out = F.regexp_replace(text, _INVISIBLE, "")
    for entity, plain in (("&amp;", "&"), ("&#64;", "@"), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.lower(F.trim(out))
    return F.when(out.rlike(_SHAPE), out)


def email_list(cell: Column) -> Column:
    """All addresses in a cell, whatever parts them: a JSON list, semicolons, commas or blanks."""
    return F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r'[^\s;,"\[\]]+@[^\s;,"\[\]]+'), F.lit(0))


def local_words(address: Column) -> Column:
    """The words of an address before its at sign, without the digits that tell namesakes apart."""
    words = F.split(F.lower(F.split(address, "@")[0]), r"[._\-]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w != "")


def email_surname(address: Column) -> Column:
    """The last word of an address of two words or more, else null."""
    words = local_words(address)
    return F.when(F.size(words) >= 2, F.element_at(words, -1))


def email_given(address: Column) -> Column:
    """The given names that an address of two words or more spells out."""
    words = local_words(address)
    return F.when(F.size(words) >= 2, F.slice(words, 1, F.size(words) - 1)).otherwise(F.array().cast("array<string>"))


def given_names_disagree(name: Column, ours: Column, theirs: Column) -> Column:
    """Whether two addresses of one surname name different people; false where either tells no given name."""
    last = F.regexp_replace(F.lower(F.try_element_at(F.split(F.trim(name), r"\s+"), F.lit(-1))), "[^a-z]", "")

    def told(address: Column) -> Column:
        words = F.split(F.lower(F.split(address, "@")[0]), r"[._\-0-9]+")
        words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: (F.length(w) > 1) & (w != F.coalesce(last, F.lit(""))))
        return F.when(F.contains(address, F.lit("@")), words).otherwise(F.array().cast("array<string>"))

    a, b = told(F.coalesce(ours, F.lit(""))), told(F.coalesce(theirs, F.lit("")))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def own_email(name: Column, addresses: Column) -> Column:
    """The person's own address among several.

    The only address is theirs; else the first with surname and a form of the given name, then the
    first with surname and initial, then the one that alone has the surname, else none.
    """

    def rated(addresses: Column, last: Column, given: Column, forms: Column) -> Column:
        points = lambda words: F.when(~F.array_contains(words, last), 0).when(given.isNotNull() & F.arrays_overlap(words, forms), 3).when(given.isNotNull() & F.array_contains(words, F.substring(given, 1, 1)), 2).otherwise(1)
        return F.filter(F.transform(addresses, lambda a: F.struct(let(local_words(a), points).alias("p"), a.alias("a"))), lambda x: x["p"] > 0)

    def chosen(rows: Column) -> Column:
        best = F.array_max(F.transform(rows, lambda x: x["p"]))
        return let(best, lambda b: F.when((b > 1) | (F.size(rows) == 1), F.try_element_at(F.filter(rows, lambda x: x["p"] == b), F.lit(1))["a"]))

    def of_person(person: Column) -> Column:
        real, last, given = person["real"], person["last"], F.try_element_at(person["given"], F.lit(1))
        several = let(rated(real, last, given, person["forms"]), chosen)
        return F.when((F.size(addresses) == 1) & (F.size(real) == 1), F.try_element_at(real, F.lit(1))).when(last != "", several)

    real = F.filter(F.transform(addresses, email), lambda a: a.isNotNull())
    parsed = let(without_credentials(name), lambda bare: F.struct(names.surname(bare).alias("last"), names.given(bare).alias("given")))
    return let(parsed, lambda n: let(F.struct(real.alias("real"), n["last"].alias("last"), n["given"].alias("given"), names.with_nicknames(F.slice(n["given"], 1, 1)).alias("forms")), of_person))


def without_credentials(name: Column) -> Column:
    """A name without the comma parts that are known credentials, marked or not; anything unknown stays."""
    known = [*CREDENTIALS, *[c + m for c in CREDENTIALS if len(c) > 1 for m in MARKS]]
    parts = F.transform(F.split(name, ","), lambda p: F.trim(p))
    letters = lambda part: F.regexp_replace(F.lower(part), "[^a-z]", "")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda part: ~letters(part).isin("", *known))
    return F.when(name.isNotNull(), F.array_join(F.concat(F.slice(parts, 1, 1), rest), ", "))


def _titled(words: Column) -> Column:
    """Capitals at the start of words, and after apostrophes and hyphens."""
    out = F.initcap(F.regexp_replace(F.lower(words), "(['-])", "$1 "))
    return F.regexp_replace(out, "(['-]) ", "$1")


def city_state(address: Column) -> Column:
    """struct(city, state) from an address that ends in city, state and ZIP; nulls otherwise.

    The city is the words before the state, back to a number or a separator and without a unit
    designator; capitals are cased.
    """

    def told(city: Column) -> Column:
        unit = (F.size(city) > 2) & F.upper(F.try_element_at(city, F.lit(1))).isin("STE", "SUITE", "UNIT", "FL", "FLOOR")
        text = F.array_join(F.when(unit, F.slice(city, 3, F.size(city))).otherwise(city), " ")
        return let(text, lambda t: F.when(t == F.upper(t), _titled(t)).otherwise(t))

    def up_to_stop(back: Column) -> Column:
        back = F.when(F.try_element_at(back, F.lit(1)) == ",", F.slice(back, 2, F.greatest(F.size(back), F.lit(1)))).otherwise(back)
        return let(back, lambda b: let(
            F.array_position(F.transform(b, lambda w: ~w.rlike("^[A-Za-z.'-]+$")), True).cast("int"),
            lambda stop: F.reverse(F.when(stop > 0, F.slice(b, 1, stop - 1)).otherwise(b)),
        ))

    def found(words: Column) -> Column:
        state, zipped = F.try_element_at(words, F.lit(-2)), F.try_element_at(words, F.lit(-1)).rlike(r"^\d{5}(-\d{4})?$")
        city = let(up_to_stop(F.reverse(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))))), told)
        sure = zipped & state.rlike("^[A-Z]{2}$")
        return let(F.when(sure, city), lambda c: F.struct(F.when(c.rlike("^[A-Za-z]."), c).alias("city"), F.when(c.rlike("^[A-Za-z]."), state).alias("state")))

    return let(F.filter(F.split(F.regexp_replace(address, "([,;])", " $1 "), r"\s+"), lambda w: w != ""), found)


def phone_digits(text: Column) -> Column:
    """The digits of a number without a leading country code."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def e164(text: Column) -> Column:
    """+1 and ten digits; null for what is no such number."""
    digits = phone_digits(text)
    return F.when(digits.rlike(r"^[2-9]\d{9}$"), F.concat(F.lit("+1"), digits))


def _label_is(word: str):
    return lambda x: F.lower(F.trim(x["label"])) == word


def first_number(cell: Column) -> Column:
    """One number out of a cell of several: the best label, else the first that is not toll-free, else the first."""
    text = F.translate(F.coalesce(cell, F.lit("")), "\u00a0", " ")
    labelled = rf"(?i)([A-Za-z][A-Za-z \-]*?)\s*Phone\s*:\s*({_PHONE})"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(labelled), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(labelled), F.lit(2)).alias("number"))
    named = [F.try_element_at(F.filter(found, _label_is(w)), F.lit(-1))["number"] for w in LABELS]
    every = F.regexp_extract_all(text, F.lit(_PHONE), F.lit(0))
    local = F.filter(every, lambda n: ~F.substring(phone_digits(n), 1, 3).isin(*TOLL_FREE))
    return F.coalesce(*named, F.try_element_at(local, F.lit(1)), F.try_element_at(every, F.lit(1)))


def team_name(cell: Column) -> Column:
    """The name of a team from a plain cell, a JSON object or the first of a JSON list; null for none."""
    text = F.trim(cell)
    inside = lambda root: F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, f"{root}.{k}")), F.lit("")) for k in ("team_name", "name", "title")])
    return F.when(text.isin("", "[]", "{}", "nan"), F.lit(None)).when(text.startswith("["), inside("$[0]")).when(text.startswith("{"), inside("$")).otherwise(text)


def absolute_url(url: Column, base: Column) -> Column:
    """A link that works by itself: from a protocol-relative, site-relative or bare-host one; null for the rest."""
    text = F.trim(url)
    site = F.regexp_replace(base, "/+$", "")
    return (
        F.when(text.startswith("//"), F.concat(F.lit("https:"), text)).when(text.startswith("/"), F.concat(site, text))
        .when(text.rlike("(?i)^https?://"), text).when(text.rlike(r"^[\w-]+(\.[\w-]+)+(/|$)"), F.concat(F.lit("https://"), text))
    )


def first_part(cell: Column) -> Column:
    """The first of several values that are split by "!", ";" or ","."""
    return F.trim(F.split(cell, "[!;,]")[0])


def iso_day(text: Column) -> Column:
    """The first ten characters; null for blanks and the words for nothing."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & ~F.lower(trimmed).isin("none", "nat"), F.substring(trimmed, 1, 10))


def category(text: Column) -> Column:
    """struct(state, market, segment) of "State - Market (Segment)"; a market "State" is none."""
    head = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    market = blank(F.regexp_extract(head, r"^.*? - (.*)$", 1))
    return F.struct(
        blank(F.split(head, " - ")[0]).alias("state"), F.when(F.lower(market) != "state", market).alias("market"),
        blank(F.regexp_extract(text, r"\(([^)]*)\)", 1)).alias("segment"),
    )


def rank_label(rank: Column, parts: Column) -> Column:
    """The short wording of a rank: by market, else by state, else bare."""
    n = F.concat(F.lit("#"), rank.cast("string"))
    return (
        F.when(rank.isNull(), "RANKED").when(parts["market"].isNotNull(), F.concat(n, F.lit(" "), F.upper(parts["market"])))
        .when(parts["state"].isNotNull(), F.concat(n, F.lit(" IN "), F.upper(parts["state"]))).otherwise(n)
    )


def platform(code: Column, known: dict[str, str]) -> Column:
    """The platform of an account code: three characters before two, the raw two where unknown."""
    labels = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    two = F.substring(code, 1, 2)
    return F.coalesce(F.element_at(labels, F.substring(code, 1, 3)), F.element_at(labels, two), F.when(two == "", "(blank)").otherwise(two))


def machine_wrote(headers: Column, subject: Column) -> Column:
    """Whether a message answers by itself, from its headers (a map with lower-case names) and its subject."""
    said = lambda name: F.coalesce(F.element_at(headers, F.lit(name)), F.lit(""))
    flags = [said(h) != "" for h in ("x-auto-response-suppress", "x-autoreply", "x-autorespond")]
    submitted = (said("auto-submitted") != "") & (F.lower(said("auto-submitted")) != "no")
    precedence = F.lower(F.trim(said("precedence"))).isin(*AUTO_PRECEDENCE)
    return F.coalesce(submitted | flags[0] | flags[1] | flags[2] | precedence, F.lit(False)) | F.coalesce(subject.rlike(AUTO_SUBJECT), F.lit(False))


def reply_kind(headers: Column, subject: Column, report: Column | None = None) -> Column:
    """bounce where the message is a delivery report, auto_reply where a machine wrote it, else reply."""
    out = F.when(machine_wrote(headers, subject), "auto_reply").otherwise("reply")
    return out if report is None else F.when(F.coalesce(report, F.lit(False)), "bounce").otherwise(out)


def guard_level(n: Column, *steps: tuple[int, str]) -> Column:
    """The level of the highest step that ``n`` exceeds, else normal; ``steps`` rise."""
    out = None
    for least, level in reversed(steps):
        out = F.when(n > least, level) if out is None else out.when(n > least, level)
    return F.lit("normal") if out is None else out.otherwise("normal")
