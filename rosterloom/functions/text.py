"""Text: comparison keys, addresses, phones, money, quotes, templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street suffixes and directions with their short forms, longer directions first.
SUFFIXES = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "DRIVE": "DR", "BOULEVARD": "BLVD", "PARKWAY": "PKWY", "LANE": "LN", "COURT": "CT",
    "CIRCLE": "CIR", "PLACE": "PL", "TERRACE": "TER", "HIGHWAY": "HWY", "TRAIL": "TRL", "SQUARE": "SQ", "TURNPIKE": "TPKE", "EXPRESSWAY": "EXPY",
    "CENTER": "CTR", "PLAZA": "PLZ", "POINT": "PT", "RIDGE": "RDG", "CROSSING": "XING", "EXTENSION": "EXT", "FREEWAY": "FWY", "JUNCTION": "JCT",
}
DIRECTIONS = {
    "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW", "NORTH EAST": "NE", "NORTH WEST": "NW", "SOUTH EAST": "SE", "SOUTH WEST": "SW",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
}
#: Designators of a part of a building.
UNITS = ["SUITE", "STE", "FLOOR", "FL", "UNIT", "APT", "APARTMENT", "ROOM", "RM", "BLDG", "BUILDING"]
#: Legal forms that do not tell firms apart; blanks stand where points stood.
LEGAL_FORMS = ["INC", "INCORPORATED", "LLC", "L L C", "LLP", "LP", "L P", "LTD", "CO", "COMPANY", "CORP", "CORPORATION", "PLLC", "PC", "PA", "SA", "NA", "N A", "TRUST", "GROUP"]
#: Filed placeholders that are no names.
NO_NAMES = ["SAME", "NA", "NONE", "N A", "NOT APPLICABLE", "SEE ABOVE", "NULL"]


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither blank nor "nan"."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def key(text: Column) -> Column:
    return F.upper(F.trim(text))


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def loose(text: Column) -> Column:
    """Lower case with every stretch of punctuation and blanks as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def loose_contains(text: Column, term: Column) -> Column:
    """Contained as words run, or with blanks removed for terms of three characters or more."""
    tight = F.replace(loose(term), F.lit(" "), F.lit(""))
    return F.contains(loose(text), loose(term)) | ((F.length(tight) >= 3) & F.contains(F.replace(loose(text), F.lit(" "), F.lit("")), tight))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def firm_key(name: Column) -> Column:
    """Firm names that differ in case, ampersands, punctuation or legal form compare equal."""
    plain = F.regexp_replace(F.replace(F.upper(name), F.lit("&"), F.lit(" AND ")), r"[^\w\s]", " ")
    forms = "|".join(f.replace(" ", r"\s*") for f in LEGAL_FORMS)
    return _squeeze(F.regexp_replace(plain, rf"\b({forms})\b", " "))


def aliases(current: Column, others: Column) -> Column:
    """The distinct other names of a firm in filed order: no placeholders, none that equals the current name or an earlier one."""
    keyed = F.filter(F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda n: F.struct(F.trim(n).alias("n"), firm_key(n).alias("k"))), lambda x: (F.length(x["k"]) >= 3) & ~x["k"].isin(*NO_NAMES) & (x["k"] != firm_key(current)))
    first = F.filter(keyed, lambda x, i: ~F.array_contains(F.transform(F.slice(keyed, 1, i), lambda y: y["k"]), x["k"]))
    return F.transform(first, lambda x: x["n"])


def street(line: Column) -> Column:
    """A street line for comparison; null unless it begins with a digit.

    A building's name before a dash goes, so does what follows a unit designator or a comma.
    """
    out = _squeeze(F.replace(F.upper(line), F.lit("."), F.lit(" ")))
    out = F.regexp_replace(out, r"^[A-Z][A-Z '-]*[-–] ?(?=\d)", "")
    out = F.regexp_replace(out, rf"[ ,]*(\b({'|'.join(UNITS)})\b|(?<=\w)#(?=\w)).*$", "")
    out = F.split(out, " ?,")[0]
    for long, short in [*DIRECTIONS.items(), *SUFFIXES.items()]:
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    out = _squeeze(out)
    return F.when(out.rlike(r"^\d"), out)


def street_of(line1: Column, line2: Column) -> Column:
    """The line that carries a street address, the first if both do."""
    return F.coalesce(street(line1), street(line2))


def house_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(line), r"^(\d+)", 1), F.lit(""))


#: The numbers that filings spell out.
NUMBER_WORDS = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN"]


def filed_number(line: Column) -> Column:
    """The house number of a filed line: digits, a spelled number, or a grid number in one or two words."""
    words = F.transform(F.split(F.trim(line), r"\s+"), lambda w: F.upper(F.regexp_replace(w, ",+$", "")))
    head, after, grid = F.get(words, 0), F.get(words, 1), r"^[NSEW]\d+$"
    spelled = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), head)
    return (
        F.when(head.rlike(r"^\d+$"), head).when(spelled > 0, spelled.cast("string"))
        .when(head.rlike(grid) & after.rlike(grid), F.concat(head, after)).when(head.rlike(r"^([NSEW]\d+){1,2}$"), head)
    )


def address_key(line: Column, city: Column, state: Column, postal: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (key(line), key(city), key(state), F.substring(F.trim(postal), 1, 5))])


def phone_digits(text: Column) -> Column:
    """Ten digits, a leading country 1 dropped; null for anything else."""
    digits = F.regexp_replace(text, r"\D", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) == 10, digits)


def pretty_phone(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def money(text: Column) -> Column:
    """"over $5.7B", "250 M", "900K" and plain numbers as doubles; the first amount in the text."""
    found = lambda k: F.regexp_extract(text, r"(?i)\$?\s*([\d.,]+)\s*([BMK])?", k)
    amount, unit = F.replace(found(1), F.lit(","), F.lit("")).try_cast("double"), F.upper(found(2))
    return amount * F.when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)


#: Typographic variants and ligatures with what they stand for.
VARIANTS = ("‘’‚‛“”„–—−\u00a0\ufffd", "'" * 4 + '"' * 3 + "-" * 3 + " " * 2)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def fold_quote(text: Column) -> Column:
    """Curly quotes, dashes, ligatures, white space and case folded, for containment tests."""
    out = F.translate(text, *VARIANTS)
    for ligature, plain in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(plain))
    return F.lower(_squeeze(out))


def quote_present(text: Column, quote: Column, least: int = 12) -> Column:
    """Contained, or split at its ellipses each part longer than ``least`` characters is (and there is one)."""
    body, said = fold_quote(text), fold_quote(quote)
    parts = F.filter(F.split(said, r"\s*(?:\.\.\.|…)\s*"), lambda p: F.length(p) > least)
    return (said != "") & (F.contains(body, said) | ((F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(body, p))))


#: What a field says when it was not found, or found absent.
NEGATIVE = ["no", "false", "none", "not_stated", "null", ""]


def quote_status(given: Column, value: Column, quote: Column, source: Column) -> Column:
    """Of one extracted field: missing, not stated, a negative finding, without quote, verified or not in the source."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(~F.coalesce(given, F.lit(False)), "missing_field").when(value.isNull() | value.isin("", "null", "not_stated"), "not_stated")
        .when(low(value).isin(*NEGATIVE), "negative_finding").when(low(quote).isin(*NEGATIVE), "VALUE_WITHOUT_QUOTE")
        .when(F.coalesce(quote_present(source, quote), F.lit(False)), "verified").otherwise("QUOTE_NOT_IN_SOURCE")
    )


def csv_guard(text: Column) -> Column:
    """A leading formula character is neutralised."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def render(template: Column, values: dict[str, Column]) -> Column:
    """``{{field}}`` replaced for the fields allowed; other braces stay to be reported."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def sorted_set(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def short_money(dollars: Column) -> Column:
    """$1.2T, $12B, $340M, $7K or $950: one decimal below ten of a unit, none above."""
    d = dollars.cast("decimal(30,6)")

    def unit(size: int, mark: str) -> Column:
        value = (d / F.lit(size)).cast("decimal(38,12)")
        text = F.when(d < 10 * size, F.round(value, 1).cast("decimal(38,1)").cast("string")).otherwise(F.round(value, 0).cast("decimal(38,0)").cast("string"))
        return F.concat(F.lit("$"), text, F.lit(mark))

    whole = lambda v: F.floor(v + F.lit(0.5)).cast("long")
    small = F.concat(F.lit("$"), F.format_number(whole(d), 0))
    thousands = F.when(d >= 10**6, F.concat(F.lit("$"), whole(d / 10**6).cast("string"), F.lit("M"))).when(d >= 1000, F.concat(F.lit("$"), whole(d / 1000).cast("string"), F.lit("K"))).otherwise(small)
    return F.when(d >= 10**12, unit(10**12, "T")).when(d >= 10**9, unit(10**9, "B")).when(d.isNotNull(), thousands)


def tenure(start: Column, today: Column) -> Column:
    """'5 months', '1 year', '3 yr 2 mo' from a day to another; a month is 30.4375 days."""
    months = F.greatest(F.floor(F.datediff(today, start) / F.lit(30.4375) + 0.5), F.lit(0)).cast("long")
    years, rest = F.floor(months / 12).cast("long"), months % 12
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    long = F.when(rest > 0, F.concat(years.cast("string"), F.lit(" yr "), rest.cast("string"), F.lit(" mo"))).otherwise(plural(years, "year"))
    return F.when(months < 12, plural(months, "month")).otherwise(long)
