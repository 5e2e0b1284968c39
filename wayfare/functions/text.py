"""Text normalisation and matching as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters, and each without its marks."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()

# fixed values: words that station names lose before they are compared
GENERIC_WORDS = "estacion|metrobus|metro|anden|platforma|plataforma|linea|line|l"
COMPASS_WORDS = "norte|sur|oriente|poniente"
#: Characters of a first name from which one name may lie within the other.
INNER = 5
# fixed values: networks that don't name a line
GENERIC_NETWORKS = "^(metrobus|stc metro|metro cdmx|mexibus|cablebus)$"


def normalize(text: Column, trim: bool = True) -> Column:
    """Without accents, lower case; null as empty."""
    bare = F.lower(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), ACCENTED, PLAIN), "[̀-ͯ]", ""))
    return F.trim(bare) if trim else bare


def normalize_name(text: Column) -> Column:
    """normalize() without generic words and with single spaces for what is no letter or digit."""
    bare = normalize(text, trim=False)
    for words in (GENERIC_WORDS, COMPASS_WORDS):
        bare = F.regexp_replace(bare, rf"\b({words})\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(text, trim=False), "[^a-z0-9]+", "-"), "^-|-$", "")


def name_words(name: Column) -> Column:
    """The distinct words of 3 letters at least of a normalised name."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) > 2))


def names_match(first: Column, second: Column) -> Column:
    """Equal, one within the other if the first has 5 characters at least, or 60 % of the
    shorter one's words of 3 letters at least shared; both normalised and not empty."""
    return normal_names_match(normalize_name(first), normalize_name(second))


def normal_names_match(a: Column, b: Column) -> Column:
    """names_match() of names that are normalised."""
    return worded_names_match(a, name_words(a), b, name_words(b))


def worded_names_match(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """names_match() of names that are normalised, with their words."""
    fewer = F.least(F.size(wa), F.size(wb))
    shared = F.when(fewer > 0, F.size(F.array_intersect(wa, wb)) / fewer >= 0.6).otherwise(F.lit(False))
    inside = (F.length(a) >= INNER) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside | shared)


def route_groups(route_ref: Column, route_name: Column, network: Column) -> Column:
    """The distinct normalised parts of the route's reference and name, and of a network that names a line."""
    own = F.when(~normalize(network).rlike(GENERIC_NETWORKS), F.coalesce(network, F.lit(""))).otherwise(F.lit(""))
    parts = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), ";") for c in (route_ref, route_name, own))))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: normalize(x)), lambda x: x != ""))


def gtfs_minutes(time: Column, strict: bool = False) -> Column:
    """Minutes since the service day's midnight of H:MM:SS, hours of 24 and more too; null for other text.

    strict: two digits for minutes and seconds each. Else any finite numbers, a missing one counts as 0.
    """
    if strict:
        ok = time.rlike(r"^\d+:\d{2}:\d{2}$")
        part = lambda k: F.regexp_extract(time, r"^(\d+):(\d{2}):(\d{2})$", k).cast("double")
        return F.when(ok, part(1) * 60 + part(2) + part(3) / 60)
    parts = F.split(time, ":")
    number = lambda k: F.when(F.size(parts) >= k, F.element_at(parts, k).try_cast("double")).otherwise(F.lit(0.0))
    return F.when(F.trim(time) != "", number(1) * 60 + number(2) + number(3) / 60)


def gtfs_weekday(date: Column) -> Column:
    """Monday is 0, of YYYYMMDD; null for other text."""
    return F.weekday(F.try_to_date(date, "yyyyMMdd"))


def service_key(route_id: Column, direction_id: Column) -> Column:
    """route/direction; an empty direction is 0."""
    return F.concat_ws("/", route_id, F.when(F.coalesce(direction_id, F.lit("")) == "", F.lit("0")).otherwise(direction_id))


def route_of_service(key: Column) -> Column:
    return F.regexp_replace(key, "/[^/]*$", "")
