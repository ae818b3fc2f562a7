"""Normal forms of names, addresses, amounts and identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landloom.functions.geo import let

#: Tokens that a name loses, street words and their short forms, compass tokens.
NAME_STOP = ["ET", "AL", "TR", "TRUST", "LLC", "INC", "LTD"]
STREET_WORDS = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "CIRCLE": "CIR", "BOULEVARD": "BLVD", "PLACE": "PL", "TERRACE": "TER", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "TRAIL": "TRL",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
COMPASS = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def owner_name(c: Column) -> Column:
    """Upper case, & as AND, letters, digits and spaces only, without legal tokens; '' for null."""
    plain = F.regexp_replace(F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9\s]", " ")
    return F.array_join(F.filter(tokens(plain), lambda t: ~t.isin(NAME_STOP)), " ")


def surname(name: Column) -> Column:
    return F.coalesce(F.get(F.filter(tokens(name), lambda t: t != "AND"), F.lit(0)), F.lit(""))


def subset_ratio(a: Column, b: Column) -> Column:
    """Share of the tokens of a that b has (repeats count)."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.filter(x, lambda t: F.array_contains(y, t))) / F.size(x))


def overlap_ratio(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.filter(y, lambda t: F.array_contains(x, t))) / F.greatest(F.size(x), F.size(y)))


def owner_address(c: Column) -> Column:
    """house, street, street_relaxed (without compass tokens), city, zip5, po_box, strict_key, relaxed_key and is_po_box of an address. Each form is computed once from the one before."""
    up = F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" AND "))
    parts = F.split(up, ",")
    plain = lambda p: collapsed(F.regexp_replace(F.coalesce(p, F.lit("")), r"[^A-Z0-9\s]", " "))
    words = F.create_map(*[x for pair in STREET_WORDS.items() for x in map(F.lit, pair)])
    house_of = lambda line: F.regexp_extract(line, r"\b(\d+)\b", 1)
    street_of = lambda line, house: F.when((house != "") & F.startswith(line, house), F.trim(F.substring(line, F.length(house) + 1, F.length(line)))).otherwise(line)
    without_compass = lambda street: F.array_join(F.filter(tokens(street), lambda t: ~t.isin(COMPASS)), " ")

    def told(h: Column, line: Column, house: Column, street: Column, relaxed: Column) -> Column:
        or_empty = lambda x: F.when(h["known"], x).otherwise("")
        return F.struct(
            or_empty(house).alias("house"), or_empty(street).alias("street"), or_empty(relaxed).alias("street_relaxed"), or_empty(h["city"]).alias("city"), or_empty(h["zip5"]).alias("zip5"),
            or_empty(F.regexp_extract(h["up"], r"\b(?:P\s*O\s*BOX|POBOX|PMB)\s*(\d+)\b", 1)).alias("po_box"),
            or_empty(F.concat_ws("|", house, street, h["city"], h["zip5"])).alias("strict_key"), or_empty(F.concat_ws("|", house, relaxed, h["city"], h["zip5"])).alias("relaxed_key"),
            (h["known"] & (F.contains(line, F.lit("PO BOX")) | F.contains(line, F.lit("PMB")))).alias("is_po_box"),
        )

    def of(h: Column) -> Column:
        city = F.array_join(F.filter(tokens(h["place"]), lambda t: ~t.isin("GA", "GEORGIA")), " ")
        zip5 = F.regexp_extract(h["up"], r"\b(\d{5})(?:-\d{4})?\b", 1)
        held = F.struct(h["up"].alias("up"), ((h["line"] != "") | (h["place"] != "")).alias("known"), city.alias("city"), zip5.alias("zip5"))
        canonical = F.array_join(F.transform(tokens(h["line"]), lambda t: F.coalesce(F.element_at(words, t), t)), " ")
        by_relaxed = lambda k, line, house, street: let(without_compass(street), lambda r: let(F.when(r == "", street).otherwise(r), lambda relaxed: told(k, line, house, street, relaxed)))
        by_street = lambda k, line, house: let(street_of(line, house), lambda street: by_relaxed(k, line, house, street))
        return let(held, lambda k: let(canonical, lambda line: let(house_of(line), lambda house: by_street(k, line, house))))

    return let(F.struct(up.alias("up"), plain(F.get(parts, F.lit(0))).alias("line"), plain(F.get(parts, F.lit(1))).alias("place")), of)


def confidence_band(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 55, "medium").otherwise("low")


def clean_address(c: Column) -> Column:
    return F.nullif(collapsed(F.coalesce(c, F.lit(""))), F.lit(""))


def zip5(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 9, F.left(digits, F.lit(5))).when(F.length(digits) == 5, digits).otherwise("")


def money(c: Column) -> Column:
    """$1,234.56 and (12.00) as numbers; 0 where there is none."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[$,\s]", ""))
    negative = F.rlike(plain, F.lit(r"^\(.*\)$"))
    value = F.coalesce(F.regexp_replace(plain, "[()]", "").try_cast("double"), F.lit(0.0))
    return F.when(negative, -value).otherwise(value)


def title_words(c: Column) -> Column:
    return F.initcap(F.lower(collapsed(c)))


def preferred_flag(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low.isin("y", "yes", "true", "t") | (F.coalesce(low.try_cast("int"), F.lit(0)) > 0)


def feature_id(county: Column, objectid: Column) -> Column:
    return F.concat(county.cast("string"), F.lit("_"), objectid.cast("string"))


def base_url(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words (runs of letters and digits) in lower case, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


#: Words of an address line and their short forms, longest first.
LINE_WORDS = {
    " BOULEVARD": " BLVD", " TERRACE": " TER", " HIGHWAY": " HWY", " PARKWAY": " PKWY", " AVENUE": " AVE", " STREET": " ST",
    " CIRCLE": " CIR", " COURT": " CT", " DRIVE": " DR", " PLACE": " PL", " ROAD": " RD", " LANE": " LN",
}


def address_line(c: Column) -> Column:
    """Upper case, street words shortened, blanks collapsed."""
    out = F.upper(F.trim(c))
    for word, short in LINE_WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(short))
    return collapsed(out)


def owner_block(block: Column, physical: Column) -> Column:
    """name and address of an owner block of lines: split at the line of the physical address, else at a PO box, else at a line that begins with digits; all name where there is none."""
    known = address_line(F.coalesce(physical, F.lit("")))
    first_word = lambda c: F.regexp_extract(c, r"^(\S*)", 1)

    def at_address(line: Column) -> Column:
        plain = address_line(line)
        return (known != "") & (F.contains(plain, known) | F.contains(known, plain) | ((first_word(plain) == first_word(known)) & F.rlike(known, F.lit(r"^\d"))))

    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), r"(?i)<br\s*/?>|\n"), lambda p: F.trim(p)), lambda p: p != "")

    def cut(held: Column) -> Column:
        first = lambda fits: F.array_min(F.filter(F.transform(held, lambda p, i: F.when(fits(p, i), i)), lambda i: i.isNotNull()))
        at = F.coalesce(first(lambda p, i: (i > 0) & at_address(p)), first(lambda p, i: F.rlike(p, F.lit(r"(?i)^P[\s.]?O[\s.]?\s*BOX"))), first(lambda p, i: F.rlike(p, F.lit(r"^\d"))), F.size(held))
        return F.struct(F.array_join(F.slice(held, F.lit(1), at), " ").alias("name"), F.array_join(F.slice(held, at + 1, F.size(held)), " ").alias("address"))

    return F.transform(F.array(lines), cut)[0]


def html_owner(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "<b>Owner</b> - (.*?)<br>", 1))


def html_acres(html: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_extract(html, "<b>Acres</b> - (.*?)<br>", 1)).try_cast("double"), F.lit(0.0))


def site_number(address: Column) -> Column:
    """The first word of an address if it is a whole number, else ''."""
    word = F.coalesce(F.get(tokens(address), F.lit(0)), F.lit(""))
    return F.when(F.rlike(word, F.lit(r"^[+-]?\d+$")), word).otherwise("")


def merged_district(old: Column, new: Column) -> Column:
    """A parcel's tax district after a bill's: the new one if it is there and extends the old one or there is none, else both."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when((b == "") | (a == b), F.nullif(a, F.lit(""))).when(F.startswith(b, a), b).otherwise(F.concat(a, F.lit(" "), b))


def url_parameter(url: Column, name: str) -> Column:
    """A query parameter as it stands, not decoded; '' where absent."""
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def copy_address(c: Column) -> Column:
    """Line breaks as commas, one blank behind each comma."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*[\r\n]+\s*", ", "), r"\s*,\s*(?:,\s*)*", ", "), r"\s+", " "))


def log_position(value: Column, low: Column, high: Column, steps: int = 1000) -> Column:
    """Place of a value on a logarithmic scale of steps between low and high, held inside; log_value finds the value again."""
    inside = F.greatest(low, F.least(high, value))
    span = F.log1p(high - low)
    return F.when(high > low, F.log1p(inside - low) / span * steps).otherwise(0.0)


def log_value(position: Column, low: Column, high: Column, steps: int = 1000) -> Column:
    """The value at a place of log_position's scale."""
    return low + F.expm1(F.greatest(F.lit(0), F.least(F.lit(steps), position)) / steps * F.log1p(high - low))


def size_text(n: Column, largest: str = "TB") -> Column:
    """Bytes as B, KB, MB, GB, TB, none larger than the largest; whole bytes and tenths are the nearest, even ones of two."""
    tenths = lambda power, unit: F.concat(F.replace(F.format_number(n / 1024**power, 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
    units = ("KB", "MB", "GB", "TB")
    known = units[: units.index(largest) + 1]
    out = tenths(len(known), largest)
    for power, unit in reversed(list(enumerate(known[:-1], 1))):
        out = F.when(n < 1024 ** (power + 1), tenths(power, unit)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", F.rint(n).cast("long"))).otherwise(out)
