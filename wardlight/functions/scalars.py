"""Scalar functions: each takes columns and returns a Column that Catalyst evaluates on the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
DEGREE_M = 111_320.0

# Word lists that results depend on.
HEADS = ("mayor", "president", "village president", "acting president")
BOARDS = ("trustee", "alderperson", "alderman", "alderwoman", "council member", "commissioner", "councilman", "councilwoman", "councilperson")
OFFICERS = ("clerk", "treasurer", "village clerk", "city clerk")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "vi", "md", "phd", "dds", "esq", "cpa", "ret")
VACANT = ("vacant", "vacancy", "unassigned", "open", "tbd", "none", "n/a", "na", "-")
KEEP_CAPS = ("ES", "MS", "HS", "PS", "IS", "NE", "NW", "SE", "SW", "IL", "NY", "CA", "US")
GRADES = ("PK", "K", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12")
STREETS = {
    "street": "st", "avenue": "ave", "av": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy", "circle": "cir", "square": "sq", "terrace": "ter",
    "parkway": "pkwy", "trail": "trl",
}
DIRECTIONS = ("n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest")
UNITS = ("box", "suite", "ste", "room", "rm", "unit", "apt", "apartment", "floor", "fl")
MAILBOXES = ("gmail.com", "yahoo.com", "hotmail.com", "aol.com", "outlook.com", "icloud.com", "comcast.net")


def norm_alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def fold_letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(F.trim(c), r"(?i)^Mt\.?(?=\s|$)", "Mount")), "[^A-Z]", "")


def norm_census_place(c: Column) -> Column:
    return fold_letters(F.regexp_replace(F.trim(c), r"(?i)\s+(village|city|town|CDP)$", ""))


def norm_source_place(c: Column) -> Column:
    return fold_letters(F.regexp_replace(F.trim(c), r"(?i)^(united\s+)?(village|city|town)\s+of\s+", ""))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def unit_title_case(c: Column) -> Column:
    roman = "^X{0,3}(IX|IV|V?I{0,3})$"
    cap = lambda p: F.when(p.rlike("^[0-9]*$"), p).when((F.length(p) <= 4) & F.upper(p).rlike(roman), F.upper(p)).otherwise(
        F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000)))
    )
    return F.array_join(F.transform(_words(c), lambda w: F.array_join(F.transform(F.split(w, "-"), cap), "-")), " ")


def feed_title_case(c: Column, keep: Sequence[str] = KEEP_CAPS) -> Column:
    cap = lambda w: F.when((F.length(w) == 1) | w.rlike("[0-9]") | w.isin(*keep), w).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000)))
    )
    return F.array_join(F.transform(_words(c), cap), " ")


def grade_range(c: Column, grades: Sequence[str] = GRADES) -> Column:
    """A contiguous list of grades as first–last; anything else unchanged."""
    order = F.array(*map(F.lit, grades))
    at = F.transform(F.split(c, r"\s*,\s*"), lambda g: F.array_position(order, F.trim(g)))
    n = F.size(at)
    straight = (n > 1) & (F.array_min(at) > 0) & (
        F.element_at(at, -1) - F.element_at(at, 1) == n - 1
    ) & (F.size(F.array_distinct(at)) == n) & (F.array_sort(at) == at)
    return F.when(
        straight,
        F.concat(F.element_at(order, F.element_at(at, 1).cast("int")), F.lit("–"), F.element_at(order, F.element_at(at, -1).cast("int")))
    ).otherwise(c)


def uninvert_name(c: Column) -> Column:
    """`Last, First` → `First Last`; null where the name has another shape or ends in a suffix."""
    last, first = (F.trim(F.regexp_extract(F.trim(c), r"^([^,]+),([^,]+)$", i)) for i in (1, 2))
    plain = r"^[A-Za-z][A-Za-z .'’‘-]*$"
    return F.when(
        last.rlike(plain) & first.rlike(plain) & ~F.lower(F.trim(F.regexp_replace(first, r"\.", ""))).isin(*SUFFIXES),
        F.concat_ws(" ", first, last)
    )


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: w != "")


def name_parts(c: Column) -> Column:
    """struct(first, last) without quoted nicknames, parentheses and suffixes."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"\x22[^\x22]*\x22|\([^)]*\)", " "), "[.,]", " "))
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*SUFFIXES))
    return F.struct(
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first"),
        F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last")
    )


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def format_phone(c: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^1(?=[0-9]{10}$)", "")
    return F.when(digits.rlike("^[0-9]{10}$"), F.regexp_replace(digits, "^(...)(...)(....)$", "$1-$2-$3")).otherwise(c)


def normalise_website(c: Column) -> Column:
    bare = F.nullif(F.trim(c), F.lit(""))
    return F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def host_of(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def slug(c: Column, overrides: Mapping[str, str] | None = None) -> Column:
    plain = F.replace(F.replace(F.lower(c), F.lit("."), F.lit("")), F.lit(" "), F.lit("-"))
    if not overrides:
        return plain
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), c), plain)


def street_key(c: Column) -> Column:
    """House number and the sorted street words, without directions and whatever follows a unit, floor or box; null for a PO box or no number."""
    text = F.lower(F.regexp_replace(F.trim(c), r"^#\s*(?=[0-9])", ""))
    text = F.regexp_replace(text, rf"\b(?:[0-9]+\s*(?:st|nd|rd|th)?\s*floor|p\.?\s?o\.?\s+box|{'|'.join(UNITS)}|#)\b.*", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[.,]", " "), r"\s+", " "))
    number, rest = F.regexp_extract(text, "^([0-9]+[a-z]?) (.*)$", 1), F.regexp_extract(text, "^([0-9]+[a-z]?) (.*)$", 2)
    names = F.create_map(*[F.lit(x) for kv in STREETS.items() for x in kv])
    words = F.filter(F.transform(F.split(rest, " "), lambda w: F.coalesce(F.try_element_at(names, w), w)), lambda w: (w != "") & ~w.isin(*DIRECTIONS))
    return F.when((number != "") & (F.size(words) > 0), F.concat_ws(" ", number, F.array_join(F.array_sort(F.array_distinct(words)), " ")))


def city_key(c: Column) -> Column:
    """The last line up to `, IL`, lower-cased with single spaces."""
    last = F.trim(F.regexp_extract(c, r"([^\n]*)$", 1))
    found = F.regexp_extract(last, r"(?i)^(.*?),\s*IL\b", 1)
    return F.lower(F.trim(F.regexp_replace(F.when(found != "", found).otherwise(last), r"\s+", " ")))


def address_line(street: Column, city: Column, state: Column, zip_: Column) -> Column:
    empty = F.lit("")
    place = F.nullif(F.concat_ws(" ", F.nullif(city, empty), F.nullif(state, empty)), empty)
    return F.nullif(F.concat_ws(", ", F.nullif(street, empty), F.when(place.isNotNull(), F.concat_ws(" ", place, F.nullif(zip_, empty)))), empty)


def squash_space(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def election_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), "^([0-9]{4})", 1), F.lit(""))


def iso_ts(c: Column) -> Column:
    """ISO time with or without fractions and offset, as a UTC timestamp under a UTC session; null if it is none."""
    return F.try_to_timestamp(c)


def cron_days(c: Column) -> Column:
    parts = F.split(F.trim(c), r"\s+")
    return F.when(
        F.coalesce(F.trim(c), F.lit("")) == "", F.lit(None).cast("int")
    ).when(F.size(parts) != 5, 7).when(F.try_element_at(parts, F.lit(3)) != "*", 31).when(F.try_element_at(parts, F.lit(5)) != "*", 7).otherwise(1)


def age_days(then: Column, now: Column) -> Column:
    return F.datediff(now, then)


def is_stale(then: Column, now: Column, limit: int = 400) -> Column:
    return age_days(then, now) > limit


def office_class(c: Column) -> Column:
    o = F.lower(F.trim(c))
    return F.when(o.isin(*HEADS), "head").when(o.isin(*BOARDS), "board").when(o.isin(*OFFICERS), "officer")


def district_number(*fields: Column) -> Column:
    found = [F.nullif(F.regexp_extract(f, r"^(?:District\s+)?([0-9]+)", 1), F.lit("")) for f in fields]
    return F.coalesce(*found)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_xy(lng: Column, lat: Column, lat0: Column) -> Column:
    return F.struct((lng * DEGREE_M * F.cos(F.radians(lat0))).alias("x"), (lat * DEGREE_M).alias("y"))


def affine_xy(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    return F.struct((x * a + y * b + c).alias("x"), (x * d + y * e + f).alias("y"))


def round_coords(rings: Column, places: int = 6) -> Column:
    """Rounds every vertex of an array of rings and closes rings that rounding or the source left open."""
    near = lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y"))
    close = lambda r: F.when((F.size(r) > 0) & (r[0] != F.element_at(r, -1)), F.concat(r, F.array(r[0]))).otherwise(r)
    return F.transform(rings, lambda r: close(F.transform(r, near)))


def densify(ax: Column, ay: Column, bx: Column, by: Column, step: float) -> Column:
    """Points every `step` or less along a segment, both ends included."""
    n = F.greatest(F.ceil(F.hypot(bx - ax, by - ay) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((ax + (bx - ax) * k / n).alias("x"), (ay + (by - ay) * k / n).alias("y")))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def segment_foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(x, y, dist): the nearest point of a segment, clamped to its ends.

    dist is the root of the squares, as in SQL, and not hypot, whose last digit may differ and decide between equal neighbours.
    """
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    t = F.when(span == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / span)))
    return F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"), distance(px - (ax + t * dx), py - (ay + t * dy)).alias("dist"))


def chord_deviation(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to the line through a and b, or to a where they are one point."""
    chord = F.hypot(bx - ax, by - ay)
    return F.when(chord == 0, F.hypot(px - ax, py - ay)).otherwise(F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / chord)


def flatten_rings(polygons: Column) -> Column:
    return F.flatten(polygons)


def legal_name(c: Column) -> Column:
    form, base = F.regexp_extract(c, r"(?i)^(.*\S)\s+(village|city|town)$", 2), F.regexp_extract(c, r"(?i)^(.*\S)\s+(village|city|town)$", 1)
    return F.when(c.rlike(r"(?i)^(village|city|town)\s+of\s"), c).when(
        form != "", F.concat(F.upper(F.substring(form, 1, 1)), F.lower(F.substring(form, 2, 20)), F.lit(" of "), base)
    ).otherwise(c)


def strip_exact_prefix(c: Column, unit: Column) -> Column:
    lead = F.concat(unit, F.lit(" - "))
    return F.when(F.startswith(c, lead), F.substr(c, F.length(lead) + 1, F.length(c))).otherwise(c)


def is_personal_mailbox(c: Column, domains: Sequence[str] = MAILBOXES) -> Column:
    return F.lower(F.substring_index(c, "@", -1)).isin(*domains) & F.contains(c, F.lit("@"))


def split_ward(c: Column) -> Column:
    """struct(body, ward): `X, 1st Ward` and `X, Ward 1` both give Ward 1; without a ward it is null."""
    nth = r"(?i)^(.*?),\s*([0-9]+)(?:st|nd|rd|th)\s+(Ward|District)\s*$"
    named = r"^(.*?),\s*((?:Ward|District)\s+.+)$"
    body = F.when(c.rlike(nth), F.regexp_extract(c, nth, 1)).when(c.rlike(named), F.regexp_extract(c, named, 1)).otherwise(c)
    ward = F.when(
        c.rlike(nth), F.concat_ws(" ", F.initcap(F.regexp_extract(c, nth, 3)), F.regexp_extract(c, nth, 2))
    ).when(c.rlike(named), squash_space(F.regexp_extract(c, named, 2)))
    return F.struct(squash_space(body).alias("body"), ward.alias("ward"))


def compact(*cols: Column) -> list[Column]:
    """Blank text as null, so that JSON output leaves the field out."""
    return [F.nullif(F.trim(c), F.lit("")) for c in cols]


def informative_lines(lines: Column, building_zip: str = "62706") -> Column:
    """The lines that say something, or null: a phone needs ten digits, an address more than a state and a zip."""

    def says(line: Column) -> Column:
        t = F.trim(F.coalesce(line, F.lit("")))
        bare = F.regexp_replace(
            F.regexp_replace(F.regexp_replace(t, r"(?i)\b(IL|Illinois)\b", " "), r"\b[0-9]{5}(-[0-9]{4})?\b", " "), "[^A-Za-z0-9]+", ""
        )
        return (t != "") & F.when(t.rlike(r"^[\s()\-.0-9]+$"), F.length(F.regexp_replace(t, "[^0-9]", "")) >= 10).otherwise(bare != "")

    kept = F.filter(lines, says)
    lone = (F.size(kept) == 1) & F.try_element_at(kept, F.lit(1)).rlike(rf"^\s*[A-Za-z ]+,\s*IL\s*{building_zip}\s*$")
    return F.when((F.size(kept) > 0) & ~lone, kept)
