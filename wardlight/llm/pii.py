"""Personal data: validated numbers and dates become keyed pseudonyms of the same format. DataFrame operations only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import free_name, read

#: The session setting that holds the secret key. Without it a session draws a key of its own.
KEY_SETTING = "spark.wardlight.pii.key"
ROUNDS = 8
HEXES = 32  # amounts, of four hex digits each, that one digest gives
#: Days from 1900-01-01 to 2099-12-31, and two factors of their number: dates are permuted among exactly these days.
FIRST_DAY, DAYS, PARTS = "1900-01-01", 73_049, (17, 4_297)

EMAIL = r"(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,8}"
#: Lengths of the countries' IBANs; a country that isn't listed has what its capitals and digits give.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n,
    c in IBAN_LENGTHS.items()
) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SECRET = r"AKIA[A-Z0-9]{16}|(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?\x22?[^\s\x22]{6,}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: With a country code or an area code in parentheses; else with dashes or dots and no code that begins with 0 or 1; with
#: blanks alone only after a word for telephone, since three numbers in a row are mostly no telephone number.
PHONE = (
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
    r"|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4}"
    r"|(?<=(?i:tel|phone|telephone|call|fax|mobile|cell)[:. ]{1,2})[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}|\+[0-9]{8,15}"
)
PHONE_SHAPE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{8,15}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
#: A card found within a run of digit groups stands between these two, which are no characters of any text.
MARKS = "\ufdd0\ufdd1"
IN_RUN = "\ufdd2"  # before a run that is searched once more
MARKED = f"{MARKS[0]}[0-9 -]+{MARKS[1]}"
#: The order decides at one place: the earlier form wins.
FORMS = (("secret", SECRET), ("email", EMAIL), ("iban", IBAN), ("ip", IPV4), ("date", DATE), ("ssn", SSN), ("phone", PHONE), ("card", CARD))
#: Not inside a longer run of letters and digits.
CANDIDATE = rf"(?<![A-Za-z0-9])(?:{MARKED}|" + "|".join(f"(?:{p})" for _, p in FORMS) + r")(?![A-Za-z0-9])"
#: What is tried before a card at one place, and a run of digit groups of any length, from 13 digits on.
EARLIER = "(?:" + "|".join(f"(?:{p})" for name, p in FORMS if name != "card") + ")(?![A-Za-z0-9])"
RUN = r"(?=[0-9](?:[ -]?[0-9]){12})[0-9 -]*[0-9](?![A-Za-z0-9]|[A-Za-z0-9._%+-]*+@)"
#: What any form begins with, so that the forms are tried at few words: a digit, letters up to a digit or an @, or a label.
BEGIN = r"(?=[0-9]|[+(][0-9]|(?<![._%+-])[A-Za-z._%+-]++[0-9@]|[A-Za-z][A-Za-z_-]{1,7}+ ?[0-9=:]|AKIA)"
EARLIER_OR_RUN = rf"(?<![A-Za-z0-9]){BEGIN}(?:{EARLIER}|{RUN})"


def _once(value: Column, f) -> Column:
    """f(value), value being evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _number(key: Column, *parts: Column) -> Column:
    """A keyed number below 2^32."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *parts), 256), 1, 8), 16, 10).cast("long")


def _shift(key: Column, text: Column, other: Column, kind: Column, round_: Column) -> Column:
    """Adds a keyed amount to each digit, lower and upper case letter within its class; other characters stay.

    The amounts are parts of a digest for each HEXES characters, which depends on the key, the kind, the round, the
    other half and this half's length.
    """
    n = F.length(text)
    digest = lambda b: F.sha2(F.concat_ws("|", key, kind, round_.cast("string"), other, n.cast("string"), b.cast("string")), 512)
    digests = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / HEXES).cast("int")), digest)

    def one(all_: Column, i: Column) -> Column:
        hexes = F.substr(F.element_at(all_, F.floor(i / HEXES).cast("int") + 1), (i % HEXES) * 4 + 1, F.lit(4))
        c = F.substr(text, i + 1, F.lit(1))
        code = F.ascii(c)
        first = F.when(code.between(48, 57), 48).when(code.between(97, 122), 97).when(code.between(65, 90), 65)
        size = F.when(code <= 57, 10).when(kind == "hex", 6).otherwise(26)
        return F.coalesce(F.char(first + F.pmod(code - first + F.conv(hexes, 16, 10).cast("int"), size)), c)

    shifted = _once(digests, lambda all_: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(all_, i)), ""))
    return F.when(n == 0, F.lit("")).otherwise(shifted)


def feistel_text(key: Column, text: Column, kind: Column) -> Column:
    """Keyed permutation of the strings with the same characters' classes: halves are shifted in turn by amounts drawn from the other half."""
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1, F.length(text))
    start = F.struct(left.alias("l"), right.alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        own, other = (F.when(even, s[x]).otherwise(s[y]) for x, y in (("l", "r"), ("r", "l")))
        moved = _shift(key, own, other, kind, k)
        return _once(moved, lambda m: F.struct(F.when(even, m).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(m).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(key: Column, value: Column, a: int | Column, b: int | Column, kind: str | Column) -> Column:
    """Keyed permutation of 0 .. a*b - 1 by an unbalanced network over value div b and value mod b."""
    a, b = (x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        own, other = (F.when(even, s[x]).otherwise(s[y]) for x, y in (("l", "r"), ("r", "l")))
        moved = F.pmod(own + _number(key, kind, k.cast("string"), other.cast("string")), F.when(even, a).otherwise(b))
        return _once(moved, lambda m: F.struct(F.when(even, m).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(m).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _part(number: Column, at: int, n: int) -> Column:
    return F.substr(number, F.lit(at), F.lit(n)).cast("long")


def _padded(*parts: tuple[Column, int]) -> Column:
    return F.concat(*[F.lpad(p.cast("long").cast("string"), n, "0") for p, n in parts])


def social_place(number: Column) -> Column:
    """Place of a valid social security number (nine digits) among all: areas 001 to 899 but 666, groups and serials from 1."""
    area = _part(number, 1, 3) - F.when(_part(number, 1, 3) > 666, 2).otherwise(1)
    return (area * 99 + _part(number, 4, 2) - 1) * 9_999 + _part(number, 6, 4) - 1


def social_number(place: Column) -> Column:
    area = F.floor(place / (99 * 9_999))
    return _padded((area + F.when(area >= 665, 2).otherwise(1), 3), (F.floor(place / 9_999) % 99 + 1, 2), (place % 9_999 + 1, 4))


def _codes(number: Column) -> tuple[list[Column], list[Column]]:
    """First value and count of the area and exchange codes like those of a telephone number: 0 to 199, which aren't assigned, or 200 to 999."""
    low = [_part(number, at, 3) < 200 for at in (1, 4)]
    return [F.when(x, 0).otherwise(200) for x in low], [F.when(x, 200).otherwise(800) for x in low]


def national_place(number: Column) -> Column:
    """Place of a telephone number of ten digits among those with codes like its own."""
    first, many = _codes(number)
    return ((_part(number, 1, 3) - first[0]) * many[1] + _part(number, 4, 3) - first[1]) * 10_000 + _part(number, 7, 4)


def national_number(place: Column, like: Column) -> Column:
    first, many = _codes(like)
    rest = F.floor(place / 10_000)
    return _padded((F.floor(rest / many[1]) + first[0], 3), (rest % many[1] + first[1], 3), (place % 10_000, 4))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order."""
    seen = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.substr(form, i, F.lit(1)))
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(digit, 1).otherwise(0)).alias("at")
        )

    return F.aggregate(seen, zero, step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one being the check digit's place."""
    n = F.length(digits)
    ds = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(
            F.pmod(n - i, F.lit(2)) == 1, 2 * F.substr(digits, i, F.lit(1)).cast("int")
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int"))
    )
    return F.aggregate(ds, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, A being 10."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _day(text: Column) -> Column:
    """The date that text writes, year first, or day and month, with slashes month and day if that is a date; null if there is none from 1900 to 2099."""
    parsed = F.when(text.rlike("^[0-9]{4}-"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).when(
        F.contains(text, F.lit("/")), F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    ).otherwise(F.try_to_timestamp(text, F.lit("d.M.yyyy"))).cast("date")
    return F.when(F.year(parsed).between(1900, 2099), parsed)


def _mark_cards(run: Column) -> Column:
    """run with each card in it between MARKS: the whole run, or else parts of whole digit groups that pass Luhn's check.

    Dates and numbers that are tried before cards are no parts of a card. Of parts that overlap, those of 16 digits
    come first, then 15, then the longer, then the earlier.
    """
    groups = F.regexp_extract_all(run, F.lit(f"({EARLIER}[ -]*|[0-9]+[ -]*)"), F.lit(1))
    n = F.size(groups)

    def part(i: Column, k: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(groups, i, k), ""), "[ -]+$", "")
        size = F.length(_digits(text))
        rank = F.when(k == n, 0).when(size == 16, 1).when(size == 15, 2).otherwise(30 - size)
        return F.struct(rank.alias("rank"), i.alias("i"), k.alias("k"), text.alias("text"))

    plain = lambda i, k: F.forall(F.slice(groups, i, k), lambda g: g.rlike("^[0-9]+[ -]*$"))
    lengths = lambda i: F.filter(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(19))), lambda k: plain(i, k))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(lengths(i), lambda k: part(i, k))))
    valid = F.array_sort(F.filter(parts, lambda p: p["text"].rlike(f"^{CARD}$") & (luhn_sum(_digits(p["text"])) % 10 == 0)))
    none = F.filter(valid, lambda p: F.lit(False))
    free = lambda taken, p: F.forall(taken, lambda t: (t["i"] + t["k"] <= p["i"]) | (p["i"] + p["k"] <= t["i"]))
    taken = F.aggregate(valid, none, lambda s, p: F.when(free(s, p), F.array_append(s, p)).otherwise(s))

    def written(cards: Column) -> Column:
        starts = lambda i: F.exists(cards, lambda t: t["i"] == i)
        ends = lambda i: F.exists(cards, lambda t: t["i"] + t["k"] - 1 == i)
        digits = lambda g: F.regexp_extract(g, "^[0-9]+", 0)
        one = lambda g, at: F.concat(
            F.when(starts(at + 1), F.lit(MARKS[0])).otherwise(F.lit("")),
            F.when(ends(at + 1), F.concat(digits(g), F.lit(MARKS[1]), F.regexp_replace(g, "^[0-9]+", ""))).otherwise(g)
        )
        return F.array_join(F.transform(groups, one), "")

    return F.element_at(F.transform(F.array(taken), written), 1)


def _woven(text: Column, pattern: str, found: Column) -> Column:
    """text with its matches of pattern replaced by found, in order."""
    return _once(
        F.split(text, pattern, -1),
        lambda between: F.concat(
            F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1)
        )
    )


def pseudonym(key: Column, value: Column) -> Column:
    """The pseudonym of one candidate, or the candidate itself where it isn't valid.

    Cards of 13 to 19 digits must pass Luhn's check (digit groups beside a card are not its own) and IBANs the remainder
    by 97, and so do their pseudonyms; spaces and dashes stay where they are and do not matter for the value, so that one
    number is linked in all its spellings. Social security numbers are permuted among the valid ones, telephone numbers
    without a country code or with +1 among those whose codes are as valid, others within their country. Dates from 1900
    to 2099 are permuted among the days and written in the form they had, with leading zeros or without; IPv4 addresses
    with parts up to 255 among all addresses, other values among those with the same classes of characters.
    """
    form = F.lit(None).cast("string")
    for name, pattern in reversed(FORMS):
        form = F.when(value.rlike(f"^(?:{PHONE_SHAPE if name == 'phone' else pattern})$"), name).otherwise(form)
    return _once(form, lambda f: _pseudonym(key, value, f))


def _pseudonym(key: Column, value: Column, form: Column) -> Column:
    """pseudonym of a value of a known form: what is permuted is brought into one of two shapes, a text or a number, so that either network is written once."""
    number, flat = _digits(value), F.regexp_replace(value, " ", "")
    label = F.regexp_extract(value, r"^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?\x22?|AKIA)", 0)
    bare = F.substr(value, F.length(label) + 1, F.length(value))
    last = F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0)
    # A country code of its own, +1 before ten digits, or the first digit of a number without blanks stays.
    country = F.when(form == "phone", F.regexp_extract(value, r"^\+(?:[0-9]{1,3}(?=[ .(-])|1(?=[0-9]{10}$)|[0-9])", 0)).otherwise("")
    rest = F.substr(value, F.length(country) + 1, F.length(value))
    national = (form == "phone") & country.isin("", "+1") & (F.length(_digits(rest)) == 10)
    parts = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
    day = _day(value)
    valid = (
        F.when(form == "card", luhn_sum(number) % 10 == 0)
        .when(form == "iban", _mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1)
        .when(form == "ssn", value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"))
        .when(form == "ip", F.forall(parts, lambda x: x <= 255)).when(form == "date", day.isNotNull()).otherwise(form.isNotNull())
    )

    text = (
        F.when(form == "secret", bare).when(form == "email", F.substr(value, F.lit(1), F.length(value) - F.length(last)))
        .when(
            form == "card", F.substr(number, F.lit(1), F.length(number) - 1)
        ).when(form == "iban", F.substr(flat, F.lit(5), F.length(flat))).otherwise(_digits(rest))
    )
    kind = F.when((form == "secret") & bare.rlike("^[0-9a-f]+$"), "hex").otherwise(F.concat(form, country))

    def of_text(t: Column) -> Column:
        check = F.pmod(10 - luhn_sum(F.concat(t, F.lit("0"))) % 10, F.lit(10)).cast("string")
        state = F.substr(flat, F.lit(1), F.lit(2))
        account = F.concat(state, F.lpad((98 - _mod97(F.concat(t, state, F.lit("00")))).cast("string"), 2, "0"), t)
        spaced = F.when(F.contains(value, F.lit(" ")), F.trim(F.regexp_replace(account, "(.{4})", "$1 "))).otherwise(account)
        return F.when(form == "secret", F.concat(label, t)).when(form == "email", F.concat(t, last)).when(form == "card", F.concat(t, check)).when(form == "iban", spaced).otherwise(t)

    first_day = F.lit(FIRST_DAY).cast("date")
    place = (
        F.when(form == "ssn", social_place(number)).when(national, national_place(_digits(rest)))
        .when(form == "ip", F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)).otherwise(F.datediff(day, first_day).cast("long"))
    )
    many = _codes(_digits(rest))[1]
    a = F.when(form == "ssn", 898 * 99).when(national, many[0]).when(form == "ip", 65_536).otherwise(PARTS[0])
    b = F.when(form == "ssn", 9_999).when(national, many[1] * 10_000).when(form == "ip", 65_536).otherwise(PARTS[1])

    def of_number(m: Column) -> Column:
        quad = F.array_join(
            F.transform(
                F.array(*map(F.lit, (24, 16, 8, 0))),
                lambda k: F.pmod(F.floor(m / F.pow(F.lit(2), k)).cast("long"), F.lit(256)).cast("string")
            ),
            "."
        )
        short = value.rlike(r"^[0-9][./]|[./][0-9][./]")  # a day or month without a leading zero
        month_first = F.contains(value, F.lit("/")) & F.try_to_timestamp(value, F.lit("M/d/yyyy")).isNotNull()
        order = F.when(value.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(month_first, F.when(short, "M/d/yyyy").otherwise("MM/dd/yyyy")).when(
            F.contains(value, F.lit("/")), F.when(short, "d/M/yyyy").otherwise("dd/MM/yyyy")
        )
        date = F.call_function(
            "date_format", F.date_add(first_day, m.cast("int")), F.coalesce(order, F.when(short, "d.M.yyyy").otherwise("dd.MM.yyyy"))
        )
        return F.when(form == "ssn", social_number(m)).when(national, national_number(m, _digits(rest))).when(form == "ip", quad).otherwise(date)

    numeric = form.isin("ssn", "ip", "date") | national
    new = F.when(numeric, _once(feistel_number(key, place, a, b, form), of_number)).otherwise(_once(feistel_text(key, text, kind), of_text))
    written = _once(new, lambda n: F.when(form.isin("card", "phone", "ssn"), F.concat(country, _refill(rest, n))).otherwise(n))
    return F.when(valid, written).otherwise(value)


def session_key(spark: SparkSession) -> str:
    """The key that the session states under KEY_SETTING; where it states none, one is drawn and kept for the session.

    Pseudonyms are linked where the key is the same. Who knows the key can invert them, so it is no part of this library.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with every valid e-mail address, card, IBAN, phone, social security and IPv4 number, date and stated secret in text replaced by its pseudonym.

    One row per input row, in the input's columns; n_chars, where there is one, follows the text. Equal values have
    equal pseudonyms in all documents, by the key alone: nothing is shuffled, collected or looked up, and a text without
    a candidate is returned as it is. A null text stays null, an empty one empty, an empty table empty; texts of any
    length are searched whole, once; repeated rows have equal results; of forms that begin at one place the first in
    FORMS wins, and of cards that overlap those of 16 digits; columns of any name are kept.
    """
    text, secret = F.col("text"), F.lit(key)
    # A run of digits may hold cards beside other numbers: they are marked first, and the run is searched once more.
    run = lambda v: v.rlike(f"^(?:{RUN})$") & ~v.rlike(f"^(?:{EARLIER})$")

    def searched(m: Column) -> Column:
        """The candidates of a match and what is between them: those of a run with its cards marked, or the match itself."""
        marked = F.contains(m, F.lit(IN_RUN))
        parts = F.when(marked, F.regexp_extract_all(m, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array(m))
        between = F.when(marked, F.split(m, CANDIDATE, -1)).otherwise(F.array(F.lit(""), F.lit("")))
        plain = lambda v: pseudonym(secret, F.translate(v, MARKS, ""))
        return F.translate(
            F.concat(F.array_join(F.zip_with(between, F.transform(parts, plain), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")),
            IN_RUN, ""
        )

    new = lambda v: _once(F.when(run(v), F.concat(F.lit(IN_RUN), _mark_cards(v))).otherwise(v), searched)
    found = free_name(docs, "found")
    out = docs.withColumn(found, F.regexp_extract_all(text, F.lit(EARLIER_OR_RUN), F.lit(0)))
    out = out.withColumn("text", F.when(F.size(found) > 0, _woven(text, EARLIER_OR_RUN, F.transform(found, new))).otherwise(text)).drop(found)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read(spark, sf_dir, "documents"), session_key(spark))
