"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Every value that passes its kind's validation is replaced by another value of the same kind and layout: a keyed
Feistel network permutes the kind's whole domain, so equal values get equal pseudonyms in all documents, different
values different ones, and whoever has the key can undo it.

| kind | validation | permuted | kept |
|---|---|---|---|
| email | form | letters and digits of the local part, each within its class | domain, punctuation |
| card | Luhn, 13 to 19 digits | all digits but the first | first digit, spacing; the check digit is computed anew |
| phone, North America | area and exchange codes | area, exchange and line number | country code, spacing |
| phone, other with + | 9 to 15 digits | digits after the first two | first two digits, spacing |
| ssn | area, group and serial ranges, with dashes or blanks | whole number | separators |
| ip | four octets | whole address | |
| ip, version 6 | eight groups, or fewer around a double colon | all digits, decimal ones and letters apart | colons, lengths of groups |
| iban | mod 97 | account part, each character within its class | country, spacing, case; check digits are computed anew |
| date | calendar | the day within its 400 years (1800 to 2199, ...) | order of the parts, separators |
| date with the month's English name | calendar | the same day as in digits | order, separators, case and short form of the name |

Dates with slashes are read month first, and day first where that is no date. A date with a one-digit day or month gets
one without leading zeros; however it is written, a day becomes the same day. North American numbers may be written with
any or no gaps after a +1 or around an area code in parentheses or after a word such as tel or phone, otherwise with gaps.
Accounts in lower case are read where they are written without blanks. An address of version 6 that is written in two ways
gets two pseudonyms. What follows a card or an account as
if it were a further group (an expiry, a check number, a word in capitals) stays, and the longest valid number before it
is replaced. A number that fails its validation is not personal data of that kind and stays. The days of the years 1 to 199
and 9800 to 9999 are permuted among themselves, so that a year keeps its four digits.

Defined results: a null text stays null, an empty one empty; other columns and rows, repeated ones and null ids
included, stay as they are. Each text is rewritten on its own, whole, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_MONTH = (r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
          r"|nov(?:ember)?|dec(?:ember)?)")
_ORDINAL = r"[0-9]{1,2}(?:st|nd|rd|th)?"
_HEX = r"[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
            r"|(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}[a-z0-9]{11,30}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})|(?:1[ .-]?)?\([2-9][0-9]{2}\))[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}"
             r"|(?:1[ .-]?)?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
             r"|(?i:tel|telephone|phone|mobile|cell|fax|call)(?i: no| number| at| is)?[.:]{0,2} ?[2-9][0-9]{2}[2-9][0-9]{6})(?![0-9])",
    "world": r"(?<![A-Za-z0-9+])\+[2-9](?:[ .()-]{0,2}[0-9]){8,14}(?![0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}"
            r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[/-][0-9]|[.][0-9])",
    "named": rf"(?<![A-Za-z0-9])(?:{_ORDINAL}(?: of)?[ -]{_MONTH}[.]?,?[ -][0-9]{{4}}|{_MONTH}[.]? {_ORDINAL},? [0-9]{{4}})(?![A-Za-z0-9])",
    "ip6": rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![A-Za-z0-9:])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}(?<dash>[ -])(?!00)[0-9]{2}\k<dash>(?!0000)[0-9]{4}(?![0-9]|[ -][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<gap>[ -])[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,4}(?:\k<gap>[0-9]{1,3})?"
            r"|[0-9]{4}(?<slot>[ -])[0-9]{6}\k<slot>[0-9]{5})(?![0-9])",
}
_ANY = "|".join(PATTERNS.values())
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(value: Column | int | str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("long")


def _keyed(key: str, kind: str, turn: Column, value: Column) -> Column:
    """A keyed hash of the value as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)


def _permuted(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column,
              use: Callable[[Column, Column], Column]) -> Column:
    """use(a, b) of a permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b."""
    def turn(pair: Column, i: Column) -> Column:
        seen = F.when(i % 2 == 0, pair["b"]).otherwise(pair["a"])
        moved = F.conv(F.substring(_keyed(key, kind, i, seen), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, F.pmod(pair["a"] + moved, size_a)).otherwise(pair["a"]).alias("a"),
            F.when(i % 2 == 0, pair["b"]).otherwise(F.pmod(pair["b"] + moved, size_b)).alias("b"))

    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), turn)
    return _let(pair, lambda p: use(p["a"], p["b"]))


def _power(digits: Column) -> Column:
    return F.rpad(F.lit("1"), digits + 1, "0").cast("long")


def _digits_permuted(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the strings of as many digits (2 to 30)."""
    left = F.floor(F.length(digits) / 2).cast("int")
    right = F.length(digits) - left
    halves = F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, right)
    return _permuted(key, kind, halves[0].cast("long"), halves[1].cast("long"), _power(left), _power(right),
                     lambda a, b: F.concat(F.lpad(a.cast("string"), left, "0"), F.lpad(b.cast("string"), right, "0")))


def _characters_permuted(key: str, kind: str, text: Column, classes: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> Column:
    """A permutation of the strings whose characters are of the same classes at the same places: two halves in turn
    shift each other's letters and digits within their classes."""
    left = F.ceil(F.length(text) / 2).cast("int")

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(stream: Column, c: Column, at: Column) -> Column:
            by = F.conv(F.substring(stream, (F.pmod(at * 4, F.lit(60)) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")

            def within(letters: str) -> Column:
                place = F.pmod(F.instr(F.lit(letters), c) - 1 + by, F.lit(len(letters)))
                return F.substring(F.lit(letters), (place + 1).cast("int"), F.lit(1))

            return reduce(lambda rest, x: F.when(c.between(x[0], x[-1]), within(x)).otherwise(rest), reversed(classes), c)

        characters = F.filter(F.split(half, ""), lambda c: c != "")
        return _let(_keyed(key, kind, i, other),
                    lambda stream: F.array_join(F.transform(characters, lambda c, at: one(stream, c, at)), ""))

    pair = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(F.substring(text, F.lit(1), left).alias("a"), F.substring(text, left + 1, F.length(text)).alias("b")),
        lambda s, i: F.struct(F.when(i % 2 == 0, shifted(s["a"], s["b"], i)).otherwise(s["a"]).alias("a"),
                              F.when(i % 2 == 0, s["b"]).otherwise(shifted(s["b"], s["a"], i)).alias("b")))
    return _let(pair, lambda p: F.concat(p["a"], p["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(template: Column, characters: Column, place: str = "[0-9]") -> Column:
    """The template with its digits (or other places) replaced in order by the characters."""
    state = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    return _let(characters, lambda new: F.aggregate(F.split(template, ""), state, lambda s, c: F.struct(
        (s["i"] + F.when(c.rlike(f"^{place}$"), 1).otherwise(0)).alias("i"),
        F.concat(s["out"], F.when(c.rlike(f"^{place}$"), F.substring(new, s["i"], F.lit(1))).otherwise(c)).alias("out")),
        lambda s: s["out"]))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _head(value: Column, gap: str, valid: Callable[[Column], Column]) -> Column:
    """The longest valid run of groups from the start of the value; null if there is none."""
    def runs(groups: Column) -> Column:
        lengths = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)),
                              lambda n: F.length(F.array_join(F.slice(groups, F.lit(1), n), " ")))
        return F.get(F.filter(F.transform(lengths, lambda n: F.substring(value, F.lit(1), n)), valid), F.lit(0))

    return _let(F.split(value, gap), runs)


def _card(key: str, value: Column) -> Column:
    def new(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1), _digits_permuted(key, "card", F.substring(digits, F.lit(2), n - 2)))
        return _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    def replaced(head: Column) -> Column:
        return F.concat(_laid_out(head, new(_digits(head))), F.substring(value, F.length(head) + 1, F.length(value)))

    return _let(_head(value, "[ -]", lambda head: (_luhn_sum(_digits(head)) % 10 == 0) & F.length(_digits(head)).between(13, 19)),
                lambda head: F.when(head.isNotNull(), replaced(head)).otherwise(value))


def _phone(key: str, value: Column) -> Column:
    def new(digits: Column) -> Column:
        last = F.substring(digits, -10, 10)

        def part(at: int, n: int) -> Column:
            return F.substring(last, at, n).cast("long")

        number = _permuted(
            key, "phone", (part(1, 3) - 200) * 100 + part(7, 2), (part(4, 3) - 200) * 100 + part(9, 2), _long(80000), _long(80000),
            lambda a, b: F.concat(*(F.lpad(x.cast("string"), n, "0") for x, n in (
                (F.floor(a / 100) + 200, 3), (F.floor(b / 100) + 200, 3), (a % 100, 2), (b % 100, 2)))))
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), number)

    return _let(_digits(value), lambda digits: _laid_out(value, new(digits)))


def _world(key: str, value: Column) -> Column:
    def replaced(digits: Column) -> Column:
        n = F.length(digits)
        new = F.concat(F.substring(digits, 1, 2), _digits_permuted(key, "world", F.substring(digits, F.lit(3), n)))
        return F.when(n.between(9, 15), _laid_out(value, new)).otherwise(value)

    return _let(_digits(value), replaced)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def written(a: Column, b: Column) -> Column:
        new = F.floor(a / 99) + 1
        new = new + F.when(new >= 666, 1).otherwise(0)
        area, group, serial = (F.lpad(x.cast("string"), n, "0") for x, n in ((new, 3), (a % 99 + 1, 2), (b + 1, 4)))
        return F.concat(area, F.substring(value, 4, 1), group, F.substring(value, 4, 1), serial)

    return _permuted(key, "ssn", place * 99 + group - 1, serial - 1, _long(898 * 99), _long(9999), written)


def _ip(key: str, value: Column) -> Column:
    octet = [F.split_part(value, F.lit("."), F.lit(i)).cast("long") for i in range(1, 5)]
    return _permuted(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], _long(65536), _long(65536), lambda a, b: F.concat_ws(
        ".", *(x.cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256))))


def _ip6(key: str, value: Column) -> Column:
    new = _characters_permuted(key, "ip6", value, (_DIGITS, _LOWER[:6], _UPPER[:6]))
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    return F.when(value.rlike("[0-9]") & ((groups < 8) | ~value.contains("::")), new).otherwise(value)


def _mod97(text: Column) -> Column:
    """The remainder of a text of digits and capitals (A = 10, ...) read as a number."""
    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.instr(F.lit("0123456789"), c) - 1) % 97).otherwise(
            (rest * 100 + F.instr(F.lit(_UPPER), c) + 9) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(key: str, value: Column) -> Column:
    def plain_of(text: Column) -> Column:
        return F.upper(F.replace(text, F.lit(" "), F.lit("")))

    def valid(head: Column) -> Column:
        return _let(plain_of(head), lambda plain: F.length(plain).between(15, 34) & (
            _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1))

    def replaced(head: Column, plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        new = _let(_characters_permuted(key, "iban", account), lambda n: F.concat(
            country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        written = _laid_out(head, F.when(head == F.upper(head), new).otherwise(F.lower(new)), "[A-Za-z0-9]")
        return F.concat(written, F.substring(value, F.length(head) + 1, F.length(value)))

    return _let(_head(value, " ", valid), lambda head: F.when(
        head.isNotNull(), _let(plain_of(head), lambda plain: replaced(head, plain))).otherwise(value))


_CYCLE = 27 * 5411  # days of 400 years
_EARLY, _LATE = (13, 5591), (184, 397)  # whose products are the days of the years 1 to 199 and 9800 to 9999


def _day(key: str, year: Column, month: Column, day: Column) -> Column:
    """The permuted day, or null where there is no such day."""
    real = (month.between(1, 12) & (year >= 1) & (day >= 1)
            & (day <= F.dayofmonth(F.last_day(F.make_date(F.greatest(year, F.lit(1)), F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))))))
    start = F.lit("1800-01-01").cast("date")

    def chosen(early: Column | int, late: Column | int, other: Column | int) -> Column:
        return F.when(year < 200, _long(early)).when(year >= 9800, _long(late)).otherwise(_long(other))

    def moved(at: Column) -> Column:
        first = chosen(*((date(y, 1, 1) - date(1800, 1, 1)).days for y in (1, 9800)), F.floor(at / _CYCLE) * _CYCLE)
        many, size = chosen(_EARLY[0], _LATE[0], 27), chosen(_EARLY[1], _LATE[1], 5411)
        return _let(at - first, lambda within: _permuted(
            key, "date", F.floor(within / size), within % size, many, size,
            lambda a, b: F.date_add(start, (first + a * size + b).cast("int"))))

    return F.when(real, _let(_long(F.datediff(F.make_date(year, month, day), start)), moved))


def _date(key: str, value: Column) -> Column:
    def read(order: str, sign: str) -> Column:
        year, month, day = (F.get(F.split(value, "[./-]"), order.index(c)).cast("int") for c in "ymd")
        full, short = (sign.join(forms[c] for c in order) for forms in ({"y": "yyyy", "m": "MM", "d": "dd"}, {"y": "yyyy", "m": "M", "d": "d"}))
        return _let(_day(key, year, month, day), lambda new: F.when(
            value.rlike("(?<![0-9])[0-9](?![0-9])"), F.date_format(new, short)).otherwise(F.date_format(new, full)))

    month_first = F.coalesce(read("mdy", "/"), read("dmy", "/"))
    new = (F.when(value.rlike("^[0-9]{4}-"), read("ymd", "-")).when(value.rlike("^[0-9]{4}/"), read("ymd", "/"))
           .when(value.contains("."), read("dmy", ".")).otherwise(month_first))
    return F.coalesce(new, value)


def _named(key: str, value: Column) -> Column:
    """A date with the month's name: the parts that are written are replaced, each in its form."""
    of_day, of_name = r"(?<![0-9])[0-9]{1,2}(?![0-9])", "[A-Za-z]{3,}"
    day, name = F.regexp_extract(value, of_day, 0), F.regexp_extract(value, of_name, 0)
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(F.lower(name), 1, 3)) + 2) / 3

    def written(new: Column) -> Column:
        n = F.dayofmonth(new)
        ending = F.when(n.between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        number = F.concat(F.when(day.startswith("0"), F.date_format(new, "dd")).otherwise(n.cast("string")),
                          F.when(value.rlike("[0-9](?:st|nd|rd|th)"), ending).otherwise(""))
        short = F.lower(name).isin("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
        word = F.when(short, F.date_format(new, "MMM")).otherwise(F.date_format(new, "MMMM"))
        word = F.when(name == F.upper(name), F.upper(word)).when(name == F.lower(name), F.lower(word)).otherwise(word)
        text = F.regexp_replace(value, F.lit("[0-9]{4}"), F.date_format(new, "yyyy"))
        return F.regexp_replace(F.regexp_replace(text, F.lit(of_day + "(?:st|nd|rd|th)?"), number), F.lit(of_name), word)

    year = F.regexp_extract(value, "[0-9]{4}", 0).cast("int")
    return _let(_day(key, year, month.cast("int"), day.cast("int")), lambda new: F.coalesce(written(new), value))


def _email(key: str, value: Column) -> Column:
    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    return F.concat(_characters_permuted(key, "email", local), F.substring(value, at, F.length(value)))


_METHODS = {"email": _email, "iban": _iban, "phone": _phone, "world": _world, "date": _date, "named": _named, "ip6": _ip6, "ip": _ip, "ssn": _ssn, "card": _card}


def kind_of(value: Column) -> Column:
    """The first kind whose pattern the whole value meets."""
    return F.coalesce(*(F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()))


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym of one found value of a kind."""
    return reduce(lambda rest, k: F.when(kind == k, _METHODS[k](key, value)).otherwise(rest), reversed(_METHODS), value)


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The same rows with every personal value in the text replaced by its pseudonym."""
    text = F.col(column)
    # the pieces between the values, and the values, are found by one pattern and so alternate
    gaps = F.split(text, _ANY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    values = F.transform(found, lambda v: pseudonym(v["kind"], v["value"], key))
    woven = F.zip_with(gaps, values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    return docs.withColumn(column, F.when(text.rlike("[0-9@]"), F.array_join(woven, "")).otherwise(text))


def personal_values(docs: DataFrame) -> DataFrame:
    """One row per found value: doc_id, kind, value. Cards and accounts are listed by form, valid or not."""
    found = docs.where(F.col("text").rlike("[0-9@]")).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))).alias("value"))
    return found.select("doc_id", kind_of(F.col("value")).alias("kind"), "value")
