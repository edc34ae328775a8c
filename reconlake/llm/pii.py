"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

Found and validated: e-mail addresses, payment card numbers (Luhn), IBANs
(mod 97), US social security numbers, North American and other international
telephone numbers, IPv4 addresses and dates from 1900 to 2099 in figures, with
one or two digits for day and month. Not looked for: IPv6 addresses, telephone
numbers without a country's code but for North American ones, dates whose month
is a word. Each valid
value is replaced by a value of the same format that is itself valid, through
a keyed Feistel network over the value's own domain. A network is a bijection,
so equal values become equal pseudonyms in every document, different values
stay different, and whoever holds the key can invert it (`undo=True`).

Two networks: one adds round values modulo the sizes of two integer halves
(dates, addresses, telephone and security numbers, whose domains are products
of two ranges); the other shifts each character of half a string within its own
class of digits or letters (cards, IBANs, mail names; these also within Latin-1
and Cyrillic letters, while letters of other scripts stay). Check digits are
computed anew. Invalid look-alikes stay as they are.

A date is one value in all its notations. It moves among the dates of all years
whose day is, like its own, one of 1 to 9, 10 to 12 or over, and whose month is
one of one digit or two (29 February: among leap years), so that figures are as
many as before, a slashed date is read in the same order again, and all
notations of a date get one pseudonym. Slashed dates are read month first, or
day first where that is the only way.

The text is cut at the matches of one pattern, the matches are replaced in
place and the pieces joined again: no shuffle, no join, no Python, and every
text is read whole.

Nulls and odd rows: a null text stays null with counts of zero, an empty text
stays empty. Rows are judged one by one, so repeated rows and equal ids are no
special case. Other columns pass through; columns named like the outputs are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even: after it both halves of a string are in their places again

#: Fixed patterns, in order of preference where several could start at one place.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{M}\p{N}-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9.,/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[.,/-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE_US = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
PHONE_INT = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])"
CARD = r"(?<![0-9.+-])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?:[ -]?[0-9]{1,3})?(?![0-9]|[.-][0-9])"
PATTERNS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "ipv4": IPV4, "card": CARD, "phone_us": PHONE_US, "phone": PHONE_INT}
KINDS = tuple(PATTERNS)
FIRST_YEAR, N_YEARS, N_LEAP = 1900, 200, 49
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

#: Runs of code points whose characters are moved among themselves.
DIGITS, LOWER, UPPER = ("0", "9"), ("a", "z"), ("A", "Z")
ASCII = (DIGITS, LOWER, UPPER)
LETTERS = (*ASCII, ("ß", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("а", "я"), ("А", "Я"))


def _text(*parts) -> Column:
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _lit(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _rounds(undo: bool) -> Column:
    order = range(ROUNDS)
    return F.array(*[F.lit(r) for r in (reversed(order) if undo else order)])


def feistel_pair(a: Column, b: Column, size_a: int | Column, size_b: int | Column, key: str, tag: str | Column, undo: bool = False) -> Column:
    """struct(a, b) permuted over range(size_a) x range(size_b)."""

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        f = _int(F.conv(F.substring(F.sha2(_text(key, tag, r.cast("string"), F.when(even, acc["b"]).otherwise(acc["a"]).cast("string")), 256), 1, 12), 16, 10))
        f = -f if undo else f
        return F.struct(
            F.when(even, F.pmod(acc["a"] + f, _lit(size_a))).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + f, _lit(size_b))).alias("b"),
        )

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(_rounds(undo), start, step)


def feistel_chars(s: Column, key: str, tag: str, undo: bool = False, classes: tuple[tuple[str, str], ...] = ASCII) -> Column:
    """The string permuted over all strings with the same class of character (one of `classes`, or itself) at each place; up to 64 characters."""

    def shifted(c: Column, by: Column) -> Column:
        by = -by if undo else by
        out = c
        for first, last in classes:
            letters = "".join(map(chr, range(ord(first), ord(last) + 1)))
            moved = F.substr(F.lit(letters), (F.pmod(F.ascii(c) - ord(first) + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            out = F.when(c.between(first, last), moved).otherwise(out)
        return out

    def mixed(half: Column, other: Column, r: Column) -> Column:
        stream = F.sha2(_text(key, tag, r.cast("string"), other), 512)
        return F.array_join(
            F.transform(F.split(half, ""), lambda c, i: shifted(c, F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))), ""
        )

    def step(acc: Column, r: Column) -> Column:
        if undo:
            return F.struct(mixed(acc["r"], acc["l"], r).alias("l"), acc["l"].alias("r"))
        return F.struct(acc["r"].alias("l"), mixed(acc["l"], acc["r"], r).alias("r"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(_rounds(undo), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, with those at places of the parity `doubled` (0: the last) doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == doubled, F.when(_int(c) > 4, _int(c) * 2 - 9).otherwise(_int(c) * 2)).otherwise(_int(c)),
    )
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _mod97(s: Column) -> Column:
    """Remainder of the number that results when letters become 10 to 35."""
    return F.aggregate(
        F.split(s, ""),
        F.lit(0).cast("bigint"),
        lambda rest, c: (
            F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
        ).cast("bigint"),
    )


def _refill(shape: Column, chars: Column, keep: str) -> Column:
    """`shape` with its characters of the class `keep` replaced, in order, by `chars`."""
    return F.array_join(
        F.transform(
            F.split(shape, ""),
            lambda c, i: F.when(
                c.rlike(keep), F.substr(chars, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^" + keep[1:], "")), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _card(m: Column, key: str, undo: bool) -> Column:
    d = _digits(m)
    valid = F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0)
    body = F.substr(d, F.lit(2), F.length(d) - 2)  # the first digit names the network and stays
    new = F.concat(F.substr(d, F.lit(1), F.lit(1)), feistel_chars(body, key, "card", undo))
    # One wrap in an array keeps the permuted body from being computed for each use.
    full = F.transform(F.array(new), lambda x: F.concat(x, ((10 - _luhn_sum(x, 0) % 10) % 10).cast("string")))[0]
    return F.when(valid, F.transform(F.array(full), lambda x: _refill(m, x, "[0-9]"))[0])


def _iban(m: Column, key: str, undo: bool) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5), F.length(s))
    valid = F.length(s).between(15, 34) & (_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1)
    full = F.transform(
        F.array(feistel_chars(body, key, "iban", undo)),
        lambda x: F.concat(country, _pad(98 - _mod97(F.concat(x, country, F.lit("00"))), 2), x),
    )[0]
    return F.when(valid, F.transform(F.array(full), lambda x: _refill(m, x, "[A-Z0-9]"))[0])


def _email(m: Column, key: str, undo: bool) -> Column:
    # The domain stays, so that mail of one provider is still seen as such.
    return F.concat(feistel_chars(F.substring_index(m, "@", 1), key, "email", undo, LETTERS), F.lit("@"), F.substring_index(m, "@", -1))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (_int(F.split_part(m, F.lit("-"), F.lit(i))) for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    at = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas
    pair = F.array(feistel_pair(at * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", undo))

    def shown(p: Column) -> Column:
        new = F.floor(p["a"] / 99) + 1
        new = new + F.when(new >= 666, 1).otherwise(0)
        return F.concat_ws("-", _pad(new, 3), _pad(p["a"] % 99 + 1, 2), _pad(p["b"] + 1, 4))

    return F.when(valid, F.transform(pair, shown)[0])


def _ipv4(m: Column, key: str, undo: bool) -> Column:
    o = F.transform(F.split(m, "[.]"), _int)
    valid = F.forall(o, lambda x: x < 256)
    pair = F.array(feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4", undo))
    shown = F.transform(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(p[h] / 256), p[h] % 256)]))
    return F.when(valid, shown[0])


def _phone_us(m: Column, key: str, undo: bool) -> Column:
    d = _digits(m)
    ten = F.right(d, F.lit(10))
    lead = F.substr(d, F.lit(1), F.length(d) - 10)
    area, office, line = (_int(F.substr(ten, F.lit(i), F.lit(n))) for i, n in ((1, 3), (4, 3), (7, 4)))
    pair = F.array(
        feistel_pair((area - 200) * 100 + F.floor(line / 100), (office - 200) * 100 + line % 100, 80000, 80000, key, "phone_us", undo)
    )

    def shown(p: Column) -> Column:
        new = F.concat(lead, _pad(F.floor(p["a"] / 100) + 200, 3), _pad(F.floor(p["b"] / 100) + 200, 3), _pad(p["a"] % 100, 2), _pad(p["b"] % 100, 2))
        return F.transform(F.array(new), lambda x: _refill(m, x, "[0-9]"))[0]

    return F.transform(pair, shown)[0]


def _phone(m: Column, key: str, undo: bool) -> Column:
    d = _digits(m)
    lead = F.substr(d, F.lit(1), F.length(d) - 7)  # the country and the largest areas stay
    new = F.concat(lead, feistel_chars(F.right(d, F.lit(7)), key, "phone", undo))
    return F.when(F.length(d).between(9, 15), F.transform(F.array(new), lambda x: _refill(m, x, "[0-9]"))[0])


def _date(m: Column, key: str, undo: bool) -> Column:
    iso, dotted = m.rlike("^[0-9]{4}-"), F.contains(m, F.lit("."))

    def read(f: Column) -> Column:
        """struct<y,m,d,m_width,d_width,day_first>: the date's numbers, and how it is written."""
        one, two, three = f[0], f[1], f[2]
        day_first = dotted | (~iso & (_int(one) > 12))
        month, day = F.when(iso | day_first, two).otherwise(one), F.when(iso, three).when(day_first, one).otherwise(two)
        return F.struct(
            F.when(iso, _int(one)).otherwise(_int(three)).alias("y"), _int(month).alias("m"), _int(day).alias("d"), F.length(month).alias("m_width"), F.length(day).alias("d_width"), day_first.alias("day_first"),
        )

    # Days over 12 before each month, among those of one digit and those of two; the leap day is apart.
    before = [sum(n - 12 for n in MONTH_DAYS[start:i]) for start, end in ((0, 9), (9, 12)) for i in range(start, end)]
    offset = F.array(*map(F.lit, before))

    def place(x: Column) -> Column:
        """Where in which domain the date lies: struct<a,b,size_a,size_b,tag>, null if it is none."""
        leap = (x["y"] % 4 == 0) & ((x["y"] % 100 != 0) | (x["y"] % 400 == 0))
        days = F.get(F.array(*map(F.lit, MONTH_DAYS)), (x["m"] - 1).cast("int")) + F.when((x["m"] == 2) & leap, 1).otherwise(0)
        valid = x["y"].between(FIRST_YEAR, FIRST_YEAR + N_YEARS - 1) & x["m"].between(1, 12) & x["d"].between(1, days)
        leap_day, short, low, middle = (x["m"] == 2) & (x["d"] == 29), x["m"] < 10, x["d"] < 10, x["d"].between(10, 12)
        month, n_months = x["m"] - F.when(short, 1).otherwise(10), F.when(short, 9).otherwise(3)
        b = F.when(leap_day, 0).when(low, month * 9 + x["d"] - 1).when(middle, month * 3 + x["d"] - 10).otherwise(F.get(offset, (x["m"] - 1).cast("int")) + x["d"] - 13)
        size_b = F.when(leap_day, 1).when(low, n_months * 9).when(middle, n_months * 3).when(short, sum(MONTH_DAYS[:9]) - 9 * 12).otherwise(sum(MONTH_DAYS[9:]) - 3 * 12)
        kind = F.when(leap_day, "leap").when(low, "low").when(middle, "middle").otherwise("high")
        a = F.when(leap_day, F.floor((x["y"] - FIRST_YEAR - 4) / 4)).otherwise(x["y"] - FIRST_YEAR)
        tag = F.concat(F.lit("date "), kind, F.when(short, " short").otherwise(" long"))
        found = F.struct(a.alias("a"), b.cast("bigint").alias("b"), F.when(leap_day, N_LEAP).otherwise(N_YEARS).alias("size_a"), size_b.alias("size_b"), tag.alias("tag"), kind.alias("kind"), short.alias("short"), x.alias("x"))
        return F.when(valid, found)

    def moved(x: Column) -> Column:
        return F.struct(feistel_pair(x["a"], x["b"], x["size_a"], x["size_b"], key, x["tag"], undo).alias("p"), x["kind"].alias("kind"), x["short"].alias("short"), x["x"].alias("x"))

    def numbers(x: Column) -> Column:
        a, b, kind = x["p"]["a"], x["p"]["b"], x["kind"]
        first = F.when(x["short"], 0).otherwise(9)  # of the months, from 0
        within = F.slice(offset, first + 1, F.when(x["short"], 9).otherwise(3))
        high = first + F.size(F.filter(within, lambda o: o <= b)) - 1
        month = F.when(kind == "leap", 1).when(kind == "low", first + F.floor(b / 9)).when(kind == "middle", first + F.floor(b / 3)).otherwise(high)
        day = F.when(kind == "leap", 29).when(kind == "low", b % 9 + 1).when(kind == "middle", b % 3 + 10).otherwise(b - F.get(offset, month.cast("int")) + 13)
        year = F.when(kind == "leap", a * 4 + 4).otherwise(a) + FIRST_YEAR
        return F.struct(year.alias("y"), (month + 1).alias("m"), day.alias("d"), x["x"].alias("x"))

    def shown(n: Column) -> Column:
        year, month, day = _pad(n["y"], 4), F.lpad(n["m"].cast("string"), n["x"]["m_width"], F.lit("0")), F.lpad(n["d"].cast("string"), n["x"]["d_width"], F.lit("0"))
        slashed = F.when(n["x"]["day_first"], F.concat_ws("/", day, month, year)).otherwise(F.concat_ws("/", month, day, year))
        return F.when(iso, F.concat_ws("-", year, month, day)).when(dotted, F.concat_ws(".", day, month, year)).otherwise(slashed)

    # Each step is bound once, so that one network serves all notations.
    placed = F.filter(F.transform(F.transform(F.array(F.split(m, "[-./]")), read), place), lambda x: x.isNotNull())
    return F.get(F.transform(F.transform(F.transform(placed, moved), numbers), shown), F.lit(0))


MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "card": _card, "phone_us": _phone_us, "phone": _phone}


def _kind(m: Column) -> Column:
    """Name of the pattern that the whole match fits, first in the order of PATTERNS."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """`docs` with `text` replaced, and n_<kind> (long), the number of values replaced of each kind."""
    any_of = "|".join(f"(?:{p})" for p in PATTERNS.values())
    t = F.col(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(any_of), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))

    def replaced(x: Column) -> Column:
        new = F.lit(None).cast("string")
        for kind in reversed(KINDS):
            new = F.when(x["kind"] == kind, MAKERS[kind](x["m"], key, undo)).otherwise(new)
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), new.alias("new"))

    held = "__found"
    while held.lower() in {c.lower() for c in docs.columns}:  # a column of that name is someone else's
        held += "_"
    with_new = docs.withColumn(held, F.when(F.regexp_like(t, F.lit("[0-9@]")), F.transform(found, replaced)))
    pieces = F.zip_with(F.split(t, any_of, -1), F.col(held), lambda gap, x: F.concat(gap, F.coalesce(x["new"], x["m"], F.lit(""))))

    def count(kind: str) -> Column:
        hits = F.filter(held, lambda x: (x["kind"] == kind) & x["new"].isNotNull())
        return F.greatest(F.coalesce(F.size(hits), F.lit(0)), F.lit(0)).cast("bigint")  # a null array's size may be -1

    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    return with_new.withColumns(counts | {text: F.when(F.size(held) > 0, F.array_join(pieces, "")).otherwise(t)}).drop(held)
