"""Personal data replaced by format-preserving pseudonyms, in DataFrame expressions only.

Card numbers, IBANs, social security numbers, telephone numbers, IPv4 addresses, dates and
e-mail addresses are found by pattern and checked (Luhn, mod 97, ranges, calendar). Each
valid value is permuted within its format by a keyed Feistel network whose round function
is SHA-256, so equal values get equal pseudonyms in all documents, different values get
different ones, and a pseudonym passes the same check as its original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network; even, so that both halves end in their own place.
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Fixed patterns by kind; the first that fits a match names it.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*(?<=\.\p{L}{2,24})",
    "ip": rf"(?<![\p{{L}}0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9]|\p{{L}})",
    "date": r"(?<![\p{L}0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}0-9]|[./-][0-9])",
    "ssn": r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}0-9]|-[0-9])",
    "phone": r"(?<![\p{L}0-9.+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\p{L}0-9]|-[0-9])",
    "card": r"(?<![\p{L}0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\p{L}0-9])",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _secret(key: str, tweak: str, *parts: Column) -> Column:
    """SHA-256 of the key, the kind of value and ``parts``, as hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256)


def permuted(low: Column, high: Column, n_low: Column, n_high: Column, key: str, tweak: str) -> Column:
    """struct(l, r): a keyed permutation of the pairs l in 0..n_low-1, r in 0..n_high-1."""

    def step(acc: Column, i: Column) -> Column:
        mask = F.conv(F.substring(_secret(key, tweak, i, acc["nl"], acc["nr"], acc["r"]), 1, 15), 16, 10)
        moved = F.pmod(acc["l"] + F.pmod(mask.cast("bigint"), acc["nl"]), acc["nl"])
        return F.struct(
            acc["r"].alias("l"), moved.alias("r"), acc["nr"].alias("nl"), acc["nl"].alias("nr")
        )

    big = [c.cast("bigint").alias(n) for c, n in ((low, "l"), (high, "r"), (n_low, "nl"), (n_high, "nr"))]
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(*big), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of the same length (2 to 36 digits)."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    found = permuted(
        F.left(digits, low).cast("bigint"), F.right(digits, n - low).cast("bigint"), _power(low), _power(n - low),
        key, tweak,
    )
    return F.concat(F.lpad(found["l"].cast("string"), low, "0"), F.lpad(found["r"].cast("string"), n - low, "0"))


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""

    def put(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.left(value, i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substring(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), put), "")


def _numbers(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("int"))


def luhn_digit(body: Column) -> Column:
    """The check digit that completes ``body``."""

    def weigh(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.reverse(_numbers(body)), weigh), F.lit(0), lambda a, d: a + d)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string in which a letter stands for two digits, A for 10."""

    def add(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(digit, 10).otherwise(100) + value, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(value: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(value)
    body = F.left(digits, F.length(digits) - 1)
    new = permuted_digits(body, key, "card")
    return F.right(digits, F.lit(1)) == luhn_digit(body), _refill(value, F.concat(new, luhn_digit(new)))


def _iban(value: Column, key: str) -> tuple[Column, Column]:
    country, account = F.left(value, F.lit(2)), F.substring(value, F.lit(5), F.length(value))
    digits = _digits(account)
    new = F.when(F.length(digits) > 1, _refill(account, permuted_digits(digits, key, "iban"))).otherwise(account)
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    moved = F.concat(account, F.left(value, F.lit(4)))
    return _mod97(moved) == 1, F.concat(country, check, new)


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = permuted(rank, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    back = new["l"] + 1 + F.when(new["l"] >= 665, 1).otherwise(0)
    parts = ((back, 3), (F.floor(new["r"] / 9999) + 1, 2), (F.pmod(new["r"], F.lit(9999)) + 1, 4))
    return valid, F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])|^", 0)
    rest = F.substring(value, F.length(country) + 1, F.length(value))
    digits = _digits(rest)
    return (
        F.length(_digits(value)).between(8, 15),
        F.concat(country, _refill(rest, permuted_digits(digits, key, "phone"))),
    )


def _ip(value: Column, key: str) -> tuple[Column, Column]:
    """Octets keep their number of digits: 10, 90 or 156 values each."""
    texts = F.split(value, r"\.")
    first = [F.when(F.length(texts[i]) == 1, 0).when(F.length(texts[i]) == 2, 10).otherwise(100) for i in range(4)]
    sizes = [F.when(F.length(texts[i]) == 1, 10).when(F.length(texts[i]) == 2, 90).otherwise(156) for i in range(4)]
    rank = [texts[i].cast("int") - first[i] for i in range(4)]
    new = permuted(
        rank[0] * sizes[1] + rank[1], rank[2] * sizes[3] + rank[3], sizes[0] * sizes[1], sizes[2] * sizes[3], key, "ip"
    )
    parts = []
    for half, i in (("l", 0), ("r", 2)):
        parts += [F.floor(new[half] / sizes[i + 1]) + first[i], F.pmod(new[half], sizes[i + 1]) + first[i + 1]]
    return F.lit(True), F.concat_ws(".", *[p.cast("string") for p in parts])


def _date(value: Column, key: str) -> tuple[Column, Column]:
    """Dates move within their century: 36,524 days are 92 * 397, 36,525 days 75 * 487."""
    iso, slash = value.contains("-"), value.contains("/")
    day_first = F.try_to_date(value, "dd/MM/yyyy")
    day = (
        F.when(iso, F.try_to_date(value, "yyyy-MM-dd"))
        .when(slash, F.coalesce(day_first, F.try_to_date(value, "MM/dd/yyyy")))
        .otherwise(F.try_to_date(value, "dd.MM.yyyy"))
    )
    century = F.floor(F.year(day) / 100) * 100
    begin = F.make_date(century, F.lit(1), F.lit(1))
    leap = F.pmod(century, F.lit(400)) == 0
    wide = F.when(leap, 487).otherwise(397)
    at = F.datediff(day, begin)
    new = permuted(
        F.floor(at / wide), F.pmod(at, wide), F.when(leap, 75).otherwise(92), wide, key, "date"
    )
    moved = F.date_add(begin, (new["l"] * wide + new["r"]).cast("int"))
    text = (
        F.when(iso, F.date_format(moved, "yyyy-MM-dd"))
        .when(slash & day_first.isNotNull(), F.date_format(moved, "dd/MM/yyyy"))
        .when(slash, F.date_format(moved, "MM/dd/yyyy"))
        .otherwise(F.date_format(moved, "dd.MM.yyyy"))
    )
    return F.coalesce(F.year(day).between(1000, 9999), F.lit(False)), text


def _shifted(chars: Column, other: Column, i: Column, key: str) -> Column:
    """``chars`` with each ASCII letter and digit moved within its class by the other half."""

    def move(c: Column, k: Column) -> Column:
        block = F.floor(k / 16)
        hexes = _secret(key, "email", i, block, F.length(chars), other)
        step = F.conv(F.substring(hexes, F.pmod(k, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        return (
            F.when(c.rlike("^[0-9]$"), F.char(F.pmod(code - 48 + step, F.lit(10)) + 48))
            .when(c.rlike("^[a-z]$"), F.char(F.pmod(code - 97 + step, F.lit(26)) + 97))
            .when(c.rlike("^[A-Z]$"), F.char(F.pmod(code - 65 + step, F.lit(26)) + 65))
            .otherwise(c)
        )

    return F.when(chars == "", chars).otherwise(F.array_join(F.transform(F.split(chars, ""), move), ""))


def _email(value: Column, key: str) -> tuple[Column, Column]:
    """The whole address moves but for its last label."""
    last = F.substring_index(value, ".", -1)
    body = F.left(value, F.length(value) - F.length(last))
    half = F.floor(F.length(body) / 2).cast("int")
    start = F.struct(F.left(body, half).alias("l"), F.right(body, F.length(body) - half).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(acc["r"].alias("l"), _shifted(acc["l"], acc["r"], i, key).alias("r"))

    new = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
    return F.lit(True), F.concat(new["l"], new["r"], last)


_WAYS = {
    "email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban,
}


def _replaced(value: Column, key: str) -> Column:
    """struct(kind, new); a value that fails its check has no kind and stays."""
    kind, new = F.lit(None).cast("string"), value
    for name in reversed(KINDS):
        valid, moved = _WAYS[name](value, key)
        # a whole value needs no look at its surroundings
        fits = value.rlike(f"^(?:{PATTERNS[name]})$")
        kind = F.when(fits, F.when(valid, F.lit(name))).otherwise(kind)
        new = F.when(fits, F.when(valid, moved).otherwise(value)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and ``found``: the kinds replaced, in order.

    Null texts stay null and empty ones empty, both with no kinds. Values that fail their
    check stay as they are. Repeated rows get equal results; all other columns are kept.
    Lengths do not change.
    """
    whole = F.col(text)
    # most texts hold neither a digit nor an address
    some = whole.rlike("[0-9@]")
    matches = F.when(some, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.split(whole, ANY, -1)
    moved = docs.withColumn(found, F.transform(matches, lambda m: _replaced(m, key)))
    joined = F.array_join(
        F.zip_with(pieces, F.col(found), lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), ""
    )
    moved = moved.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(whole))
    kinds = F.filter(F.transform(F.col(found), lambda m: m["kind"]), lambda k: k.isNotNull())
    return moved.withColumn(found, F.coalesce(kinds, F.array().cast("array<string>")))
