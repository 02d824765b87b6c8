"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Found and validated values are replaced by others of the same format; equal values get
equal pseudonyms wherever they stand, and different values of a format different ones.

=========  =======================================  =========================================
kind       validated by                             permuted
=========  =======================================  =========================================
card       13 to 19 digits with a right Luhn digit  all digits but the last, which is computed
iban       remainder 1 modulo 97                    letters and digits of the account
ssn        parts in their ranges                    number of the valid (area, group) and serial
ip         four parts up to 255                     two halves of 16 bits
phone      ten digits as (ddd) ddd-dddd             the ten digits
date       day of the calendar, 1800 to 2199        number of the day in the 400 years
email      local part, @ and a dotted domain        letters and digits of the local part
=========  =======================================  =========================================

Numbers are permuted by a Feistel network over two moduli whose product is the exact size
of the format, so no walk is needed; texts by one that shifts each letter within its
alphabet and each digit within 0 to 9.  The round function is SHA-256 of the key, kind, round
and the other half.  Values that aren't valid stay as they are.

Only DataFrame functions run here.  Defined results: a null text stays null with 0 values, an empty
text stays empty; texts of any length are searched whole; rows, other columns (of any names) and their order stay; a column
``n_values`` is replaced.  The key stands in the plan, and so in event logs: keep those as safe as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import free_name, quoted

ROUNDS = 10

# The patterns of the formats.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "phone": r"(?<!\d)(?:\+\d{1,3} )?\(\d{3}\) \d{3}-\d{4}(?!\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?<!\d[.,])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
}
ANY = "|".join(PATTERNS.values())

_DAYS = 146_097  # of 400 years
_FIRST_DAY = "1800-01-01"


def _digest(key: Column, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), step.cast("string"), half.cast("string")), 256)


def _amount(digest: Column, below: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(below))


def permute_number(value: Column, a: int, b: int, kind: str, key: Column) -> Column:
    """A permutation of 0 to a * b - 1."""
    start = F.struct(F.floor(value / b).cast("bigint").alias("x"), F.pmod(value.cast("bigint"), F.lit(b)).alias("y"))

    def step(acc: Column, i: Column) -> Column:
        x = F.pmod(acc["x"] + _amount(_digest(key, kind, i, acc["y"]), a), F.lit(a))
        return F.struct(F.when(i % 2 == 1, x).otherwise(acc["x"]).alias("x"), F.when(i % 2 == 1, acc["y"]).otherwise(F.pmod(acc["y"] + _amount(_digest(key, kind, i, acc["x"]), b), F.lit(b))).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc["x"] * b + acc["y"])


def _shift(text: Column, digest: Column) -> Column:
    """Shift each digit, small and capital letter within its alphabet."""

    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(j, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + j
        turned = lambda base, size: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(size)))
        return F.when(c.rlike("^[0-9]$"), turned(48, 10)).when(c.rlike("^[a-z]$"), turned(97, 26)).when(c.rlike("^[A-Z]$"), turned(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def permute_text(text: Column, kind: str, key: Column) -> Column:
    """A permutation of the texts with the same pattern of digits, small and capital letters."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    step = lambda acc, i: F.struct(acc["r"].alias("l"), _shift(acc["l"], _digest(key, kind, i, acc["r"])).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _filled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        new = F.when(is_digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(template, ""), start, step, lambda acc: acc["out"])


def _card(value: Column, key: Column) -> Column:
    digits = _digits(value)
    body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    luhn = lambda x: F.call_function("luhn_check", x)
    ended = lambda x: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(x, d.cast("string"))), luhn), 1)
    return F.when(luhn(digits), _filled(value, _once(body, ended))).otherwise(value)


def _iban_rest(account: Column, country: Column, check: Column) -> Column:
    """The number of an IBAN modulo 97: the account, country and check digits, letters as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        value = F.when(letter, F.ascii(c) - 55).when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(0)
        return F.when(c == "", acc).otherwise(F.pmod(acc * F.when(letter, 100).otherwise(10) + value, F.lit(97)))

    return F.aggregate(F.split(F.concat(account, country, check), ""), F.lit(0), step)


def _iban(value: Column, key: Column) -> Column:
    country, check, account = F.substring(value, 1, 2), F.substring(value, 3, 2), F.substr(value, F.lit(5))
    new = permute_text(account, "iban", key)
    digits = F.lpad((F.lit(98) - _iban_rest(new, country, F.lit("00"))).cast("string"), 2, "0")
    return F.when(_iban_rest(account, country, check) == 1, F.concat(country, digits, new)).otherwise(value)


def _ssn(value: Column, key: Column) -> Column:
    area, group, serial = (F.substring(value, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    new = permute_number(rank.cast("bigint"), 898 * 99, 9999, "ssn", key)

    def written(x: Column) -> Column:
        pair, last = F.floor(x / 9999).cast("int"), F.pmod(x, F.lit(9999)) + 1
        first = F.floor(pair / 99).cast("int")
        return F.concat(F.lpad(F.when(first >= 665, first + 2).otherwise(first + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.pmod(pair, F.lit(99)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad(last.cast("string"), 4, "0"))

    return F.when(valid, _once(new, written)).otherwise(value)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ip(value: Column, key: Column) -> Column:
    parts = F.split(value, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ~p.rlike("^0[0-9]"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.cast("bigint"))
    new = permute_number(number, 65536, 65536, "ip", key)
    written = lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when(valid, _once(new, written)).otherwise(value)


def _phone(value: Column, key: Column) -> Column:
    country = F.regexp_extract(value, r"^(\+\d+ )?", 0)
    rest = F.substr(value, F.length(country) + 1)
    return F.concat(country, _filled(rest, permute_text(_digits(rest), "phone", key)))


def _date(value: Column, key: Column) -> Column:
    iso = value.rlike(r"^\d{4}-")
    year = F.when(iso, F.substring(value, 1, 4)).otherwise(F.substring(value, 7, 4))
    month = F.when(iso, F.substring(value, 6, 2)).otherwise(F.substring(value, 4, 2))
    day = F.when(iso, F.substring(value, 9, 2)).otherwise(F.substring(value, 1, 2))
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    offset = F.datediff(date, F.lit(_FIRST_DAY).cast("date"))
    valid = date.isNotNull() & offset.between(0, _DAYS - 1)
    new = permute_number(offset.cast("bigint"), 27, 5411, "date", key)  # 27 * 5411 days

    def written(x: Column) -> Column:
        moved = F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int"))
        return F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(value.contains("."), F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy"))

    return F.when(valid, _once(new, written)).otherwise(value)


def _email(value: Column, key: Column) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_text(local, "email", key), F.substr(value, F.length(local) + 1))


_MAKERS = {"email": _email, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "iban": _iban}


def pseudonym(value: Column, key: Column) -> Column:
    """The pseudonym of a value that one of the patterns found; invalid ones stay."""
    whole = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    out = F.when(whole("email"), _email(value, key))
    for kind in list(PATTERNS)[1:]:
        out = out.when(whole(kind), _MAKERS[kind](value, key))
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, *, text_column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its texts, and ``n_values``, the number of values replaced."""
    if not key:
        raise ValueError("a key is needed")
    text = quoted(text_column)
    kept = [c for c in docs.columns if c.lower() != "n_values"]
    values, new, whole = free_name(docs, "values", "new", "whole")
    # Values are found once; texts without any digit or @ are never searched.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    step = docs.select(*map(quoted, kept)).withColumn(values, found)
    step = step.withColumn(new, F.when(F.size(values) > 0, F.transform(values, lambda v: pseudonym(v, F.lit(key)))))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col(new), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with(values, new, lambda old, v: old != v), lambda x: x)), F.lit(0))
    out = step.withColumn(whole, F.when(F.col(new).isNotNull(), joined).otherwise(text)).withColumn("n_values", F.when(F.col(new).isNotNull(), changed).otherwise(0).cast("bigint"))
    return out.select(*((F.col(whole) if c == text_column else quoted(c)).alias(c) for c in kept), "n_values")
