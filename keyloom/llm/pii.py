"""Format-preserving pseudonyms for personal data, by keyed Feistel networks in DataFrame expressions only.

Validated values are permuted within their format, so a value has the same pseudonym in every document, different
values have different ones, and the key's holder can go back (`inverse=True`):

* payment cards (13 to 19 digits, Luhn): all digits but the last are permuted, the check digit follows, separators stay;
  digits in a row or in the usual groups count as a card also within a longer run of numbers, and before the whole run;
* IPv4 addresses: the 32-bit number; * North American phones: area, exchange (both from 200) and line;
* social security numbers: the valid areas, groups and serials; * dates (yyyy-mm-dd, and nn/nn/yyyy read as month/day
  or else day/month) of 1800 to 2199: the days of that 400-year cycle, 189 x 773 of them;
* e-mail addresses: letters and digits of the local part, each within its class.

A network alternates l = (l + F(r)) mod a and r = (r + F(l)) mod b over `ROUNDS` rounds, F being SHA-256 of key, kind,
round and the other half; it permutes 0..a*b-1 exactly for any a and b.

Defined results. Null text stays null with zero values; empty and very long texts are whole, and a candidate may be of any
length. A candidate that does not
validate is left alone. Overlapping candidates: the leftmost, then the first kind in the order of `PATTERN`, counts.
Equal rows give equal rows. Extra columns pass through; the count's column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import spare_name

ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive loops take no stack
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
CARD_GROUPS = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9])"
PATTERN = f"{EMAIL}|(?<![0-9A-Za-z.])(?=[0-9+(])(?:{IP}|{DATE}|{SSN}|{PHONE}|{CARD})"

PHONE_PARTS = r"^((?:\+1[ .-]?)?\(?)([2-9][0-9]{2})(\)? ?[.-]?)([2-9][0-9]{2})([ .-])([0-9]{4})$"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYCLE_START, DATE_A, DATE_B = "1800-01-01", 189, 773


def _digest(key: str, kind: str, round_no: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), half.cast("string")).cast("binary"), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _rounds(inverse: bool) -> Column:
    return F.array(*[F.lit(r) for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """struct(l, r): the pair permuted within [0, a) x [0, b)."""
    sign = F.lit(-1 if inverse else 1)

    def turn(acc: Column, r: Column) -> Column:
        l, x = acc["l"], acc["r"]  # noqa: E741
        first = F.struct(F.pmod(l + sign * F.pmod(_number(_digest(key, kind, r, x)), a), a).alias("l"), x.alias("r"))
        second = F.struct(l.alias("l"), F.pmod(x + sign * F.pmod(_number(_digest(key, kind, r, l)), b), b).alias("r"))
        return F.when(r % 2 == 0, first).otherwise(second)

    return F.aggregate(_rounds(inverse), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _zeros(n: Column, width: int | Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def ip_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    at = lambda i: F.get(p, F.lit(i))
    new = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), key, "ip", inverse)
    text = _let(new, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))
    return F.when(F.forall(p, lambda x: x <= 255), text).otherwise(m)


def date_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    def of(fmt: str, otherwise: Column) -> Column:
        day = F.try_to_timestamp(m, F.lit(fmt)).cast("date")
        n = F.datediff(day, F.lit(CYCLE_START).cast("date"))
        new = feistel(F.floor(n / DATE_B), n % DATE_B, F.lit(DATE_A), F.lit(DATE_B), key, "date", inverse)
        moved = _let(new, lambda s: F.date_add(F.lit(CYCLE_START).cast("date"), (s["l"] * DATE_B + s["r"]).cast("int")))
        return F.when((n >= 0) & (n < DATE_A * DATE_B), F.date_format(moved, fmt)).otherwise(otherwise)

    return F.when(m.contains("-"), of("yyyy-MM-dd", m)).otherwise(of("MM/dd/yyyy", of("dd/MM/yyyy", m)))


def ssn_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("bigint") for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    new = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", inverse)

    def text(s: Column) -> Column:
        i = F.floor(s["l"] / 99)
        return F.concat_ws("-", _zeros(i + F.when(i >= 665, 2).otherwise(1), 3), _zeros(s["l"] % 99 + 1, 2), _zeros(s["r"] + 1, 4))

    return F.when(valid, _let(new, text)).otherwise(m)


def phone_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    part = lambda i: F.regexp_extract(m, PHONE_PARTS, i)
    area, exchange, line = (part(i).cast("bigint") for i in (2, 4, 6))
    new = feistel((area - 200) * 800 + exchange - 200, line, F.lit(640_000), F.lit(10_000), key, "phone", inverse)
    text = lambda s: F.concat(part(1), (F.floor(s["l"] / 800) + 200).cast("string"), part(3), (s["l"] % 800 + 200).cast("string"), part(5), _zeros(s["r"], 4))
    return _let(new, text)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, beginning with that position (0 or 1)."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((i + doubled_from_right) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda acc, d: acc + d)


def replaced(whole: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """whole with new(match) for every match of the pattern."""
    found = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(whole, pattern, -1), F.transform(found, new), lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))
    return F.array_join(F.flatten(parts), "")


def card_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    """The cards in a run of digits: those of its groups that validate, else the run itself if it does. The choice is the
    same for the pseudonyms of groups, which validate as their cards do."""

    def of(m: Column, d: Column) -> Column:
        n = F.length(d) - 1
        k = F.floor(n / 2).cast("int")
        power = lambda e: F.pow(F.lit(10.0), e).cast("bigint")
        new = feistel(d.substr(F.lit(1), k), d.substr(k + 1, n - k), power(k), power(n - k), key, "card", inverse)

        def text(s: Column) -> Column:
            return _let(F.concat(_zeros(s["l"], k), _zeros(s["r"], n - k)), lambda body: F.concat(body, F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string")))

        spread = lambda out: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), out.substr(F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
        return F.when(luhn_sum(d, 1) % 10 == 0, _let(_let(new, text), spread)).otherwise(m)

    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    one = lambda x: _let(digits(x), lambda d: of(x, d))
    return _let(replaced(m, CARD_GROUPS, one), lambda out: F.when((out == m), one(m)).otherwise(out))


def _shifted(text: Column, digest: Column, sign: int) -> Column:
    """Letters and digits moved within their class by the digest's bytes."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(digest.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        out = c
        for letters in (LOWER, UPPER, DIGITS):
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.lit(letters).substr(F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), move), ""))


def email_pseudonym(m: Column, key: str, inverse: bool) -> Column:
    at = F.instr(m, "@")
    local = m.substr(F.lit(1), at - 1)
    half = F.floor(F.length(local) / 2).cast("int")
    sign = -1 if inverse else 1

    def turn(acc: Column, r: Column) -> Column:
        l, x = acc["l"], acc["r"]  # noqa: E741
        first = F.struct(_shifted(l, _digest(key, "email", r, x), sign).alias("l"), x.alias("r"))
        second = F.struct(l.alias("l"), _shifted(x, _digest(key, "email", r, l), sign).alias("r"))
        return F.when(r % 2 == 0, first).otherwise(second)

    new = F.aggregate(_rounds(inverse), F.struct(local.substr(F.lit(1), half).alias("l"), local.substr(half + 1, F.length(local)).alias("r")), turn)
    return _let(new, lambda s: F.concat(s["l"], s["r"], m.substr(at, F.length(m))))


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """A candidate's pseudonym; itself if it does not validate."""
    return (
        F.when(m.contains("@"), email_pseudonym(m, key, inverse))
        .when(m.rlike(f"^(?:{IP})$"), ip_pseudonym(m, key, inverse))
        .when(m.rlike(f"^(?:{DATE})$"), date_pseudonym(m, key, inverse))
        .when(m.rlike(f"^(?:{SSN})$"), ssn_pseudonym(m, key, inverse))
        .when(m.rlike(f"^(?:{PHONE})$"), phone_pseudonym(m, key, inverse))
        .otherwise(card_pseudonym(m, key, inverse))
    )


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", count: str = "n_pseudonyms", inverse: bool = False) -> DataFrame:
    """docs with personal data in the text replaced, and the number of values that were."""
    whole = F.col(text)
    old, new, parts = (spare_name(docs, x) for x in ("old", "new", "pieces"))
    found = F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0))
    pieces = F.split(whole, PATTERN, -1)
    may = whole.rlike("[0-9@]")
    out = docs.withColumn(old, F.when(may, found)).withColumn(parts, F.when(F.size(old) > 0, pieces))
    out = out.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key, inverse))))
    joined = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    changed = F.aggregate(F.zip_with(old, new, lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn(count, F.coalesce(F.when(F.size(old) > 0, changed), F.lit(0)).cast("long"))
    return out.withColumn(text, F.coalesce(F.when(F.size(old) > 0, joined), whole)).drop(old, new, parts)
