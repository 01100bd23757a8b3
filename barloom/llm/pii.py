r"""Personal data replaced by format-preserving Feistel pseudonyms, in Spark's own functions only.

Numbers and dates are recognised by form, validated (Luhn and IBAN check digits, octets, calendar, number areas), and
permuted under a key within their own format: a valid card number becomes another valid one, a date another
date. The permutation is a Feistel network of alternating keyed additions on two halves, so equal values get equal
pseudonyms in all documents, different values get different ones, and whoever has the key can restore them with
`inverse=True`. What only looks like personal data and fails its check stays.

nn/nn/yyyy is dd/MM/yyyy where that is a date, else MM/dd/yyyy; the latter stay such dates, so that both can be restored.

E-mail addresses keep their domain; their local part is permuted in lower case. Letters beyond ASCII in it make it
a permuted number in base 16 of its bytes.

Defined cases: a null text stays null with counts of 0; an empty text stays empty; equal rows get equal results;
other columns are kept as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "iban", "card")

# characters of an IBAN by country, as registered
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD MR PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z\d]{{4}}){{{groups}}}" + (f" ?[A-Z\\d]{{{rest}}}" if rest else "")


_BEFORE, _AFTER = r"(?<![\p{L}\d_.@+-])", r"(?![\p{L}\d_])"
FORMS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@(?:[A-Za-z\d-]+\.)+[A-Za-z]{2,24}(?![A-Za-z\d-])",
    "ip": _BEFORE + r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)" + _AFTER,
    "date": _BEFORE + r"(?:(?:19|20)\d{2}-\d{2}-\d{2}(?![\d-])|\d{2}/\d{2}/(?:19|20)\d{2}(?![\d/]))",
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}(?!-)" + _AFTER,
    "phone": r"(?<![\p{L}\d_.@+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!-)" + _AFTER,
    # by the country's length, so that a word or number behind it is not taken in; any other by groups of four
    "iban": r"(?<![\p{L}\d_])(?:" + "|".join(f"{_iban(n, c)}{_AFTER}" for n, c in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?" + _AFTER + ")",
    "card": _BEFORE + r"(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3})(?!-)" + _AFTER,
}


def _powers(base: int, most: int) -> Column:
    return F.array(*(F.lit(base**k).cast("long") for k in range(most + 1)))


def _power(base: int, most: int, exponent: Column) -> Column:
    return F.element_at(_powers(base, most), (exponent + 1).cast("int"))


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: Column, inverse: bool = False) -> Column:
    """struct(a, b): a keyed permutation of the pairs of a in 0..m-1 and b in 0..n-1, both longs of at most 18 digits."""

    def shift(i: Column, value: Column, modulus: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)

    sign = F.lit(-1 if inverse else 1)

    def step(pair: Column, i: Column) -> Column:
        left = F.pmod(pair.a + sign * shift(i, pair.b, m), m)
        right = F.pmod(pair.b + sign * shift(i, pair.a, n), n)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(pair.a).alias("a"), F.when(odd, pair.b).otherwise(right).alias("b"))

    rounds = list(range(ROUNDS, 0, -1)) if inverse else list(range(1, ROUNDS + 1))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*(F.lit(i) for i in rounds)), start, step)


def _string(chars: Column, base: int, most: int, key: str, tweak: Column, inverse: bool) -> Column:
    """A string of 2 to 2 * most digits of a base, permuted among those of its length."""
    size = F.length(chars)
    u = F.floor(size / 2).cast("int")
    v = size - u

    def number(part: Column) -> Column:
        return F.conv(part, base, 10).cast("long")

    def text(value: Column, width: Column) -> Column:
        return F.right(F.concat(F.lit("0" * most), F.lower(F.conv(value.cast("string"), 10, base))), width)

    pair = feistel(number(F.substring(chars, F.lit(1), u)), number(F.substring(chars, u + 1, v)), _power(base, most, u), _power(base, most, v),
                   key, F.concat_ws("|", tweak, size.cast("string")), inverse)
    return F.transform(F.array(pair), lambda p: F.concat(text(p.a, u), text(p.b, v)))[0]


def _refill(form: Column, chars: Column, keep: str) -> Column:
    """form with its characters of the class `keep` replaced by those of chars, one after another."""
    def at(i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        upto = F.length(F.regexp_replace(F.substring(form, F.lit(1), i), f"[^{keep}]", ""))
        return F.when(c.rlike(f"[{keep}]"), F.substring(chars, upto, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits as the check weighs them, the last one counted once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(places, F.lit(0), add)


def _mod97(value: Column) -> Column:
    """The IBAN check of letters and digits."""
    def add(rest: Column, c: Column) -> Column:
        n = F.conv(c, 36, 10).cast("int")
        return F.when(n > 9, rest * 100 + n).otherwise(rest * 10 + n) % 97

    return F.aggregate(F.split(value, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(add(rest, c)))


def _date(value: Column) -> Column:
    iso = F.substring(value, 5, 1) == "-"
    return F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(value, "dd/MM/yyyy"))


def _month_first(value: Column) -> Column:
    """The day of MM/dd/yyyy; only where it is no dd/MM/yyyy, so that its day is after the 12th."""
    return F.when(_date(value).isNull() & (F.substring(value, 3, 1) == "/"), F.try_to_date(value, "MM/dd/yyyy"))


# days after the 12th before each month of a year, and their number from 1900 to 2099; 1900 is no leap year
_LATE = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)
_LATE_DAYS, _SIDE = 200 * 221 + 49, 210


def _late_rank(day: Column) -> Column:
    """Number of a day after the 12th of its month among those since 1900. Four years, the last a leap year, have 885."""
    since = F.year(day) - 1897
    leap = F.when((since % 4 == 3) & (F.month(day) > 2), 1).otherwise(0)
    x = F.floor(since / 4) * 885 + since % 4 * 221 + F.array(*map(F.lit, _LATE))[F.month(day) - 1] + leap + F.dayofmonth(day) - 13 - 663
    return (x - F.when(x > 35, 1).otherwise(0)).cast("long")


def _late_day(rank: Column) -> Column:
    """The day of a number of _late_rank."""
    x = rank + 663 + F.when(rank >= 35, 1).otherwise(0)
    year = F.least(F.floor(x % 885 / 221), F.lit(3))
    starts = F.array(*(F.lit(n) + (F.when(year == 3, 1).otherwise(0) if k > 1 else 0) for k, n in enumerate(_LATE)))
    inside = x % 885 - year * 221
    month = F.size(F.filter(starts, lambda n: n <= inside))
    return F.make_date((F.floor(x / 885) * 4 + year + 1897).cast("int"), month, (inside - starts[month - 1] + 13).cast("int"))


def _late_moved(rank: Column, key: str, inverse: bool) -> Column:
    """rank permuted: all but the last ones, then all but the first ones."""
    most, side = _SIDE * _SIDE, F.lit(_SIDE).cast("long")

    def part(from_: int) -> Callable[[Column], Column]:
        def moved(r: Column) -> Column:
            pair = feistel(F.floor((r - from_) / _SIDE), (r - from_) % _SIDE, side, side, key, F.lit(f"late{from_}"), inverse)
            return F.when(r.between(from_, from_ + most - 1), F.transform(F.array(pair), lambda p: p.a * _SIDE + p.b + from_)[0]).otherwise(r)

        return moved

    out = F.array(rank)
    for from_ in (_LATE_DAYS - most, 0) if inverse else (0, _LATE_DAYS - most):
        out = F.transform(out, part(from_))
    return out[0]


def kind_of(value: Column) -> Column:
    """The kind of a match whose check holds, else null."""
    digits = _digits(value)
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    plain = F.regexp_replace(value, " ", "")
    checks = {
        "email": F.lit(True),
        "ip": F.forall(octets, lambda x: x <= 255),
        "date": _date(value).isNotNull() | _month_first(value).isNotNull(),
        "ssn": ~digits.rlike("^(000|666|9)") & ~digits.rlike("^...00") & ~digits.rlike("0000$"),
        "phone": F.lit(True),
        "iban": F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.lit(40)), F.substring(plain, 1, 4))) == 1),
        "card": (_luhn(digits) % 10 == 0) & ~digits.rlike("^0+$"),
    }
    out = F.when(value.contains("@"), F.lit("email"))
    for kind in KINDS[1:]:
        out = out.when(value.rlike(f"^(?:{FORMS[kind]})$"), F.when(checks[kind], F.lit(kind)))
    return out


def _email(value: Column, key: str, inverse: bool) -> Column:
    local, domain = F.lower(F.substring_index(value, "@", 1)), F.substring_index(value, "@", -1)
    plain = F.regexp_replace(local, "[^a-z0-9]", "")

    def permuted(chars: Column, base: int, most: int) -> Column:
        # parts of 2 to 2 * most digits
        parts = F.regexp_extract_all(chars, F.lit(f"(.{{{2 * most - 2}}}(?=..)|.{{2,{2 * most - 1}}})"), F.lit(1))
        return F.array_join(F.transform(parts, lambda p, i: _string(p, base, most, key, F.concat(F.lit("email"), i.cast("string")), inverse)), "")

    ascii_only = local.rlike("^[a-z0-9._%+-]+$") & (F.length(plain) >= 2)
    # the mark tells such a local part from others, and no address is likely to begin with it
    coded = local.rlike("^0x_([0-9a-f]{2})+$")
    if inverse:
        other = F.when(coded, F.unhex(permuted(F.substring(local, F.lit(4), F.length(local)), 16, 14)).cast("string"))
        return F.concat(F.when(coded, other).otherwise(_refill(local, permuted(plain, 36, 11), "a-z0-9")), F.lit("@"), domain)
    other = F.concat(F.lit("0x_"), permuted(F.lower(F.hex(F.encode(local, "UTF-8"))), 16, 14))
    return F.concat(F.when(ascii_only & ~coded, _refill(local, permuted(plain, 36, 11), "a-z0-9")).otherwise(other), F.lit("@"), domain)


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a match of a kind; what has no kind stays."""
    digits = _digits(value)
    size = F.length(digits)

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    ip = F.transform(F.array(feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"), inverse)),
                     lambda p: F.concat_ws(".", *(F.floor(x).cast("string") for x in (p.a / 256, p.a % 256, p.b / 256, p.b % 256))))[0]

    # blocks of 365 * 200 days from 1900 on
    day = F.datediff(_date(value), F.lit("1900-01-01").cast("date"))
    block = F.floor(day / 73000)
    inside = F.pmod(day, F.lit(73000))
    moved = F.transform(
        F.array(feistel(F.floor(inside / 200), inside % 200, F.lit(365).cast("long"), F.lit(200).cast("long"), key, F.concat(F.lit("date"), block.cast("string")), inverse)),
        lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (block * 73000 + p.a * 200 + p.b).cast("int")))[0]
    late = F.transform(F.array(_late_moved(_late_rank(_month_first(value)), key, inverse)), _late_day)[0]
    date = F.when(_month_first(value).isNotNull(), F.date_format(late, "MM/dd/yyyy")).when(
        F.substring(value, 5, 1) == "-", F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "dd/MM/yyyy"))

    # areas 1 to 899 without 666, groups 1 to 99, serial numbers 1 to 9999
    area = F.substring(digits, 1, 3).cast("long")
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    ssn = F.transform(
        F.array(feistel(area * 99 + F.substring(digits, 4, 2).cast("long") - 1, F.substring(digits, 6, 4).cast("long") - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"), inverse)),
        lambda p: F.concat_ws("-", F.lpad((F.floor(p.a / 99) + F.when(p.a / 99 >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                              F.lpad((p.a % 99 + 1).cast("string"), 2, "0"), F.lpad((p.b + 1).cast("string"), 4, "0")))[0]

    national = F.right(digits, F.lit(10))
    phone = _refill(value, F.concat(F.substring(digits, F.lit(1), size - 10), _string(national, 10, 18, key, F.lit("phone"), inverse)), "0-9")

    plain = F.regexp_replace(value, " ", "")
    account = F.substring(plain, F.lit(5), F.lit(40))
    inner = _digits(account)
    changed = F.when(F.length(inner) >= 2, _refill(account, _string(inner, 10, 18, key, F.lit("iban"), inverse), "0-9")).otherwise(account)
    iban = F.transform(F.array(changed), lambda c: _refill(value, F.concat(
        F.substring(plain, 1, 2), F.lpad((98 - _mod97(F.concat(c, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"), c), "A-Z0-9"))[0]

    body = _string(F.substring(digits, F.lit(1), size - 1), 10, 18, key, F.lit("card"), inverse)
    card = F.transform(F.array(body), lambda c: _refill(value, F.concat(c, F.pmod(10 - _luhn(F.concat(c, F.lit("0"))) % 10, F.lit(10)).cast("string")), "0-9"))[0]

    out = F.when(kind == "email", _email(value, key, inverse))
    for name, made in (("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone), ("iban", iban), ("card", card)):
        out = out.when(kind == name, made)
    return out.otherwise(value)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = False, inverse: bool = False) -> DataFrame:
    """docs with personal data in text replaced; with counts also n_<kind> for every kind, which must not be columns yet."""
    whole = F.lit("|".join(f"(?:{FORMS[k]})" for k in KINDS))
    taken = set(docs.columns)

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        return name

    found, parts, kinds = free("_found"), free("_parts"), free("_kinds")
    body = F.col(text)
    some = F.coalesce(body, F.lit("")).rlike("[0-9@]")
    cut = docs.withColumns({
        found: F.when(some, F.regexp_extract_all(body, whole, F.lit(0))).otherwise(F.array().cast("array<string>")),
        parts: F.when(some, F.split(body, "|".join(f"(?:{FORMS[k]})" for k in KINDS), -1)).otherwise(F.array(body)),
    }).withColumn(kinds, F.transform(found, kind_of))
    fakes = F.zip_with(found, kinds, lambda value, kind: pseudonym(value, kind, key, inverse))
    glued = F.array_join(F.zip_with(parts, F.concat(fakes, F.array(F.lit(""))), lambda p, f: F.concat(p, f)), "")
    out = {text: F.when(F.size(found) == 0, body).otherwise(glued)}
    if counts:
        out |= {f"n_{k}": F.coalesce(F.size(F.filter(kinds, _is(k))).cast("long"), F.lit(0)) for k in KINDS}
    return cut.select(*(out.pop(c).alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns), *(v.alias(k) for k, v in list(out.items())))
