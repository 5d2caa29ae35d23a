"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

One pattern finds candidates; each is validated by its kind (card: Luhn; IBAN: mod 97; SSN: areas; IPv4: octets; date:
calendar). A valid value is permuted by a keyed Feistel network within its own format, so an equal value gets an
equal pseudonym in every document, different values get different ones, and the pseudonym is valid again:

- numbers: two parts of fixed ranges, alternately added a keyed digest of the other part modulo their range. Cards keep
  their first digit and get a new check digit; phones keep a country code; SSN parts stay in valid ranges.
- dates from 1900 to 2099: the day's number, as 17 x 4297 days. Of dates with slashes those that can be are month first;
  others are day first, and are permuted among such days (after the 12th), so no two dates get one pseudonym.
- e-mail addresses (without case) and IBAN accounts: the letters and digits of each half are shifted within their class.

The key is a parameter; without one it is read from the session (KEY_CONF), and only a session that has none gets the
public demonstration key, under which whoever has this code can undo the pseudonyms. Candidates that aren't valid stay as they are.

Defined results: a null text stays null, an empty one empty; repeated rows get equal results; the text keeps
everything outside the values; an empty table stays empty; other columns pass through (one named ``pii`` as ``_pii``), and
ids are not looked at.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import making_room, unused

ROUNDS = 8
KEY_CONF, DEMO_KEY = "spark.swirlframe.pii.key", "demonstration"
KINDS = ("email", "iban", "card", "ssn", "date", "ip", "phone")
_L, _R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: Lengths of IBANs by country (registry), tried first, so that words that follow stay outside.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: What has no country's length is taken at any.
IBAN = _L + "(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)" + _R
CARD = _L + r"(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R
SSN = _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R
DATE = _L + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:" + _R + r"|(?=T[0-9]{2}:?[0-9]{2}))"
IP = r"(?<![0-9A-Za-z_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z_+.])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,4})" + _R
ANY = "|".join((EMAIL, IBAN, CARD, SSN, DATE, IP, PHONE))


def _digest(key: str, kind: str, step: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")), 256)


def _number(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 1, 14), 16, 10).cast("long")


def feistel(left: Column, right: Column, m: Column, n: Column, key: str, kind: str) -> Column:
    """(left, right) permuted within [0, m) x [0, n)."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        a = F.when(i % 2 == 1, (acc["a"] + _number(_digest(key, kind, i, acc["b"]))) % m).otherwise(acc["a"])
        b = F.when(i % 2 == 0, (acc["b"] + _number(_digest(key, kind, i, acc["a"]))) % n).otherwise(acc["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)]), start, turn)


def _digits(s: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted within its length."""
    half = F.floor(F.length(s) / 2).cast("int")
    a, b = F.substring(s, 1, half), F.substring(s, half + 1, F.length(s) - half)
    done = feistel(a.cast("long"), b.cast("long"), F.pow(F.lit(10.0), F.length(a)).cast("long"), F.pow(F.lit(10.0), F.length(b)).cast("long"), key, kind)
    # One evaluation of the network for both parts: a one-element array, transformed.
    return F.transform(F.array(done), lambda p: F.concat(F.lpad(p["a"].cast("string"), F.length(a), F.lit("0")), F.lpad(p["b"].cast("string"), F.length(b), F.lit("0"))))[0]


def _shifted(s: Column, digest: Column) -> Column:
    """Letters and digits of s moved within their class by the digest's bytes."""

    def one(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        x, k = F.ascii(c), F.conv(F.substring(digest, ((i - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = lambda low, n: F.char(F.lit(low) + (x - low + k) % n)
        return F.when(x.between(48, 57), moved(48, 10)).when(x.between(97, 122), moved(97, 26)).when(x.between(65, 90), moved(65, 26)).otherwise(c)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), "")).otherwise(s)


def _letters(s: Column, key: str, kind: str) -> Column:
    """A string permuted within the classes of its characters."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, 1, half).alias("a"), F.substring(s, half + 1, F.length(s) - half).alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        # The digest depends on the other half; of one character there is no other half, and its class is shifted.
        a = F.when(i % 2 == 1, _shifted(acc["a"], _digest(key, kind, i, acc["b"]))).otherwise(acc["a"])
        b = F.when(i % 2 == 0, _shifted(acc["b"], _digest(key, kind, i, acc["a"]))).otherwise(acc["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    return F.transform(F.array(F.aggregate(F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)]), start, turn)), lambda p: F.concat(p["a"], p["b"]))[0]


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    gaps = F.split(form, "[0-9]", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn_sum(payload: Column) -> Column:
    """Sum over a payload whose last digit is doubled (a check digit follows)."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(payload), F.lit(1)))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(spots, F.lit(0), add)


def _check_digit(payload: Column) -> Column:
    return ((10 - _luhn_sum(payload) % 10) % 10).cast("string")


def _mod97(s: Column) -> Column:
    """Of an alphanumeric string, letters counting 10 to 35."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(x >= 65, (acc * 100 + x - 55) % 97).otherwise((acc * 10 + x - 48) % 97)

    return F.aggregate(spots, F.lit(0), add)


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    name, rest = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.substring_index(rest, ".", -1)
    domain = F.substring(rest, F.lit(1), F.length(rest) - F.length(top) - 1)
    return F.concat(_letters(name, key, "email"), F.lit("@"), _letters(domain, key, "domain"), F.lit("."), top)


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    land, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat) - 4)
    fresh = _letters(account, key, "iban")
    whole = F.transform(F.array(fresh), lambda a: F.concat(land, F.lpad((98 - _mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a))[0]
    gaps = F.split(m, "[0-9A-Z]", -1)
    put = F.transform(F.array(whole), lambda w: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.substring(w, i + 1, F.lit(1)))), ""))[0]
    fits = F.lit(True)  # a country of the list has its own length
    for n, countries in IBAN_LENGTHS.items():
        fits = F.when(land.isin(countries.split(" ")), F.length(flat) == n).otherwise(fits)
    right = F.length(flat).between(15, 34) & fits & (_mod97(F.concat(account, F.substring(flat, 1, 4))) == 1)
    return F.when(right, put)


def _card(m: Column, key: str) -> Column:
    d = _only_digits(m)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    fresh = F.concat(F.substring(payload, 1, 1), _digits(F.substring(payload, F.lit(2), F.length(payload) - 1), key, "card"))
    put = F.transform(F.array(fresh), lambda p: _refilled(m, F.concat(p, _check_digit(p))))[0]
    valid = F.length(d).between(13, 19) & (_check_digit(payload) == F.substring(d, -1, 1)) & (F.regexp_replace(d, "0", "") != "")
    return F.when(valid, put)


def _ssn(m: Column, key: str) -> Column:
    d = _only_digits(m)
    area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    told = lambda p: F.format_string("%03d-%02d-%04d", p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1)
    return F.when(valid, F.transform(F.array(done), told)[0])


def _day(form: str):
    return lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * 4297 + p["b"]).cast("int")), form)


def _late(p: Column) -> Column:
    """Whether a day (a, b) is after the 12th of its month."""
    return F.dayofmonth(F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * 4297 + p["b"]).cast("int"))) > 12


def _date(m: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for form, like in (("yyyy-MM-dd", "^[0-9]{4}-"), ("yyyy/MM/dd", "^[0-9]{4}/"), ("MM/dd/yyyy", "^[0-9]{2}/"), ("dd/MM/yyyy", "^(1[3-9]|2[0-9]|3[01])/"), ("dd.MM.yyyy", "^[0-9]{2}[.]")):
        parts = {p: F.substring(m, form.index(p) + 1, len(p)) for p in ("yyyy", "MM", "dd")}
        day = F.datediff(F.try_to_date(F.concat_ws("-", parts["yyyy"], parts["MM"], parts["dd"]), "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
        done = feistel(F.floor(day / 4297), day % 4297, F.lit(17), F.lit(4297), key, "date")
        if form == "dd/MM/yyyy":  # walk on until the day can't be taken for a month; three in five can't
            done = F.aggregate(F.array_repeat(F.lit(0), 64), done, lambda p, _: F.when(_late(p), p).otherwise(feistel(p["a"], p["b"], F.lit(17), F.lit(4297), key, "date")))
        told = F.transform(F.array(done), _day(form))[0]
        out = F.when(m.rlike(like), F.when(day.between(0, 73048), told)).otherwise(out)
    return out


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, "[.]")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ((F.length(p) == 1) | ~p.startswith("0")))
    n = [parts[i].cast("int") for i in range(4)]
    done = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, "ip")
    told = lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)
    return F.when(valid, F.transform(F.array(done), told)[0])


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m) - F.length(code))
    return F.concat(code, _refilled(rest, _digits(_only_digits(rest), key, "phone")))


_MADE = {"email": (EMAIL, _email), "iban": (IBAN, _iban), "card": (CARD, _card), "ssn": (SSN, _ssn), "date": (DATE, _date), "ip": (IP, _ip), "phone": (PHONE, _phone)}


def pseudonyms(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the text's values replaced, and ``pii``: array of (kind, pseudonym) in order of the text."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, DEMO_KEY)
    if key == DEMO_KEY:
        warnings.warn(f"pseudonyms under the public demonstration key can be undone; set {KEY_CONF}", stacklevel=2)
    docs = making_room(docs, "pii")
    body, names = F.col(f"`{text}`"), docs.columns
    found, told = unused(docs, "found", "told")
    likely = body.rlike("[0-9]") | body.contains("@")  # every pattern has one of them

    def made(m: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,pseudonym:string>")
        for kind in reversed(KINDS):
            pattern, make = _MADE[kind]
            value = make(m, key)
            out = F.when(m.rlike(f"^(?:{pattern})$"), F.struct(F.lit(kind).alias("kind"), value.alias("pseudonym"))).otherwise(out)
        return out

    every = [F.col(f"`{c}`") for c in names]
    rows = docs.select(*every, F.when(likely, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).alias(found))
    some = F.size(found) > 0
    rows = rows.select(*every, F.when(some, F.col(found)).alias(found), F.when(some, F.transform(found, made)).alias(told))
    gaps = F.split(body, ANY, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(told), i)["pseudonym"], F.get(F.col(found), i), F.lit("")))), "")
    fresh = F.when(F.col(found).isNotNull(), joined).otherwise(body)
    pii = F.coalesce(F.filter(told, lambda p: p["pseudonym"].isNotNull()), F.array().cast("array<struct<kind:string,pseudonym:string>>"))
    return rows.select(*[fresh.alias(c) if c == text else F.col(f"`{c}`") for c in names], pii.alias("pii"))
