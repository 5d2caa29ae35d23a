"""Pseudonyms against a plain-Python finder and Feistel network, value by value."""

import datetime
import hashlib
import random
import re

import pytest

from swirlframe.llm import pii

KEY = "a key"


def digest(kind, step, other):
    return hashlib.sha256("|".join((KEY, kind, str(step), str(other))).encode()).hexdigest()


def feistel(a, b, m, n, kind):
    for i in range(1, 9):
        if i % 2:
            a = (a + int(digest(kind, i, b)[:14], 16)) % m
        else:
            b = (b + int(digest(kind, i, a)[:14], 16)) % n
    return a, b


def digits(s, kind):
    h = len(s) // 2
    a, b = feistel(int(s[:h]), int(s[h:]), 10**h, 10 ** (len(s) - h), kind)
    return f"{a:0{h}d}{b:0{len(s) - h}d}"


def letters(s, kind):
    def shifted(x, d):
        out = ""
        for i, c in enumerate(x):
            k = int(d[2 * (i % 32) : 2 * (i % 32) + 2], 16)
            for low, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(low) <= ord(c) < ord(low) + n:
                    c = chr(ord(low) + (ord(c) - ord(low) + k) % n)
                    break
            out += c
        return out

    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, 9):
        if i % 2:
            a = shifted(a, digest(kind, i, b))
        else:
            b = shifted(b, digest(kind, i, a))
    return a + b


def refilled(form, d):
    d = iter(d)
    return re.sub("[0-9]", lambda _: next(d), form)


def check_digit(payload):
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def email(m):
    name, host = m.lower().split("@")
    domain, top = host.rsplit(".", 1)
    return f"{letters(name, 'email')}@{letters(domain, 'domain')}.{top}"


def iban(m):
    flat = m.replace(" ", "")
    if not 15 <= len(flat) <= 34 or mod97(flat[4:] + flat[:4]) != 1:
        return None
    account = letters(flat[4:], "iban")
    fresh = iter(f"{flat[:2]}{98 - mod97(account + flat[:2] + '00'):02d}{account}")
    return re.sub("[0-9A-Z]", lambda _: next(fresh), m)


def card(m):
    d = re.sub("[^0-9]", "", m)
    if not 13 <= len(d) <= 19 or check_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    p = d[0] + digits(d[1:-1], "card")
    return refilled(m, p + check_digit(p))


def ssn(m):
    a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
    if not 1 <= a <= 899 or a == 666 or not g or not s:
        return None
    a, b = feistel(a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def date(m):
    form = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y" if m[:2] < "13" else "%d/%m/%Y"
    try:
        day = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= day <= 73048:
        return None
    a, b = feistel(day // 4297, day % 4297, 17, 4297, "date")
    while form == "%d/%m/%Y" and (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).day < 13:
        a, b = feistel(a, b, 17, 4297, "date")
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).strftime(form)


def ip(m):
    p = m.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in p):
        return None
    n = list(map(int, p))
    a, b = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def phone(m):
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", m)
    code = code[0] if code else ""
    rest = m[len(code) :]
    return code + refilled(rest, digits(re.sub("[^0-9]", "", rest), "phone"))


MADE = {"email": email, "iban": iban, "card": card, "ssn": ssn, "date": date, "ip": ip, "phone": phone}


def brute(text):
    values = []

    def put(m):
        for kind in pii.KINDS:
            if re.fullmatch(getattr(pii, kind.upper()), m[0]):
                fresh = MADE[kind](m[0])
                if fresh is not None:
                    values.append((kind, fresh))
                return m[0] if fresh is None else fresh
        return m[0]

    return (None if text is None else re.sub(pii.ANY, put, text)), values


def random_texts():
    rng = random.Random(17)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    luhn = lambda p: p + check_digit(p)
    account = lambda: n(18)

    def bank():
        a = account()
        flat = f"DE{98 - mod97(a + 'DE00'):02d}{a}"
        return " ".join(flat[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else flat

    kinds = [
        lambda: f"{rng.choice(['Ann', 'bob.k', 'x_y'])}{n(2)}@{rng.choice(['mail', 'web-1'])}.example.{rng.choice(['com', 'org'])}", bank, lambda: luhn("4" + n(14)), lambda: luhn("37" + n(12)),
        lambda: (lambda c: f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}")(luhn("5" + n(14))), lambda: n(16), lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 32):02d}",
        lambda: f"{rng.randrange(1, 13):02d}/{rng.randrange(1, 32):02d}/{rng.randrange(1900, 2100)}", lambda: f"{rng.randrange(1, 32):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(1900, 2100)}",
        lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"+{rng.choice(['1', '44', '353'])} ({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+49 {n(3)} {n(4)} {n(3)}", lambda: n(5),
    ]
    around = ["seen", "on", "é", "(", "EUR", "number:", "日本", "x=", "\n", "T"]
    out = [" ".join(rng.choice(around) if rng.random() < 0.5 else rng.choice(kinds)() + rng.choice(["", ".", ","]) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    return [*out, None, "", "word " * 20_000 + out[0] + " word" * 20_000]


def test_equals_the_plain_version(spark):
    texts = random_texts()
    docs = spark.createDataFrame([(i, t, i, i, "p") for i, t in enumerate(texts)], "doc_id long, text string, found long, told long, pii string")
    done = pii.pseudonyms(docs, KEY)
    assert done.columns == ["doc_id", "text", "found", "told", "_pii", "pii"]
    got = {r.doc_id: (r.text, [tuple(p) for p in r.pii]) for r in done.collect()}
    want = {i: brute(t) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        assert got[i] == want[i], t
    assert {k for _, v in want.values() for k, _ in v} == set(pii.KINDS)


def test_the_key_is_the_sessions(spark):
    docs = spark.createDataFrame([(1, "born 1984-02-29")], "doc_id long, text string")
    spark.conf.set(pii.KEY_CONF, KEY)
    try:
        assert pii.pseudonyms(docs).first().text == brute("born 1984-02-29")[0]
    finally:
        spark.conf.unset(pii.KEY_CONF)
    assert pii.pseudonyms(docs).first().text != brute("born 1984-02-29")[0]


def test_day_first_dates_stay_apart_from_month_first_ones(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(i) for i in range(0, 900, 3)]
    texts = [d.strftime("%d/%m/%Y") for d in days if d.day > 12] + [d.strftime("%m/%d/%Y") for d in days] + ["25/12/1990", "31/02/1990", "99/99/1990", "12/13/1990"]
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(i, f"on {t}.") for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonyms(docs, KEY).collect()}
    made = [got[i][3:-1] for i in range(len(texts))]
    assert len(set(made)) == len(texts)
    assert all((m != t) == (date(t) is not None) or date(t) == t for m, t in zip(made, texts, strict=True))
    assert made == [date(t) or t for t in texts]
    assert made[texts.index("25/12/1990")] != "25/12/1990" and made[texts.index("31/02/1990")] == "31/02/1990"


def test_an_iban_has_its_countrys_length(spark):
    def checked(land, account):
        for n in range(2, 99):
            flat = f"{land}{n:02d}{account}"
            if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                return flat
        raise AssertionError

    right, wrong, free = checked("DE", "370400440532013000"), checked("DE", "3704004405320130"), checked("QQ", "3704004405320130")
    docs = spark.createDataFrame(list(enumerate((right, wrong, free))), "doc_id int, text string")
    got = [r.text for r in pii.pseudonyms(docs, KEY).orderBy("doc_id").collect()]
    assert got[0] != right and got[1] == wrong and got[2] != free


def test_the_demonstration_key_warns(spark):
    with pytest.warns(UserWarning, match="demonstration"):
        pii.pseudonyms(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
