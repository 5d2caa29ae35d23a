"""PII pseudonyms and license scans, DataFrame functions only."""

import datetime
import re

from pyspark.sql import functions as F

from swirlframe.llm import licenses, pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return {r.doc_id: (r.text, [tuple(p) for p in r.pii]) for r in pii.pseudonyms(docs).collect()}


def test_values_keep_their_formats_and_stay_linked(spark):
    texts = [
        "mail thea.34@mail0.example.com now", "MAIL Thea.34@mail0.example.com", "card 4556737586899855.", "card 4556-7375-8689-9855", "6375986702482655 stays",
        "call +1 (640) 555-0953!", "ip 208.240.42.236", "999.1.1.1 stays", "ssn 123-45-6789", "ssn 666-45-6789 stays", "born 1984-02-29", "born 02/29/1984", "born 29.02.1984",
        "1984-02-30 stays", "iban DE89 3704 0044 0532 0130 00", "iban DE89370400440532013000", "hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", None, "", "no values here", "2504982509303916 4556737586899855 x",
    ]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        if t is None or "stays" in t or t in ("", "no values here") or t.startswith("hash"):
            assert got[i] == (t, [])
    kinds = [[k for k, _ in got[i][1]] for i in range(len(texts))]
    assert kinds[:4] == [["email"], ["email"], ["card"], ["card"]] and kinds[5] == ["phone"] and kinds[14] == kinds[15] == ["iban"]
    assert got[0][1][0][1] == got[1][1][0][1] and re.fullmatch(r"[a-z]{4}\.[0-9]{2}@[a-z]{4}[0-9]\.[a-z]{7}\.com", got[0][1][0][1])
    card = got[2][1][0][1]
    assert luhn(card) and card[0] == "4" and card != "4556737586899855" and got[3][1][0][1].replace("-", "") == card and got[2][0] == f"card {card}."
    assert got[20][0] == f"2504982509303916 {card} x"
    assert re.fullmatch(r"call \+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}!", got[5][0]) and got[5][0] != texts[5]
    assert all(int(p) < 256 for p in got[6][1][0][1].split("."))
    days = [datetime.datetime.strptime(got[i][1][0][1], f).date() for i, f in ((10, "%Y-%m-%d"), (11, "%m/%d/%Y"), (12, "%d.%m.%Y"))]
    assert days[0] == days[1] == days[2] != datetime.date(1984, 2, 29) and 1900 <= days[0].year < 2100
    flat = got[15][1][0][1]
    assert got[14][1][0][1].replace(" ", "") == flat and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 and flat[:2] == "DE"
    assert pii.pseudonyms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_valid_values_are_found_whatever_stands_around_them(spark):
    texts = [
        "dns 8.8.8.8", "dns 8.8.8.8 in 2024", "to AT61 1904 3002 3457 3201 EUR", "AT611904300234573201 EUR", "GB82 WEST 1234 5698 7654 32 BIC X", "at 2024-01-15T10:00:00Z", "on 2024-01-15",
        "2024-01-15Test stays", "NO93 8601 1117 947 NOK", "MT84 MALT 0110 0001 2345 MTLC AST0 01S 12",
    ]
    got = run(spark, texts)
    assert [[k for k, _ in got[i][1]] for i in range(len(texts))] == [["ip"], ["ip"], ["iban"], ["iban"], ["iban"], ["date"], ["date"], [], ["iban"], ["iban"]]
    value = [got[i][1][0][1] if got[i][1] else None for i in range(len(texts))]
    assert value[0] == value[1] and value[2].replace(" ", "") == value[3] and value[5] == value[6]
    assert got[0][0] == f"dns {value[0]}" and got[2][0] == f"to {value[2]} EUR" and got[4][0] == f"{value[4]} BIC X" and got[5][0] == f"at {value[5]}T10:00:00Z"
    assert got[7][0] == texts[7] and got[8][0] == f"{value[8]} NOK" and got[9][0] == f"{value[9]} 12"


def test_permutations_are_one_to_one(spark):
    def told(df):
        rows = [r[0] for r in df.collect()]
        assert len(set(rows)) == len(rows)
        return set(rows)

    every = told(spark.range(1000).select(pii._digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x")))
    assert every == {f"{i:03d}" for i in range(1000)}
    two = told(spark.range(6760).select(pii._letters(F.concat(F.char(97 + F.floor(F.col("id") / 260)), F.char(97 + F.floor(F.col("id") / 10) % 26), F.col("id") % 10), "k", "x")))
    assert len(two) == 6760
    days = told(spark.range(73049).select(pii._date(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), "k")))
    assert len(days) == 73049 and min(days) == "1900-01-01" and max(days) == "2099-12-31"
    ssn = told(spark.range(898).select(pii._ssn(F.format_string("%03d-01-0001", F.col("id") + F.when(F.col("id") >= 665, 2).otherwise(1)), "k")))
    assert not any(x.startswith(("000", "666", "9")) or "-00-" in x or x.endswith("-0000") for x in ssn)
    ips = told(spark.range(2000).select(pii._ip(F.concat_ws(".", F.lit(10), F.lit(0), F.floor(F.col("id") / 256), F.col("id") % 256), "k")))
    assert len(ips) == 2000


def test_very_long_texts(spark):
    got = run(spark, ["a." * 50_000 + "@", "1 " * 50_000, "9" * 50_000, "x@" + "b." * 20_000, "1.2." * 20_000])
    assert all(not p for _, p in got.values())


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    hits = [(label, i) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for _, i in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in hits}))


def brute_blocks(t, threshold=0.8):
    w, out = licenses.template_words(t or ""), set()
    for label, text in licenses.NOTICES:
        x = licenses.template_words(text)
        for b in range(len(w)):
            if w[b] not in x:
                continue
            share = len(set(x) & set(w[b : b + 2 * len(x)])) / len(set(x))
            if share >= threshold - 1e-9:
                out.add((label, b, min(b + 2 * len(x), len(w)), round(share, 9)))
    return out


def test_licenses(spark):
    notices = dict(licenses.NOTICES)
    texts = [
        None, "", "license", "mit license", "MIT License and the mit-license, Apache  LICENSE", "general public license general PUBLIC license", "admit license", "mit licence public license",
        "x " * 300 + notices["mit"] + " y" * 333, notices["bsd"].replace("source", "sauce").upper(), " ".join(notices["gpl"].split()[:20]), "filler " * 77 + notices["apache-2.0"] + notices["isc"],
        "Licensed under CC BY-NC 4.0.", "İ mit license É", *["filler " * k + "licensed x under x cc x by x nc x 4 x 0" for k in range(7)], "a" * 100_000 + " mit license", "one two " * 20_000 + notices["mpl-2.0"],
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, base string")
    scanned = licenses.scan_licenses(docs)
    blocks = {r.doc_id: {(m.label, m.start, m.end, round(m.containment, 9)) for m in r.matches} for r in scanned.collect()}
    rows = licenses.license_digest(scanned).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        want = brute_blocks(t)
        assert blocks[r.doc_id] == want, t
        assert r.labels == ",".join(sorted({x for x, *_ in want} | set(filter(None, r.base_labels.split(",")))))
        assert abs(r.score - (1.0 if r.n_base else max((s for *_, s in want), default=0.0))) < 1e-8
    assert blocks[8] and blocks[9] and blocks[11] and blocks[12] and all(blocks[14 + k] for k in range(7)) and blocks[22]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert all(not r.matches for r in licenses.scan_licenses(docs, templates=()).collect())
