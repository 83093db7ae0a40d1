"""Surrogates: what is found, what it becomes, and that all else stays, against plain checks."""

import re

import pytest

from tallgrass.llm import pii

FOUND = {
    "call 555-234-4567 now": ["phone"], "call 030 1234567 now": ["phone"], "06 12 34 56 78": ["phone"], "+442079460958": ["phone"], "+44 20 7946 0958": ["phone"], "card 378282246310005.": ["card"],
    "3782 822463 10005": ["card"], "4222222222222": ["card"], "at 2001:db8:85a3:0:0:8a2e:370:7334 now": ["ipv6"], "fe80::1ff:fe23:4567:890a": ["ipv6"], "DE89 3704 0044 0532 0130 00": ["iban"],
    "John Smith wrote to Emma Brown": ["person", "person"], "My name is Zorro Quux.": ["person"], "Regards, Zelda O'Neil-Bray": ["person"], "Dr. von Neumann spoke": ["person"], "Меня зовут Пётр Чайкин": ["person"],
}
CLEAN = [
    "version 1.2.3 of 2024-12-31 at 10:20:30", "12345678901234 and 1234567890123456", "The The Of Of", "isbn 978-3-16-148410-0", "ratio 3::4 a::b", "pages 123-456-7890", "see 555 234", "Mark Twain's Public License", "x = 0.123456789", "10:20", "a 030 b",
]


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban_fits(value):
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_kinds_and_formats(spark):
    texts = [*FOUND, *CLEAN]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.anonymised(df, "k").collect()}
    for i, (t, kinds) in enumerate(FOUND.items()):
        assert (got[i]["_kinds"], got[i]["_n_entities"]) == (sorted(set(kinds)), len(kinds)), t
        shape = lambda x: re.sub(r"[^\W\d_]+", "w", re.sub(r"\d", "0", x))
        if kinds[0] in ("phone", "card", "iban"):
            assert shape(got[i].text) == shape(t) and got[i].text != t
    for i, t in enumerate(CLEAN, len(FOUND)):
        assert got[i].text == t and got[i]["_n_entities"] == 0, t
    by = dict(zip(texts, (got[i].text for i in range(len(texts)))))
    assert by["+442079460958"].startswith("+44") and by["+44 20 7946 0958"].startswith("+44 ") and by["call 030 1234567 now"].startswith("call 0")
    assert by["+442079460958"][1:] == re.sub(r"\D", "", by["+44 20 7946 0958"])
    for t in ("card 378282246310005.", "3782 822463 10005", "4222222222222"):
        assert luhn(re.sub(r"\D", "", by[t])) and re.sub(r"\D", "", by[t])[0] == re.sub(r"\D", "", t)[0]
    assert iban_fits(by["DE89 3704 0044 0532 0130 00"]) and by["DE89 3704 0044 0532 0130 00"].startswith("DE")
    assert re.fullmatch(r"at (?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4} now", by["at 2001:db8:85a3:0:0:8a2e:370:7334 now"])
    m = re.fullmatch(r"(\w+) (\p{0}\w+) wrote to (\w+) (\w+)".replace(r"\p{0}", ""), by["John Smith wrote to Emma Brown"])
    assert m[1] in pii.NAMES["latin", "m"] and m[3] in pii.NAMES["latin", "f"] and not {m[2], m[4]} & {"Smith", "Brown"}


def test_surnames_stay_one_person(spark):
    texts = ["Mrs Smith met John Smith. Smith said so, Smithson did not; SMITH@x.org stays a mail.", "Smith alone is a trade.", "Frau Müller-Lüdenscheidt und Herr Müller", "Анна Петрова и Иван Петров; Петрова ушла"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.anonymised(df, "k").collect()}
    m = re.match(r"Mrs (\w+) met (\w+) (\w+)\. (\w+) said so, Smithson did not; (\S+) stays a mail\.", got[0])
    assert m[1] == m[3] == m[4] != "Smith" and m[2] in pii.NAMES["latin", "m"] and m[5].lower() != "smith@x.org"
    assert got[1] == texts[1]
    assert re.fullmatch(r"Frau \w+-\w+ und Herr \w+", got[2]) and "Müller" not in got[2]
    m = re.fullmatch(r"(\w+) (\w+) и (\w+) (\w+); (\w+) ушла", got[3])
    assert m[2] == m[5] and m[2].endswith("а") and not m[4].endswith("а") and m[1] in pii.NAMES["cyrillic", "f"]


def test_distinct_entities_stay_distinct_and_the_rest_stays(spark):
    people = [f"{g} {a}{b}" for g in ("John", "Emma") for a in "Ab Br Cr Dr El Fr".split() for b in "and ock ill umm een".split()]
    numbers = [f"555-2{k:02}-{4000 + k}" for k in range(60)]
    texts = [f"<{p}> and <{n}> #{k}" for k, (p, n) in enumerate(zip(people, numbers))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.anonymised(df, "k").collect()}
    parts = {k: re.fullmatch(r"<(\w+ \w+)> and <(\d{3}-\d{3}-\d{4})> #(\d+)", t).groups() for k, t in got.items()}
    assert all(parts[k] == parts[k + 60] and parts[k][2] == str(k) for k in range(60))
    assert len({p[1] for p in parts.values()}) == 60 and len({parts[k][0] for k in range(60)}) == 60
    assert not {p[1] for p in parts.values()} & set(numbers) and not {p[0].split()[1] for p in parts.values()} & {p.split()[1] for p in people}
    other = {r.doc_id: r.text for r in pii.anonymised(df, "another key").collect()}
    assert sum(other[k] == got[k] for k in range(60)) < 5


def test_a_key_is_asked_for_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "John Smith", 5, "x")], "doc_id long, text string, _n_entities int, _kinds string")
    got = pii.anonymised(df, "k").first()
    assert (got["_n_entities"], got["_kinds"], got["__n_entities"], got["__kinds"]) == (5, "x", 1, ["person"])
    old = spark.conf.get("spark.tallgrass.surrogates.key")
    spark.conf.unset("spark.tallgrass.surrogates.key")
    try:
        with pytest.raises(ValueError, match="key"):
            pii.anonymised(df)
    finally:
        spark.conf.set("spark.tallgrass.surrogates.key", old)


LEAKS = [
    ("My name is Priyanka Sharma. Priyanka likes it.", ["Priyanka", "Sharma"]), ("Contact: Wei Zhang", ["Wei", "Zhang"]), ("Dr Priyanka Sharma wrote. Sharma left, Priyanka too.", ["Priyanka", "Sharma"]),
    ("JOHN SMITH and Smith", ["JOHN", "SMITH", "Smith"]), ("John F. Kennedy met J. Kennedy and KENNEDY", ["John", "Kennedy", "KENNEDY"]), ("Prof. Ada M. Lovelace, Ada", ["Ada", "Lovelace"]), ("My name is Zorro Quux.", ["Zorro", "Quux"]),
    ("call 020 7946 0958 or 0161 496 0123", ["7946", "0958", "0123"]), ("我叫王小明。王小明说", ["王小明"]), ("اسمي محمد الفارسي", ["محمد", "الفارسي"]), ("Меня зовут Пётр Чайкин, Пётр", ["Пётр", "Чайкин"]),
]


def test_no_word_of_an_entity_is_left(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LEAKS)], "doc_id long, text string")
    for key in ("k", "another"):
        for r in pii.anonymised(df, key).collect():
            text, words = LEAKS[r.doc_id]
            assert r["_n_entities"] > 0 and not [w for w in words if re.search(rf"(?<!\w){w}(?!\w)" if w.isascii() else w, r.text)], r.text
            if r.doc_id == 0:
                m = re.fullmatch(r"My name is (\w+) (\w+)\. (\w+) likes it\.", r.text)
                assert m[1] == m[3] and m[1].endswith(("a", "ette"))
            if r.doc_id == 2:
                m = re.fullmatch(r"Dr (\w+) (\w+) wrote\. (\w+) left, (\w+) too\.", r.text)
                assert (m[1], m[2]) == (m[4], m[3])
            if r.doc_id == 3:
                m = re.fullmatch(r"(\w+) (\w+) and (\w+)", r.text)
                assert m[1].isupper() and m[2] == m[3].upper() != m[3] and m[1].title() in pii.NAMES["latin", "m"]
            if r.doc_id == 4:
                assert re.fullmatch(r"\w+ [A-Z]\. (\w+) met J\. \1 and \w+", r.text)


def test_cards_keep_their_issuer_and_given_names_no_shift(spark):
    cards = ["378282246310005", "6011 1111 1111 1117", "5555-5555-5555-4444", "4111111111111111"]
    names = pii.NAMES["latin", "f"]
    df = spark.createDataFrame([*enumerate(cards), *((100 + k, f"{n} Sharma") for k, n in enumerate(names))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.anonymised(df, "k").collect()}
    for k, c in enumerate(cards):
        assert got[k][:4] == c[:4] and got[k] != c and luhn(re.sub(r"\D", "", got[k])) and len(got[k]) == len(c)
    moved = [got[100 + k].split()[0] for k in range(len(names))]
    assert sorted(moved) == sorted(names) and not any(a == b for a, b in zip(moved, names, strict=True))
    assert len({(names.index(b) - k) % len(names) for k, b in enumerate(moved)}) > 10
