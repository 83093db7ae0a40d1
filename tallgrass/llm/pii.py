"""Personal data replaced by keyed surrogates, in DataFrame and SQL expressions only.

Entities are found with one pattern, checked by kind (Luhn and issuer range for cards,
octet range for addresses, digit counts for phones), and replaced in place: digits by
digits, letters by letters of the same case and script, given names by names of the same
gender and script, surnames by made-up surnames of the script with the ending of the
gender, with all punctuation kept. Country codes of phones and account numbers and the
first four digits of cards stay, and check digits are made to fit. Persons are found by a
title, a listed given name, or the words that introduce a name, in small letters or
capitals, with initials; given names that are on no list are made up like surnames. Every
word of a name that a text has introduced is replaced wherever else it stands in that text. A surrogate depends on a key and on the entity's normal
form, so one entity has one surrogate in the whole corpus, however it is written. The
table of distinct entities is checked for collisions, of surrogates with each other and
with real entities; whichever loses is drawn again until none is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import added, let, staged, text_key

# Given names by script and gender.
NAMES = {
    ("latin", "m"): (
        "James Robert Michael William David Richard Joseph Thomas Charles Christopher Jürgen Klaus Wolfgang Heinrich Pierre Jacques François Carlos Miguel Javier "
        "John Daniel Matthew Anthony Andrew Steven Paul Kevin Brian George Edward Peter Stephen Hans Stefan Andreas Uwe Jean Michel Philippe Alain Nicolas José Juan Antonio Pedro Luis Fernando"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Margaret Deborah Ursula Heike Gudrun Monique Chantal Isabelle Françoise Lucía Pilar Mercedes "
        "Sarah Emma Karen Lisa Nancy Sandra Ashley Emily Donna Michelle Laura Anna Sabine Petra Monika Claudia Marie Nathalie Sophie Camille Carmen Ana Isabel Elena Rosa Teresa"
    ).split(),
    ("cyrillic", "m"): "Иван Дмитрий Сергей Алексей Николай Михаил Владимир Андрей".split(),
    ("cyrillic", "f"): "Анна Ольга Елена Мария Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική".split(),
}
# Endings of made-up given names, those of words that end like women's names apart.
GIVEN_ENDS = {"latin": ("an el en is on or us", "a ia ina ette"), "cyrillic": ("ан ей ил он", "ана ия ина"), "greek": ("ας ης ος", "ία ίνα ώ")}
HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红梅建文志国海波宁龙林辉"  # of names
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Sra Sr Señor Señora Monsieur Madame".split()
# Words before a name of two words or more.
INTRODUCTIONS = ["[Mm]y name is", "[Nn]ame:", "[Ss]igned by", "[Ss]igned,", "[Rr]egards,", "[Ss]incerely,", "[Cc]ontact:", "[Aa]ttn\\.?:?", "[Mm]ein Name ist", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "Меня зовут"]
# Parts of made-up surnames by script: beginnings, middles, endings (those of women apart).
SURNAMES = {
    "latin": ("Al Bar Ber Bran Cal Car Dal Dor El Fal Far Gar Gil Hal Har Hol Kel Ken Lan Lor Mal Mar Mel Mor Nor Or Pal Per Ral Ros Sal Sel Tal Tor Ul Val Vor Wal Wes Win", "ba be bi da de di fa fe ga go ka ke la le li lo ma me mo na ne no ra re ri ro sa se so ta te ti to va ve", "berg ner ford ley man mann mont net ric ron sen son stein ton vard well"),
    "cyrillic": ("Бар Бел Вал Вер Гор Дан Дор Жар Зор Кал Кор Лад Мар Мел Нев Ор Пол Рад Сав Сол Тар Фед Чер Яр", "ан ат ев ед ел ен ер ик ил ин ир ок ол ом он ор", "ов ев ин", "ова ева ина"),
    "greek": ("Αλ Βαρ Γερ Δημ Ζαφ Θεο Καλ Κορ Λαμ Μαν Μελ Νικ Παλ Ραλ Σαρ Ταλ Φαν Χαρ", "αδ ακ αλ αν ατ εδ ελ εν ερ ιδ ικ ιλ ιν ολ ον ορ", "όπουλος ίδης άκης", "οπούλου ίδου άκη"),
}
# Calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "accented": "àâäçéèêëîïôöùûüñ",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
PLAIN = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}'’]{1,30}"
NAME = rf"{PLAIN}(?:-\p{{Lu}}\p{{Ll}}{{1,30}})?"
PARTICLES = r"(?:(?:von|van|zu|der|den|de|del|della|di|da|du) ){0,2}"
GIVEN = "|".join(n for names in NAMES.values() for n in names)
CAPITALS = GIVEN.upper()
INITIALS = r"(?:\p{Lu}\. ?){0,3}"
#: Names in scripts without capitals, after words that introduce them.
UNCASED = r"(?=[\p{IsHan}\p{IsArabic}])(?:(?<=我叫|我的名字是|姓名：|姓名:|名前は|氏名：|氏名:)\p{IsHan}{2,4}|(?<=اسمي |الاسم: )\p{IsArabic}{2,20} \p{IsArabic}{2,20})"
TITLE = "|".join(TITLES)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}+\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}_\-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[0-9a-fA-F]{0,31}[0-9])(?=[0-9a-fA-F]{0,31}[a-fA-F])[0-9a-fA-F]{32,128})(?![\p{L}\p{N}_\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,36}[0-9])(?=[0-9A-Fa-f:]{0,36}[0-9A-Fa-f]{3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "card": r"(?<![\p{L}\p{N}.\-])\d{4}(?:[ \-]?)(?:\d{4}(?:[ \-]?)\d{4}(?:[ \-]?)(?:\d{4}(?:[ \-]?\d{3})?|\d{1,3})|\d{6}(?:[ \-]?)\d{5})(?![\p{L}\p{N}\-])",
    "ssn": r"(?<![\p{L}\p{N}.\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "phone": (
        r"(?<![\p{L}\p{N}+.])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)[ .\-]?|\d{1,4}[ .\-])(?:\d{2,4}[ .\-]){0,3}\d{2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+.])\+\d{8,15}(?![\p{L}\p{N}])"
        r"|(?<![\p{L}\p{N}+.])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+.\-/])[2-9]\d{2}([ .\-])[2-9]\d{2}\1\d{4}(?![\p{L}\p{N}\-])"
        r"|(?<![\p{L}\p{N}+.\-/])0\d{2}[ .\-]\d{4}[ .\-]\d{4}(?![\p{L}\p{N}\-])|(?<![\p{L}\p{N}+.\-/])0\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\p{L}\p{N}\-])"
        r"|(?<![\p{L}\p{N}+.\-/])0\d(?:[ .\-]\d{2}){4}(?![\p{L}\p{N}\-])|(?<![\p{L}\p{N}+.\-/])0[1-9]\d{1,3}[ /\-]\d{6,8}(?![\p{L}\p{N}\-])"
    ),
    "person": (
        rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{TITLE})\.? )?(?:{GIVEN}) {INITIALS}{PARTICLES}{NAME}|(?:{TITLE})\.? {INITIALS}(?:{PLAIN} {INITIALS})?{PARTICLES}{NAME}"
        rf"|(?<=(?:{'|'.join(INTRODUCTIONS)}) ){PLAIN} {INITIALS}{PARTICLES}{NAME}|(?:(?:{TITLE.upper()})\.? )?(?:{CAPITALS}) {INITIALS}\p{{Lu}}[\p{{Lu}}'’]{{1,30}}(?:-\p{{Lu}}{{2,30}})?)(?![\p{{L}}\p{{N}}])"
    ),
}
PATTERNS["phone"] = PATTERNS["phone"].replace("([ .\\-])", "(?<sep>[ .\\-])").replace("\\1", "\\k<sep>")  # by name: patterns are joined
#: What an entity begins with: tested first, so that most places of a text cost one look.
BEGINNINGS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])(?=[\p{L}\p{N}._%+\-]++@)", "secret": r"(?<![\p{L}\p{N}_\-])(?=[A-Za-z0-9_\-]{19})", "iban": r"(?=[A-Z]{2}\d)", "ipv6": "(?=[0-9A-Fa-f]{1,4}:)", "card": r"(?=\d{4})", "ssn": r"(?=\d{3}-)",
    "ip": r"(?=\d{1,3}\.)", "phone": r"(?=[\d+(])", "person": r"(?=\p{Lu})",
}
START = r"(?<![\p{L}\p{N}])(?=[\d+(\p{Lu}]|[\p{L}\p{N}_\-]{19}|[\p{L}\p{N}._%+\-]*+@|[0-9A-Fa-f]{1,4}:)"
ANY = START + "(?:" + "|".join(f"(?:{BEGINNINGS[k]}(?:{p}))" for k, p in PATTERNS.items()) + ")|" + UNCASED
DIGIT_KINDS = ("card", "ssn", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, doubling every other digit from the right from place ``doubled`` (0-based)."""
    spots = F.sequence(F.lit(0), F.length(digits) - 1)

    def one(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled, (2 * d) % 10 + F.floor(2 * d / 10).cast("int")).otherwise(d)

    return F.aggregate(F.transform(spots, one), F.lit(0), lambda a, x: a + x)


def kind_of(value: Column) -> Column:
    """The entity's kind, or null for a look-alike that fails its check."""
    digits = _digits(value)
    octets = F.forall(F.split(value, r"\."), lambda x: x.try_cast("int") <= 255)
    issuer = digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3|6)")
    is_ = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(value.contains("@"), "email")
        .when(is_("ipv6"), "ipv6")
        .when(is_("phone") & ~value.rlike(r"^[+(]"), "phone")
        .when(value.rlike(r"^\d[\d \-]*$") & F.length(digits).between(13, 19), F.when(issuer & (_luhn_sum(digits, 1) % 10 == 0), "card"))
        .when(is_("ssn"), "ssn")
        .when(is_("ip"), F.when(octets, "ip"))
        .when(value.rlike(r"^[+(]"), F.when((F.length(digits) >= 7) & (F.length(digits) <= 16), "phone"))
        .when(is_("secret"), "secret")
        .when(is_("iban"), "iban")
        .when(value.rlike(r"^[\p{Lu}\p{IsHan}\p{IsArabic}]"), "person")
    )


def _surname(value: Column) -> Column:
    """The last word, a double name whole; names in scripts without capitals are one."""
    return F.when(value.rlike(r"^[\p{IsHan}\p{IsArabic}]"), value).otherwise(F.regexp_extract(value, r"([^ .]+)$", 1))


def _capitals(value: Column) -> Column:
    return value.rlike(r"^\p{Lu}[\p{Lu}'’.\- ]+$")


def _front(value: Column) -> Column:
    """The words before a surname."""
    return F.split(F.left(value, F.length(value) - F.length(_surname(value))), "(?<=[ .])(?=[^ .])")


def _is_given(word: Column) -> Column:
    """Whether a word of a name is neither a title, an initial nor a particle."""
    return word.rlike(r"^\p{Lu}[\p{L}'’]+ ?$") & ~F.rtrim(F.replace(word, F.lit("."), F.lit(""))).isin(*TITLES, *[t.upper() for t in TITLES])


def given_names(value: Column) -> Column:
    """The given names in a person's mention."""
    return F.transform(F.filter(_front(value), _is_given), lambda w: F.rtrim(w))


def normal_of(kind: Column, value: Column) -> Column:
    """The form under which mentions of one entity are equal."""
    return (
        F.when(kind.isin(*DIGIT_KINDS), _digits(value))
        .when(kind == "person", F.lower(_surname(value)))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "secret", value)
        .otherwise(F.lower(value))
    )


def _stream(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """128 hex digits from the key, the entity and the draw."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string")), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, b: Column) -> Column:
    """A letter of the same script and case."""

    def pick(letters: str) -> Column:
        found = F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))
        return F.when(c.rlike(r"^\p{Lu}$"), F.upper(found)).otherwise(found)

    return (
        F.when(c.rlike("^[a-zA-Z]$"), pick(LETTERS["latin"]))
        .when(c.rlike(r"^\p{IsCyrillic}$"), pick(LETTERS["cyrillic"]))
        .when(c.rlike(r"^\p{IsGreek}$"), pick(LETTERS["greek"]))
        .when(c.rlike(r"^\p{IsLatin}$"), pick(LETTERS["accented"]))
        .otherwise(c)
    )


def _mapped(value: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter and digit by one of its kind; hexadecimal values stay so."""

    def one(c, i):
        b = _byte(stream, i)
        letter = _letter(c, b)
        if hexadecimal is not None:
            hexed = F.substring(F.lit("abcdef"), b % 6 + 1, F.lit(1))
            letter = F.when(hexadecimal & c.rlike("^[a-f]$"), hexed).when(hexadecimal & c.rlike("^[A-F]$"), F.upper(hexed)).otherwise(letter)
        return F.when(c.rlike("^[0-9]$"), (b % 10).cast("string")).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _country_digits(value: Column, digits: Column) -> Column:
    """How many digits of a phone number are its country's code, which stays."""
    return F.when(~value.startswith("+"), 0).when(digits.rlike("^[17]"), 1).when(F.left(digits, F.lit(2)).isin(*TWO_DIGITS), 2).otherwise(3)


def _new_digits(kind: Column, value: Column, digits: Column, stream: Column) -> Column:
    """As many digits: a first zero stays one and others become none, a country's code stays, and a card
    keeps its issuer (the first four) and ends in its check digit."""
    first = F.when(digits.startswith("0"), 0).otherwise(_byte(stream, F.lit(0)) % 9 + 1)
    drawn = F.array_join(
        F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.when(i == 0, first).otherwise(_byte(stream, i) % 10).cast("string")), ""
    )
    body = F.concat(F.left(digits, F.lit(4)), F.substring(drawn, F.lit(5), F.length(digits) - 5))
    card = let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
    phone = let(_country_digits(value, digits), lambda n: F.concat(F.left(digits, n), F.substring(drawn, n + 1, F.length(digits))))
    return F.when(kind == "card", card).when(kind == "phone", phone).otherwise(drawn)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(a, c):
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(a["out"], F.when(is_digit, F.substring(digits, a["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (a["k"] + is_digit.cast("int")).alias("k")
        )

    return F.aggregate(F.split(value, ""), start, step, lambda a: a["out"])


def _listed(value: Column, key: str) -> Column:
    """A listed given name becomes the next of its script and gender in an order that the key draws:
    distinct names stay distinct, none stays itself, and one known pair tells no other. Null for others."""
    out = F.lit(None).cast("string")
    for (script, gender), names in NAMES.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{script}|{gender}|{n}".encode()).digest())
        at = F.array_position(F.array(*map(F.lit, order)), value)
        out = F.when(value.isin(*order), F.get(F.array(*map(F.lit, order[1:] + order[:1])), (at - 1).cast("int"))).otherwise(out)
    return out


def given_surrogate(value: Column, attempt: Column, key: str) -> Column:
    """A given name for one: from its list, or made up in its script with an ending of its kind."""
    word = F.when(_capitals(value), F.initcap(F.lower(value))).otherwise(value)

    def made(stream: Column) -> Column:
        pick = lambda options, k: F.get(F.array(*map(F.lit, options.split())), (_byte(stream, F.lit(k)) % len(options.split())).cast("int"))

        def of(script: str) -> Column:
            begin, middle, *_ = SURNAMES[script]
            man, woman = GIVEN_ENDS[script]
            return F.concat(pick(begin, 0), pick(middle, 1), F.when(word.rlike("(?:a|а|я|η|α)$"), pick(woman, 2)).otherwise(pick(man, 2)))

        return F.when(word.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin"))

    found = F.coalesce(_listed(word, key), let(_stream(key, F.lit("given"), F.lower(value), attempt), made))
    return F.when(_capitals(value), F.upper(found)).otherwise(found)


def _made_up(value: Column, stream: Column) -> Column:
    """A surname of the value's script: a beginning, middles drawn by their number from the stream, an ending,
    a woman's where the value has one. Parts of a double name are made up one by one."""

    def part(script: str, i: Column, word: Column) -> Column:
        begin, middle, *ends = ([*map(F.lit, x.split())] for x in SURNAMES[script])
        pick = lambda options, k: F.get(F.array(*options), (_byte(stream, 8 * i + k) % len(options)).cast("int"))
        end = pick(ends[0], 5)
        if len(ends) > 1:
            end = F.when(word.rlike("(?:а|ая|ου|η)$"), pick(ends[1], 5)).otherwise(end)
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when((k == 1) | (_byte(stream, 8 * i + k + 5) % 2 == 0), pick(middle, k)).otherwise("")), "")
        return F.concat(pick(begin, F.lit(0)), more, end)

    def uncased(word: Column, letters: str) -> Column:
        pick = lambda c, k: F.when(c == " ", c).otherwise(F.substring(F.lit(letters), _byte(stream, k) % len(letters) + 1, F.lit(1)))
        return F.array_join(F.transform(F.split(word, ""), pick), "")

    def one(word: Column, i: Column) -> Column:
        cased = F.when(word.rlike(r"^\p{IsHan}"), uncased(word, HAN)).when(word.rlike(r"^\p{IsArabic}"), uncased(word, ARABIC))
        return cased.when(word.rlike(r"^\p{IsCyrillic}"), part("cyrillic", i, word)).when(word.rlike(r"^\p{IsGreek}"), part("greek", i, word)).otherwise(part("latin", i, word))

    found = F.array_join(F.transform(F.split(value, "-"), one), "-")
    return F.when(_capitals(value), F.upper(found)).otherwise(found)


def _email(value: Column, stream: Column) -> Column:
    end = F.regexp_extract(value, r"(\.\p{L}{2,24})$", 1)
    return F.concat(_mapped(F.left(value, F.length(value) - F.length(end)), stream), end)


def _address(stream: Column) -> Column:
    return F.concat_ws(".", (_byte(stream, F.lit(0)) % 223 + 1).cast("string"), *[_byte(stream, F.lit(i)).cast("string") for i in (1, 2, 3)])


def surrogate(kind: Column, value: Column, attempt: Column, key: str, given=lambda word: F.lit(0)) -> Column:
    """The replacement of one mention; ``given`` tells the draw of a given name in it."""
    normal = normal_of(kind, value)

    def build(stream):
        digits = _digits(value)
        hexadecimal = value.rlike("^[0-9a-fA-F]+$")
        last = _surname(value)

        def word(w: Column, i: Column) -> Column:
            name = F.rtrim(w)
            initial = F.concat(_letter(F.left(w, F.lit(1)), _byte(stream, i + 40)), F.substring(w, F.lit(2), F.length(w)))
            return F.when(_is_given(w), F.concat(given_surrogate(name, given(name), key), F.substring(w, F.length(name) + 1, F.length(w)))).when(w.rlike(r"^\p{Lu}\. ?$"), initial).otherwise(w)

        words = F.transform(_front(value), word)
        return (
            F.when(kind == "email", _email(value, stream))
            .when(kind.isin(*DIGIT_KINDS), _refilled(value, _new_digits(kind, value, digits, stream)))
            .when(kind == "ip", _address(stream))
            .when(kind == "ipv6", _mapped(value, stream, F.lit(True)))
            .when(kind == "person", F.concat(F.array_join(words, ""), _made_up(last, stream)))
            .when(kind == "given", given_surrogate(value, attempt, key))
            .when(kind == "iban", _iban(value, stream))
            .otherwise(_mapped(value, stream, hexadecimal))
        )

    return let(_stream(key, kind, normal, attempt), build)


def _mod97(text: Column) -> Column:
    """The remainder of an account number's digits, letters counting from 10, taken character by character."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban(value: Column, stream: Column) -> Column:
    """The country, check digits that fit, and letters and digits numbered without the spaces that mentions may differ in."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    country = F.left(value, F.lit(2))
    drawn = _mapped(F.substring(packed, F.lit(5), F.length(value)), stream)
    whole = let(drawn, lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    rest = F.split(F.substring(value, F.lit(3), F.length(value)), "")

    def spaced(new: Column) -> Column:
        step = lambda a, c: F.struct(F.concat(a["out"], F.when(c == " ", c).otherwise(F.substring(new, a["k"] + 1, F.lit(1)))).alias("out"), (a["k"] + (c != " ").cast("int")).alias("k"))
        return F.aggregate(rest, start, step, lambda a: a["out"])

    return F.concat(country, let(whole, spaced))


def _found(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct ``kind, normal`` of all texts; given names that are on no list are a kind of their own."""
    rows = docs.select(F.explode(F.array_distinct(_found(F.col("text")))).alias("value")).withColumn("kind", kind_of(F.col("value"))).filter("kind IS NOT NULL")
    return rows.select(F.explode(_named(F.col("kind"), F.col("value"))).alias("e")).select("e.kind", "e.normal").distinct()


def _named(kind: Column, value: Column) -> Column:
    """The entities of a mention: itself and a person's given names that are on no list."""
    own = F.array(F.struct(kind.alias("kind"), normal_of(kind, value).alias("normal")))
    listed = [n for names in NAMES.values() for n in names]
    others = F.filter(given_names(value), lambda w: ~F.initcap(F.lower(w)).isin(*listed) & ~w.isin(*listed))
    more = F.transform(others, lambda w: F.struct(F.lit("given").alias("kind"), F.lower(w).alias("normal")))
    return F.when(kind == "person", F.concat(own, more)).otherwise(own)


def draws(found: DataFrame, key: str, rounds: int = 40) -> DataFrame | None:
    """``kind, normal, attempt`` of the entities whose first draw collided, or None.

    A round is one grouped count over entities and surrogates. Of entities with one
    surrogate the least keeps it; one that meets a real entity is always drawn again.
    """
    now = found.withColumn("attempt", F.lit(0))
    for n in range(rounds):
        # the surrogate of a normal form is the normal form of a mention's surrogate
        shape = F.when(F.col("kind").isin("person", "given"), F.initcap("normal")).otherwise(F.col("normal"))
        shown = surrogate(F.col("kind"), shape, F.col("attempt"), key)
        drawn = now.withColumn("s", F.when(F.col("kind").isin("person", "given"), F.lower(shown)).otherwise(normal_of(F.col("kind"), shown)))
        drawn = staged(drawn, "draws")
        meet = drawn.select("kind", "s", F.lit(0).alias("real"), "normal").unionByName(drawn.select("kind", F.col("normal").alias("s"), F.lit(1).alias("real"), F.lit(None).cast("string").alias("normal")))
        meet = meet.groupBy("kind", "s").agg(F.count("*").alias("n"), F.max("real").alias("real"), F.min("normal").alias("least")).filter("n > 1 AND least IS NOT NULL")
        meet = staged(meet, "collisions")
        if not meet.limit(1).count():
            return drawn.filter("attempt > 0").select("kind", "normal", "attempt") if n else None
        lost = drawn.join(meet, ["kind", "s"], "left").withColumn("lost", F.coalesce((F.col("real") == 1) | (F.col("normal") != F.col("least")), F.lit(False)))
        now = lost.select("kind", "normal", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def _bare(pieces: Column, known: Column, attempt, given, key: str) -> Column:
    """Text between mentions, in which the words of names that a text's persons have introduced (``known``:
    their mentions) are replaced too: as whole words, capitalised or in capitals as well."""
    variants = lambda names: F.array_distinct(F.concat(names, F.transform(names, F.upper), F.transform(names, lambda n: F.when(_capitals(n), F.initcap(F.lower(n))).otherwise(n))))
    last = variants(F.transform(known, _surname))
    first = variants(F.filter(F.flatten(F.transform(known, given_names)), lambda w: F.length(w) >= 3))
    cased, whole = lambda n: ~n.rlike(r"^\p{IsHan}"), lambda n: n.rlike(r"^\p{IsHan}")
    quoted = lambda names: F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")

    def replaced(names: Column) -> Column:
        some = F.filter(F.concat(names["last"], names["first"]), cased)
        worded = F.when(F.size(some) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}@._\-])(?:"), quoted(some), F.lit(r")(?![\p{L}\p{N}@_])")))
        han = F.filter(names["last"], whole)
        pattern = F.concat_ws("|", worded, F.when(F.size(han) > 0, quoted(han)))

        def filled(at: Column) -> Column:
            def one(p: Column) -> Column:
                found = F.regexp_extract_all(p, at, F.lit(0))
                new = F.transform(found, lambda v: F.when(F.array_contains(names["last"], v), surrogate(F.lit("person"), v, attempt(v), key)).otherwise(given_surrogate(v, given(v), key)))
                return F.array_join(F.zip_with(F.split(p, at, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

            return F.transform(pieces, one)

        return let(pattern, filled)

    return F.when(F.size(known) > 0, let(F.struct(last.alias("last"), first.alias("first")), replaced)).otherwise(pieces)


def anonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced, ``_n_entities`` (mentions replaced) and ``_kinds``; where ``docs`` has
    a column of such a name, the added one has an underscore more.

    Whoever knows the key can draw the surrogates again, so there is none by default: it is given, or
    the session's ``spark.tallgrass.surrogates.key``. Every row stays, with its other columns; null
    text stays null; equal mentions get equal surrogates in every row, repeated or not; a text
    without entities is unchanged byte for byte; an empty table stays empty.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get("spark.tallgrass.surrogates.key", None)
    if not key:
        raise ValueError("surrogates need a key")
    again = draws(entities(docs), key)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("values", _found(F.col("text")))
    if again is None:
        rows = rows.withColumn("draws", F.lit(None).cast("map<string,int>"))
    else:
        # texts with redrawn entities get them as a map, by a digest of the text: a map holds one text's entities
        hits = docs.select(text_key(F.col("text")).alias("th"), F.explode(F.array_distinct(_found(F.col("text")))).alias("v")).withColumn("kind", kind_of(F.col("v")))
        hits = hits.filter("kind IS NOT NULL").select("th", F.explode(_named(F.col("kind"), F.col("v"))).alias("e")).select("th", "e.*").distinct().join(again, ["kind", "normal"])
        maps = hits.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "normal"), "attempt"))).alias("draws"))
        rows = rows.withColumn("th", text_key(F.col("text"))).join(maps, "th", "left")
    rows = rows.withColumn("named", F.transform("values", lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))))
    attempt = lambda k, v: F.coalesce(F.element_at("draws", F.concat_ws(":", k, normal_of(k, v))), F.lit(0))
    given = lambda w: F.coalesce(F.element_at("draws", F.concat(F.lit("given:"), F.lower(w))), F.lit(0))
    replaced = F.transform("named", lambda x: F.when(x["k"].isNull(), x["v"]).otherwise(surrogate(x["k"], x["v"], attempt(x["k"], x["v"]), key, given)))
    persons = F.transform(F.filter("named", lambda x: x["k"] == "person"), lambda x: x["v"])
    between = _bare(F.split(F.col("text"), ANY, -1), persons, lambda v: attempt(F.lit("person"), v), given, key)
    text = F.array_join(F.zip_with(between, F.concat(replaced, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    known = F.filter("named", lambda x: x["k"].isNotNull())
    rows = rows.withColumn("n", F.coalesce(F.size(known), F.lit(0))).withColumn("kinds", F.array_sort(F.array_distinct(F.transform(known, lambda x: x["k"]))))
    n, kinds = added(docs.columns, "_n_entities", "_kinds")
    new = F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text")
    return rows.select(*[new if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], F.col("n").alias(n), F.col("kinds").alias(kinds))
