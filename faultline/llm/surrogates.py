"""Personal data replaced by keyed surrogates, with built-in functions only.

One pattern finds e-mail addresses, bank accounts (IBAN), secrets (long tokens with a
digit), phone numbers, IPv4 and IPv6 addresses, long numbers (cards among them) and
titled names: one or more titles, initials, and one or two names in any script. After a
title in lower case with a full stop, names in lower case count, but for COMMON words.
Each entity is normalised (addresses and names in lower case, names without their
title, numbers as digits), and the normal form goes through a keyed permutation of
its own format, so one entity gets one surrogate in every document and spelling
(coreference), and different entities of a format get different ones by construction.

The permutation (`permuted`) sees a form as symbols, each of a class of its own size
(digits, vowels, letters of one script and case, octets of one length). The last
symbol moves by 1 to n - 1 places, by a hash of key and rest; every other one moves by
a hash of key, the moved last symbol and the symbols before it. That can be undone
from the result, so it is a permutation, and no form stays as it is. Of each type:

* letters stay in script and case, digits are digits, other characters stay; a
  secret's letters a-f and g-z stay apart, so one of hexadecimal digits remains one;
* a phone number with a plus sign keeps its country code, an address its top-level
  domain, and equal domains stay equal; a number is the same with brackets and without;
* a bank account keeps its country, and its check digits are right or wrong as they were;
* the octets of an IPv4 address stay in range and length;
* a number that passes the Luhn check still passes it, another one still fails it;
* a name keeps its titles and is told apart without them and without initials, which
  become others. Its surname is permuted by vowels and consonants, alike with
  and without a given name. A given name becomes a listed one of its gender and script,
  never itself, and, after a hyphen, its own permutation. Its gender is that of the
  first titles that it stands with anywhere; under titles of both, it is neutral.

Collision check: over the distinct entities of the whole table, a surrogate that is
some entity's real form, or that two entities share, moves to another attempt (another
permutation), until none is left. A format so full that some entities find no free
form in `max_rounds` attempts goes back to its first permutation as a whole: surrogates are
distinct there by construction, but may be other entities' real forms. Only entities
with attempts beyond the first, and given names whose gender other texts decide,
have to be sent back to their documents; where there are none, that join is left out.

Nulls: a null text stays null without entities. Rows are changed one by one, by
their text alone; repeated rows change alike and null doc_ids matter nothing. A very
long text is a row like any other. Other columns stay as they are, whatever their
names; one called like a column of the result gives way to it. An empty table gives no
rows. Characters beyond the Basic Multilingual Plane stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.checkpoints import cut
from faultline.llm.columns import set_aside

#: Titles by gender.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Don", "Господин", "Κύριος", "السيد", "מר"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "Госпожа", "Κυρία", "السيدة", "גברת"]
NEUTRAL = ["Dr", "Prof", "Mx"]
#: Given names by gender and script.
NAMES = {
    ("male", "latin"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Max", "Noah", "Oscar", "Paul"],
    ("female", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("neutral", "latin"): ["Alex", "Blake", "Casey", "Dana", "Eden", "Frances", "Gale", "Harper", "Indigo", "Jules", "Kim", "Lee", "Morgan", "Noel", "Quinn", "Robin"],
    ("male", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    ("female", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Ева", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара"],
    ("neutral", "cyrillic"): ["Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Миша", "Лёша"],
    ("male", "greek"): ["Αλέξης", "Βασίλης", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
    ("female", "greek"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    ("neutral", "greek"): ["Άρτεμις", "Μελίνα", "Φίλις", "Χάρις"],
}
SCRIPTS = [("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", r"\p{IsLatin}")]
#: Vowels and consonants, for names.
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
#: First and last code point of each class of characters.
RANGES = [
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xDF, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x430, 0x44F), (0x450, 0x45F), (0x410, 0x42F), (0x400, 0x40F),
    (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3AC, 0x3AF), (0x3CC, 0x3CE), (0x561, 0x586), (0x531, 0x556), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A),
    (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]
#: For secrets the letters of hexadecimal digits are classes of their own.
SECRET_RANGES = [(0x30, 0x39), (0x61, 0x66), (0x67, 0x7A), (0x41, 0x46), (0x47, 0x5A)]
#: Country codes of one and of two digits; all others have three.
SHORT_COUNTRIES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: Titles that may stand in lower case, with a full stop, and words after them that aren't names.
LOWER_TITLES = ["mr", "mrs", "ms", "dr", "prof"]
COMMON = "a about after also an and are as asked at be been but by called came can could did do for from gave got had has have he her here his how i in is it its knows made met my not of on or our said saw says she so that the their them then there they this to told took was we went were what when where which who will with would wrote you your der die das und ist war hat le la les et est de du el los y es".split()

_BLANK = "[ \\u00A0]"
_TITLES = "|".join(sorted({w for t in (*MALE, *FEMALE, *NEUTRAL) for w in (t, t.upper())}, key=lambda w: (-len(w), w)))
_TITLE = rf"(?:(?:{_TITLES})(?:\.{_BLANK}*|{_BLANK}+))"
_LOWER_TITLE = rf"(?:(?:{'|'.join(LOWER_TITLES)})\.{_BLANK}*)"
#: What stands in front of a name: titles, then initials.
_BEFORE = rf"{_TITLE}+(?:\p{{Lu}}\.{_BLANK}*)*+"
_BEFORE_LOWER = rf"{_LOWER_TITLE}+(?:\p{{Ll}}\.{_BLANK}*)*+"
#: A capitalised name, or one of a script without cases.
_CAPITAL = r"\p{Lu}[\p{L}\p{M}'’-]+"
_CASELESS = r"\p{IsHan}{2,4}|\p{IsHangul}{2,4}|[\p{IsKatakana}\p{IsHiragana}ー・]{2,}|[\p{L}\p{M}&&[^\p{Lu}\p{Ll}\p{Lt}\p{IsHan}\p{IsHangul}\p{IsKatakana}\p{IsHiragana}]]{2,}"
_NAME = rf"(?!{_TITLE})(?:{_CAPITAL}|{_CASELESS})"
_LOWER_NAME = rf"(?!(?:{'|'.join(COMMON)})(?![\p{{L}}\p{{M}}]))\p{{Ll}}[\p{{Ll}}\p{{M}}'’-]+"
_LOCAL = r"[\p{L}\p{N}._%+\-]"
EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++"
SECRET = r"(?<![\p{L}\p{N}_\-])(?=[A-Za-z_\-]*+[0-9])(?=[0-9_\-]*+[A-Za-z])[A-Za-z0-9_\-]{20,}+(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
NUMBER = r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){6,18}(?![\p{L}\p{N}]|[ \-]\d)|(?<![\p{L}\p{N}])\d{7,}+(?![\p{L}\p{N}])"
IBAN = rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}\d{{2}}(?:{_BLANK}?[A-Z0-9]{{4}}){{2,7}}(?:{_BLANK}?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_BEFORE}{_NAME}(?: {_NAME})?|{_BEFORE_LOWER}{_LOWER_NAME}(?: {_LOWER_NAME})?)"
PATTERN = "|".join([EMAIL, IBAN, SECRET, PHONE, IP6, IP, NUMBER, NAME])
#: Texts without any of these have no entity; it spares them the long pattern.
HINT = rf"[@0-9]|::|[A-Fa-f]:[A-Fa-f]|{_TITLE}|{_LOWER_TITLE}"
#: Put around entities; where texts have it, it is written as MASK and a letter meanwhile.
MARK, MASK = "\uFDD0", "\uFDD1"


def let(value: Column, use: Callable) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def kind(v: Column) -> Column:
    return (
        F.when(v.contains("@"), "email")
        .when(v.rlike(rf"^(?:{_TITLE}|{_LOWER_TITLE})"), "name")
        .when(v.rlike(rf"^{IBAN}$"), "iban")
        .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(v.rlike("^[0-9A-Fa-f:]+$") & v.contains(":"), "ip6")
        .when(v.rlike(r"^[A-Za-z0-9_\-]{20,}$") & v.rlike("[A-Za-z]"), "secret")
        .when(v.startswith("+"), "phone")
        .otherwise("number")
    )


def normal(v: Column) -> Column:
    k = kind(v)
    digits = F.concat(F.when(v.startswith("+"), "+").otherwise(""), F.regexp_replace(v, "[^0-9]", ""))
    return F.when(k.isin("email", "ip6"), F.lower(v)).when(k == "name", F.lower(_untitled(v))).when(k == "iban", F.regexp_replace(v, _BLANK, "")).when(k.isin("phone", "number"), digits).otherwise(v)


def form(n: Column) -> Column:
    """The format of a normal form, or a coarser one: a permutation never leaves it."""
    out = F.regexp_replace(n, r"\p{N}", "9")
    for pattern, sign in ((r"\p{Ll}", "a"), (r"\p{Lu}", "A"), (r"\p{Lo}", "o")):
        out = F.regexp_replace(out, pattern, sign)
    return out


def _untitled(v: Column) -> Column:
    """A name without titles and initials."""
    return F.regexp_replace(v, rf"^(?:{_BEFORE}|{_BEFORE_LOWER})", "")


def gender(v: Column) -> Column:
    """That of the first title that tells one."""

    def spelled(words):
        return "|".join([*words, *(t.upper() for t in words), *(t for t in LOWER_TITLES if t.capitalize() in words)])

    def any_of(words):
        return v.rlike(rf"^(?:(?:{spelled(NEUTRAL)})(?:\.{_BLANK}*|{_BLANK}+))*(?:{spelled(words)})(?:\.|{_BLANK})")

    return F.when(any_of(MALE), "male").when(any_of(FEMALE), "female").otherwise("neutral")


def given(v: Column) -> Column:
    """A name's given name in lower case; null where it has none."""
    rest = F.lower(_untitled(v))
    return F.when(rest.contains(" "), F.substring_index(rest, " ", 1))


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def _symbols(text: Column, mode: Column) -> Column:
    """A form as symbols: their text, place, the first place and size of their class (a size of 1: they stay), and whether the place is one in SOUNDS."""

    def classes(ranges) -> Column:
        return F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in ranges])

    ends = [sum(map(len, SOUNDS[:k])) for k in range(len(SOUNDS) + 1)]
    sounds = classes([(a + 1, b) for a, b in zip(ends, ends[1:])])  # noqa: B905

    def one(c: Column) -> Column:
        def placed(b: Column) -> Column:
            listed = (mode == "name") & (b["nth"] > 0)
            table = F.when(listed, sounds).when(mode == "hex", classes(SECRET_RANGES)).otherwise(classes(RANGES))
            at = F.when(listed, b["nth"]).otherwise(b["code"])
            # letters of other scripts move among their 16 neighbours
            other = c.rlike(r"^\p{L}$") & (b["code"] < 0xD800)
            low = F.when(other, at - F.pmod(at, F.lit(16))).otherwise(at)
            own = F.coalesce(F.get(F.filter(table, lambda r: (r["low"] <= at) & (at <= r["high"])), 0), F.struct(low.alias("low"), F.when(other, low + 15).otherwise(low).alias("high")))
            return F.struct(c.alias("c"), at.alias("at"), own["low"].alias("low"), (own["high"] - own["low"] + 1).alias("n"), listed.alias("listed"))

        return let(F.struct(F.instr(F.lit("".join(SOUNDS)), c).cast("long").alias("nth"), F.ascii(c).cast("long").alias("code")), placed)

    def octet(o: Column) -> Column:
        n, wide, padded = o.cast("long"), F.length(o), o.startswith("0")
        low = F.when(wide == 3, 100).when((wide == 2) & ~padded, 10).when((wide == 1) & (n > 0), 1).otherwise(0)
        size = F.when(wide == 3, 156).when((wide == 2) & ~padded, 90).when(wide == 2, 10).when(n > 0, 9).otherwise(1)
        return F.struct(o.alias("c"), n.alias("at"), low.cast("long").alias("low"), size.cast("long").alias("n"), F.lit(False).alias("listed"))

    return F.when(mode == "ip", F.transform(F.split(text, r"\."), octet)).otherwise(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one))


def permuted(text: Column, tag: Column, mode: Column) -> Column:
    """The form that the keyed permutation `tag` makes of a form. mode: text, name, hex or ip."""

    def moved(x: Column, by: Column) -> Column:
        at = x["low"] + F.pmod(x["at"] - x["low"] + by, x["n"])
        letter = F.decode(F.unhex(F.lpad(F.hex(at), 4, "0")), "UTF-16BE")
        written = F.when(mode == "ip", F.lpad(at.cast("string"), F.length(x["c"]), F.lit("0"))).when(x["listed"], F.substring(F.lit("".join(SOUNDS)), at.cast("int"), F.lit(1))).otherwise(letter)
        return F.when(x["n"] > 1, written).otherwise(x["c"])

    def texts(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda x: x["c"]), "\x1f")

    def last_moved(b: Column) -> Column:
        x, rest = F.get(b["s"], b["last"]), F.concat(F.slice(b["s"], F.lit(1), b["last"]), F.slice(b["s"], b["last"] + 2, F.size(b["s"])))
        return F.struct(b["s"].alias("s"), b["last"].alias("last"), F.when(b["last"] >= 0, moved(x, 1 + F.pmod(_hash(tag, F.lit("last"), texts(rest)), x["n"] - 1))).alias("z"))

    def all_moved(b: Column) -> Column:
        return F.transform(b["s"], lambda x, i: F.when(i == b["last"], b["z"]).when(i > b["last"], x["c"]).otherwise(moved(x, _hash(tag, b["z"], texts(F.slice(b["s"], F.lit(1), i))))))

    def bound(s: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(s, lambda x, i: F.when(x["n"] > 1, i))), F.lit(-1))
        return let(let(F.struct(s.alias("s"), last.alias("last")), last_moved), all_moved)

    return let(let(_symbols(text, mode), bound), lambda out: F.when(mode == "ip", F.array_join(out, ".")).otherwise(F.array_join(out, "")))


def _cased(made: Column, v: Column) -> Column:
    """made with capitals where v has them."""
    capital = F.transform(F.split(made, ""), lambda c, i: F.when(v.substr(i + 1, F.lit(1)) != F.lower(v.substr(i + 1, F.lit(1))), F.upper(c)).otherwise(c))
    return F.when((F.length(made) == F.length(v)) & (F.lower(v) != v), F.array_join(capital, "")).otherwise(made)


def _spelled(digits: Column, v: Column) -> Column:
    """v with its digits replaced, one by one, from `digits`."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(v, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")


def _check(body: Column) -> Column:
    """The Luhn check digit of a string of digits."""
    doubled = F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(doubled, F.lit(0), lambda a, b: a + b), F.lit(10)), F.lit(10))


def _listed(word: Column, of: Column, tag: Column) -> Column:
    """A given name of the word's script and the gender, and a hyphen; empty for scripts without a list."""
    script = F
    for name, pattern in SCRIPTS:
        script = script.when(word.rlike(pattern), name)
    lists = F.create_map(*[x for (g, name), names in NAMES.items() for x in (F.lit(f"{g} {name}"), F.array(*map(F.lit, names)))])
    return let(F.filter(F.try_element_at(lists, F.concat(of, F.lit(" "), script)), lambda n: F.lower(n) != word), lambda names: F.coalesce(F.concat(F.get(names, F.pmod(_hash(tag, F.lit("list"), word), F.size(names)).cast("int")), F.lit("-")), F.lit("")))


def _like(made: Column, word: Column) -> Column:
    """made in capitals or small letters if the word is."""
    return F.when(word == F.lower(word), F.lower(made)).when((word == F.upper(word)) & (F.length(word) > 1), F.upper(made)).otherwise(made)


def _initialled(before: Column, tag: Column) -> Column:
    """Titles and initials, with each initial of A to Z moved on by one keyed number of places."""
    by = 1 + F.pmod(_hash(tag, F.lit("initials")), F.lit(25)).cast("int")

    def moved(x: Column, a: str) -> Column:
        return F.concat(F.chr(F.pmod(F.ascii(x) - ord(a) + by, F.lit(26)) + ord(a)), F.substring(x, F.lit(2), F.length(x)))

    pieces = F.regexp_extract_all(before, F.lit(rf"{_TITLE}|{_LOWER_TITLE}|.\.?{_BLANK}*"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^[A-Z]\."), moved(x, "A")).when(x.rlike(r"^[a-z]\."), moved(x, "a")).otherwise(x)), "")


def _mod97(text: Column) -> Column:
    """The number that digits and letters (10 to 35) spell, modulo 97."""
    worth = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(worth, F.lit(0), lambda a, w: F.pmod(a * F.when(w > 9, 100).otherwise(10) + w, F.lit(97)))


def _iban(v: Column, body: Column) -> Column:
    """v with another account, spaced as it was; check digits are off by as much, modulo 97, as they were."""
    bare = F.regexp_replace(v, _BLANK, "")
    country = F.substring(bare, 1, 2)

    def check(account: Column) -> Column:
        return 98 - _mod97(F.concat(account, country, F.lit("00")))

    off = F.substring(bare, 3, 2).cast("int") - check(F.substring(bare, 5, 40))
    made = F.concat(country, F.lpad((2 + F.pmod(check(body) - 2 + off, F.lit(97))).cast("string"), 2, "0"), body)
    nth = lambda i: F.length(F.regexp_replace(F.substring(v, F.lit(1), i + 1), _BLANK, ""))
    return F.array_join(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(_BLANK), c).otherwise(F.substring(made, nth(i), F.lit(1)))), "")


def surrogate(v: Column, key: str, attempt: Column, of: Column) -> Column:
    """The replacement of an entity as it is written in the text. of: a given name's gender."""

    def field(text: Column, part: str, mode: str) -> Column:
        return F.struct(text.alias("text"), F.lit(part).alias("part"), F.lit(mode).alias("mode"))

    def read(b: Column) -> Column:
        """The parts that are permuted, each for itself."""
        low, k, raw = F.lower(b["v"]), b["kind"], F.regexp_replace(b["v"], "[^0-9]", "")
        rest = F.lower(_untitled(b["v"]))
        code = F.when((k != "phone") | ~b["v"].startswith("+"), "").when(raw.rlike(SHORT_COUNTRIES), F.regexp_extract(raw, SHORT_COUNTRIES, 0)).otherwise(F.substring(raw, 1, 3))
        card = (k == "number") & (F.length(raw) >= 12) & (F.length(raw) <= 19)
        fields = (
            F.when(k == "email", F.array(field(F.regexp_extract(low, "^([^@]*)@", 1), "local", "text"), field(F.regexp_extract(low, r"@(.*)(\.[^.]*)$", 1), "domain", "text")))
            .when((k == "name") & rest.contains(" "), F.array(field(F.substring_index(rest, " ", -1), "surname", "name"), field(F.substring_index(rest, " ", 1), "given", "name")))
            .when(k == "name", F.array(field(rest, "surname", "name")))
            .when(k == "ip", F.array(field(b["v"], "", "ip")))
            .when(k == "ip6", F.array(field(low, "", "hex")))
            .when(k == "secret", F.array(field(b["v"], "", "hex")))
            .when(k == "iban", F.array(F.struct(F.substring(F.regexp_replace(b["v"], _BLANK, ""), 5, 40).alias("text"), F.substring(b["v"], 1, 2).alias("part"), F.lit("text").alias("mode"))))
            .when(card, F.array(field(F.substring(raw, F.lit(1), F.length(raw) - 1), "card", "text")))
            .otherwise(F.array(F.struct(F.substring(raw, F.length(code) + 1, F.length(raw)).alias("text"), code.alias("part"), F.lit("text").alias("mode"))))
        )
        made = F.transform(fields, lambda f: permuted(f["text"], F.concat_ws("|", b["tag"], f["part"]), f["mode"]))
        return F.struct(*[b[n].alias(n) for n in ("v", "kind", "tag", "of")], raw.alias("raw"), code.alias("code"), card.alias("card"), made.alias("made"))

    def written(b: Column) -> Column:
        v, k, one, two = b["v"], b["kind"], F.get(b["made"], 0), F.get(b["made"], 1)
        rest = _untitled(v)
        title = _initialled(v.substr(F.lit(1), F.length(v) - F.length(rest)), b["tag"])
        first, last = F.substring_index(rest, " ", 1), F.substring_index(rest, " ", -1)
        # of 12 to 19 digits the last one keeps or, in another way, misses the Luhn check
        off = F.pmod(F.substring(b["raw"], F.length(b["raw"]), F.lit(1)).cast("int") - _check(F.substring(b["raw"], F.lit(1), F.length(b["raw"]) - 1)), F.lit(10))
        ends = F.pmod(_check(one) + F.when(off == 0, 0).otherwise(1 + F.pmod(off - 1 + _hash(b["tag"]), F.lit(9))), F.lit(10)).cast("int").cast("string")
        return (
            F.when(k == "email", _cased(F.concat(one, F.lit("@"), two, F.regexp_extract(F.lower(v), r"(\.[^.]*)$", 1)), v))
            .when((k == "name") & two.isNotNull(), F.concat(title, _like(_listed(F.lower(first), b["of"], b["tag"]), first), _cased(two, first), F.lit(" "), _cased(one, last)))
            .when(k == "name", F.concat(title, _cased(one, rest)))
            .when(k.isin("ip", "secret"), one)
            .when(k == "iban", _iban(v, one))
            .when(k == "ip6", _cased(one, v))
            .otherwise(_spelled(F.concat(b["code"], one, F.when(b["card"], ends).otherwise("")), v))
        )

    tag = F.sha2(F.concat_ws("\x1f", F.lit(key), kind(v), attempt.cast("string")), 256)
    return let(let(F.struct(v.alias("v"), kind(v).alias("kind"), tag.alias("tag"), of.alias("of")), read), written)


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def attempts(known: DataFrame, key: str, max_rounds: int) -> DataFrame:
    """(kind, normal form, attempt) of the entities beyond their first attempt. known: kind, normal, v."""
    real = known.select(F.col("kind").alias("r_kind"), F.col("normal").alias("r_normal"))
    now = known.withColumn("attempt", F.lit(0))
    for done in range(max_rounds + 1):
        # written first: a join's filters on `made` would unfold the long expression several times
        formed = cut(now.withColumn("s__made", surrogate(F.col("v"), key, F.col("attempt"), F.lit("neutral"))))
        made = formed.withColumn("made", normal(F.col("s__made"))).drop("s__made")
        first = made.groupBy(F.col("kind").alias("f_kind"), F.col("made").alias("f_made")).agg(F.count("*").alias("n"), F.min(F.struct("attempt", "normal")).alias("owner")).where("n > 1")
        shared = made.join(first, (F.col("kind") == F.col("f_kind")) & (F.col("made") == F.col("f_made")), "left").join(real, (F.col("kind") == F.col("r_kind")) & (F.col("made") == F.col("r_normal")), "left")
        loses = (F.col("owner").isNotNull() & (F.struct("attempt", "normal") != F.col("owner"))) | F.col("r_kind").isNotNull()
        judged = cut(shared.select("kind", "normal", "v", "attempt", loses.alias("loses")))
        if judged.where("loses").isEmpty():
            break
        if done == max_rounds:
            full = judged.where("loses").select(F.col("kind").alias("x_kind"), form(F.col("normal")).alias("x_form")).distinct()
            now = judged.join(full, (F.col("kind") == F.col("x_kind")) & (form(F.col("normal")) == F.col("x_form")), "left_anti").drop("loses")
        else:
            now = judged.withColumn("attempt", F.col("attempt") + F.col("loses").cast("int")).drop("loses")
    return cut(now.where("attempt > 0").select("kind", "normal", "attempt"))


def genders(spelled: DataFrame) -> DataFrame:
    """(token, of): given names that stand with titles of several genders. spelled: v."""
    names = spelled.where(kind(F.col("v")) == "name").select(given(F.col("v")).alias("token"), gender(F.col("v")).alias("g")).where("token is not null")
    seen = names.groupBy("token").agg(F.max((F.col("g") == "male").cast("int")).alias("m"), F.max((F.col("g") == "female").cast("int")).alias("f"), F.max((F.col("g") == "neutral").cast("int")).alias("u")).where("m + f + u > 1")
    return seen.select("token", F.when(F.col("m") == F.col("f"), "neutral").when(F.col("m") == 1, "male").otherwise("female").alias("of"))


def _pieces(text: Column) -> Column:
    """The text cut into what lies between entities (even places) and entities (odd ones); null where it can't have any."""
    masked = F.when(text.rlike(f"[{MARK}{MASK}]"), F.replace(F.replace(text, F.lit(MASK), F.lit(MASK + "b")), F.lit(MARK), F.lit(MASK + "a"))).otherwise(text)
    return F.when(text.rlike(HINT), F.split(F.regexp_replace(masked, f"({PATTERN})", f"{MARK}$1{MARK}"), MARK, -1))


def _unmasked(text: Column) -> Column:
    return F.when(text.contains(MASK), F.replace(F.replace(text, F.lit(MASK + "a"), F.lit(MARK)), F.lit(MASK + "b"), F.lit(MASK))).otherwise(text)


def replace_entities(docs: DataFrame, key: str, max_rounds: int = 6) -> DataFrame:
    """docs with `clean_text` and `n_entities` added."""
    docs, back = set_aside(docs.drop("clean_text", "n_entities"), lambda name: name.startswith("s__"))
    # the texts' entities: found here, and once more where they are replaced
    spelled = cut(docs.select(F.xxhash64("text").alias("t"), F.explode(F.array_distinct(_found(F.col("text")))).alias("v")))
    known = cut(spelled.groupBy(kind(F.col("v")).alias("kind"), normal(F.col("v")).alias("normal")).agg(F.min("v").alias("v")))  # one spelling stands for each entity
    again, mixed = attempts(known, key, max_rounds), cut(genders(spelled))
    marked = docs.withColumn("s__pieces", _pieces(F.col("text")))
    none = F.lit(None)
    if again.isEmpty() and mixed.isEmpty():
        joined = marked.withColumn("s__tries", none.cast("map<string,int>")).withColumn("s__of", none.cast("map<string,string>"))
    else:
        asked = spelled.select("t", kind(F.col("v")).alias("k"), normal(F.col("v")).alias("m"), given(F.col("v")).alias("g")).distinct()
        tries = asked.join(again, (F.col("k") == F.col("kind")) & (F.col("m") == F.col("normal"))).select("t", F.concat_ws("|", "k", "m").alias("name"), "attempt", none.cast("string").alias("of"))
        sides = asked.where("k = 'name'").join(mixed, F.col("g") == F.col("token")).select("t", F.col("g").alias("name"), none.cast("int").alias("attempt"), "of")
        hit = tries.unionByName(sides).distinct().groupBy(F.col("t").alias("s__t")).agg(
            F.map_from_entries(F.collect_list(F.when(F.col("attempt").isNotNull(), F.struct("name", "attempt")))).alias("s__tries"),
            F.map_from_entries(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("name", "of")))).alias("s__of"),
        )
        joined = marked.withColumn("s__key", F.xxhash64("text")).join(cut(hit), F.col("s__key") == F.col("s__t"), "left")

    def one(v: Column) -> Column:
        tries = F.when(F.col("s__tries").isNotNull(), F.element_at("s__tries", F.concat_ws("|", kind(v), normal(v))))
        of = F.when(F.col("s__of").isNotNull(), F.element_at("s__of", given(v)))
        return surrogate(v, key, F.coalesce(tries, F.lit(0)), F.coalesce(of, gender(v)))

    clean = F.array_join(F.transform("s__pieces", lambda p, i: F.when(i % 2 == 1, one(p)).otherwise(p)), "")
    n = F.coalesce(F.when(F.col("s__pieces").isNotNull(), F.floor(F.size("s__pieces") / 2)), F.lit(0)).cast("long")
    done = joined.withColumns({"s__clean": F.when(F.size("s__pieces") > 1, _unmasked(clean)).otherwise(F.col("text")), "s__n": n})
    return done.select(*back.values(), F.col("s__clean").alias("clean_text"), F.col("s__n").alias("n_entities"))


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key="op3-demonstration-key").select("doc_id", "n_entities", F.col("clean_text").alias("text"))
