"""Personal data replaced by keyed surrogates of the same type and form.

Entities are found by one expression per kind. Repeated parts of the expressions are single
character classes, so the time is linear and the stack flat however long an entity is. An
entity is made of units, mostly one; the words of a name are units of their own, so that
"Frau Anna Schmidt" and "Dr. Schmidt" still share a surname afterwards.

The normal form of a unit (no case, no separators) is hashed with HMAC-SHA256 under `key`, which
the caller must give, and the surrogate is made from that character by character: digits become
digits, letters letters of the same script, so lengths and forms do not change. What identifies
a kind is kept or made right again: a card's network and checksum, an account number's country and
check digits, an address's class, a phone number's country, the prefix of an access key, a mail
address's labels and top-level domain. A given name that is listed gets one of the same gender and script; any
other word of a name keeps its pattern of vowels and consonants and (in alphabets, not in syllables or Han) its
ending, which shows gender. Words of a script without letters in SCRIPTS become Latin.
Each occurrence gets its own case and separators back.

A name is a title and what follows: a surname after listed given names and initials, else up to two
words (one more after a Spanish title, and particles), so that capitalised running text stays. In scripts without
case it is a Han run of two to four characters or up to two other words. IPv6 addresses are one entity
however they are written, and zeros stay zeros where there is room; those that begin with :: and bare prefixes of one
group stay, as they name nobody. A value after one of the words of _SAID is a secret if it is quoted, or has a digit.

Surrogates that two units share, or that are themselves a unit of the corpus, are looked for; all
but one of them get the next attempt, until there is none. The number of attempts is not limited:
words, keys, mail addresses, phone and social security numbers grow by a character when their form is
crowded, addresses go to another range of the same class. Only an address may, past LIFT attempts (when nearly its
whole class occurs in the corpus), be one that occurs; it still stands for one address alone.

Only DataFrame functions are used; texts without an entity are not shuffled at all. Titles stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, partitions, written

#: Given names by gender and script; a surrogate comes from the list of the name it replaces.
NAMES = {
    ("f", "latin"): ["Anna", "Maria", "Julia", "Sofia", "Laura", "Elena", "Clara", "Emma", "Sarah", "Alice", "Marie", "Lucia", "Carmen", "Ingrid", "Hannah", "Camille"],
    ("m", "latin"): ["John", "Peter", "Paul", "Thomas", "Martin", "Carlos", "Pierre", "Hans", "Luis", "David", "James", "Robert", "Michael", "Jean", "Karl", "Miguel"],
    ("f", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Павел", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил"],
}
#: Titles before names.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Señora", "Señorita", "Sr", "Sra", "Srta",
          "Господин", "Госпожа", "Доктор", "г-н", "г-жа", "Κύριος", "Κυρία", "Δρ", "السيد", "السيدة", "الدكتور", "الدكتورة")
#: Titles before names with two surnames, and words inside surnames.
TWO_SURNAMES = ("Señor", "Señora", "Señorita", "Sr", "Sra", "Srta")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "bin", "al")


def _one_of(words) -> str:
    return f"(?:{'|'.join(sorted(words, reverse=True))})"


_TITLE = rf"(?=[MDPHFSГДгΚΔا])(?:{_one_of(TITLES)}\.? ){{1,3}}"
_GIVEN = rf"(?:(?:{_one_of(n for names in NAMES.values() for n in names)}(?:-\p{{Lu}}[\p{{L}}\p{{M}}]*+)?|\p{{Lu}}\.) )"
_CASED = rf"(?:{_one_of(PARTICLES)} ){{0,3}}\p{{Lu}}[\p{{L}}\p{{M}}'’-]*\.?"
_UNCASED = r"(?!\p{IsHan})\p{Lo}[\p{Lo}\p{M}]*"


def _name(surnames: int) -> str:
    return rf"(?:{_GIVEN}{{1,3}}{_CASED}(?: {_CASED}){{0,{surnames - 1}}}|{_CASED}(?: {_CASED}){{0,{surnames}}}|\p{{IsHan}}{{2,4}}|{_UNCASED}(?: {_UNCASED})?)"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: How well-known access keys begin.
_KEY_HEAD = "(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza)"
_SAID = r"(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)"
#: A group of an IPv6 address; first groups of the ranges that are in use (global, unique local, link-local, multicast).
_GROUP, _FIRST = "[0-9A-Fa-f]{1,4}", "(?:[23][0-9A-Fa-f]{3}|[Ff][CDFcdf][0-9A-Fa-f]{2}|[Ff][Ee][89ABab][0-9A-Fa-f])"
#: (kind, what must stand before, expression, what must stand after), asked in this order; all start after no letter or digit.
KINDS = (
    ("mail", "(?<![._%+-])", r"[\p{L}0-9][\p{L}\p{M}0-9._%+-]*+@[\p{L}\p{M}0-9-]++\.[\p{L}\p{M}0-9.-]*[\p{L}\p{M}0-9]", ""),
    ("secret", "", f"(?:[0-9a-fA-F]{{32,}}+|{_KEY_HEAD}[0-9A-Za-z_-]{{16,}}+|eyJ[0-9A-Za-z_-]{{8,}}+\\.[0-9A-Za-z_-]++\\.[0-9A-Za-z_-]++)", "(?![0-9A-Za-z])"),
    ("secret", rf"(?<=[\"'])(?<={_SAID}[\"']? ?[=:] ?[\"'])", r"[0-9A-Za-z][^\s\"']{7,}+", r"(?=[\"'])"),
    ("secret", rf"(?<=[=:] ?)(?<={_SAID}[\"']? ?[=:] ?)(?=[^\s\"'<>,;]*[0-9])", r"[0-9A-Za-z][^\s\"'<>,;]{7,}+", ""),
    ("address", r"(?<!\.)", rf"{_OCTET}(?:\.{_OCTET}){{3}}", r"(?![0-9]|\.[0-9])"),
    ("address6", "(?<!:)", rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|{_FIRST}(?=[:0]*[1-9A-Fa-f])(?::{_GROUP}){{0,6}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)", r"(?![0-9A-Za-z:]|\.[0-9])"),
    ("card", "", "(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})", "(?![0-9])"),
    ("ssn", "(?<!-)", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?![0-9-])"),
    ("phone", "", r"(?:\+(?=(?:[ ()./-]{0,2}[0-9]){8})[0-9]{1,3}(?:[ ./-]?(?:\([0-9]{1,4}\)|[0-9]{1,5})){2,5}|(?:\([0-9]{2,5}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|0[1-9][0-9]{0,3}[ /-][0-9]{5,9})", "(?![0-9])"),
    ("iban", "", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "(?![0-9A-Za-z])"),
    ("name", "", rf"(?:(?={_one_of(TWO_SURNAMES)}\.? ){_TITLE}{_name(2)}|{_TITLE}{_name(1)})", r"(?![\p{L}0-9])"),
)
#: The tests at the front fail at once inside words.
ANY = r"(?<![0-9\p{L}\p{M}])(?=[0-9+(\p{L}])(?:" + "|".join(f"{before}{core}{after}" for _, before, core, after in KINDS) + ")"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR_LOWER, _CYR_UPPER = "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"
#: Per script (as regular expressions name it), vowels and other letters that surrogates are made of, more letters that count as vowels, and whether endings stay.
SCRIPTS = {
    "Latin": ("aeiou", "bcdfghklmnprstvz", "yéèêáàâäëïíóöôúüùë", True),
    "Cyrillic": ("аеиоуюя", "бвгдзклмнпрстфхч", "ыэё", True),
    "Greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋΐΰ", True),
    "Arabic": ("اوي", "بتجحدرسشصعفقكلمنه", "أإآىئؤ", True),
    "Hebrew": ("אוי", "בגדהזחטכלמנסעפצקרשת", "", True),
    "Armenian": ("աեիոու", "բգդզթլխկհմնպռստր", "էըօ", True),
    "Georgian": ("აეიოუ", "ბგდვზთკლმნპრსტფქ", "", True),
    "Devanagari": ("अआइईउएओ", "कखगचजटडतदनपबमरलवशसह", "", False),
    "Thai": ("อ", "กขคงจชดตถทนบปพมยรลวสห", "", False),
    "Hangul": ("아이우오", "가강경김나남동마문민박서성신영윤재정조진최하한현", "", False),
    "Hiragana": ("あいうえお", "かきくけさしすせたちつてなにのはひまみもやゆよらりるわ", "", False),
    "Katakana": ("アイウエオ", "カキクケサシスセタチツテナニノハヒマミモヤユヨラリルワ", "", False),
    "Han": ("", "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹伟芳娜敏静丽强磊军洋勇艳杰娟涛明超兰霞平", "", False),
}
#: Attempts after which a surrogate grows by a character (words, keys and mail addresses; then numbers), and after which an address may be one that occurs.
GROW, GROW_NUMBER, LIFT = 8, 64, 64
#: How country codes begin (fixed values): all that have one or two digits; the others have three.
_COUNTRY = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: First octets whose class depends on the second one.
_TWO = ("100", "169", "172", "192", "198", "203")


def kind_of(entity: Column) -> Column:
    """The first kind whose expression is the whole entity; what only its surroundings give away is a phone number (+) or a secret."""
    found = F.when(entity.startswith("+"), "phone").otherwise("secret")
    for kind, _, core, _ in reversed(KINDS):
        if not core.startswith(r"[0-9A-Za-z][^\s"):
            found = F.when(entity.rlike(rf"\A(?:{core})\z"), kind).otherwise(found)
    return found


def _sides(address: Column) -> tuple[Column, Column]:
    """The groups before and after the :: of an IPv6 address; without one, all are before."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    return groups(F.substring_index(address, "::", 1)), F.when(address.contains("::"), groups(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))


def _expanded(address: Column) -> Column:
    """All groups of an IPv6 address, without zeros before them."""
    before, after = _sides(address)
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(before) - F.size(after), F.lit(0)))
    return F.array_join(F.transform(F.concat(before, zeros, after), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def normal(unit: Column, kind: Column) -> Column:
    """Forms of one unit that only differ in case (mail, names, hexadecimal) or separators (numbers) are one: coreference."""
    return (F.when(kind == "address6", _expanded(F.lower(unit)))
            .when(kind.isin("mail", "name") | (kind == "secret") & unit.rlike(r"\A[0-9a-fA-F]+\z"), F.lower(unit))
            .when(kind.isin("card", "phone", "iban", "ssn"), F.regexp_replace(unit, "[^0-9A-Za-z+]", "")).otherwise(unit))


def hashed(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def stream(kind: Column, norm: Column, attempt: Column, key: bytes) -> Column:
    """64 numbers from 0 to 65535 for a unit and attempt."""
    base = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    digits = F.concat(*(hashed(F.encode(F.concat(F.lit(f"{i}\x1f"), base), "utf-8"), key) for i in range(4)))
    return F.transform(F.regexp_extract_all(digits, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda d: F.conv(d, 16, 10).cast("int"))


def _number(numbers: Column, i: Column) -> Column:
    """The i-th number; past 64 they are used again, changed by the turn."""
    turn = F.floor(i / 64).cast("int")
    return F.pmod(F.get(numbers, (i % 64).cast("int")) * (turn % 997 * 2 + 1) + turn % 65536, F.lit(65536))


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _letters(text: Column, numbers: Column, hexadecimal: Column) -> Column:
    """text with each digit and letter replaced by one of its kind. What holds for the whole text is asked once, not in the lambdas."""

    def one(c, i):
        b = _number(numbers, i)
        made = (F.when(c.between("0", "9"), _pick(_DIGITS, b)).when(c.between("a", "z"), _pick(_LOWER, b)).when(c.between("A", "Z"), _pick(_UPPER, b)).when(c < "\x80", c)
                .when(c.between("а", "я") | (c == "ё"), _pick(_CYR_LOWER, b)).when(c.between("А", "Я") | (c == "Ё"), _pick(_CYR_UPPER, b))
                .when(~c.rlike(r"\p{L}"), c))
        for script, (vowels, others, _, _) in SCRIPTS.items():
            made = made.when(c.rlike(rf"\p{{Is{script}}}"), _pick(vowels + others, b))
        return made.otherwise(_pick(_LOWER, b))

    digit = lambda c, i: _pick("0123456789abcdef", _number(numbers, i))
    return F.array_join(F.when(hexadecimal, F.transform(_chars(text), digit)).otherwise(F.transform(_chars(text), one)), "")


def _word(norm: Column, numbers: Column, attempt: Column) -> Column:
    """A word of a name: one of the list that has it, or vowels for vowels and consonants for consonants, with its last letter."""

    def built(script: str) -> Column:
        vowels, others, like_vowels, ends = SCRIPTS[script]
        grown = F.concat(norm, F.repeat(F.lit((vowels or others)[0] + others[0]), F.floor(attempt / GROW).cast("int")))
        ending = F.when(F.length(norm) > 2, F.substring(norm, -1, 1)).otherwise("") if ends else F.lit("")
        body = F.substring(grown, F.lit(1), F.length(grown) - F.length(ending))

        def one(c, i):
            b = _number(numbers, i)
            mark = F.when(c.rlike(r"\p{M}"), c)  # the signs of a syllable stay with it
            return (mark.when(c.isin(*(vowels + like_vowels)), _pick(vowels, b)) if vowels else mark).otherwise(_pick(others, b))

        return F.concat(F.array_join(F.transform(_chars(body), one), ""), ending)

    word = F.when(norm.rlike(r"\p{IsLatin}"), built("Latin"))
    for script in list(SCRIPTS)[1:]:
        word = word.when(norm.rlike(rf"\p{{Is{script}}}"), built(script))
    word = word.otherwise(built("Latin"))
    for names in NAMES.values():
        listed = [n.lower() for n in names]
        other = F.element_at(F.array(*map(F.lit, listed)), (_number(numbers, F.lit(0)) % len(listed) + 1).cast("int"))
        word = F.when(norm.isin(listed) & (attempt < GROW), other).otherwise(word)
    return word


def _luhn(digits: Column) -> Column:
    """digits with the last one set so that the checksum is right."""
    n = F.length(digits)

    def part(c, i):
        d = c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(i == n - 1, F.lit(0)).otherwise(F.when(d > 9, d - 9).otherwise(d))

    total = F.aggregate(F.transform(_chars(digits), part), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _iban(country: Column, rest: Column) -> Column:
    """An account number with the right check digits: the number with its head last is 1 modulo 97, letters counting from 10."""
    value = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    left = F.aggregate(_chars(F.concat(rest, country, F.lit("00"))), F.lit(0), value)
    return F.concat(country, F.lpad((F.lit(98) - left).cast("string"), 2, "0"), rest)


def _address(norm: Column, numbers: Column, attempt: Column) -> Column:
    """An address of the same range, after GROW attempts of the same class: private or public, multicast and the like stay as they are."""
    octets = F.split(norm, r"\.")
    a, b, n = octets[0], octets[1], lambda i, lo, hi: (_number(numbers, F.lit(i)) % (hi - lo + 1) + lo).cast("string")
    two = a.isin(*_TWO)
    private = (a == "10") | (a == "172") & b.cast("int").between(16, 31) | (a == "192") & (b == "168")
    special = a.isin("0", "127", "100", "169") | (a.cast("int") > 223)
    wide = F.when(private, F.concat_ws(".", F.lit("10"), n(4, 0, 255))).when(special, F.concat_ws(".", a, n(4, 0, 255))).otherwise(F.concat_ws(".", n(5, 11, 98), n(4, 0, 255)))
    head = F.when(attempt >= GROW, wide).when(two, F.concat_ws(".", a, b)).otherwise(F.concat_ws(".", a, n(4, 0, 255)))
    return F.concat_ws(".", head, n(6, 0, 255), n(7, 1, 254))


def _address6(norm: Column, numbers: Column, attempt: Column) -> Column:
    """An IPv6 address of the same range: the first group stays (of a unique local one, which is drawn, two digits), groups keep their lengths and zeros; after GROW attempts groups get four digits, after twice as many zeros are filled too."""

    def one(g, i):
        low = F.when(attempt >= GROW, 4096).otherwise(F.pow(F.lit(16), F.length(g) - 1).cast("int"))
        new = lambda low: F.lower(F.hex(low + _number(numbers, i + 8) % (low * 15)))
        return F.when((i == 0) & g.rlike("^f[cd]..$"), F.concat(F.substring(g, 1, 2), new(F.lit(16)))).when((i == 0) | (g == "0") & (attempt < 2 * GROW), g).otherwise(new(low))

    return F.array_join(F.transform(F.split(norm, ":"), one), ":")


def _like_address6(unit: Column, made: Column) -> Column:
    """made with the ::, leading zeros and case of unit; in full where made has no zeros for the ::."""
    before, after = _sides(unit)
    groups = F.split(made, ":")
    padded = lambda new, old: F.zip_with(new, old, lambda n, o: F.lpad(n, F.greatest(F.length(n), F.length(o)), "0"))
    left, right = F.slice(groups, F.lit(1), F.size(before)), F.slice(groups, F.size(groups) - F.size(after) + 1, F.size(after))
    between = F.slice(groups, F.size(before) + 1, F.greatest(F.size(groups) - F.size(before) - F.size(after), F.lit(0)))
    short = F.concat(F.array_join(padded(left, before), ":"), F.lit("::"), F.array_join(padded(right, after), ":"))
    text = F.when(~unit.contains("::"), F.array_join(padded(groups, before), ":")).when(F.forall(between, lambda g: g == "0"), short).otherwise(made)
    return F.when((unit == F.upper(unit)) & (unit != F.lower(unit)), F.upper(text)).otherwise(text)


def surrogate(kind: Column, norm: Column, attempt: Column, numbers: Column) -> Column:
    """The surrogate of a normal form; numbers: its stream."""
    more = F.repeat(F.lit("0"), F.greatest(F.floor(attempt / GROW_NUMBER).cast("int"), F.lit(0)))
    grown = F.when(kind == "secret", F.concat(norm, F.repeat(F.lit("0"), F.floor(attempt / GROW).cast("int")))).when(kind == "mail", F.concat(F.repeat(F.lit("x"), F.floor(attempt / GROW).cast("int")), norm)).when(kind.isin("phone", "ssn"), F.concat(norm, more)).otherwise(norm)
    mixed = _letters(grown, numbers, (kind == "secret") & norm.rlike(r"\A[0-9a-f]+\z"))
    # what a number or key begins with tells its network, country or issuer
    head = F.when(kind == "phone", F.regexp_extract(norm, rf"^\+{_COUNTRY}|^0", 0)).when(kind == "card", F.substring(norm, 1, 1)).when(kind == "secret", F.regexp_extract(norm, "^" + _KEY_HEAD, 0)).otherwise("")
    kept = F.concat(head, F.substring(mixed, F.length(head) + 1, F.length(grown)))
    ssn = F.concat(_pick("12345", _number(numbers, F.lit(9))), F.substring(mixed, F.lit(2), F.lit(3)), _pick("123456789", _number(numbers, F.lit(10))), F.substring(mixed, F.lit(6), F.length(grown)))
    domain = F.substring_index(norm, ".", -1)
    mail = F.concat(F.substring(mixed, F.lit(1), F.length(grown) - F.length(domain)), domain)
    iban = _iban(F.substring(norm, 1, 2), F.substring(mixed, F.lit(5), F.length(norm)))
    return (F.when(kind == "mail", mail).when(kind == "address", _address(norm, numbers, attempt)).when(kind == "address6", _address6(norm, numbers, attempt)).when(kind == "card", _luhn(kept)).when(kind == "iban", iban)
            .when(kind == "name", _word(norm, numbers, attempt)).when(kind == "ssn", ssn).otherwise(kept))


def formatted(unit: Column, made: Column, kind: Column) -> Column:
    """The surrogate in the form of one occurrence: its separators and its case."""
    plain = F.regexp_replace(unit, "[^0-9A-Za-z+]", "")
    is_mark = lambda c: c.rlike("[^0-9A-Za-z+]")
    shaped = F.aggregate(  # numbers are short
        _chars(unit), F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda a, c: F.struct(F.concat(a["text"], F.when(is_mark(c), c).otherwise(F.substring(made, a["next"], F.lit(1)))).alias("text"), (a["next"] + F.when(is_mark(c), 0).otherwise(1)).alias("next")),
        lambda a: F.concat(a["text"], F.substring(made, a["next"], F.length(made))),
    )
    by_place = F.array_join(F.zip_with(_chars(unit), _chars(made), lambda c, s: F.when(c.isNotNull() & (c != F.lower(c)), F.upper(s)).otherwise(F.coalesce(s, F.lit("")))), "")
    cased = F.when(unit == F.lower(unit), made).when((unit == F.upper(unit)) & (F.length(unit) > 1), F.upper(made)).when(kind == "name", F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))).otherwise(by_place)
    return F.when(kind.isin("card", "phone", "iban", "ssn"), F.when(plain != unit, shaped).otherwise(made)).when(kind == "address6", _like_address6(unit, made)).when(kind.isin("mail", "name") | (kind == "secret") & unit.rlike(r"\A[0-9a-fA-F]+\z"), cased).otherwise(made)


def mapping(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, surrogate) for the distinct (kind, norm) of found: no two surrogates of a kind are equal, none is a unit of the corpus (see LIFT).

    Each turn makes the surrogates of what is open in as many tasks as the session shuffles to, writes them and settles those without a rival.
    """
    n = partitions(found.sparkSession)
    units = written(found.select("kind", "norm").distinct(), "units")
    taken = units.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("occurs"))
    done, open_ = [], units.withColumn("attempt", F.lit(0))
    while True:
        made = open_.withColumn("numbers", stream(F.col("kind"), F.col("norm"), F.col("attempt"), key)).repartition(n, "kind", "norm")
        made = written(made.select("kind", "norm", "attempt", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("numbers")).alias("surrogate")), "surrogates")
        first = made.groupBy("kind", "surrogate").agg(F.min("norm").alias("owner"))
        others = taken
        for settled in done:
            others = others.unionByName(settled.select("kind", "surrogate", F.lit(False).alias("occurs")))
        rivals = others.groupBy("kind", "surrogate").agg(F.min("occurs").alias("occurs"))  # false: another unit has it
        judged = made.join(first, ["kind", "surrogate"]).join(rivals, ["kind", "surrogate"], "left")
        free = F.col("occurs").isNull() | F.col("occurs") & (F.col("kind") == "address") & (F.col("attempt") >= LIFT) & (F.col("surrogate") != F.col("norm"))
        judged = written(judged.select("kind", "norm", "attempt", "surrogate", ((F.col("owner") == F.col("norm")) & free).alias("good")), "judged-surrogates")
        done.append(judged.where("good").select("kind", "norm", "surrogate"))
        open_ = judged.where("not good").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def replace_entities(docs: DataFrame, key: bytes | str) -> DataFrame:
    """docs with `text` replaced and the columns n_entities and entities (kind, entity, surrogate of each place, in order).

    key: the secret that surrogates depend on; equal keys give equal surrogates for equal corpora. Null and empty
    texts stay as they are and have no entities. Rows that repeat are replaced alike. An empty table
    gives no rows. Columns of docs keep their names and order; n_entities and entities of docs itself give way to the operator's.
    docs must be a scan or a written table.
    """
    key = key.encode() if isinstance(key, str) else key
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_entities", "entities")
    found, row, joined, places = (fresh(docs, x) for x in ("found", "row", "joined", "places"))
    text = F.col("text")
    kinds = "array<struct<kind: string, entity: string, surrogate: string>>"
    searched = docs.withColumn(found, F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    clean = searched.where(F.size(found) == 0).select(*docs.columns, F.lit(0).alias("n_entities"), F.array().cast(kinds).alias("entities"))
    hit = numbered(searched.where(F.size(found) > 0), row)

    entity, kind = F.col("entity"), F.col("kind")
    title = F.when(kind == "name", F.regexp_extract(entity, rf"\A{_TITLE}", 0)).otherwise("")
    rest = F.substring(entity, F.length("title") + 1, F.length(entity))
    letters = r"[\p{L}\p{M}]+"
    units = F.when(kind == "name", F.regexp_extract_all(F.col("rest"), F.lit(letters), F.lit(0))).otherwise(F.array("entity"))
    gaps = F.when(kind == "name", F.split("rest", letters, -1)).otherwise(F.array(F.lit(""), F.lit("")))
    place = hit.select(F.col(row).alias("row"), F.posexplode(found).alias("at", "entity")).withColumn("kind", kind_of(entity)).withColumn("title", title).withColumn("rest", rest)
    place = place.select("row", "at", "entity", "kind", "title", gaps.alias("gaps"), F.posexplode(units).alias("nth", "unit")).withColumn("norm", normal(F.col("unit"), kind))
    placed = written(place, "entity-places")
    made = placed.join(mapping(placed, key), ["kind", "norm"]).withColumn("new", formatted(F.col("unit"), F.col("surrogate"), kind))
    words = F.array_sort(F.collect_list(F.struct("nth", "new")))
    per_place = made.groupBy("row", "at").agg(F.first("entity").alias("entity"), F.first("kind").alias("kind"), F.first("title").alias("title"), F.first("gaps").alias("gaps"), words.alias("words"))
    whole = F.concat("title", F.array_join(F.zip_with("gaps", "words", lambda gap, w: F.concat(gap, F.coalesce(w["new"], F.lit("")))), ""))
    per_row = per_place.groupBy(F.col("row").alias(joined)).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "entity", whole.alias("surrogate")))).alias(places))
    rebuilt = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(places), lambda gap, p: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(p["surrogate"], F.lit("")))), "")
    entities = F.transform(places, lambda p: F.struct(p["kind"].alias("kind"), p["entity"].alias("entity"), p["surrogate"].alias("surrogate"))).cast(kinds)
    new = [rebuilt.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return hit.join(per_row, F.col(row) == F.col(joined)).select(*new, F.size(places).alias("n_entities"), entities.alias("entities")).unionByName(clean)
