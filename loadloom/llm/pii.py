"""PII surrogates: keyed, type-consistent stand-ins for personal data. DataFrame functions only.

Entities are found by pattern and taken apart into units: a mail address, a number's digits, each word of a name. A unit's
stand-in depends on the key and the unit alone, so one person stays one person whatever the title, and one number stays one
number however it is grouped. Digits are permuted by a keyed Feistel network over all numbers of their length, which is
one-to-one; country codes, separators and check digits stay valid. Name words become made-up ones of the same script, case
and (for known given names) gender. The distinct units of the corpus are checked: a stand-in that two units share, or that is
another unit itself, is drawn again for the one unit concerned, and the texts that hold it are told.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from loadloom.llm.columns import let
from loadloom.session import materialize

#: The patterns, tried in this order at each place.
#: Groups that repeat without bound are possessive, as Java's regular expressions recurse in others, and a long text would end its task.
#: A domain reaches to the last of its labels that begins with two letters.
_LABEL, _TOP = r"[\p{L}\p{M}\p{N}-]++", r"\p{L}[\p{L}\p{M}]"
_OTHERS = rf"(?:\.(?!{_TOP}){_LABEL})*+"
MAIL = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}._%+'’-]*@{_LABEL}(?:{_OTHERS}\.(?={_TOP}){_LABEL}(?={_OTHERS}\.{_TOP}))*+{_OTHERS}\.{_TOP}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
#: Eight groups, or fewer about one '::'; a digit is demanded, which keeps names of code (a::b) out.
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|:(?::{_H}){{2,7}})(?![\p{{L}}\p{{N}}:])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])"
#: A plus and 7 to 15 digits in groups; three groups; an area code (no year) in brackets; a trunk 0 (no date) and groups; ten digits of a North American number.
_GAP = r"[\x20\u00a0\u202f\u2011./-]"
_PHONES = (
    r"(?<![0-9A-Za-z])\+(?![0-9]{8,15}(?![0-9A-Za-z]))[0-9](?:[\x20\u00a0\u202f\u2011./()-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z])\((?!(?:19|20)[0-9]{{2}}\))(?=[0-9](?:[\x20\u00a0\u202f\u2011./)-]{{0,2}}[0-9]){{7}})[0-9]{{2,5}}\){_GAP}?[0-9]{{2,8}}(?:{_GAP}[0-9]{{2,8}}){{0,3}}(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z.,:+-])(?![0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}(?![0-9]|[./-][0-9]))(?=0[0-9](?:{_GAP}?[0-9]){{7}})0[1-9][0-9]{{0,4}}{_GAP}[0-9](?:{_GAP}?[0-9]){{5,9}}(?![0-9A-Za-z]|[.,:-][0-9])",
    r"(?<![0-9A-Za-z.,:-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z]|[.,:-][0-9])",
)
PHONE = "|".join(f"(?:{p})" for p in _PHONES)
PLUS = r"\+[0-9]{8,15}(?![0-9A-Za-z])"
#: Titles that make what follows a name.
TITLES = (
    "Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Mx.", "Miss", "Sir", "Dr.", "Dr", "Prof.", "Professor", "Rev.", "Capt.", "Sgt.",
    "Frau", "Herr", "Hr.", "Fr.", "Madame", "Mme", "Mme.", "Mademoiselle", "Mlle", "Monsieur", "Señor", "Señora", "Señorita", "Sr.", "Sra.", "Srta.", "Doña",
    "Signor", "Signora", "Sig.", "Sig.ra", "Dott.", "Senhor", "Senhora", "Mevrouw", "Meneer", "Pan", "Pani",
    "Госпожа", "Господин", "Доктор", "Профессор", "Κυρία", "Κύριος", "Κύριε",
)
_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for t in sorted(TITLES, key=lambda t: (-len(t), t))) + ")"
#: Small words within a name, which stay as they are.
PARTICLES = ("da", "das", "de", "del", "della", "den", "der", "des", "di", "do", "dos", "du", "el", "la", "las", "le", "los", "ten", "ter", "van", "vom", "von", "zu", "zum", "zur", "al", "bin", "ben", "ibn", "фон")
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.){0,2}"
_SMALL = r"(?:(?:" + "|".join(sorted(PARTICLES, key=lambda t: (-len(t), t))) + r")\x20){0,3}"
_PART = rf"{_SMALL}(?:{_INITIALS}|\p{{Lu}}[\p{{L}}\p{{M}}'’-]*)"
NAME = rf"(?<!\p{{L}}){_TITLE}\x20{_PART}(?:\x20{_PART}){{0,3}}"
#: Two or more capitalised words in a row: where a name that is known by a title elsewhere may stand without one.
ROW = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_PART}(?:\x20{_PART})++"
KINDS = {"mail": MAIL, "iban": IBAN, "ip": IPV4, "ip6": IPV6, "ssn": SSN, "card": CARD, "phone": PHONE, "plus": PLUS, "name": NAME}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A quick test for texts that can't have an entity: no @, no four digits near each other, no two colons, no title.
MAYBE = rf"@|[0-9][0-9()./\x20\u00a0\u202f\u2011+-]{{5,}}[0-9]|[A-Z]{{2}}[0-9]{{2}}|:[0-9A-Fa-f]{{0,4}}:|(?<!\p{{L}}){_TITLE}\x20"
#: Country codes after a plus (E.164); those not listed have three digits.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Given names that tell a gender.
GIVEN = {
    "f": "Alice Amelia Amy Andrea Angela Anita Anna Anne Barbara Carla Carmen Carol Caroline Catherine Charlotte Chiara Christina Clara Claire Claudia Diana Elena Elisabeth Elizabeth Ella Emily Emma Eva Eve Francesca Giulia Grace Hannah Heidi Helen Ines Ingrid Irene Isabel Jane Jennifer Jessica Joan Judith Julia Karen Kate Katherine Laura Linda Lisa Louise Lucia Lucy Margaret Maria Marie Marta Martha Mary Mia Michelle Monica Nancy Natalie Nora Olga Olivia Pamela Patricia Paula Rachel Rebecca Rosa Ruth Sandra Sara Sarah Silvia Sofia Sonia Sophie Susan Teresa Ursula Valentina Vera Victoria Анна Вера Елена Ирина Мария Наталья Нина Ольга София Татьяна Άννα Ελένη Ειρήνη Μαρία Σοφία Αικατερίνη".split(),
    "m": "Adam Albert Alexander Alfred Andrew Anthony Antonio Arthur Benjamin Bernard Brian Carl Carlos Charles Christopher Daniel David Diego Edward Eric Erik Ernst Felix Fernando Francesco Francisco Frank Franz Fritz George Georg Gerhard Giovanni Giuseppe Hans Harry Heinrich Henry Herbert Hugo Ivan Jack Jacob James Jean Joe John Johann Jonas Jorge Joseph José Juan Karl Kevin Klaus Lars Louis Luca Lucas Luigi Luis Manuel Marc Marco Mario Mark Martin Matthew Max Michael Miguel Nicholas Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Pierre Richard Robert Roger Samuel Simon Stefan Stephen Thomas Tim Tom Victor Walter William Wolfgang Антон Борис Виктор Иван Максим Олег Павел Сергей Николай Александр Γιάννης Κώστας Νίκος Πέτρος Σπύρος Γιώργος".split(),
}
#: How made-up names are put together, by script: consonants, vowels, and endings of women's and men's given names.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v w z", "a e i o", "nia", "nard"),
    "cyrillic": ("б д ф г х к л м н п р с т в ж з", "а е и о", "ния", "нор"),
    "greek": ("β δ φ γ χ κ λ μ ν π ρ σ τ θ ξ ζ", "α ε ι ο", "νία", "νος"),
}
SYLLABLES, LEAST_LETTERS, ROUNDS = 4, 10, 6
#: Words in a name, particles included.
MOST_WORDS = 16
ROUNDS_APART = 20
#: Texts and entries in them of which every task is sent what it must know; beyond that they are joined by a shuffle.
BROADCAST_TEXTS = 100_000


def _hash(key: str, *parts) -> Column:
    return F.xxhash64(F.lit(key), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _split_rounds(left: Column, right: Column, key: str, turn: Column, step) -> Column:
    """Feistel rounds on two halves: even ones change the left half by a keyed hash of the right one, odd ones the other way."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.alias("l"), right.alias("r")),
        lambda acc, i: F.struct(
            F.when(i % 2 == 0, step(acc["l"], _hash(key, turn, i, acc["r"]))).otherwise(acc["l"]).alias("l"),
            F.when(i % 2 == 1, step(acc["r"], _hash(key, turn, i, acc["l"]))).otherwise(acc["r"]).alias("r"),
        ),
    )


def permuted(digits: Column, key: str, turn: Column | int = 0) -> Column:
    """A one-to-one map on the digit strings of each length; another for each ``turn``."""
    again = turn if isinstance(turn, Column) else F.lit(turn)

    def step(own: Column, h: Column) -> Column:
        most = F.pow(F.lit(10.0), F.length(own)).cast("long")
        return F.lpad(((F.concat(F.lit("0"), own).cast("long") + F.pmod(h, most)) % most).cast("string"), F.length(own), F.lit("0"))

    def whole(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        return let(_split_rounds(F.substring(d, F.lit(1), half), F.substring(d, half + 1, F.length(d)), key, again, step), lambda s: F.concat(s["l"], s["r"]))

    return let(digits, whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(form: Column, digits: Column, sign: str = "[0-9]") -> Column:
    """``form`` with its digits replaced in turn."""
    return F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike(sign), F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + c.rlike(sign).cast("int")).alias("at"),
        ),
        lambda acc: acc["out"],
    )


def _check_digit(digits: Column) -> Column:
    """What the Luhn rule appends to ``digits``."""
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(digits: Column, key: str, turn: Column) -> Column:
    """All but the last digit are permuted; the last keeps its distance from the check digit, so valid cards stay valid."""
    n = F.length(digits)
    old = F.substring(digits, F.lit(1), n - 1)
    last = lambda new: F.pmod(F.substring(digits, n, F.lit(1)).cast("int") - _check_digit(old) + _check_digit(new), F.lit(10))
    return let(permuted(old, key, turn), lambda new: F.concat(new, last(new).cast("string")))


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits, from 2 to 98, that make an account number valid (ISO 7064, modulo 97)."""
    of = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != "")
    return 98 - F.aggregate(chars, F.lit(0), lambda a, c: F.when(of(c) > 9, a * 100 + of(c)).otherwise(a * 10 + of(c)) % 97)


def _iban(plain: Column, key: str, turn: Column) -> Column:
    """Country and letters stay; the account's digits are permuted, and the check digits keep their distance from the valid ones."""
    country, check, rest = F.substring(plain, 1, 2), F.substring(plain, 3, 2).cast("int"), F.substring(plain, F.lit(5), F.length(plain))
    told = lambda new: F.lpad((F.pmod(_iban_check(country, new) - 2 + check - _iban_check(country, rest), F.lit(97)) + 2).cast("string"), 2, "0")
    return let(_fill(rest, permuted(_digits(rest), key, turn)), lambda new: F.concat(country, told(new), new))


def _address(value: Column, key: str, turn: Column) -> Column:
    step = lambda own, h: (own + F.pmod(h, F.lit(65536))) % 65536
    part = lambda o, i: F.element_at(o, i).cast("long")

    def whole(o: Column) -> Column:
        halves = _split_rounds(part(o, 1) * 256 + part(o, 2), part(o, 3) * 256 + part(o, 4), key, turn, step)
        text = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
        return let(halves, lambda s: F.concat(text(s["l"]), F.lit("."), text(s["r"])))

    return let(F.split(value, r"\."), whole)


def _long_address(low: Column, key: str, turn: Column) -> Column:
    """An IPv6 address of the same form; its digits are shifted half by half, which is one-to-one on those of each length."""
    of = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1

    def step(own: Column, h: Column) -> Column:
        by = F.lower(F.lpad(F.hex(h), 16, "0"))
        signs = F.filter(F.split(own, ""), lambda c: c != "")
        return F.array_join(F.transform(signs, lambda c, i: F.substring(F.lit("0123456789abcdef"), (of(c) + of(F.substring(by, i + 1, F.lit(1)))) % 16 + 1, F.lit(1))), "")

    def whole(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        return let(_split_rounds(F.substring(d, F.lit(1), half), F.substring(d, half + 1, F.length(d)), key, turn, step), lambda s: F.concat(s["l"], s["r"]))

    return _fill(low, let(F.regexp_replace(low, ":", ""), whole), "[0-9a-f]")


def _drawn(seed: Column, key: str, choices: list[str], times: Column | int) -> Column:
    """``times`` keyed draws from ``choices``, run together."""
    table = F.array(*[F.lit(c) for c in choices])
    return F.array_join(F.transform(F.sequence(F.lit(1), times if isinstance(times, Column) else F.lit(times)), lambda i: F.element_at(table, F.pmod(_hash(key, i, seed), F.lit(len(choices))).cast("int") + 1)), "")


def _mail(low: Column, key: str, turn: Column) -> Column:
    letters, domain = list("abcdefghijklmnopqrstuvwxyz"), F.substring_index(low, "@", -1)
    return F.concat(_drawn(low, key + "l", letters, LEAST_LETTERS + turn), F.lit("@"), _drawn(domain, key + "d", letters, LEAST_LETTERS), F.lit(".example."), F.substring_index(domain, ".", -1))


def _word(low: Column, key: str, turn: Column) -> Column:
    """A made-up word of the same script; given names of a known gender get an ending of that gender. Each turn adds a syllable."""

    def of(script: str) -> Column:
        consonants, vowels, woman, man = SOUNDS[script]
        stem = _drawn(low, key + "w", [c + v for c in consonants.split() for v in vowels.split()], SYLLABLES - 1 + turn)
        last = _drawn(low, key + "e", [c + v for c in consonants.split() for v in vowels.split()], 1)
        known = lambda g: low.isin(*[w.lower() for w in GIVEN[g]])
        return F.concat(stem, F.when(known("f"), F.lit(woman)).when(known("m"), F.lit(man)).otherwise(last))

    return F.when(low.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(low.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def stand_in(kind: Column, own: Column, key: str, turn: Column) -> Column:
    """What stands for a unit; ``kind``: mail, iban, ip, ip6, card, digits or word."""
    return (
        F.when(kind == "mail", _mail(own, key, turn))
        .when(kind == "iban", _iban(own, key, turn))
        .when(kind == "ip", _address(own, key, turn))
        .when(kind == "ip6", _long_address(own, key, turn))
        .when(kind == "card", _card(own, key, turn))
        .when(kind == "word", _word(own, key, turn))
        .otherwise(permuted(own, key, turn))
    )


def _words(name: Column) -> Column:
    return F.split(F.regexp_replace(name, rf"^{_TITLE}\x20", ""), " ")


def _plain(word: Column) -> Column:
    """Whether a word of a name is neither a particle nor initials."""
    return ~word.isin(*PARTICLES) & ~word.rlike(rf"^{_INITIALS}$")


def _kept(value: Column) -> Column:
    """The country code of a number, plus sign included; empty without one."""
    return F.regexp_extract(value, COUNTRY, 0)


def units(value: Column, kind: Column) -> Column:
    """The units of an entity as array of (kind, own)."""
    one = lambda k, own: F.array(F.struct(F.lit(k).alias("kind"), own.alias("own")))
    parts = F.flatten(F.transform(F.filter(_words(value), _plain), lambda w: F.split(F.lower(w), "-")))
    return (
        F.when(kind == "mail", one("mail", F.lower(value)))
        .when(kind == "iban", one("iban", F.replace(value, F.lit(" "), F.lit(""))))
        .when(kind == "ip", one("ip", value))
        .when(kind == "ip6", one("ip6", F.lower(value)))
        .when(kind == "card", one("card", _digits(value)))
        .when(kind == "name", F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.lit("word").alias("kind"), p.alias("own"))))
        .otherwise(one("digits", _digits(F.substring(value, F.length(_kept(value)) + 1, F.length(value)))))
    )


def _turn(turns: Column, kind: str, own: Column) -> Column:
    return F.coalesce(F.get(F.filter(turns, lambda t: (t["kind"] == kind) & (t["own"] == own)), 0)["turn"], F.lit(0))


def _name_word(word: Column, key: str, turns: Column) -> Column:
    """The stand-in of a name's word: particles stay, initials are exchanged one to one, parts around hyphens are words of their own."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shift = sum(key.encode()) % 25 + 1
    part = lambda p: let(F.lower(p), lambda low: _word(low, key, _turn(turns, "word", low)))
    styled = lambda p: let(part(p), lambda m: F.when(p == "", p).when((F.upper(p) == p) & (F.length(p) > 1), F.upper(m)).otherwise(F.initcap(m)))
    made = F.array_join(F.transform(F.split(word, "-"), styled), "-")
    return F.when(word.isin(*PARTICLES), word).when(word.rlike(rf"^{_INITIALS}$"), F.translate(word, signs, signs[shift:] + signs[:shift])).otherwise(made)


def surrogate(value: Column, key: str, turns: Column | None = None) -> Column:
    """The stand-in of an entity in its form; ``turns``: array of (kind, own, turn) for units that had to be drawn again."""
    turns = F.array().cast("array<struct<kind:string,own:string,turn:int>>") if turns is None else turns
    stood = lambda k, own, of: of(own, key, _turn(turns, k, own))

    def whole(kind: Column) -> Column:
        rest = F.substring(value, F.length(_kept(value)) + 1, F.length(value))
        return (
            F.when(kind == "mail", let(F.lower(value), lambda x: stood("mail", x, _mail)))
            .when(kind == "iban", let(F.replace(value, F.lit(" "), F.lit("")), lambda x: _fill(value, stood("iban", x, _iban), "[0-9A-Z]")))
            .when(kind == "ip", stood("ip", value, _address))
            .when(kind == "ip6", let(F.lower(value), lambda x: stood("ip6", x, _long_address)))
            .when(kind == "card", let(_digits(value), lambda x: _fill(value, stood("card", x, _card))))
            .when(kind == "name", F.concat(F.regexp_extract(value, rf"^{_TITLE}\x20", 0), F.array_join(F.transform(_words(value), lambda w: _name_word(w, key, turns)), " ")))
            .otherwise(F.concat(_kept(value), let(_digits(rest), lambda x: _fill(rest, stood("digits", x, permuted)))))
        )

    return let(kind_of(value), whole)


def drawn_again(own: DataFrame, key: str) -> DataFrame:
    """(kind, own, turn) of the units of ``own`` (kind, own; distinct) whose first stand-in is another's, or another unit itself.

    Of units that share a stand-in the least keeps it. Only units that meet are drawn again, until none does. Where a form is so
    crowded that ``ROUNDS_APART`` rounds find no number that is nobody's, stand-ins are still kept distinct.
    """
    made = lambda t: t.withColumn("made", stand_in(F.col("kind"), F.col("own"), key, F.col("turn")))
    now = materialize(made(own.withColumn("turn", F.lit(0))), "pii-units")
    for k in count():
        shared = now.groupBy("kind", "made").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "made", "first")
        meets = now.join(shared, ["kind", "made"]).where("own <> first").select("kind", "own")
        taken = now.join(now.select("kind", F.col("own").alias("made")), ["kind", "made"], "left_semi").select("kind", "own")
        bad = materialize((meets.unionByName(taken) if k < ROUNDS_APART else meets).distinct(), "pii-meeting")
        if bad.isEmpty():
            return now.where("turn > 0").select("kind", "own", "turn")
        again = made(now.join(bad, ["kind", "own"], "left_semi").withColumn("turn", F.col("turn") + 1))
        now = materialize(now.join(bad, ["kind", "own"], "left_anti").unionByName(again), "pii-units")


def _marks(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_pii_a"), F.xxhash64(F.lit(1), text).alias("_pii_b")]


def told_texts(docs: DataFrame, key: str) -> DataFrame:
    """For the texts of ``docs`` (text) that must know more than the key: _pii_a, _pii_b, _pii_turns and _pii_words.

    ``_pii_turns``: units of the text that were drawn again. ``_pii_words``: words of names that stand in it without a title and
    are known by one elsewhere in the corpus. Texts are read once, copies count once, and entities are made distinct in each
    task before they are shuffled, so a hot one sends one row for each task.
    """
    text, marks = F.col("text"), ["_pii_a", "_pii_b"]
    entities = F.when(text.rlike(MAYBE), F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    found = docs.where("text is not null").select(*_marks(text), entities.alias("entities"), F.array_distinct(F.regexp_extract_all(text, F.lit(ROW), F.lit(0))).alias("rows"))
    found = materialize(found.where((F.size("entities") > 0) | (F.size("rows") > 0)).dropDuplicates(marks), "pii-entities")
    told = found.select(*marks, F.explode("entities").alias("value")).withColumn("kind", kind_of(F.col("value")))
    own = told.select("value", "kind").distinct().select(F.explode(units(F.col("value"), F.col("kind"))).alias("u")).select("u.kind", "u.own").where("own <> ''").distinct()
    again = drawn_again(own, key)
    none = F.lit(None).cast("struct<kind:string,own:string,turn:int>")
    turns = told.select(*marks, F.explode(units(F.col("value"), F.col("kind"))).alias("u")).select(*marks, "u.kind", "u.own").distinct().join(again, ["kind", "own"])
    turns = turns.select(*marks, F.struct("kind", "own", "turn").alias("turn"), F.lit(None).cast("string").alias("word"))

    known = told.where("kind = 'name'").select("value").distinct().select(_words(F.col("value")).alias("w")).where(F.size("w") > 1).select(F.lower(F.array_join("w", " ")).alias("name")).distinct()
    runs = found.select(*marks, F.explode("rows").alias("row")).select(*marks, F.split("row", " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(MOST_WORDS), F.size("w") - i)), lambda n: F.slice("w", i + 1, n))))
    bare = runs.select(*marks, F.explode(spans).alias("span")).withColumn("name", F.lower(F.array_join("span", " "))).distinct().join(known, "name", "left_semi")
    bare = bare.select(*marks, F.explode("span").alias("word")).where(_plain(F.col("word"))).distinct().select(*marks, none.alias("turn"), "word")
    both = turns.unionByName(bare).groupBy(*marks)
    return both.agg(F.collect_set("turn").alias("_pii_turns"), F.collect_set("word").alias("_pii_words"))  # each bounded by its own text


def _told_words(names: Column, bare: Column, key: str, turns: Column) -> Column:
    """Each word of ``names`` (entities) and of ``bare`` and what stands for it, the longest first; no particles or initials."""
    own = F.array_distinct(F.concat(F.flatten(F.transform(names, lambda v: F.filter(_words(v), lambda w: _plain(w) & (F.length(w) > 1)))), bare))
    ordered = F.sort_array(F.transform(own, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word"))))
    return F.transform(ordered, lambda x: F.struct(x["word"].alias("word"), _name_word(x["word"], key, turns).alias("made")))


def _bare(piece: Column, known: Column) -> Column:
    """``piece`` with the words ``known`` (array of word, made; not empty) replaced where they stand alone, and their number."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(known["word"], "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))

    def whole(p: Column) -> Column:
        parts = F.arrays_zip(F.split(piece, p, -1).alias("rest"), F.regexp_extract_all(piece, p, F.lit(0)).alias("word"))
        made = lambda w: F.get(F.filter(known, lambda k: k["word"] == w), 0)["made"]
        return F.struct(F.array_join(F.transform(parts, lambda x: F.concat(x["rest"], F.coalesce(made(x["word"]), F.lit("")))), "").alias("text"), F.size(F.filter(parts, lambda x: x["word"].isNotNull())).alias("n"))

    return let(pattern, whole)


def replace_entities(docs: DataFrame, key: str = "public-test-key") -> DataFrame:
    """Every personal entity in ``text`` replaced by its surrogate under ``key``; all other columns and rows as they came.

    The words of a name found by its title are also replaced where they stand alone in the same text, and a name of two or more
    words that has a title anywhere in the corpus is found without one, by the same stand-ins. Adds the column ``entities``
    (number replaced) in place of one of that name. Null text stays null with 0 entities; empty texts and texts without
    entities stay as they are. Repeated rows stay, and get the same surrogates. Empty table: no rows. Very long texts are
    treated whole. A surrogate depends on the key and the entity alone, not on row order or partitions, save that a unit whose
    stand-in is another unit of the corpus, or another's stand-in, is drawn again. Columns named ``_pii_...`` are refused.
    """
    if clash := sorted(c for c in docs.columns if c.lower().startswith("_pii_")):
        raise ValueError(f"columns {clash} are the operator's own")
    columns = [c for c in docs.columns if c != "entities"]
    docs = docs.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])
    told = materialize(told_texts(docs.select("text"), key), "pii-told")
    size = told.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("_pii_turns") + F.size("_pii_words")), F.lit(0)).alias("entries")).first()
    few = max(size["texts"], size["entries"]) <= BROADCAST_TEXTS
    text, bare = F.col("text"), F.coalesce(F.col("_pii_words"), F.array().cast("array<string>"))
    turns = F.coalesce(F.col("_pii_turns"), F.array().cast("array<struct<kind:string,own:string,turn:int>>"))
    marked = docs.select("*", *_marks(text)).join(F.broadcast(told) if few else told, ["_pii_a", "_pii_b"], "left") if size["texts"] else docs.select("*", F.lit(None).cast("array<string>").alias("_pii_words"), F.lit(None).cast("array<struct<kind:string,own:string,turn:int>>").alias("_pii_turns"))
    pairs = F.arrays_zip(F.split(text, ENTITY, -1).alias("piece"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("value"))
    made = F.transform(pairs, lambda p: F.struct(p["piece"].alias("piece"), p["value"].alias("value"), surrogate(p["value"], key, turns).alias("made")))

    def bared(all_: Column, known: Column) -> Column:
        piece = lambda p: F.when(F.size(known) > 0, _bare(p["piece"], known)).otherwise(F.struct(p["piece"].alias("text"), F.lit(0).alias("n")))
        parts = F.transform(all_, lambda p: let(piece(p), lambda b: F.struct(F.concat(b["text"], F.coalesce(p["made"], F.lit(""))).alias("text"), (b["n"] + p["value"].isNotNull().cast("int")).alias("n"))))
        return let(parts, lambda x: F.struct(F.array_join(x["text"], "").alias("text"), F.aggregate(x["n"], F.lit(0), lambda n, k: n + k).alias("n")))

    names = lambda all_: F.filter(F.transform(all_, lambda p: p["value"]), lambda v: v.isNotNull() & (kind_of(v) == "name"))
    whole = let(made, lambda all_: let(_told_words(names(all_), bare, key, turns), lambda known: bared(all_, known)))
    same = F.struct(text.alias("text"), F.lit(0).alias("n"))
    new = F.when(text.rlike(MAYBE) | (F.size(bare) > 0), whole).otherwise(same)
    out = marked.select(*[F.col(f"`{c}`") for c in columns], new.alias("_pii_told"))
    return out.select(*[F.col("_pii_told.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], F.col("_pii_told.n").cast("long").alias("entities"))
