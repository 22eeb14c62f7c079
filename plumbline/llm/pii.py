"""PII surrogates: detected entities get keyed, type-consistent replacements. DataFrame functions only.

Detection is one regular expression over e-mail addresses, IPv4 and IPv6 addresses, IBANs, card-like
numbers, phone numbers with a country code or in a national form, national ids (3-2-4 digits), long
hexadecimal secrets, and names of any length that follow a title or begin with a
listed given name. A replacement is a function of key, type and the entity's
canonical form (letters and digits, lower case), so one entity has one
replacement in every document and spelling:

* Characters are shifted within their own alphabet (digits, letters of a case and
  script, hexadecimal digits) by a keyed hash of what stands before them - of the characters
  in their own block of BLOCK and a hash of the blocks before, so time is linear. Such a map
  can be undone from left to right, so different entities of a format stay
  different, format and script stay, and no shift is zero, so no entity stays. Letters
  and digits outside the listed alphabets have alphabets by rule: those of their case and
  script in Unicode's tables, upper and lower case in one order.
* Address octets stay octets, hexadecimal groups stay such, an IBAN keeps its country, card numbers keep whether their check digit is right,
  domains keep their last label and are mapped alike for all addresses.
* Names keep their title; given names are drawn by the hash from a list of the same
  gender and script, so here two may meet. From the second attempt on the family name is
  shifted by a hash of the given name too, and after every GROW attempts it
  gets a letter more, so there is always a name that nobody has.

The collision check finds replacements that two entities share or that
are themselves entities of the corpus, and gives those entities the next attempt
(another hash) until none is left, or fails after ROUNDS. There are few or none: they are sent as
literals while below MAX_LITERAL, beyond that joined by entity.

Defined results: a null or empty text stays as it is with no entities; rows
are mapped one by one, so null or repeated ids do not matter; other columns
are carried along; columns named like the new ones are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

MAX_LITERAL, ROUNDS, GROW = 1000, 100, 8
#: Characters of an entity between which the hash of what stands before starts over.
BLOCK = 32

# Given names by script and gender, titles by gender.
MALE = {"latin": ["James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Peter", "Hans", "Pierre", "Carlos", "Juan"], "cyrillic": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"]}
FEMALE = {"latin": ["Mary", "Anna", "Linda", "Susan", "Laura", "Emma", "Julia", "Sarah", "Ingrid", "Marie", "Carmen", "Elena"], "cyrillic": ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина"]}
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"]
NEUTRAL_TITLES = ["Dr", "Doctor", "Prof", "Professor"]
# Alphabets within which characters are shifted, lower and upper case in one order.
DIGITS = "0123456789"
ALPHABETS = [DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäåæçèéêëìíîïñòóôöøùúûüý", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝ", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
HEX = [DIGITS + "abcdef", "ABCDEF"]
PLAIN = [DIGITS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
# The same letters as vowels and consonants, for names that can be spoken.
SPOKEN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäåæèéêëìíîïòóôöøùúûü", "çñý", "ÀÁÂÄÅÆÈÉÊËÌÍÎÏÒÓÔÖØÙÚÛÜ", "ÇÑÝ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]


@cache
def other_letters(most: int = 256) -> tuple[list[str], list[tuple[int, int]]]:
    """What ALPHABETS lacks: alphabets of letters that have two cases, and of single ones; runs (first code point, length) of one category and script."""
    listed = set("".join(ALPHABETS))
    cased: dict[tuple, list[tuple[str, str]]] = defaultdict(list)
    runs: list[list] = []
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)
        if kind[0] not in "LN" or c in listed:
            continue
        other = c.lower() if kind == "Lu" else c.upper()
        paired = kind in ("Lu", "Ll") and len(other) == 1 and other != c and other not in listed and (other.upper() if kind == "Lu" else other.lower()) == c and unicodedata.category(other) in ("Lu", "Ll")
        upper = other if paired and kind == "Ll" else c
        script = unicodedata.name(upper, "").split(" ")[0]
        if paired:
            cased[kind, script].append((upper, c))
        elif runs and runs[-1][:2] == [kind, script] and runs[-1][2] + runs[-1][3] == ord(c):
            runs[-1][3] += 1
        else:
            runs.append([kind, script, ord(c), 1])
    for key in [key for key, group in cased.items() if len(group) == 1]:  # a script of one pair joins the largest
        cased[key[0], "LATIN"] += cased.pop(key)
    single: dict[tuple, str] = defaultdict(str)
    for kind, script, at, n in runs:
        single[kind, script] += chr(at) if n == 1 else ""
    for wider in (lambda key: (key[0], ""), lambda key: ("", "")):  # what is alone in its script, then in its category
        for key in [key for key, letters in single.items() if len(letters) == 1]:
            single[wider(key)] += single.pop(key)
    out = sorted((s for s in single.values() if s), key=len)
    if len(out[0]) == 1:
        out[-1] += out.pop(0)
    for group in cased.values():
        letters, parts = [c for _, c in sorted(group)], -(-len(group) // most)
        out += ["".join(letters[len(letters) * i // parts : len(letters) * (i + 1) // parts]) for i in range(parts)]
    return out, [(at, n) for _, _, at, n in runs if n > 1]


_GIVEN = "|".join(x for names in (*MALE.values(), *FEMALE.values()) for x in names)
_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True))
_NAME = r"\p{Lu}\p{L}++"
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_GIVEN}) {_NAME})"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]*[\p{L}\p{N}])+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
PHONE = r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
CARD = r"(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)"
SECRET = r"(?<![\p{L}\p{N}])(?=[a-fA-F]*\d)[0-9a-fA-F]{24,}(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])"
NATIONAL = r"(?<![\p{L}\d+.,/-])(?:\d{3}-\d{2}-\d{4}|0\d{2,4}[ /-]\d{5,8})(?![\p{L}\d-])"
PATTERN = "|".join([EMAIL, SECRET, IBAN, CARD, IP6, IP, PHONE, NATIONAL, NAME])
#: Texts without any of these have no entity.
HINT = rf"[0-9@]|(?=\p{{Lu}})(?:{_TITLES}|{_GIVEN})\.? \p{{Lu}}"
IS_IP, IS_SECRET, IS_CARD, IS_PHONE = rf"^{IP}$", r"^[0-9a-fA-F]{24,}$", rf"^(?:{CARD})$", r"^[+(\d]"
IS_IP6, IS_IBAN = r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F:]*$", r"^[A-Z]{2}\d{2}[ A-Z0-9]*\d[ A-Z0-9]*$"


def kind(m: Column) -> Column:
    """Type of a match of PATTERN."""
    return F.when(F.contains(m, F.lit("@")), "email").when(m.rlike(IS_IP), "ip").when(m.rlike(IS_SECRET), "secret").when(m.rlike(IS_CARD), "card").when(m.rlike(IS_IP6), "ip6").when(m.rlike(IS_IBAN), "iban").when(m.rlike(IS_PHONE), "phone").otherwise("name")


def canonical(m: Column) -> Column:
    """Letters and digits, lower case: what all spellings of an entity share."""
    bare = F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", "")
    return F.lower(F.regexp_replace(bare, F.when(F.contains(m, F.lit("@")), r"\s").when(m.rlike(IS_IP) | m.rlike(IS_IP6), r"\s").otherwise(r"[^\p{L}\p{N}]"), F.lit("")))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(seed: Column, before: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, before), 256), 1, 12), 16, 10).cast("long")


def _bare(part: Column) -> Column:
    return F.lower(F.regexp_replace(part, r"[^\p{L}\p{N}]", ""))


def _states(text: Column) -> Column:
    """Of every block of BLOCK characters a hash of all blocks before it; empty for the first."""
    def add(states: Column, n: Column) -> Column:
        return F.concat(states, F.array(F.sha2(F.concat(F.element_at(states, -1), _bare(F.substring(text, (n - 1) * BLOCK + 1, F.lit(BLOCK)))), 256)))

    first = F.array(F.lit(""))
    return F.when(F.length(text) <= BLOCK, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.floor((F.length(text) - 1) / BLOCK).cast("int")), first, add))


def _shift(text: Column, seed: Column, alphabets: list[str]) -> Column:
    """Every character moved within its alphabet by a keyed hash of what stands before it."""
    return F.when(F.length(text) == 0, text).otherwise(_let(_states(text), lambda states: _shifted(text, states, seed, alphabets)))


def _shifted(text: Column, states: Column, seed: Column, alphabets: list[str]) -> Column:
    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        block = F.floor((i - 1) / BLOCK).cast("int")
        h = _hash(seed, F.concat(F.get(states, block), _bare(F.substring(text, block * BLOCK + 1, i - 1 - block * BLOCK))))
        by = lambda at, n: (at + 1 + h % F.greatest(n - 1, F.lit(1))) % n
        move = lambda a: F.substring(a, (by(F.position(c, a) - 1, F.length(a)) + 1).cast("int"), F.lit(1))
        moved = lambda found: F.get(F.transform(F.slice(F.filter(found, lambda a: F.contains(a, c)), 1, 1), move), F.lit(0))
        own = moved(F.array(*[F.lit(a) for a in alphabets]))
        if alphabets in ([DIGITS], HEX, PLAIN):
            return F.coalesce(own, c)
        others, runs = other_letters()
        step = lambda r: F.decode(F.unhex(F.lpad(F.hex(r["at"] + by(F.ascii(c) - r["at"], r["n"])), 8, "0")), "UTF-32")
        table = F.from_json(F.lit("[" + ",".join(f'{{"at":{at},"n":{n}}}' for at, n in runs) + "]"), "array<struct<at:int,n:int>>")
        near = F.get(F.transform(F.slice(F.filter(table, lambda r: (F.ascii(c) >= r["at"]) & (F.ascii(c) < r["at"] + r["n"])), 1, 1), step), F.lit(0))
        rest = F.coalesce(moved(F.split(F.lit("|".join(others)), r"\|")), near)
        return F.coalesce(own, F.when(c.rlike(r"[\p{L}\p{N}]"), rest), c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _octets(ip: Column, seed: Column) -> Column:
    parts = F.split(ip, r"\.")
    one = lambda i: ((F.get(parts, i).cast("int") + 1 + _hash(seed, F.array_join(F.slice(parts, F.lit(1), i), ".")) % 255) % 256).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), one), ".")


def _check_digit(body: Column) -> Column:
    """The digit that makes body plus it pass the mod-10 check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add) % 10) % 10


def _card(m: Column, seed: Column) -> Column:
    def whole(body: Column, last: Column, new: Column) -> Column:
        off = F.pmod(last.cast("int") - _check_digit(body), F.lit(10))
        off = F.when(off == 0, 0).otherwise((off - 1 + _hash(seed, body) % 9) % 9 + 1)
        return F.concat(new, ((_check_digit(new) + off) % 10).cast("string"))

    def put(new: Column) -> Column:
        seen = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), r"\D", ""))
        char = lambda i: F.when(F.substring(m, i, F.lit(1)).rlike(r"\d"), F.substring(new, seen(i), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")

    digits = F.regexp_replace(m, r"\D", "")
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1))
    return _let(body, lambda b: _let(_shift(b, seed, [DIGITS]), lambda n: _let(whole(b, last, n), put)))


def _phone(m: Column, seed: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    return F.concat(code, _let(F.substring(m, F.length(code) + 1, F.length(m)), lambda rest: _shift(rest, F.concat_ws("|", seed, code), [DIGITS])))


def _email(m: Column, seed: Column) -> Column:
    host = F.substring_index(m, "@", -1)
    label = F.regexp_extract(host, r"^(.*)\.[^.]*$", 1)
    return F.concat(_shift(F.substring_index(m, "@", 1), F.concat_ws("|", seed, F.lower(host)), ALPHABETS), F.lit("@"), _shift(label, F.concat(F.lit("host|"), seed), ALPHABETS), F.substring(host, F.length(label) + 1, F.length(host)))


def _name(m: Column, seed: Column, attempt: Column) -> Column:
    title = F.regexp_extract(m, rf"^(?:{_TITLES})\.? ", 0)
    name = F.substring(m, F.length(title) + 1, F.length(m))
    given = F.when(F.contains(name, F.lit(" ")), F.substring_index(name, " ", 1)).otherwise("")
    family = F.substring_index(name, " ", -1)
    lists = {(s, g): names for g, by in (("m", MALE), ("f", FEMALE)) for s, names in by.items()}
    female = F.when((title != "") & ~title.rlike(rf"^(?:{'|'.join(NEUTRAL_TITLES)})\.? $"), title.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})\.? $")).otherwise(given.isin([x for names in FEMALE.values() for x in names]))
    cyrillic = given.rlike(r"^\p{IsCyrillic}")
    draw = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (_hash(seed, F.lower(given)) % len(names)).cast("int"))
    new = F.when(female & cyrillic, draw(lists["cyrillic", "f"])).when(female, draw(lists["latin", "f"])).when(cyrillic, draw(lists["cyrillic", "m"])).otherwise(draw(lists["latin", "m"]))
    own = F.when(attempt > 0, F.concat_ws("|", seed, F.lower(given))).otherwise(seed)
    more = F.repeat(F.when(family.rlike(r"\p{IsCyrillic}$"), "а").otherwise("a"), F.floor(attempt / GROW).cast("int"))
    return F.concat(title, F.when(given == "", "").otherwise(F.concat(new, F.lit(" "))), _shift(F.concat(family, more), own, SPOKEN))


def surrogate(m: Column, key: str, attempt: Column) -> Column:
    """Replacement of a match of PATTERN."""
    seed = lambda t: F.concat_ws("|", F.lit(key), F.lit(t), attempt.cast("string"))
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, seed("email")))
        .when(m.rlike(IS_IP), _octets(m, seed("ip")))
        .when(m.rlike(IS_SECRET), _shift(m, seed("secret"), HEX))
        .when(m.rlike(IS_CARD), _card(m, seed("card")))
        .when(m.rlike(IS_IP6), _shift(m, seed("ip6"), HEX))
        .when(m.rlike(IS_IBAN), F.concat(F.substring(m, F.lit(1), F.lit(2)), _shift(F.substring(m, F.lit(3), F.length(m)), F.concat_ws("|", seed("iban"), F.substring(m, F.lit(1), F.lit(2))), PLAIN)))
        .when(m.rlike(IS_PHONE), _phone(m, seed("phone")))
        .otherwise(_name(m, seed("name"), attempt))
    )


def matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def collisions(found: DataFrame, key: str) -> DataFrame | None:
    """Entities (kind, entity, attempt) whose first replacement is taken; none: None.

    found: the corpus' distinct entities (kind, entity, sample spelling).
    """
    taken = None
    state = found.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        put = materialize(state.withColumn("new", canonical(surrogate(F.col("sample"), key, F.col("attempt")))))
        shared = put.groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        second = put.join(shared, ["kind", "new"]).where("struct(attempt, entity) <> first").select("kind", "entity")
        real = put.join(found.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        again = materialize(second.union(real).distinct().withColumn("again", F.lit(1)))
        if again.isEmpty():
            return None if taken is None else materialize(taken.where("attempt > 0").select("kind", "entity", "attempt"))
        state = put.drop("new").join(again, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again")
        taken = state
    raise RuntimeError(f"replacements still collide after {ROUNDS} attempts: the entities leave too few of their formats")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's entities replaced, and n_entities: how many were."""
    text = F.col(text_col)
    docs = docs.drop("n_entities")
    each = docs.select(F.explode(matches(text)).alias("m"))
    found = materialize(each.groupBy(kind(F.col("m")).alias("kind"), canonical(F.col("m")).alias("entity")).agg(F.min("m").alias("sample")))
    taken = collisions(found, key)
    if taken is None or len(few := taken.limit(MAX_LITERAL + 1).collect()) <= MAX_LITERAL:
        attempt = lambda m: F.lit(0)
        if taken is not None and few:
            table = F.create_map(*[x for r in few for x in (F.lit(f"{r.kind}|{r.entity}"), F.lit(r.attempt))])
            attempt = lambda m: F.coalesce(table[F.concat_ws("|", kind(m), canonical(m))], F.lit(0))
        return _apply(docs, text_col, lambda m: surrogate(m, key, attempt(m)))
    names = docs.columns
    docs = docs.withColumn("__row", F.struct(F.spark_partition_id(), F.monotonically_increasing_id()))
    use = docs.select("__row", F.explode(F.array_distinct(matches(text))).alias("m")).withColumns({"kind": kind(F.col("m")), "entity": canonical(F.col("m"))})
    use = use.join(taken, ["kind", "entity"]).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("m", "attempt"))).alias("__tries"))
    joined = materialize(docs.join(use, "__row", "left"))
    return _apply(joined, text_col, lambda m: surrogate(m, key, F.coalesce(F.col("__tries")[m], F.lit(0)))).select(*names, "n_entities")


def _apply(docs: DataFrame, text_col: str, new) -> DataFrame:
    """Cut the text at the matches and join the pieces with the replacements between them."""
    text = F.col(text_col)
    found = matches(text)
    rest = F.split(text, PATTERN)
    body = F.array_join(F.zip_with(rest, F.transform(found, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.withColumns({"n_entities": F.coalesce(F.size(found), F.lit(0)), text_col: F.when(text.rlike(HINT), body).otherwise(text)})
