"""Personal data replaced by keyed surrogates of the same type and form, in DataFrame functions only.

An entity is a kind and a normal form (digits of a number, lower-case letters of an
address or a name; each given and family name is one of its own).  Its surrogate follows from a secret key, kind and normal form alone,
so all mentions in all documents agree, whatever their punctuation:

* email: letters by letters, digits by digits, the last label stays;
* IPv4 address: each number by one of as many digits that is valid;
* card: digits, the last one making a valid Luhn sum;
* phone: digits; after a plus sign the country code, split from the digits alone, stays;
* social security number and IBAN: digits by digits, letters by letters;
* person after a title: the title stays; given names become given names of the gender that
  most titles of the name tell, the family name is made of syllables; the script stays.
  What a title has introduced is replaced in the whole text, also without the title.

Each mention keeps its own punctuation, length (but for names) and case.  Where the forms
of a length are taken, later attempts are wider: any valid numbers of an address, a longer
local part, more digits of a phone number, more syllables.

Distinct names have distinct surrogates, so persons of one family keep one family name; a
given name that finds none of the list free gets a made one behind it.

Distinctness is checked over the corpus: entities whose surrogate another one has, or that
is itself an entity of the corpus, get a further attempt until none is left.  Only distinct
entities are compared; attempts other than the first, which are few, go back to the
documents through a join, as do given names with titles of several genders.

Null texts stay null and empty texts empty.  Texts without entities stay as they are.
Equal texts get equal answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satchel.functions.binding import let
from satchel.llm.common import fresh
from satchel.plans.session import stage

# Titles by the gender they tell, and given names by gender and script.
TITLES = {"m": "Mr|Sir|Herr|Monsieur|Señor|Don", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Doña", "n": "Dr|Prof|Mx"}
GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nico Oscar Paul Robert Simon Thomas Victor".split(),
    "f": "Ada Bella Clara Diana Emma Flora Greta Hanna Irene Julia Klara Laura Maria Nina Olga Paula Rosa Sofia Tina Vera".split(),
    "n": "Alex Andrea Charlie Dominique Jamie Jules Kim Lou Noa Robin Sam Sascha Toni Chris Eden Jordan Morgan Quinn Sky Val".split(),
}
CYRILLIC = {
    "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Тимур Юрий Яков Андрей Илья".split(),
    "f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лариса Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия Яна".split(),
}
CYRILLIC_TITLES = {"m": "г-н|господин", "f": "г-жа|госпожа"}
_UPPER, _NAME = r"\p{Lu}", r"\p{Lu}[\p{L}'’-]+"
# Kinds in the order in which they are tried, and the characters that do not count.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+", ""),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])", r"[^\p{L}\p{N}]"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", ""),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", r"\D"),
    ("phone", r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
              r"|(?<![\p{L}\d])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", r"\D"),
    ("card", r"(?<![\d.])(?:\d[ -]?){12,18}\d(?!\d)", r"\D"),
    ("person", r"(?<![\p{L}\p{N}])(?:" + "|".join([*TITLES.values(), *CYRILLIC_TITLES.values()]) + r")\.? " + _NAME + "(?: " + _NAME + "){0,2}", r"^\S+ "),
)
KINDS = [k for k, _, _ in PATTERNS]
ANY = "|".join(f"(?:{p})" for _, p, _ in PATTERNS)
# A quick look that every pattern passes, so most texts are read once: first letters before whole titles.
_ALL_TITLES = [t for table in (TITLES, CYRILLIC_TITLES) for names in table.values() for t in names.split("|")]
TITLE = r"^(?:" + "|".join(_ALL_TITLES) + r")\.? "
# What every match of a kind holds; an email address is looked for by its @ alone.
HINTS = {
    "iban": r"[A-Z][A-Z][0-9][0-9]",
    "ip": r"[0-9]\.[0-9]",
    # At least five digits after a plus, or a digit followed by five characters of a number.
    "phone": r"\+[0-9][0-9 .-]{4}|[0-9][0-9 .()-]{5}",
    "person": r"(?=[" + "".join(sorted({t[0] for t in _ALL_TITLES})) + "])(?:" + "|".join(_ALL_TITLES) + r")\.? \p{Lu}",
}
HINT = "|".join(HINTS.values())
# Fixed value: country codes of one and two digits; all others have three, and none begins another.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: Attempts at a given name that stay within the list.
LISTED_ATTEMPTS = 4
#: From this attempt on a surrogate may be longer than its entity, by one more character each time.
WIDE = 4
#: Further attempts for an entity, at most; each makes a clash that much rarer.
MOST_ATTEMPTS = 50


def _hash(key: Column, kind: Column, form: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    text = F.concat_ws("\u0001", key, kind, form, attempt.cast("string"))
    return F.sha2(F.concat(F.sha2(text, 256), key, text), 512)


def _number(digest: Column, i: Column, below: int | Column) -> Column:
    """A number for position ``i``, from two digits of the hash and one that depends on how often it was used."""
    at = F.pmod(i * 2, F.lit(124)) + 1
    value = F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") + F.floor(i / 62).cast("int") * 7
    return F.pmod(value, below if isinstance(below, Column) else F.lit(below))


def _letter(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n + 1, F.lit(1))


_LATIN, _RUSSIAN, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "0123456789"


def _by_class(c: Column, digest: Column, i: Column) -> Column:
    """A character of the same class."""
    return (F.when(c.rlike("[0-9]"), _letter(_DIGITS, _number(digest, i, 10)))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter(_RUSSIAN, _number(digest, i, len(_RUSSIAN))))
            .when(c.rlike(r"\p{L}"), _letter(_LATIN, _number(digest, i, 26))).otherwise(c))


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _ip(form: Column, digest: Column, attempt: Column) -> Column:
    def octet(part: Column, i: Column) -> Column:
        size, n = F.length(part), _number(digest, i * 3, 1 << 16)
        return (F.when(attempt >= WIDE, F.pmod(n, F.lit(256))).when(size == 1, F.pmod(n, F.lit(9)) + 1).when(size == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(155)) + 100)).cast("string")

    return F.array_join(F.transform(F.split(form, r"\."), octet), ".")


def _luhn(digits: Column) -> Column:
    """``digits`` with its last one changed so that the Luhn sum is valid."""
    n = F.length(digits)
    body = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1))
    total = F.aggregate(body, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.concat(F.substring(digits, F.lit(1), n - 1), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _person(family: bool, form: Column, gender: Column, key: Column, attempt: Column) -> Column:
    """The surrogate of one name.  The first attempts at a given name are names of the list alone."""

    def made(digest: Column) -> Column:
        russian = form.rlike(r"\p{IsCyrillic}")

        def pick(table: dict[str, list[str]]) -> Column:
            found = F
            for g, given in table.items():
                value = F.element_at(F.array(*map(F.lit, given)), _number(digest, F.lit(5), len(given)) + 1)
                found = found.when(gender == g, value)
            return found.otherwise(F.element_at(F.array(*(F.lit(x) for given in table.values() for x in given)), _number(digest, F.lit(5), sum(map(len, table.values()))) + 1))

        def syllables(consonants: str, vowels: str) -> Column:
            first, more = (F.concat(*(x for k in ks for x in (
                _letter(consonants, _number(digest, F.lit(8 * k + 7), len(consonants))), _letter(vowels, _number(digest, F.lit(8 * k + 11), len(vowels)))))) for ks in (range(4), range(4, 6)))
            return F.initcap(F.concat(first, F.when(attempt >= WIDE, more).otherwise("")))

        whole = F.when(russian, syllables("бвгдзклмнпрст", "аеио")).otherwise(syllables("bdfgklmnprstvz", "aeiou"))
        if family:
            return whole
        first = F.when(russian, pick(CYRILLIC)).otherwise(pick(GIVEN))
        return F.when(attempt < LISTED_ATTEMPTS, first).otherwise(F.concat(first, F.lit("-"), whole))

    return let(_hash(key, F.lit("family" if family else "given"), form, attempt), made)


def kind_of(mention: Column) -> Column:
    found = F
    for kind, pattern, _ in PATTERNS:
        found = found.when(mention.rlike(rf"^(?:{pattern})$"), kind)
    # Look-arounds see only the mention here, so it has a kind.
    return found.otherwise(KINDS[-1])


def _gender(mention: Column) -> Column:
    found = F
    for titles in (TITLES, CYRILLIC_TITLES):
        for gender, names in titles.items():
            found = found.when(mention.rlike(rf"^(?:{names})\.? "), gender)
    return found.otherwise("n")


def normal_form(kind: Column, mention: Column) -> Column:
    found = F
    for name, _, idle in PATTERNS[:-1]:
        lower = F.lower(mention)
        plain = F.regexp_replace(lower, idle, "") if idle else lower
        if name == "phone":
            plain = F.when(mention.startswith("+"), F.regexp_replace(F.concat(F.lit("+"), plain), rf"^\+({COUNTRY})", "+$1 ")).otherwise(plain)
        found = found.when(kind == name, plain)
    return found.otherwise(_untitled(mention))


def _untitled(mention: Column) -> Column:
    """The names of a mention of a person in lower case, without possessive endings, which are no part of a name."""
    return F.regexp_replace(F.lower(F.regexp_replace(mention, TITLE, "")), r"(?:['’]s|['’-]+)$", "")


def surrogate_form(kind: Column, form: Column, gender: Column, key: Column, attempt: Column) -> Column:
    """The normal form of the surrogate, with its capitals for a name.  The hash is bound, so that it is computed once and not for each character."""

    extra = F.greatest(attempt - (WIDE - 1), F.lit(0))
    roomy = (F.when(kind == "email", F.replace(form, F.lit("@"), F.concat(F.repeat(F.lit("x"), extra), F.lit("@"))))
             .when(kind == "phone", F.concat(form, F.repeat(F.lit("0"), extra))).otherwise(form))

    def made(digest: Column) -> Column:
        return let(roomy, lambda wide: filled(wide, digest))

    def filled(form: Column, digest: Column) -> Column:
        changed = F.array_join(F.transform(_chars(form), lambda c, i: _by_class(c, digest, i)), "")
        last = F.length(F.regexp_extract(form, r"\.[^.]*$", 0))
        code = F.length(F.regexp_extract(form, r"^\+\d+ ", 0))
        return (F.when(kind == "email", F.concat(F.substring(changed, F.lit(1), F.length(form) - last), F.substring(form, F.length(form) - last + 1, last)))
                .when(kind == "ip", _ip(form, digest, attempt)).when(kind == "card", let(changed, _luhn))
                .when(kind == "phone", F.concat(F.substring(form, F.lit(1), code), F.substring(changed, code + 1, F.length(form))))
                .when(kind == "iban", F.concat(F.substring(form, 1, 2), F.substring(changed, F.lit(3), F.length(form)))).otherwise(changed))

    return F.when(kind == "family", _person(True, form, gender, key, attempt)).when(kind == "given", _person(False, form, gender, key, attempt)).otherwise(let(_hash(key, kind, form, attempt), made))


def lay(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the form of the mention: its punctuation, capitals and title."""

    def over(idle: str, mention: Column, made: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), idle, "")) if idle else i + 1
            new = F.substring(made, place, F.lit(1))
            counts = ~c.rlike(idle) if idle else F.lit(True)
            return F.when(counts, F.when(c.rlike(_UPPER), F.upper(new)).otherwise(new)).otherwise(c)

        return F.array_join(F.transform(_chars(mention), at), "")

    found = F.when(kind == "ip", made).when(kind == "person", F.concat(
        F.regexp_extract(mention, TITLE, 0), made, F.regexp_extract(mention, r"(?:['’]s|['’-]+)$", 0)))
    for name, _, idle in PATTERNS[:-1]:
        if name == "phone":
            digits = F.regexp_replace(made, idle, "")
            longer = F.concat(mention, F.repeat(F.lit("0"), F.length(digits) - F.length(F.regexp_replace(mention, idle, ""))))
            found = found.when(kind == name, let(longer, lambda m: over(idle, m, digits)))
        elif name == "email":
            longer = F.replace(mention, F.lit("@"), F.concat(F.repeat(F.lit("x"), F.length(made) - F.length(mention)), F.lit("@")))
            found = found.when(kind == name, let(longer, lambda m: over(idle, m, made)))
        elif name != "ip":
            found = found.when(kind == name, over(idle, mention, made))
    return found.otherwise(mention)


def _mentions(text: Column) -> Column:
    """The mentions of a text in order; none for most texts after a quick look."""
    return F.when(F.contains(text, F.lit("@")) | text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pieces(mention: Column, introduced: Column | None = None) -> Column:
    """``kind, form, gender`` of what is replaced in a mention: each name of a person, else the whole.

    ``introduced``: the pieces of the text's titled persons, which tell what a single name without a title is.
    """

    def of(kind: Column) -> Column:
        def named(x: Column) -> Column:
            names, gender, titled = F.split(x["form"], " "), x["gender"], mention.rlike(TITLE)

            def piece(name: Column, i: Column) -> Column:
                family = i == F.size(names) - 1
                told = gender
                if introduced is not None:
                    same = F.filter(introduced, lambda k: k["form"] == name)
                    family &= titled | (F.size(names) > 1) | (F.size(same) == 0) | F.exists(same, lambda k: k["kind"] == "family")
                    first = F.get(F.filter(same, lambda k: k["kind"] == "given"), F.lit(0))["gender"]
                    told = F.when(titled, gender).otherwise(F.coalesce(first, F.lit("n")))
                return F.struct(F.when(family, "family").otherwise("given").alias("kind"), name.alias("form"), F.when(family, "").otherwise(told).alias("gender"))

            return F.transform(names, piece)

        form = normal_form(kind, mention)
        return F.when(kind == "person", let(F.struct(form.alias("form"), _gender(mention).alias("gender")), named)).otherwise(
            F.array(F.struct(kind.alias("kind"), form.alias("form"), F.lit("").alias("gender"))))

    return let(kind_of(mention), of)


def _introduced(mentions: Column) -> Column:
    """The names that titles introduce, as pieces, and ``form`` of a whole person of several names with kind ``person``."""
    titled = F.filter(mentions, lambda m: m.rlike(TITLE))
    whole = F.transform(titled, lambda m: F.struct(F.lit("person").alias("kind"), _untitled(m).alias("form"), F.lit("").alias("gender")))
    return F.array_distinct(F.concat(F.filter(whole, lambda x: x["form"].contains(" ")), F.flatten(F.transform(titled, lambda m: _pieces(m)))))


def _with_names(introduced: Column) -> Column:
    """The pattern of all mentions of a text whose titles introduce these names, longest first.  Names hold letters, apostrophes and dashes only."""
    forms = F.array_sort(F.array_distinct(F.transform(introduced, lambda x: F.struct((-F.length(x["form"])).alias("n"), x["form"].alias("form")))))
    return F.concat(F.lit(ANY + r"|(?:(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(F.transform(forms, lambda x: x["form"]), "|"), F.lit(r")(?![\p{L}\p{N}]))"))


def _found(text: Column, mentions: Column) -> Column:
    """``m``, the mention, and ``pieces`` for all mentions of a text, those without titles too; and ``gaps``, the text between them."""

    def placed(introduced: Column) -> Column:
        def parts(ms: Column, known: Column | None) -> Column:
            return F.transform(ms, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"), _pieces(m, known).alias("pieces")))

        def all_(pattern: Column) -> Column:
            return F.struct(parts(F.regexp_extract_all(text, pattern, F.lit(0)), introduced).alias("parts"), F.split(text, pattern).alias("gaps"))

        return F.when(F.size(introduced) > 0, let(_with_names(introduced), all_)).when(
            F.size(mentions) > 0, F.struct(parts(mentions, None).alias("parts"), F.split(text, F.lit(ANY)).alias("gaps")))

    return let(_introduced(mentions), placed)


def entities(docs: DataFrame) -> DataFrame:
    """The distinct ``kind, form`` of the corpus, the ``gender`` that most mentions of a given name tell, and whether mentions differ in it (``mixed``).

    Mentions are distinct within documents and tasks before they are shuffled.
    """
    found = docs.select(F.explode(F.array_distinct(_mentions(F.col("text")))).alias("mention")).distinct()
    pieces = found.select(F.explode(_pieces(F.col("mention"))).alias("e")).select("e.*")
    told = pieces.groupBy("kind", "form").agg(*(F.count_if(F.col("gender") == g).alias(g) for g in "mfn"))
    return told.select("kind", "form", F.when(F.col("kind") != "given", "").when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender"),
                       (F.least("m", F.lit(1)) + F.least("f", F.lit(1)) + F.least("n", F.lit(1)) > 1).alias("mixed"))


def attempts(known: DataFrame, key: str) -> DataFrame:
    """``kind, form, gender, attempt`` of the entities that need another attempt than the first, or whose mentions differ in gender.

    An entity gives way if its surrogate is an entity of the corpus, or if one of smaller
    normal form has it too.
    """
    own = stage(known.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(MOST_ATTEMPTS):
        made = own.select("kind", "form", F.lower(surrogate_form(F.col("kind"), F.col("form"), F.col("gender"), F.lit(key), F.col("attempt"))).alias("made"))
        made = stage(made, "made")
        first = made.groupBy("kind", "made").agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "made", "first")
        taken = own.select("kind", F.col("form").alias("made"), F.lit(True).alias("taken"))
        again = stage(made.join(first, ["kind", "made"], "left").join(taken, ["kind", "made"], "left")
                      .where("taken OR form <> first").select("kind", "form"), "clashes")
        if not again.limit(1).count():
            break
        again = again.withColumn("more", F.lit(1))
        own = stage(own.join(again, ["kind", "form"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more"), "entities")
    else:
        raise RuntimeError("Surrogates still clash.")
    return own.where("attempt > 0 OR mixed").select("kind", "form", "gender", "attempt")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and a last column of counts, named by ``fresh("entities", docs)``.

    The column is a struct: ``n_entities`` mentions, and one count for each kind.
    """
    later = attempts(entities(docs), key)
    at, side, other, held = fresh("entities", docs), fresh("attempts", docs), fresh("attempts_id", docs), fresh("attempts_text", docs)
    has_later = bool(later.limit(1).count())
    text, usual = F.col("text"), lambda x: F.struct(x["gender"].alias("gender"), F.lit(0).alias("attempt"))
    if has_later:
        # By id and text, so that rows which share an id do not collect each other's entities; a null id is one too.
        named = docs.select("doc_id", F.xxhash64("text").alias(held), F.explode(F.array_distinct(F.flatten(F.transform(_mentions(text), lambda m: _pieces(m))))).alias("e"))
        named = named.select("doc_id", held, "e.kind", "e.form").distinct().join(later, ["kind", "form"])
        named = named.groupBy(F.col("doc_id").alias(other), held).agg(F.map_from_entries(F.collect_list(
            F.struct(F.concat_ws(":", "kind", "form"), F.struct("gender", "attempt")))).alias(side))
        docs_ = docs.join(named, docs.doc_id.eqNullSafe(named[other]) & (F.xxhash64(docs.text) == named[held]), "left")

        def answer(x: Column) -> Column:
            return F.coalesce(F.element_at(F.col(side), F.concat_ws(":", x["kind"], x["form"])), usual(x))
    else:
        docs_, answer = docs, usual

    def made(x: Column) -> Column:
        return let(answer(x), lambda a: surrogate_form(x["kind"], x["form"], a["gender"], F.lit(key), a["attempt"]))

    def rebuilt(found: Column) -> Column:
        parts = F.coalesce(found["parts"], F.array().cast("array<struct<m: string, kind: string, pieces: array<struct<kind: string, form: string, gender: string>>>>"))
        new = F.transform(parts, lambda x: let(F.array_join(F.transform(x["pieces"], made), " "), lambda whole: lay(x["kind"], x["m"], whole)))
        whole = F.array_join(F.zip_with(found["gaps"], new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

        def count(kind: str) -> Column:
            return F.size(F.filter(parts, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

        return F.struct(F.when(F.size(parts) > 0, whole).otherwise(text).alias("text"), F.size(parts).cast("bigint").alias("n_entities"), *map(count, KINDS))

    # Generated as rows, so that the fields that are taken from it do not each evaluate it anew.
    found = let(F.coalesce(_mentions(text), F.array().cast("array<string>")), lambda ms: _found(text, ms))
    done = docs_.select(*(docs[c] for c in docs.columns), F.explode(F.transform(F.array(found), rebuilt)).alias(at))
    return done.select(*(F.col(at)["text"].alias(c) if c == "text" else F.col(c) for c in docs.columns), F.col(at).dropFields("text").alias(at))
