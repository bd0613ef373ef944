"""Keyed surrogates for personal data and secrets, in native DataFrame operations.

Detected entities are replaced by surrogates of the same type, drawn from a keyed hash: an e-mail address
stays one with the same lengths and character classes (longer where a domain has no such address left), a card number keeps its first digit, grouping and a
right check digit, a phone number its country code and punctuation, an address four octets, a key its
prefix and alphabet, and a name after a title becomes a name of the same gender, script and number of words.
One entity has one surrogate in the whole corpus (coreference). Surrogates are checked over all entities:
two entities never share one, and none is an entity that occurs; an entity that collides is drawn again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import save

# fixed values: formats of the entity types, in order of precedence
# (no group is repeated without bound: the engine would recurse once per repetition and overflow its stack; a local
# part has 64 characters at most, so that a long run of its characters is not read again from each of them)
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9\-][A-Za-z0-9.\-]*(?<!\.)\.[A-Za-z]{2,}"
TOKEN = r"(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])"
KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
CARD = r"(?<![\d.\-])(?:\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\d\-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ \-]?\(?\d{2,4}\)?[ \-]?\d{3,4}[ \-]?\d{3,4}(?!\d)"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d|\d)"
# fixed values: titles that tell the gender of the name after them
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
NAME = r"(?<![\p{L}])(?:" + "|".join(FEMALE_TITLES + MALE_TITLES) + r")\.? \p{Lu}[\p{L}'\-]+(?: \p{Lu}[\p{L}'\-]+)?"
#: every entity has one of these; texts without are not searched further
SIGN = r"[@\d]|(?:" + "|".join(FEMALE_TITLES + MALE_TITLES) + r")\.? \p{Lu}"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, TOKEN, KEY, CARD, PHONE, ADDRESS, NAME))
# fixed values: given names by script and gender, and syllables of family names by script
GIVEN = {
    "latin": {"f": ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Sofia"], "m": ["Adam", "David", "Felix", "Hugo", "Leon", "Martin", "Paul", "Victor"]},
    "cyrillic": {"f": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"], "m": ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел", "Роман", "Юрий"]},
    "greek": {"f": ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Νίκη", "Σοφία", "Χλόη"], "m": ["Αλέξης", "Γιώργος", "Θωμάς", "Κώστας", "Λουκάς", "Νίκος", "Πέτρος", "Φίλιππος"]},
}
SYLLABLES = {"latin": ["ba", "del", "fo", "gar", "hen", "kol", "lin", "mar", "nor", "pel", "ros", "sal", "tan", "ver", "wil", "zan"],
             "cyrillic": ["ба", "дел", "фо", "гар", "жен", "кол", "лин", "мар", "нор", "пел", "рос", "сал", "тан", "вер", "вил", "зан"],
             "greek": ["βα", "δελ", "φο", "γαρ", "θεν", "κολ", "λιν", "μαρ", "νορ", "πελ", "ροσ", "σαλ", "ταν", "βερ", "ξιλ", "ζαν"]}

#: rounds of draws before an e-mail's surrogate grows by a letter
WIDEN = 4


def kind(entity: Column) -> Column:
    """Type of a detected entity."""
    out = F.when(F.contains(entity, F.lit("@")), "email").when(entity.rlike(f"^(?:{TOKEN})$"), "token").when(entity.rlike(f"^(?:{KEY})$"), "key")
    return out.when(F.startswith(entity, F.lit("+")), "phone").when(entity.rlike(f"^(?:{ADDRESS})$"), "address").when(entity.rlike(r"^\d"), "card").otherwise("name")


def normal(entity: Column, type_: Column) -> Column:
    """What makes two mentions one entity: e-mail in lower case, card and phone by their digits."""
    return F.when(type_ == "email", F.lower(entity)).when(type_.isin("card", "phone"), F.regexp_replace(entity, r"\D", "")).otherwise(entity)


def _draw(digest: Column, i: Column, n: Column | int) -> Column:
    """The i-th keyed number below n from a 128-digit hexadecimal digest."""
    return F.pmod(F.conv(F.substring(digest, F.pmod(i * 3, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int") + i, F.lit(n) if isinstance(n, int) else n)


def _letter(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at + 1, F.lit(1))


def _each(text: Column, digest: Column, change) -> Column:
    """``change(character, position)`` over the characters of a text, joined again."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), change), "")


def _masked(text: Column, digest: Column, first: Column) -> Column:
    """Letters and digits from position ``first`` on become keyed ones of their class; the rest stays."""
    def one(c, i):
        return (F.when((i < first) | ~c.rlike("[0-9A-Za-z]"), c).when(c.rlike("[0-9]"), _letter("0123456789", _draw(digest, i, 10)))
                .when(c.rlike("[a-z]"), _letter("abcdefghijklmnopqrstuvwxyz", _draw(digest, i, 26))).otherwise(_letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(digest, i, 26))))
    return _each(text, digest, one)


def _checked(digits: Column) -> Column:
    """15 digits and the check digit that makes a card number right."""
    def value(c, i):
        n = c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)
    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)
    return F.concat(digits, F.pmod(-total, F.lit(10)).cast("string"))


def surrogate(norm: Column, type_: Column, round_: Column, secret: str) -> Column:
    """The keyed surrogate of a normalised entity, in its normal form."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), type_, norm, round_.cast("string")), 512)
    at = F.instr(norm, "@")
    # where draws keep colliding, letters before the local part widen the space, one more every WIDEN rounds
    wider = F.when(round_ >= WIDEN, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(round_ / WIDEN).cast("int"))),
                                                             lambda i: _letter("abcdefghijklmnopqrstuvwxyz", _draw(digest, i + 30, 26))), "")).otherwise("")
    email = F.concat(wider, _masked(F.substring(norm, F.lit(1), at - 1), digest, F.lit(0)), F.substring(norm, at, F.length(norm)))
    hexes = _each(norm, digest, lambda c, i: F.lower(_letter("0123456789abcdef", _draw(digest, i, 16))))
    key = F.concat(F.lit("AKIA"), _each(F.substring(norm, 5, 16), digest, lambda c, i: _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _draw(digest, i, 32))))
    keep = F.greatest(F.lit(1), F.length(norm) - 10)
    first = F.when(F.length(norm) > 10, keep).otherwise(F.lit(2))
    phone = _each(norm, digest, lambda c, i: F.when(i < first, c).when(i == first, _letter("23456789", _draw(digest, i, 8))).otherwise(_letter("0123456789", _draw(digest, i, 10))))
    card = _checked(F.concat(F.substring(norm, 1, 1), _each(F.substring(norm, 2, 14), digest, lambda c, i: _letter("0123456789", _draw(digest, i, 10)))))
    address = F.array_join(F.transform(F.split(norm, r"\."), lambda c, i: (_draw(digest, i, 254) + 1).cast("string")), ".")

    title = F.regexp_extract(norm, r"^(\S+) ", 1)
    female = F.regexp_replace(title, r"\.$", "").isin(FEMALE_TITLES)
    person = F.substring(norm, F.length(title) + 2, F.length(norm))
    name = F.lit(None).cast("string")
    for script, test in (("cyrillic", person.rlike(r"\p{IsCyrillic}")), ("greek", person.rlike(r"\p{IsGreek}")), ("latin", F.lit(True))):
        given = F.when(female, F.array(*map(F.lit, GIVEN[script]["f"]))[_draw(digest, F.lit(20), 8)]).otherwise(F.array(*map(F.lit, GIVEN[script]["m"]))[_draw(digest, F.lit(20), 8)])
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + F.floor(round_ / 4).cast("int")), lambda i: parts[_draw(digest, i + 4, 16)]), ""))
        name = F.coalesce(name, F.when(test, F.concat_ws(" ", title, F.when(F.contains(person, F.lit(" ")), given), family)))
    return (F.when(type_ == "email", email).when(type_ == "token", hexes).when(type_ == "key", key).when(type_ == "phone", phone)
            .when(type_ == "card", card).when(type_ == "address", address).otherwise(name))


def formatted(mention: Column, type_: Column, replacement: Column) -> Column:
    """A surrogate in the format of one mention: its grouping, and capitals where an e-mail has them."""
    def grouped(c, i):
        before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike(r"\d"), F.substring(replacement, before + 1, F.lit(1))).otherwise(c)
    def cased(c, i):
        other = F.substring(replacement, more + i + 1, F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(other)).otherwise(other)
    more = F.length(replacement) - F.length(mention)
    email = F.concat(F.substring(replacement, F.lit(1), more), _each(mention, mention, cased))
    return F.when(type_.isin("card", "phone"), _each(mention, mention, grouped)).when(type_ == "email", email).otherwise(replacement)


def mapping(entities: DataFrame, secret: str) -> DataFrame:
    """(type, norm, replacement) for distinct entities (type, norm): all replacements differ within a type
    and none is an entity. Draws again, for the entities that collide, until none is left."""
    open_, done = save(entities.withColumn("round", F.lit(0)), "entities"), None
    while True:
        drawn = save(open_.withColumn("replacement", surrogate(F.col("norm"), F.col("type"), F.col("round"), secret)), "drawn")
        taken = entities.select("type", F.col("norm").alias("replacement")).withColumn("hit", F.lit(True))
        if done is not None:
            taken = taken.unionByName(done.select("type", "replacement").withColumn("hit", F.lit(True)))
        first = drawn.groupBy("type", "replacement").agg(F.min("norm").alias("first"))
        judged = save(drawn.join(first, ["type", "replacement"]).join(taken, ["type", "replacement"], "left")
                      .withColumn("good", F.col("hit").isNull() & (F.col("norm") == F.col("first"))), "judged")
        good = judged.where("good").select("type", "norm", "replacement")
        done = good if done is None else done.unionByName(good)
        open_ = judged.where("NOT good").select("type", "norm", (F.col("round") + 1).alias("round"))
        if open_.isEmpty():
            return done


def replace_entities(docs: DataFrame, secret: str = "kgweave", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_entities, n_replaced, text): every document with its entities replaced.

    The text between entities stays as it is. A null text stays null with no entities; an empty text stays
    empty. Repeated rows, and equal entities in any documents, get equal surrogates under one ``secret``.
    Rows need not have distinct or non-null ids. Other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = save(rows.withColumn("found", found).withColumn("row", F.expr("uuid()")), "texts")
    plain = rows.where("found IS NULL OR size(found) = 0").select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_replaced"), "text")
    some = rows.where("size(found) > 0")
    typed = kind(F.col("entity"))
    mentions = save(some.select("row", F.posexplode("found").alias("at", "entity")).withColumn("type", typed).withColumn("norm", normal(F.col("entity"), F.col("type"))), "mentions")
    table = save(mapping(mentions.select("type", "norm").distinct(), secret), "surrogates")
    new = (mentions.join(table, ["type", "norm"]).withColumn("new", formatted(F.col("entity"), F.col("type"), F.col("replacement")))
           .groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda s: s["new"]).alias("new")))
    pieces = F.split("text", ENTITY, -1)
    built = F.concat(F.array_join(F.transform("new", lambda n, i: F.concat(pieces[i], n)), ""), pieces[F.size("new")])
    changed = F.size(F.filter(F.arrays_zip("found", "new"), lambda z: z["found"] != z["new"])).cast("long")
    done = some.join(new, "row").select("doc_id", F.size("found").cast("long").alias("n_entities"), changed.alias("n_replaced"), built.alias("text"))
    return plain.unionByName(done)
