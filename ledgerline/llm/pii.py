"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Detected by pattern: e-mail and IP addresses (4 and 6), phone, card, bank account and
social-security numbers, birth dates after a word that names them, hexadecimal secrets, and
names after a title; and, in a document that holds such a name, its words wherever else they
stand there without the title. A replacement keeps the format: digits for digits, letters for
letters of the same case, separators in place; IP octets stay octets, dates stay dates, card
numbers keep their first digit and whether their check digit is right, a name gets a name of the
title's gender and the script it is written in.

Replacements are drawn by a keyed SHA-512 of kind and value, so a value is replaced alike
everywhere (names word by word, so "Mr. Jan Ek" and "Mr. Ek" still are one person), and cannot
be traced back without the key. The key is a parameter (or ``KEY_SETTING`` of the session); where
none is given a fresh one is drawn, which nobody keeps. Then replacements are checked: of values of
a kind that got the same one, all but one, and those whose replacement is itself a value of the
corpus, are drawn again. A format may have fewer values than that takes (there are 100 addresses
like ``1@2.co``), so from draw ``NARROW`` on replacements are widened, by four more digits or letters
each time (an e-mail's mailbox, a suffix of numbers, a second syllable of names): the values to
draw from grow 10,000-fold with each draw, so it ends however many values there are. A draw
writes the values that it settles and those that it leaves, nothing else.

Only DataFrame functions are used. Texts without digit, ``@``, long hexadecimal run and title are
told apart by a cheap test and not searched. Values are handled once per distinct value, not per
mention; mentions join them by value (a join whose hot keys Spark splits).

Defined results: a null text stays null in ``replace``; an empty text has no entities; rows
that repeat doc_id and text come out alike; an empty table gives no rows; other columns pass
through untouched. A word that has a title of either gender in one document is replaced, where
it stands alone, by the first of its replacements.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, join_same

#: Session setting that names the key when no parameter does.
KEY_SETTING = "spark.ledgerline.surrogateKey"
#: Draws in the value's own format before replacements are widened.
NARROW = 6

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds of entities and their patterns; an earlier one is tried first at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)",
    "ip6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,6}:[0-9A-Fa-f]{1,4}(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "born": r"(?<=(?:[Bb]orn|[Bb]irth|DOB|[Gg]eboren am|[Nn]ée? le|[Nn]acid[oa] el)(?: on|:)? )\d{1,2}[./-]\d{1,2}[./-]\d{4}(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ -]?)?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?!\w)"
             r"|(?<![\w+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w+.-])0\d{2,4} \d{3,4} \d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)",
    "name": r"(?<!\w)(?:(?:Mr|Mrs|Ms|Sr|Sra)\.|Mr|Mrs|Ms|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|г-н|г-жа) \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity but a name holds, and what every title starts with.
SIGNS, TITLES = r"[0-9@]|[a-f]{32}|[A-F]{32}", ["Mr", "Ms", "Sr", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "г-"]
FEMALE_TITLES = ["Mrs.", "Mrs", "Ms.", "Ms", "Sra.", "Frau", "Mme", "Madame", "Señora", "г-жа"]
#: Replacement names by part, gender and script.
NAMES = {
    "given_male_latin": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Tomas Viktor".split(),
    "given_female_latin": "Anna Berta Clara Diana Emma Flora Greta Helena Ida Julia Karin Laura Maria Nora Olga Paula Rosa Sara Teresa Vera".split(),
    "family_male_latin": "Abel Brandt Costa Dahl Ekman Falk Garner Holm Iversen Jansen Keller Lind Moran Novak Olsen Perrin Roth Soler Thorn Weber".split(),
    "given_male_cyrillic": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    "given_female_cyrillic": "Анна Вера Галина Дарья Елена Жанна Зоя Инна Ксения Лариса Мария Нина Ольга Полина Софья".split(),
    "family_male_cyrillic": "Агеев Белов Волков Громов Дроздов Ершов Зуев Исаев Крылов Лосев Марков Носов Орлов Попов Рогов".split(),
    "family_female_cyrillic": "Агеева Белова Волкова Громова Дроздова Ершова Зуева Исаева Крылова Лосева Маркова Носова Орлова Попова Рогова".split(),
}
NAMES["family_female_latin"] = NAMES["family_male_latin"]


def found(text: Column) -> Column:
    """All entities of a text, in order."""
    maybe = reduce(lambda x, y: x | y, [text.rlike(SIGNS), *[text.contains(t) for t in TITLES]])
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(value: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        # what stands before a birth date is not part of it
        pattern = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}" if kind == "born" else PATTERNS[kind]
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _stream(key: str, kind: Column, value: Column, attempt: int) -> Column:
    """512 keyed hexadecimal digits."""
    return F.concat(*[F.sha2(F.concat_ws("\x00", F.lit(key), kind, F.lit(str(attempt)), F.lit(str(i)), value).cast("binary"), 512)
                      for i in range(4)])


def _draw(stream: Column, i: Column, digits: int = 4) -> Column:
    """The ``i``-th number of a stream."""
    return F.conv(F.substring(stream, (i * digits) % (512 - digits) + 1, F.lit(digits)), 16, 10).cast("long")


def _like(value: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits, letters for letters of the same case, all else as it is."""
    def one(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        if hexadecimal:
            fresh = F.substring(F.lit("0123456789abcdef"), (n % 16 + 1).cast("int"), F.lit(1))
            return F.when(c.rlike("[A-F]"), F.upper(fresh)).otherwise(fresh)
        return (F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
                 .when(c.rlike("[a-z]"), F.char(n % 26 + 97)).when(c.rlike("[A-Z]"), F.char(n % 26 + 65)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _like6(value: Column, stream: Column) -> Column:
    """Hexadecimal digits for digits and letters, colons in place."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == ":", c).otherwise(
        F.substring(F.lit("0123456789abcdef"), (_draw(stream, i) % 16 + 1).cast("int"), F.lit(1)))), "")


def _luhn(number: Column) -> Column:
    """Sum of the card check, 0 modulo 10 if the check digit is right."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                          .otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _last_digit(number: Column) -> Column:
    return F.substring(number, -1, 1).cast("int")


def _card(value: Column, stream: Column) -> Column:
    drawn = F.concat(F.substring(value, 1, 1), F.substr(_like(value, stream), F.lit(2)))
    off = (_luhn(value) - _luhn(drawn)) % 10
    last = (_last_digit(drawn) + off + 10) % 10
    return F.concat(F.substr(drawn, F.lit(1), F.char_length(drawn) - 1), last.cast("string"))


def _ip(value: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (_draw(stream, i) % 254 + 1).cast("string")), ".")


def _email(value: Column, stream: Column) -> Column:
    top = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    return F.concat(_like(F.substr(value, F.lit(1), F.char_length(value) - F.char_length(top)), stream), top)


def _phone(value: Column, stream: Column) -> Column:
    country = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ (-]))", 1)
    return F.concat(country, _like(F.substr(value, F.char_length(country) + 1), stream))


def _born(value: Column, stream: Column) -> Column:
    """A date in the same form: any day up to 28 of any month, in the same century."""
    parts, sep = F.split(value, "[./-]"), F.regexp_extract(value, "([./-])", 1)
    two = lambda i, most: F.lpad((_draw(stream, F.lit(i)) % most + 1).cast("string"), F.char_length(parts[i]), "0")
    # the order of day and month is not told by the form: both stay within 12 where both were
    first, second = (F.when(parts[i].cast("int") > 12, F.lpad((_draw(stream, F.lit(i)) % 16 + 13).cast("string"), 2, "0"))
                     .otherwise(two(i, 9)) for i in (0, 1))
    year = F.concat(F.substring(parts[2], 1, 2), F.lpad((_draw(stream, F.lit(2)) % 100).cast("string"), 2, "0"))
    return F.concat(first, sep, second, sep, year)


def _iban(value: Column, stream: Column) -> Column:
    return F.concat(F.substring(value, 1, 2), F.substr(_like(value, stream), F.lit(3)))


def _name(kind: Column, value: Column, stream: Column, attempt: int) -> Column:
    out = F.lit(None).cast("string")
    for k, names in NAMES.items():
        pick = lambda i, names=names: F.get(F.array(*map(F.lit, names)), (_draw(stream, F.lit(i), 8) % len(names)).cast("int"))
        fresh = pick(0)
        if attempt:
            fresh = F.concat(fresh, F.lit("-"), pick(1))
        if attempt > 4:  # names are few; the values may be many
            fresh = F.concat(fresh, F.lit("-"), F.initcap(_like(F.lit("a" * (6 + 3 * (attempt - 5))), stream)))
        out = F.when(kind == k, fresh).otherwise(out)
    return F.when((F.upper(value) == value) & (F.char_length(value) > 1), F.upper(out)).otherwise(out)


def _wider(kind: Column, out: Column, stream: Column, size: int) -> Column:
    """A replacement with ``size`` more characters."""
    digits = F.substring(_like(F.lit("0" * (size + 64)), stream), 65, size)
    letters = F.substring(_like(F.lit("a" * (size + 64)), stream), 65, size)
    at = F.instr(out, "@")
    return (F.when(kind == "email", F.concat(F.substring(out, F.lit(1), at - 1), letters, F.substr(out, at)))
             .when(kind == "secret", F.concat(out, digits)).otherwise(F.concat(out, F.lit("-"), digits)))


def _surrogate(values: DataFrame, key: str, attempt: int) -> DataFrame:
    """``values`` (``kind``, ``value``) with ``surrogate``."""
    v = values.withColumn("stream", _stream(key, F.col("kind"), F.col("value"), attempt))
    kind, value, stream = F.col("kind"), F.col("value"), F.col("stream")
    rule = {"email": _email(value, stream), "ip": _ip(value, stream), "phone": _phone(value, stream), "iban": _iban(value, stream),
            "ip6": _like6(value, stream), "born": _born(value, stream),
            "ssn": _like(value, stream), "card": _card(value, stream), "secret": _like(value, stream, True)}
    if attempt >= NARROW:
        rule = {k: _wider(kind, out, stream, 4 * (attempt - NARROW + 1)) for k, out in rule.items()}
    out = reduce(lambda rest, k: F.when(kind == k, rule[k]).otherwise(rest), rule, _name(kind, value, stream, attempt))
    return v.withColumn("surrogate", out).drop("stream")


def key_of(spark: SparkSession, key: str | None) -> str:
    """The key given, or the session's, or a fresh one."""
    return key or spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def surrogates(values: DataFrame, key: str | None = None) -> DataFrame:
    """``kind``, ``value``, ``surrogate`` for distinct ``values``: no two values of a kind share a
    replacement, and none is a value itself."""
    key = key_of(values.sparkSession, key)
    values = cut(values)
    done: list[DataFrame] = []
    open_, attempt = values, 0
    while not open_.isEmpty():
        drawn = _surrogate(open_, key, attempt)
        # of those that share a replacement the smallest keeps it
        owner = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"))
        taken = reduce(DataFrame.unionByName, [values.select("kind", F.col("value").alias("surrogate")),
                                               *[d.select("kind", "surrogate") for d in done]]).withColumn("taken", F.lit(True))
        told = cut(drawn.join(owner, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
                        .withColumn("ok", (F.col("owner") == F.col("value")) & F.col("taken").isNull()))
        done.append(told.filter("ok").select("kind", "value", "surrogate"))
        open_ = told.filter("NOT ok").select("kind", "value")
        attempt += 1
    return reduce(DataFrame.unionByName, done) if done else values.withColumn("surrogate", F.lit("")).filter("false")


def _parts(mention: Column) -> Column:
    """A mention as (kind, value) parts; parts of kind null stay as they are. A name is its
    title and one or two words, any other mention is one part."""
    words = F.split(mention, " ")
    gender = F.when(words[0].isin(FEMALE_TITLES), F.lit("female")).otherwise(F.lit("male"))
    last = F.size(words) - 1
    of = F.transform(words, lambda w, i: F.struct(
        F.when(i > 0, F.concat_ws("_", F.when(i == last, F.lit("family")).otherwise(F.lit("given")), gender,
                                  F.when(w.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin")))).alias("kind"),
        w.alias("value")))
    kind = _kind(mention)
    return F.when(kind == "name", of).otherwise(F.array(F.struct(kind.alias("kind"), mention.alias("value"))))


def replacements(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``doc_id``, ``fp``, ``fresh`` (the replacements of all entities of each document that has
    some, in order) and ``names`` (the words of its titled names and their replacements).
    ``docs``: ``doc_id``, ``fp``, ``text``."""
    held = cut(docs.select("doc_id", "fp", found(F.col("text")).alias("found")).filter("size(found) > 0").dropDuplicates(["doc_id", "fp"]))
    mentions = held.select("doc_id", "fp", F.posexplode("found").alias("pos", "mention"))
    parts = cut(mentions.select("doc_id", "fp", "pos", F.posexplode(_parts(F.col("mention"))).alias("sub", "part"))
                        .select("doc_id", "fp", "pos", "sub", "part.kind", "part.value"))
    settled = surrogates(parts.filter("kind IS NOT NULL").select("kind", "value").distinct(), key)
    fresh = parts.join(settled, ["kind", "value"], "left").withColumn("fresh", F.coalesce("surrogate", "value"))
    in_order = lambda col: F.transform(F.sort_array(col), lambda x: x["fresh"])
    # a document's own entities, no more than its text holds
    named = F.when(F.col("kind").rlike("^(given|family)_"), F.struct("value", "fresh"))
    per_mention = (fresh.groupBy("doc_id", "fp", "pos").agg(F.collect_list(F.struct("sub", "fresh")).alias("p"), F.collect_list(named).alias("names"))
                        .select("doc_id", "fp", "pos", F.array_join(in_order("p"), " ").alias("fresh"), "names"))
    return (per_mention.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("pos", "fresh", "names")).alias("m"))
                       .select("doc_id", "fp", in_order("m").alias("fresh"),
                               F.flatten(F.transform(F.sort_array("m"), lambda x: x["names"])).alias("names")))


def _without_names(gap: Column, names: Column) -> Column:
    """Text between entities, with the words of ``names`` (``value``, ``fresh``) replaced where they
    stand as words; all in one pass, so no replacement is replaced again."""
    words = F.array_distinct(F.transform(names, lambda x: x["value"]))
    first = F.transform(words, lambda w: F.get(F.filter(names, lambda x: x["value"] == w), F.lit(0))["fresh"])
    table = F.map_from_arrays(words, first)
    # longer words first: a word that starts like another does not hide it
    by_size = F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.char_length(w), w.alias("w"))))), lambda x: x["w"])
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(by_size, "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    rest = F.split(gap, pattern, -1)
    hits = F.regexp_extract_all(gap, pattern, F.lit(0))
    swapped = F.concat(F.get(rest, F.lit(0)), F.array_join(F.transform(hits, lambda w, i: F.concat(
        F.element_at(table, w), F.get(rest, i + 1))), ""))
    return F.when(F.size(words) > 0, swapped).otherwise(gap)


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None,
            key: str | None = None) -> DataFrame:
    """``docs`` with all entities of the text replaced; ``count_col``, if given, is added and
    tells how many there were."""
    rows = (docs.withColumn("__id", F.col(f"`{id_col}`"))
                .withColumn("__fp", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    new = replacements(rows.select(F.col("__id").alias("doc_id"), F.col("__fp").alias("fp"), text.alias("text")), key)
    new = new.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("fresh").alias("__fresh"), F.col("names").alias("__names"))
    rows = join_same(rows, new, "__id", "__fp", how="left")
    rows = rows.withColumn("__gaps", F.when(F.col("__fresh").isNotNull(), F.split(text, ANY, -1)))
    gaps = F.when(F.size("__names") > 0, F.transform("__gaps", lambda g: _without_names(g, F.col("__names")))).otherwise(F.col("__gaps"))
    rows = rows.withColumn("__gaps", gaps)
    cleaned = F.when(F.col("__fresh").isNull(), F.col(f"`{text_col}`")).otherwise(F.concat(
        F.get("__gaps", F.lit(0)),
        F.array_join(F.transform("__fresh", lambda r, i: F.concat(r, F.get(F.col("__gaps"), i + 1))), "")))
    cols = [(cleaned.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns]
    if count_col:
        cols.append(F.coalesce(F.size("__fresh").cast("long"), F.lit(0).cast("long")).alias(count_col))
    return rows.select(*cols)
