"""PII surrogates: keyed replacements of the same type, format, script and gender.

DataFrame functions only. One regular expression with a branch for each type
cuts a text into pieces and entities; every entity is replaced, the pieces are
left alone. A replacement is a function of a secret key, the type and the
entity's normal form (so the same person, number or address has the same
surrogate in every document):

* e-mail: letters and digits of the local part and of the domain's first label
  by others of their kind and case; the rest of the domain stays;
* phone, card, SSN: the digits, in the same format; a phone keeps its country
  code, a card its first digit and a valid check digit;
* IPv4: four numbers from 1 to 254;
* IBAN: country and format stay, letters and digits by others of their kind;
* name: title, given names and surname. A title stays, which keeps the gender.
  A listed given name goes to another of its gender and script, by a keyed
  permutation of the list, so no two share one; any other word of a name goes
  to syllables of its script. Words go by themselves, so ``Dr. Ann Cole`` and
  ``Ms. Cole`` stay one family.

A name is what follows a title, a listed given name with another capitalised
word, or two and more capitalised words after a cue such as ``Name:``. The
surnames found so in a document are then names wherever they stand in it, with
the capitalised word before them (``Xander Cole`` beside ``Ms. Cole``), unless
that is an article or the like.

Distinctness: two entities of a type may get the same surrogate by chance, or
one that is itself an entity of the corpus. After a first pass over all
documents such entities are found by a join on (type, surrogate); all but the
least of them take their key's next attempt, until none is left. Surnames are
entities of their own here, whatever stands before them. Where a small
space of short mailboxes or phones is too full for that, those left after
``MAX_ATTEMPTS`` rounds take longer surrogates: letters more at the end of a
local part, a group of digits more in a phone, syllables more in a surname. If
even then some are left, the job ends with an error. Only documents with such
entities meet their exceptions, by a join on the text's digest; what is joined
is sent to all tasks where it is small.

Nulls and empty texts stay as they are, with no entity. Long texts are one row of
a task, with work in proportion to their length. Repeated rows each get their
own result, which is the same for the same text. Of entities that could begin at
the same place the first type in ``TYPES`` counts. An empty table gives an empty
result. Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.shared import BROADCAST_BYTES, BROADCAST_ROWS, cut

KEY = "surrogate-key"
MAX_ATTEMPTS = 24
#: Rounds with longer surrogates after these.
LONGER_ATTEMPTS = 8

# Given names by script and gender, titles, cues, and words that are no names though capitalised.
GIVEN = {
    ("latin", "f"): "Agnes Alice Amelia Anna Beatrice Camille Carla Carmen Chloe Clara Diana Elena Elsa Emily Emma Eva Fatima Fiona Frieda Grace Greta Hannah Helen Ines Ingrid Irene Jane Jessica Julia Karen Laura Leila Linda Lucia Maria Marie Mary Mia Nora Olivia Paula Rosa Ruth Sarah Sofia Susan Teresa Ursula Vera Zoe".split(),
    ("latin", "m"): "Adam Ahmed Alan Albert Andrew Anton Bruno Carl Carlos Charles Daniel David Diego Edward Eric Felix Frank George Hans Henry Hugo Ivan James Jean John Jorge Jose Karl Kevin Kurt Leon Liam Louis Luis Marco Mark Martin Michael Miguel Omar Oscar Otto Pablo Paul Peter Pierre Robert Samuel Thomas William Xavier".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Пётр Сергей".split(),
}
TITLES = "Mrs|Miss|Ms|Frau|Mme|Madame|Señora|Sra|Mr|Herr|Monsieur|Señor|Sr|Dr|Prof|Sir|Dame".split("|")
CUES = "[Nn]ame|[Cc]ontact|[Aa]uthor|[Ss]igned|[Pp]atient|[Cc]ustomer|[Ee]mployee|[Rr]ecipient|[Ss]ender|[Rr]egards,|[Ss]incerely,"
NO_NAMES = "The|A|An|In|On|At|And|But|Or|For|To|Of|By|With|From|As|If|So|Then|When|That|This|Der|Die|Das|Und|Ein|Eine|Le|La|Les|Et|Un|Une|De|Du|El|Los|Las|Y|Una"
# Syllables of surnames.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ho ka ko la le lo ma me mo na ne no pa pe ra re ro sa so ta te".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ро са со та то".split(),
}
WORD_NAME = r"[\p{Lu}][\p{Ll}]+(?:[-'’][\p{Lu}][\p{Ll}]+)?"
_ALL_GIVEN = "|".join(dict.fromkeys(n for names in GIVEN.values() for n in names))

#: A local part takes in all its characters, however many; a domain has at most 127 labels.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,125}\.\p{L}{2,}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD = r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{13}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
_CUE = rf"(?<=(?:{CUES})(?:: | is |:| ))"
NAME = rf"(?:(?:{'|'.join(TITLES)})\.? (?:{WORD_NAME} )?{WORD_NAME}|(?:{_ALL_GIVEN}) {WORD_NAME}|{_CUE}{WORD_NAME}(?: {WORD_NAME}){{1,2}})"
TYPES = (("email", EMAIL), ("iban", IBAN), ("ip", IP), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("name", NAME))
#: Before an entity no word character may stand, after it neither. Names are tried at capitals only.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_BRANCHES = "|".join((EMAIL, IBAN, rf"(?<![.]){IP}(?![.][0-9])", CARD, SSN, PHONE, rf"(?=\p{{Lu}}){NAME}"))
ENTITY = rf"{_BEFORE}(?:{_BRANCHES}){_AFTER}"
#: Any entity has one of these; texts without are not searched further.
HINT = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|(?=\p{{Lu}})(?:{_BEFORE}(?:{'|'.join(TITLES)}|{_ALL_GIVEN})[. ]|{_CUE})"


def entity_type(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.rlike(value, F.lit(rf"^{IP}$")), "ip")
        .when(F.rlike(value, F.lit(r"^[A-Z]{2}[0-9]{2}")), "iban")
        .when(F.rlike(value, F.lit(rf"^{SSN}$")), "ssn")
        .when(F.rlike(value, F.lit(r"^[0-9][0-9 -]*$")) & (digits >= 15), "card")
        .when(F.rlike(value, F.lit(r"^[+(0-9]")), "phone")
        .otherwise("name")
    )


def normal_form(kind: Column, value: Column) -> Column:
    """What two mentions of one entity share."""
    return (
        F.when(kind == "email", F.lower(F.regexp_replace(value, "^[._%+-]+", "")))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def _number(stem: Column, k: Column | int, modulus: int) -> Column:
    """A number below ``modulus`` for place k of a keyed stem."""
    place = F.lit(k) if isinstance(k, int) else k
    return F.conv(F.substring(F.sha2(F.concat(stem, F.lit(":"), place.cast("string")), 256), 1, 12), 16, 10).cast("long") % modulus


def _stem(key: str, kind, form: Column, attempt: Column) -> Column:
    return F.concat(F.lit(f"{key}|"), kind if isinstance(kind, Column) else F.lit(kind), F.lit("|"), form, F.lit("|"), attempt.cast("string"))


def _shift(stem: Column, index: Column, letters: str) -> Column:
    return F.substr(F.lit(letters), (_number(stem, index, len(letters)) + 1).cast("int"), F.lit(1))


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"


def _same_kind(stem: Column, text: Column, fold_case: bool = False) -> Column:
    """Letters and digits by others of their kind. The k-th letter or digit depends on k only, so other signs don't matter."""
    one = lambda c, k: (
        F.when(F.rlike(c, F.lit("^[0-9]$")), _shift(stem, k, DIGITS))
        .when(F.rlike(c, F.lit("^[a-z]$")), _shift(stem, k, LOWER))
        .when(F.rlike(c, F.lit("^[A-Z]$")), F.upper(_shift(stem, k, LOWER)) if fold_case else _shift(stem, k, UPPER))
        .when(F.rlike(c, F.lit(r"^\p{IsCyrillic}$")), F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(_shift(stem, k, CYRILLIC))).otherwise(_shift(stem, k, CYRILLIC)))
        .when(F.rlike(c, F.lit(r"^[\p{L}\p{N}]$")), _shift(stem, k, LOWER))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(text, ""), lambda c, k: one(c, k)), "")


def _digits(stem: Column, value: Column, fixed: Column) -> Column:
    """The digits of ``value`` after the first ``fixed`` ones by others; the format stays."""
    chars = F.split(value, "")
    seen = lambda k: F.length(F.regexp_replace(F.substr(value, F.lit(1), k + 1), "[^0-9]", ""))
    return F.array_join(F.transform(chars, lambda c, k: F.when(F.rlike(c, F.lit("^[0-9]$")) & (seen(k) > fixed), _shift(stem, seen(k), DIGITS)).otherwise(c)), "")


def _card(stem: Column, value: Column) -> Column:
    """As ``_digits`` with the first digit kept and the last one the Luhn check digit."""
    drawn = _digits(stem, value, F.lit(1))
    plain = F.regexp_replace(drawn, "[^0-9]", "")
    n = F.length(plain)
    weigh = lambda d, k: F.when((n - k) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    body = F.transform(F.split(F.substr(plain, F.lit(1), n - 1), ""), lambda c, k: weigh(c.cast("int"), k))
    check = (10 - F.aggregate(body, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10) % 10
    return F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), check.cast("string"))


def _surname(key: str, word: Column, attempt: Column) -> Column:
    """Five syllables of the word's script, two more for each attempt over ``MAX_ATTEMPTS``."""
    stem = _stem(key, "surname", word, attempt)

    def made(script: str) -> Column:
        s = F.array(*map(F.lit, SYLLABLES[script]))
        one = lambda k: F.element_at(s, (_number(stem, k, len(SYLLABLES[script])) + 1).cast("int"))
        count = F.lit(4) + 2 * F.greatest(F.lit(0), attempt - MAX_ATTEMPTS)
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count), one), ""))

    return F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), made("cyrillic")).otherwise(made("latin"))


def given_names(key: str = KEY) -> dict[str, str]:
    """Every listed given name -> the next one of its gender and script in an order that the key makes."""
    out: dict[str, str] = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        out |= {a: b for a, b in zip(order, order[1:] + order[:1], strict=True) if a not in out}
    return out


def _is_title(word: Column) -> Column:
    return F.rlike(word, F.lit(rf"^(?:{'|'.join(TITLES)})\.?$"))


def _surnames(value: Column) -> Column:
    """The words of a name that are neither its title nor a listed given name."""
    return F.filter(F.split(value, " "), lambda w: ~_is_title(w) & ~w.isin(*_ALL_GIVEN.split("|")))


def components(value: Column) -> Column:
    """The entities of their own in a mention, as structs of kind and value: a name's surnames, or the mention itself."""
    kind = entity_type(value)
    return F.when(kind == "name", F.transform(_surnames(value), lambda w: F.struct(F.lit("surname").alias("kind"), w.alias("value")))).otherwise(
        F.array(F.struct(kind.alias("kind"), value.alias("value")))
    )


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY, surnames: bool = True) -> Column:
    """Of an entity (a surname, not a whole name); null for a surname if these aren't asked for."""
    form = normal_form(kind, value)
    stem = _stem(key, kind, form, attempt)
    lead = F.regexp_extract(value, "^[._%+-]*", 0)
    at = F.instr(value, "@")
    local, domain = F.substr(value, F.length(lead) + 1, at - 1 - F.length(lead)), F.substring_index(value, "@", -1)
    label = F.substring_index(domain, ".", 1)
    longer = attempt - MAX_ATTEMPTS
    more = F.translate(F.sha2(F.concat(stem, F.lit(":longer")), 256), DIGITS, "ghijklmnop")
    more = F.when(longer > 0, F.substr(more, F.lit(1), 4 * longer)).otherwise("")
    group = F.when(longer > 0, F.concat(F.lit("-"), F.lpad(_number(stem, 1000, 10000).cast("string"), 4, "0"))).otherwise("")
    moved = _same_kind(F.concat(F.lit(f"{key}|domain|"), F.lower(domain)), label, True)
    email = F.concat(lead, _same_kind(stem, local, True), more, F.lit("@"), moved, F.substr(domain, F.length(label) + 1, F.length(domain)))
    ip = F.concat_ws(".", *[(_number(stem, k, 254) + 1).cast("string") for k in range(4)])
    code = F.length(F.regexp_extract(value, r"^\+([0-9]+)[ .(-]", 1))
    iban = F.concat(F.substr(value, F.lit(1), F.lit(2)), _same_kind(stem, F.substr(value, F.lit(3), F.length(value))))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(stem, value))
        .when(kind == "ssn", _digits(stem, value, F.lit(0)))
        .when(kind == "phone", F.concat(_digits(stem, value, code), group))
        .when(kind == "iban", iban)
        .otherwise(_surname(key, value, attempt) if surnames else F.lit(None))
    )


def with_entities(df: DataFrame) -> DataFrame:
    """``df``, whose ``text`` is looked through, with ``found`` (its entities) and ``pieces`` (what stands between them; null if nothing is found).

    Once with the fixed expression; where that finds names, again with the surnames in it, and the capitalised
    word before each. Words of names are letters, hyphens and apostrophes, so they are patterns of themselves.
    """
    none = F.array().cast("array<string>")
    text, entity = F.col("text"), F.lit(ENTITY)
    df = df.withColumn("found", F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, entity, F.lit(0))).otherwise(none))
    called = F.filter("found", lambda v: F.rlike(v, F.lit(r"^\p{Lu}\p{Ll}")) & (entity_type(v) == "name"))
    df = df.withColumn("known", F.array_distinct(F.transform(called, lambda v: F.element_at(F.split(v, " "), -1))))
    own = F.concat(F.lit(rf"{_BEFORE}(?:{_BRANCHES}|(?=\p{{Lu}})(?:(?!(?:{NO_NAMES}) ){WORD_NAME} )?(?:"), F.array_join("known", "|"), F.lit(rf")){_AFTER}"))
    df = df.withColumn("cuts", F.when(F.size("known") > 0, own))
    df = df.withColumn("found", F.when(F.col("cuts").isNotNull(), F.regexp_extract_all(text, F.col("cuts"), F.lit(0))).otherwise(F.col("found")))
    pieces = F.when(F.col("cuts").isNotNull(), F.split(text, F.col("cuts"), -1)).when(F.size("found") > 0, F.split(text, ENTITY, -1))
    return df.withColumn("pieces", pieces).drop("known", "cuts")


def _name_of(kind: Column, value: Column) -> Column:
    """The key of an entity in a map of exceptions."""
    return F.concat(kind, F.lit("|"), value)


def exceptions(docs: DataFrame, key: str = KEY) -> DataFrame | None:
    """kind, value, surrogate of the entities that can't take their first surrogate; None if there are none."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mentions = with_entities(docs.select("text")).select(F.explode(F.array_distinct("found")).alias("mention")).distinct()
    found = mentions.select(F.explode(components(F.col("mention"))).alias("e")).select("e.kind", "e.value").distinct()
    # A number of its own keeps surrogates, which take long, from being made in one task.
    seen = found.repartition(tasks, "kind", "value").withColumn("form", normal_form(F.col("kind"), F.col("value")))
    taken = seen.select("kind", "value", "form", F.lit(0).alias("attempt"))
    taken = cut(taken.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    originals = taken.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("original"))
    moved = None
    for n in range(MAX_ATTEMPTS + LONGER_ATTEMPTS):
        # Forms, not spellings, must differ: spellings of one entity move together.
        shared = taken.groupBy("kind", "surrogate").agg(F.min("form").alias("least"), F.max("form").alias("most"))
        clash = taken.join(shared, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        clash = clash.where("(least <> most and form <> least) or original").select("kind", "form").distinct().withColumn("again", F.lit(1))
        clash = cut(clash)
        if not clash.limit(1).count():
            break
        moved = True
        least = 0 if n < MAX_ATTEMPTS else MAX_ATTEMPTS + 1
        after = F.when(F.col("again").isNull(), F.col("attempt")).otherwise(F.greatest(F.col("attempt") + 1, F.lit(least)))
        taken = taken.join(clash, ["kind", "form"], "left").withColumn("attempt", after).drop("again")
        again = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)
        taken = cut(taken.select("kind", "value", "form", "attempt", F.when(F.col("attempt") > 0, again).otherwise(F.col("surrogate")).alias("surrogate")))
    else:
        raise RuntimeError("entities still share surrogates after the last round")
    return taken.where("attempt > 0").select("kind", "value", "surrogate") if moved else None


def _special(docs: DataFrame, special: DataFrame) -> DataFrame:
    """id (a text's digest), special (a map of the exceptions in it), of the texts that hold one."""
    held = with_entities(docs.select("text")).select(F.md5("text").alias("id"), F.explode(F.array_distinct("found")).alias("mention"))
    held = held.select("id", F.explode(components(F.col("mention"))).alias("e")).select("id", "e.kind", "e.value")
    size = lambda df, *c: df.agg(F.count("*"), F.coalesce(F.sum(sum((F.octet_length(x) for x in c), F.lit(0))), F.lit(0))).first()
    fits = lambda n: n[0] <= BROADCAST_ROWS and n[1] <= BROADCAST_BYTES
    few = F.broadcast(special) if fits(size(special, "value", "surrogate")) else special
    pairs = cut(held.join(few, ["kind", "value"]).select("id", _name_of(F.col("kind"), F.col("value")).alias("value"), "surrogate").distinct())
    own = pairs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("special"))
    return F.broadcast(own) if fits(size(pairs, "id", "value", "surrogate")) else own


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc (a struct of all columns of ``docs``, with the new text) and kinds, the types of the entities in order."""
    special = exceptions(docs, key)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    out = with_entities(docs.select(row, F.col("text").alias("text")))
    if special is None:
        out = out.withColumn("special", F.lit(None).cast("map<string,string>"))
    else:
        out = out.join(_special(docs, special), F.md5(out["text"]) == F.col("id"), "left")
    known = lambda kind, v: F.try_element_at(F.col("special"), _name_of(kind, v))
    given = F.create_map(*[F.lit(x) for pair in given_names(key).items() for x in pair])
    first = F.lit(0)
    word = lambda w: F.when(_is_title(w), w).otherwise(F.coalesce(F.try_element_at(given, w), known(F.lit("surname"), w), _surname(key, w, first)))
    other = lambda kind, v: F.coalesce(known(kind, v), surrogate(kind, v, first, key, False))
    new = lambda v: F.when(entity_type(v) == "name", F.array_join(F.transform(F.split(v, " "), word), " ")).otherwise(other(entity_type(v), v))
    out = out.withColumn("new", F.transform("found", new))
    joined = F.array_join(F.zip_with("pieces", "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    return out.select(F.col("doc").withField("text", text).alias("doc"), F.transform("found", entity_type).alias("kinds"))


def _count(kind: str) -> Column:
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace_entities(docs)
    return out.select("doc.doc_id", *(_count(n).alias(f"n_{n}") for n, _ in TYPES), "doc.text")


def keep_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with surrogates in the text, same columns."""
    return replace_entities(docs).select("doc.*")
