"""Surrogates for personal data: detected entities get keyed, type-consistent replacements. DataFrame functions only.

Entities are mail addresses, network addresses, phone, card and social security numbers, account numbers (IBAN), secrets
(long hex strings, quoted values of token, secret, password and the like, keys with a known beginning) and names after a form of address. The canonical form of
an entity (type, lower case, separators dropped) gets one surrogate for the whole corpus, so mentions in different spelling
or in different documents stay the same person. Surrogates are made from SHA-2 of key, type and canonical form: digits for
digits, letters of the same script and case for letters, names with the ending of the same gender. Two canonical forms with
equal surrogates, or a surrogate that is itself an entity of the corpus, are found by grouping and tried again with the next
round number until all are distinct.

Names are replaced word by word, so a family name has one surrogate with and without a given name. A family name found behind
a form of address is also replaced where it stands alone in the same text.

Only texts with an entity are shuffled, by a hash of the text; copies of a text share one list of replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import fresh, store

#: Next digit of a phone number at the brackets of an area code.
_BRACKETS = r"(?<=\+[0-9]{1,3})[ .-]?\([0-9]|(?<=\([0-9]{1,5})\)[ .-]?[0-9]"
#: A country code of one digit and ten digits in any groups; or 5 to 15 digits in all, in whole groups, of which only the first
#: after the code and a bracketed one may be a single digit. The total keeps the next number out.
INTERNATIONAL = (
    rf"\+(?:[17]|[0-9](?=[ .(-]))(?:[ .-]?[0-9]|{_BRACKETS}){{10}}(?!\p{{N}})"
    rf"|\+[0-9](?:[0-9]|[ .-][0-9](?=[0-9])|(?<=\+[0-9]{{1,3}})[ .-][0-9]|{_BRACKETS}){{4,14}}(?!\p{{N}})(?<!\([0-9]{{1,5}})"
    r"|\+[0-9]{1,3}[ .-]?\([0-9]{1,5}\)[ .-]?(?:[0-9]{3}[ .-]?[0-9]{3,4}|[0-9]{5,8})(?!\p{N})|"
)
#: Initials between a form of address and a name; they stay.
INITIALS = r"(?:\p{Lu}\. ?(?:\p{Lu}\. ?(?:\p{Lu}\. ?)?)?)?"
#: Types in order of precedence, with the pattern of a whole entity. Cheap tests stand before costly ones: a pattern is
#: tried at every position of a text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "assigned": r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey)[\"']? ?[=:] ?[\"'])[^\"'\n]{6,}+(?=[\"'])|(?<![\p{L}\p{N}])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+)(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:\p{N}{1,3}\.){3}\p{N}{1,3}(?!\.?\p{N})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": INTERNATIONAL + r"(?<![\p{L}\p{N}])\([0-9]{2,5}\) ?[0-9]{3}[ .-][0-9]{4}(?!\p{N})|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{N}-])",
    "female": rf"(?=\p{{Lu}})(?<=[ .])(?<=(?:(?:Mrs|Ms)\.?|Miss|Frau|Mme|Madame|Señora|Sra\.|г-жа|госпожа) {INITIALS})\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
    "male": rf"(?=\p{{Lu}})(?<=[ .])(?<=(?:Mr\.?|Herrn?|Monsieur|Señor|Sr\.|г-н|господин) {INITIALS})\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these in it or, a form of address, before it: a cheap test ahead of the patterns.
HINT = r"[@\p{N}=:]|A[KS]IA|gh[pousr]_|sk-|[a-fA-F]{32}|Mr|Ms|Miss|Frau|Herr|Mme|Madame|Monsieur|Señor|Sra?\. |г-|госпо"
_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрстф", "greek": "βγδζκλμνπρστφχ"}
#: Types whose values are words of names.
NAMES = ("female", "male")
#: Written with or without separators.
NUMBERS = ("phone", "card", "ssn", "iban")
MAX_ROUNDS = 64


def kind_of(value: Column, before: Column | None = None) -> Column:
    """Type of a matched entity. The forms of address stand before a name, so its gender is told from ``before``."""
    kind = F.lit("assigned")
    if before is not None:
        female = before.rlike(r"(?:Mrs\.?|Ms\.?|Miss|Frau|Mme|Madame|Señora|Sra\.|г-жа|госпожа) " + INITIALS + "$")
        male = before.rlike(r"(?:Mr\.?|Herrn?|Monsieur|Señor|Sr\.|г-н|господин) " + INITIALS + "$")
        kind = F.when(female, "female").when(male, "male").otherwise(kind)
    for name in ("phone", "ssn", "card", "iban", "ip", "secret", "email"):
        kind = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def canonical(value: Column, kind: Column) -> Column:
    """Lower case, numbers without separators; assigned secrets as they are."""
    digits = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return F.when(kind == "assigned", value).when(kind.isin(*NUMBERS), F.lower(digits)).otherwise(F.lower(value))


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2^32 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))


def surrogate(kind: Column, value: Column, round_: Column, key: str) -> Column:
    """Replacement of a canonical form, character by character: digits for digits, letters of the same script for letters.

    Kept: all punctuation, the country of an account, hex letters in hex strings. Octets of network
    addresses stay below 256; mail domains end in the reserved ``.example``. A word of a name becomes syllables of the same
    script with the usual ending of the gender, longer with later rounds.
    """
    def character(c: Column, i: Column) -> Column:
        n = _number(key, kind, value, round_, i)
        hexed = (kind == "secret") & c.rlike("[a-f]")
        fixed = (kind == "iban") & (i < 2)
        return (
            F.when(fixed, c).when(c.rlike("[0-9]"), _pick("0123456789", n)).when(hexed, _pick("abcdef", n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, n)).when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, n))
            .when(c.rlike(r"\p{Lu}"), F.upper(_pick(_LATIN, n))).when(c.rlike(r"\p{L}"), _pick(_LATIN, n)).when(c.rlike(r"\p{N}"), _pick("0123456789", n))
            .otherwise(c)
        )

    spelled = F.array_join(F.transform(F.split(value, ""), character), "")
    mail = F.concat(F.regexp_replace(spelled, r"\.[^.@]*$", ""), F.lit(".example"))
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (_number(key, kind, value, round_, i) % 256).cast("string")), ".")

    def name(script: str, female: str, male: str) -> Column:
        vowels, consonants = _VOWELS[script], _CONSONANTS[script]
        syllables = F.transform(F.sequence(F.lit(0), F.lit(1) + round_), lambda i: F.concat(_pick(consonants, _number(key, value, round_, i, F.lit("c"))), _pick(vowels, _number(key, value, round_, i, F.lit("v")))))
        return F.concat(F.array_join(syllables, ""), _pick(consonants, _number(key, value, round_, F.lit("end"))), F.when(kind == "female", female).otherwise(male))

    cyrillic, greek = name("cyrillic", "а", "ор"), name("greek", "α", "ος")
    names = F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).when(value.rlike(r"\p{IsGreek}"), greek).otherwise(name("latin", "a", "o"))
    return F.when(kind.isin(*NAMES), names).when(kind == "email", mail).when(kind == "ip", octets).otherwise(spelled)


def _cased(new: Column, like: Column) -> Column:
    """New text in the case of the old one: capitals at the beginning of words, or throughout."""
    upper = (like == F.upper(like)) & (like != F.lower(like))
    return F.when(upper, F.upper(new)).when(like.rlike(r"^\p{Lu}"), F.initcap(new)).otherwise(new)


def spell(new: Column, kind: Column, mention: Column) -> Column:
    """A surrogate in the format of the mention it replaces: separators of numbers, upper or lower case."""
    # The i-th letter or digit of the mention gives way to the i-th of the surrogate.
    def step(s: Column, c: Column) -> Column:
        one = F.substr(new, s["at"] + 1, F.lit(1))
        put = F.struct(F.concat(s["text"], F.when(c.rlike(r"\p{Lu}"), F.upper(one)).otherwise(one)).alias("text"), (s["at"] + 1).alias("at"))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), put).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["at"].alias("at")))

    spelled = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)["text"]
    return F.when(kind == "assigned", new).when(kind.isin(*NUMBERS), spelled).otherwise(_cased(new, mention))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct surrogates (kind, value, surrogate) for distinct (kind, value).

    In every round all open values get a candidate. A candidate is given away if no entity of the corpus is spelled like it
    and no earlier surrogate is; of several values with one candidate the smallest gets it. The others go on.
    """
    known = store(entities.select("kind", "value").distinct(), "entities")
    open_, done, round_ = known, None, 0
    while not open_.isEmpty():
        if round_ == MAX_ROUNDS:
            raise ValueError("Too few surrogates of some form for the values that have it.")
        tried = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(round_), key))
        first = tried.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("owner"))
        won = first.select(F.col("owner.kind").alias("kind"), F.col("owner.value").alias("value"), "surrogate")
        # Numbers are compared without their separators, as entities are.
        won = won.join(known.select(F.col("value").alias("surrogate")).distinct(), "surrogate", "left_anti")
        if done is not None:
            won = won.join(done.select("surrogate"), "surrogate", "left_anti")
        won = store(won.select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = store(open_.join(won, ["kind", "value"], "left_anti"), "open")
        round_ += 1
    return done if done is not None else known.withColumn("surrogate", F.lit(""))


def _read(text: Column, pattern: Column, alone: Column | None = None) -> Column:
    """Array of (kind, value, mention) of the matches of a pattern; ``alone`` is a map from lone family names to their kind."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.struct(b.alias("before"), m.alias("mention")))

    def read(p: Column) -> Column:
        kind = kind_of(p["mention"], p["before"])
        if alone is not None:
            kind = F.when(kind == "assigned", F.coalesce(F.try_element_at(alone, p["mention"]), kind)).otherwise(kind)
        return F.struct(kind.alias("kind"), canonical(p["mention"], kind).alias("value"), p["mention"].alias("mention"))

    return F.transform(F.filter(pairs, lambda p: p["mention"].isNotNull()), read)


def mentions(text: Column) -> Column:
    """Array of (kind, value, mention) of all entities but lone family names, in order of the text."""
    return _read(text, F.lit(ENTITY))


def family_names(found: Column) -> Column:
    """Map from the last words of the names among the mentions, as spelled, to the kind of the first one."""
    names = F.filter(found, lambda m: m["kind"].isin(*NAMES))
    last = F.transform(names, lambda m: F.struct(F.element_at(F.split(m["mention"], " "), -1).alias("word"), m["kind"].alias("kind")))
    words = F.array_distinct(F.transform(last, lambda n: n["word"]))
    return F.map_from_arrays(words, F.transform(words, lambda w: F.element_at(F.filter(last, lambda n: n["word"] == w), 1)["kind"]))


def pattern_of(families: Column) -> Column:
    """The entity pattern of a text with the family names that it may repeat without a form of address."""
    # Names are letters, apostrophes and hyphens: nothing that a pattern would read otherwise.
    words = F.array_join(F.map_keys(families), "|")
    return F.when(F.size(families) > 0, F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ENTITY))


def replace_entities(documents: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The rows with their columns, entities in the text replaced, and one column more: ``entities`` (a fresh name if taken).

    It lists kind and surrogate as spelled for each mention, in order. Null stays null; texts without an entity are returned
    as they are. Repeated rows and null ids are rows like any other. An empty table gives no rows.
    """
    own = {n: fresh(documents.columns, n) for n in ("entities", "text_key", "given", "families")}
    text = F.col(f"`{text_column}`")
    kept = [F.col(f"`{c}`") for c in documents.columns]
    hit = F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))
    listed = "array<struct<kind: string, surrogate: string>>"
    plain = documents.where(~hit).select(*kept, F.array().cast(listed).alias(own["entities"]))

    hits = documents.where(hit).withColumn(own["text_key"], F.sha2(text.cast("binary"), 256))
    read = hits.select(F.col(own["text_key"]).alias("text_key"), text.alias("text"), mentions(text).alias("found")).withColumn("families", family_names(F.col("found")))
    whole = F.when(F.size("families") > 0, _read(F.col("text"), pattern_of(F.col("families")), F.col("families"))).otherwise(F.col("found"))
    found = store(read.select("text_key", "families", whole.alias("found")).groupBy("text_key").agg(F.any_value("found").alias("found"), F.any_value("families").alias("families")), "mentions")
    each = found.select("text_key", F.posexplode("found").alias("place", "m")).select("text_key", "place", "m.*")
    # A name is given away word by word, anything else as a whole.
    def words(c: str) -> Column:
        return F.when(F.col("kind").isin(*NAMES), F.split(F.col(c), " ")).otherwise(F.array(c))

    each = each.select("text_key", "place", "kind", F.posexplode(F.arrays_zip(words("value").alias("value"), words("mention").alias("mention"))).alias("part", "w")).select("text_key", "place", "kind", "part", "w.*")
    parts = each.join(assign(each, key), ["kind", "value"]).select("text_key", "place", "kind", "part", spell(F.col("surrogate"), F.col("kind"), F.col("mention")).alias("surrogate"))
    given = parts.groupBy("text_key", "place", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda p: p["surrogate"]), " ").alias("surrogate"))
    lists = given.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "surrogate"))).alias("given"))
    lists = lists.join(found.select("text_key", "families"), "text_key")
    lists = lists.select(F.col("text_key").alias(own["text_key"]), F.transform("given", lambda g: F.struct(g["kind"], g["surrogate"])).cast(listed).alias(own["given"]), F.col("families").alias(own["families"]))

    put = F.array_join(F.zip_with(F.split(text, pattern_of(F.col(own["families"])), -1), own["given"], lambda b, g: F.concat(b, F.coalesce(g["surrogate"], F.lit("")))), "")
    replaced = hits.join(lists, own["text_key"]).select(
        *[put.alias(c) if c == text_column else F.col(f"`{c}`") for c in documents.columns], F.col(own["given"]).alias(own["entities"])
    )
    return plain.unionByName(replaced)
