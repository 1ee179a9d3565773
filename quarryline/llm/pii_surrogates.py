"""Operator 4, PII: detected entities receive keyed surrogates of the same type, gender, script and format.

Everything that runs over the documents is DataFrame code. One pattern finds e-mail addresses, IPv4 addresses, card
numbers, IBANs, phone numbers and names of persons: a title, a known given name or a phrase that introduces a person,
with the capitalised words after it and further names joined by "and". Names that nothing marks as such aren't
found: two capitalised words may as well be a licence or a town. Within a document, the bare words of a name follow it
wherever they stand. A surrogate is a function of the key, the kind, the entity in canonical form and an attempt, so one
entity gets one surrogate everywhere (coreference: e-mail addresses without regard to case, numbers without regard to
their separators, persons word by word, so `Mr Smith` follows `John Smith`). The surface form is kept: separators,
capitals, country prefix, top level domain; given names are exchanged for names of the same gender and script, first by
a keyed rotation of fixed lists, then by made-up names with the ending of the gender; other words of a name become
made-up words of the same script.

Collision checks: surrogates of all distinct entities are compared with each other and with all originals; whoever
collides (but for the first) makes another attempt. Made-up names and addresses grow with the attempt. Numbers keep
their format for SAME_FORMAT attempts and grow from then on (an IPv4 address becomes an IPv6 one), as distinctness
goes before format; so however full a format is, each attempt has a larger space than the last, and the loop ends. Only
the few entities that needed more than one attempt are joined back to the documents that hold them.

A text is searched twice, once to gather the entities and once to replace them: the pattern puts a mark on either side
of a hit, and the marked text is split there. No part of the pattern recurses, so texts and runs of any length are read.

Cases: null texts stay null, empty ones empty; texts without entities come back unchanged; very long texts are
handled whole; repeated rows, ties and rows without an id get the surrogates that any other row with the entity gets; an
empty table gives an empty result; extra columns pass through `pseudonymised` whatever their names, unless they are
named n_entities, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import let, read_table, text_of, written

#: Given names by gender and script.
GIVEN = {
    "female latin": ("Alice", "Anna", "Carmen", "Catherine", "Claire", "Elena", "Emma", "Greta", "Hannah", "Ingrid", "Isabel", "Jane", "Laura", "Lucia", "Maria", "Marie", "Mary", "Olivia", "Sarah", "Sophie"),
    "male latin": ("Carlos", "David", "Diego", "Emil", "Felix", "Hans", "Henry", "James", "Jean", "John", "Jonas", "Klaus", "Louis", "Lukas", "Michael", "Pablo", "Paul", "Peter", "Robert", "Thomas"),
    "female cyrillic": ("Анна", "Вера", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    "male cyrillic": ("Александр", "Алексей", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей", "Юрий"),
    "female greek": ("Αγγελική", "Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
    "male greek": ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Professor", "Doctor", "Sir", "Lady", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Don", "Doña", "Господин", "Госпожа", "Κύριος", "Κυρία")
#: What stands before a person's name, and what joins two of them.
INTRODUCTIONS = ("my name is", "name is", "mein Name ist", "je m'appelle", "me llamo", "meine Kollegin", "mein Kollege", "signed by", "written by", "reported by", "according to", "dear", "sincerely,", "regards,", "меня зовут", "με λένε")
JOINERS = ("and", "&", "und", "et", "y", "и", "και")
SYLLABLES = {
    "latin": ("bar", "bel", "cor", "dan", "der", "fen", "gar", "hal", "kel", "lan", "mar", "nor", "per", "ros", "sel", "ver"),
    "cyrillic": ("бар", "вел", "гор", "дан", "жел", "зор", "кам", "лан", "мар", "нов", "пет", "рос", "сел", "тар", "фед", "чер"),
    "greek": ("βαρ", "γαλ", "δαν", "ερα", "ζην", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παν", "ροδ", "σελ", "τασ", "φιλ", "χρι"),
}
#: Endings of made-up given names.
ENDINGS = {"female latin": "a", "male latin": "o", "female cyrillic": "а", "male cyrillic": "ей", "female greek": "α", "male greek": "ος"}
ACCENTED = "áàâäéèêëíîïñóôöúùûüçß"
#: Attempts of a number in its own format; rounds after which something must be wrong.
SAME_FORMAT, MOST_ROUNDS = 8, 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}\p{L}++(?:[-'’]\p{Lu}\p{L}++)?"
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
_GIVEN = rf"(?:{'|'.join(n for names in GIVEN.values() for n in names)})(?!\p{{L}})"
_INTRODUCED = "|".join(f"(?<=(?i:{i}) )" for i in INTRODUCTIONS)
PATTERN = "|".join((
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"(?<![\d+])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    r"(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}{_WORD}(?: {_WORD}){{0,2}}|{_GIVEN} {_WORD}(?: {_WORD})?|(?:{_INTRODUCED}){_WORD}(?: {_WORD}){{0,2}})"
    rf"(?: (?:{'|'.join(JOINERS)}) (?:{_TITLE})?{_WORD}(?: {_WORD}){{0,2}}+)*+",
))
#: Stands on either side of a hit; where a text has these characters itself they are written otherwise meanwhile.
MARK, _ESCAPES = "\x01", (("\x02", "\x02\x04"), ("\x01", "\x02\x03"))


def marked(text: Column, pattern: Column | str = PATTERN) -> Column:
    """A text in parts: what stands between the hits, and, at every second place, the hits."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def escaped(text: Column) -> Column:
    for raw, written_as in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written_as))
    return text


def unescaped(text: Column) -> Column:
    for raw, written_as in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written_as), F.lit(raw))
    return text


def hits_of(parts: Column) -> Column:
    return F.filter(parts, lambda p, i: i % 2 == 1)


def kind_of(hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return (
        F.when(hit.contains("@"), "email")
        .when(hit.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4")
        .when(hit.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(hit.rlike(r"^\p{L}"), "person")
        .when(~hit.startswith("+") & digits.between(13, 19), "card")
        .otherwise("phone")
    )


def canonical(kind: Column, hit: Column) -> Column:
    return F.when(kind == "email", F.lower(hit)).when(kind == "ipv4", hit).when(kind == "iban", F.replace(hit, F.lit(" "), F.lit(""))).when(kind.isin("word", *GIVEN), F.lower(hit)).otherwise(F.regexp_replace(hit, "[^0-9+]", ""))


def _is_given(word: Column) -> Column:
    return F.initcap(word).isin([n for names in GIVEN.values() for n in names])


def _words(hit: Column) -> Column:
    return F.split(hit, " ")


def _is_name(word: Column) -> Column:
    """True for the words of a person's name that are neither titles nor what joins two names."""
    return word.rlike(r"^\p{Lu}") & ~F.rtrim(word, F.lit(".")).isin(list(TITLES))


def word_kind(word: Column) -> Column:
    """`word`, or the list that a given name is on."""
    out = F.lit("word")
    for group, names in GIVEN.items():
        out = F.when(F.initcap(word).isin(list(names)), group).otherwise(out)
    return out


def entities(hits: Column) -> Column:
    """(kind, canon) of what the hits of a text name; words of persons are entities of their own."""
    entity = lambda kind, c: F.struct(kind.alias("kind"), canonical(kind, c).alias("canon"))
    one = lambda h: F.when(kind_of(h) == "person", F.transform(F.filter(_words(h), _is_name), lambda w: entity(word_kind(w), w))).otherwise(F.array(entity(kind_of(h), h)))
    return F.array_distinct(F.flatten(F.transform(hits, one)))


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)


def _value(h: Column, i: Column) -> Column:
    """A number below 256 for place i, from two digits of a hash of 64."""
    return F.conv(F.substring(h, ((i - 1) * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int") + F.floor((i - 1) / 31).cast("int")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity."""
    entity = F.struct(kind.alias("kind"), canon.alias("canon"), attempt.alias("attempt"), _hash(key, kind, canon, attempt).alias("h"))
    return let(entity, lambda e: _surrogate(key, e["kind"], e["canon"], e["attempt"], e["h"]))


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column, h: Column) -> Column:
    chars = F.split(canon, "")
    tail = F.length(canon) - F.length(F.substring_index(canon, ".", -1)) - 1

    def changed(c: Column, i0: Column, top: Column) -> Column:
        i = i0 + 1
        v = _value(h, i)
        fixed = ((kind == "email") & (i > top)) | ((kind == "iban") & (i <= 2)) | ((kind == "phone") & (i == 2) & canon.startswith("+"))
        return (
            F.when(fixed, c)
            .when(c.rlike("[0-9]"), ((c.cast("int") + v) % 10).cast("string"))
            .when(c.rlike("[A-Z]"), F.char(F.lit(65) + v % 26))
            .when(c.rlike("[a-z]"), F.char(F.lit(97) + v % 26))
            .when(c.rlike(r"\p{L}"), F.substring(F.lit(ACCENTED), v % len(ACCENTED) + 1, F.lit(1)))
            .otherwise(c)
        )

    more = F.greatest(attempt - SAME_FORMAT, F.lit(0))
    digits = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (_value(h, i + 7) % 10).cast("string")), "")
    letters = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.char(F.lit(97) + _value(h, i + 7) % 26)), "")
    by_character = let(tail, lambda top: F.array_join(F.transform(chars, lambda c, i: changed(c, i, top)), ""))
    number = F.when(more > 0, F.concat(by_character, digits(F.greatest(more, F.lit(1))))).otherwise(by_character)
    email = F.when(attempt > 0, F.concat(letters(F.greatest(attempt, F.lit(1))), by_character)).otherwise(by_character)
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_value(h, i) % 256).cast("string")), ".")
    ip = F.when(more > 0, F.concat(F.lit("2001:db8::"), *(p for k in (1, 5, 9) for p in ((F.lit(":") if k > 1 else F.lit("")), F.substring(h, k, 4))))).otherwise(octets)
    made_up = lambda script, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.array(*map(F.lit, SYLLABLES[script])), _value(h, i) % 16)), "")
    script = _script(canon)
    word = F.when(script == "cyrillic", made_up("cyrillic", 4 + attempt)).when(script == "greek", made_up("greek", 4 + attempt)).otherwise(made_up("latin", 4 + attempt))
    out = F.when(kind == "ipv4", ip).when(kind == "word", word).when(kind == "email", email).otherwise(number)
    for group, names in GIVEN.items():
        shift = F.conv(F.substring(F.sha2(F.lit(f"{key}|{group}"), 256), F.lit(1), F.lit(6)), 16, 10).cast("int") % (len(names) - 1) + 1
        listed = F.array(*map(F.lit, names))
        turned = F.lower(F.get(listed, ((F.array_position(listed, F.initcap(canon)) - 1).cast("int") + shift) % len(names)))
        out = F.when(kind == group, F.when(attempt == 0, turned).otherwise(F.concat(made_up(group.split()[1], 1 + attempt), F.lit(ENDINGS[group])))).otherwise(out)
    return out


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like)), F.upper(word)).otherwise(word)


def replacement(key: str, hit: Column, attempts: Column | None) -> Column:
    """What stands in the text instead of a hit."""

    keeps = lambda kind: F.when(kind == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9+]"))

    def spread(kind: Column, new: Column) -> Column:
        """The new characters at the places of the old ones; what is left over stands at the end."""
        before = lambda i: F.length(F.regexp_replace(F.substring(hit, F.lit(1), i), keeps(kind), F.lit("")))
        held = F.array_join(F.transform(F.split(hit, ""), lambda c, i: F.when(c.rlike("[A-Z0-9+]"), F.substring(new, before(i + 1), F.lit(1))).otherwise(c)), "")
        return F.concat(held, F.substr(new, before(F.length(hit)) + 1))

    def other(kind: Column) -> Column:
        canon = canonical(kind, hit)
        new = surrogate(key, kind, canon, _attempt(attempts, kind, canon))
        return let(new, lambda n: F.when(kind == "email", _cased(hit, n)).when(kind == "ipv4", n).otherwise(spread(kind, n)))

    words = F.array_join(F.transform(_words(hit), lambda w: F.when(_is_name(w), new_word(key, w, attempts)).otherwise(w)), " ")
    return let(kind_of(hit), lambda kind: F.when(kind == "person", words).otherwise(other(kind)))


def _attempt(attempts: Column | None, kind: Column, canon: Column) -> Column:
    return F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws("|", kind, canon)), F.lit(0))


def new_word(key: str, w: Column, attempts: Column | None) -> Column:
    """What stands instead of a word of a person's name."""
    return let(word_kind(w), lambda kind: _cased(w, F.initcap(surrogate(key, kind, F.lower(w), _attempt(attempts, kind, F.lower(w))))))


def replaced(key: str, parts: Column, attempts: Column | None) -> Column:
    """The text of marked parts with surrogates for the hits, and for the words of their persons wherever else they stand."""

    def names_in(p: Column) -> Column:
        said = F.array_distinct(F.flatten(F.transform(F.filter(hits_of(p), lambda h: kind_of(h) == "person"), lambda h: F.filter(_words(h), _is_name))))
        return F.array_distinct(F.flatten(F.transform(said, lambda w: F.array(w, F.initcap(w), F.upper(w)))))

    def bare(gap: Column, pattern: Column) -> Column:
        return F.array_join(F.transform(F.split(F.regexp_replace(gap, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1), lambda x, i: F.when(i % 2 == 1, new_word(key, x, attempts)).otherwise(x)), "")

    def joined(p: Column, names: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        gap = lambda x, q: F.when(F.size(names) > 0, bare(x, q)).otherwise(x)
        return let(pattern, lambda q: F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, replacement(key, x, attempts)).otherwise(gap(x, q))), ""))

    return let(parts, lambda p: let(names_in(p), lambda names: joined(p, names)))


def settled(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the distinct entities in `found` that need more than the first attempt (attempt 0)."""
    every = written(found.select("kind", "canon").distinct(), "entities")
    # names of all kinds stand in the same place of a text, so they are compared with each other
    family = F.when(F.col("kind").isin("word", *GIVEN), "name").otherwise(F.col("kind"))
    originals = every.select(family.alias("family"), F.col("canon").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    state = every.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ROUNDS):
        now = state.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("family", family)
        first = now.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("first"))
        joined = now.join(first, ["family", "surrogate"]).join(originals, ["family", "surrogate"], "left")
        again = F.col("taken").isNotNull() | (F.struct("kind", "canon") != F.col("first"))
        state = written(joined.select("kind", "canon", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "attempts")
        if state.where("again").isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt")
        state = state.drop("again")
    raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} rounds")


#: Documents whose entities needed more attempts are broadcast up to this number; beyond it they are joined by shuffle.
BROADCAST_DOCS = 50_000


def pseudonymised(docs: DataFrame, key: str = "quarryline") -> DataFrame:
    """`docs` with surrogates in the text, and n_entities (how many the pattern found)."""
    columns = [c for c in docs.columns if c != "n_entities"]
    # the caller's columns travel in one struct, so no name of theirs can meet one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    parts = marked(escaped(F.col("row.text").cast("string")))
    held = rows.select(F.col("row.doc_id").alias("doc_id"), hits_of(parts).alias("hits")).where(F.size("hits") > 0)
    found = written(held.select("doc_id", F.explode(entities(F.col("hits"))).alias("e")).select("doc_id", "e.kind", "e.canon"), "found")
    more = written(settled(found, key), "more")
    attempts = None
    if not more.isEmpty():
        of_doc = found.join(more, ["kind", "canon"]).groupBy(F.col("doc_id").alias("of_doc")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("attempts"))
        of_doc = written(of_doc, "of_doc")
        if of_doc.count() <= BROADCAST_DOCS:
            of_doc = F.broadcast(of_doc)
        rows, attempts = rows.join(of_doc, F.col("row.doc_id").eqNullSafe(F.col("of_doc")), "left"), F.col("attempts")
    new = let(parts, lambda p: F.struct(F.when(F.size(p) > 1, unescaped(replaced(key, p, attempts))).alias("text"), F.floor(F.size(p) / 2).cast("long").alias("n")))
    rows = rows.select("row", *([] if attempts is None else ["attempts"]), F.when(F.col("row.text").isNotNull(), new).alias("new"))
    text = F.coalesce("new.text", "row.text")
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns), F.coalesce("new.n", F.lit(0).cast("long")).alias("n_entities"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, text with surrogates, n_entities."""
    return pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
