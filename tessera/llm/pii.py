"""Surrogates for personal data, with DataFrame and SQL functions only.

Detected are e-mail addresses, IPv4, IPv6 and MAC addresses, payment card numbers, secrets (long hex strings and keys), IBANs, phone
numbers, US social security numbers and names after a title of address. Each is replaced by a surrogate of its type that a
key determines. A surrogate has the form of what it stands for: the same length and punctuation, digits for digits, letters of
the same case, script and kind (vowel, consonant) for letters. A name keeps its title and its last letter, which carry
its gender, and a listed given name becomes another of the same gender and script; an IPv4 address stays one; a card
number keeps its first digit and whether its check digit is right; an e-mail address keeps its top-level domain, and
equal domains stay equal. A number is a card's only if its check digit is right.

Forms are kept by a Feistel network over the text's characters, so within a form different texts get different surrogates.
What networks can't rule out is checked: all distinct entities are gathered in a table (never at the driver), and one whose surrogate is
another's surrogate, is itself or any text's real entity of the type is drawn anew, until none is. The mapping
is a function of the entity over all documents, so mentions of one entity stay mentions of one.

A name found after a title is also replaced where it stands without one in the same text, by the same surrogate (n_entities counts
those with a title). E-mail addresses that differ in case only get surrogates that do so too; telephone numbers of equal digits after
the country's code or trunk 0 get equal digits, whatever stands between them.

The key is in no plan's text and no event log: it comes as a table of one row.

Given results: null text stays null; a text without entities stays as it is, byte for byte; a repeated row is treated as its
copy; doc_id isn't used; an empty table gives no rows; other columns stay, whatever their names (n_entities is set anew). Texts are whole,
however long. Ties: of entities with one surrogate the first draw, then the first entity in order, keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KEY = "tessera-surrogates-1"
#: Draws after which a surrogate's characters are all taken from a hash.
DRAWS = 6

TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Herrn|Frau|Fräulein|Monsieur|Madame|Mademoiselle|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Srta|Don|Doña|Signor|Signora|г-н|г-жа|κ|κα)"
#: Given names with a gender: a listed name becomes another of its list.
GIVEN = {
    "f": ["Alice", "Anna", "Barbara", "Carmen", "Claire", "Elena", "Emma", "Grace", "Hannah", "Ingrid", "Julia", "Laura", "Lucía", "Maria", "Marie", "Mary", "Nora", "Olivia", "Sarah", "Sofia"],
    "m": ["Adam", "Carlos", "Daniel", "David", "Erik", "Felix", "George", "Henri", "Jacob", "James", "Javier", "John", "Louis", "Lukas", "Martin", "Miguel", "Paul", "Peter", "Robert", "Thomas"],
}
#: IPv6 addresses with '::' for groups of zeros, by the number of groups before it; an IPv4 address at the end is one of its own.
_H = "[0-9A-Fa-f]{1,4}"
SHORT_IPV6 = "(?:" + "|".join([f"(?:{_H}:){{1,7}}:", *(f"(?:{_H}:){{{k}}}(?::{_H}){{1,{7 - k}}}" for k in range(1, 7)), f":(?::{_H}){{1,7}}"]) + r")(?!\.\d)"
#: Each pattern is tried at each place in this order; the first that matches there wins.
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ip": r"(?=\d)(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "hexid": rf"(?=[0-9A-Fa-f]{{0,4}}:|[0-9A-Fa-f]{{2}}-)(?<![\w:.-])(?:{SHORT_IPV6}|" r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2})(?![\w:-])",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "phone": r"(?=[\d+(])(?:(?<![\w.+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?\d{2,5}(?:[ .-]\d{2,5}){1,3}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8})(?![\w-])|(?<![\w.(-])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?![\w-]))",
    "secret": r"(?=[0-9a-fAspgx])(?<!\w)(?:[0-9a-f]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|ghp|gho|xoxb)[-_][A-Za-z0-9_-]{16,100})(?!\w)",
    "name": rf"(?=[MDPSHFгκ])(?<![\p{{L}}\p{{M}}\d]){TITLES}\.?[  ]\p{{Lu}}[\p{{L}}\p{{M}}'’-]{{1,40}}+(?: \p{{Lu}}[\p{{L}}\p{{M}}'’-]{{1,40}}+){{0,2}}",
}
#: None begins inside a run of ASCII letters and digits, nor with another character than these.
ANY = r"(?<![A-Za-z0-9])(?=[\w.+%(:гκ-])(?:" + "|".join(PATTERNS.values()) + ")"

#: Characters that stand for each other.
ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz",  # the first three: ASCII without upper case
    "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "çñ", "ÇÑ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
HEX = ["0123456789abcdef"]


def among(*alphabets: str) -> Column:
    """Alphabets as one string, between line ends, which no entity has: one expression serves any number of them."""
    return F.lit("\n" + "\n".join(alphabets) + "\n")


def substr(text: Column, start: Column | int, n: Column | int | None = None) -> Column:
    return F.call_function("substr", text, *(x if isinstance(x, Column) else F.lit(x) for x in (start, n) if x is not None))


def cut(text: Column, by: Column | str, n: int) -> Column:
    """SQL's substring_index."""
    return F.call_function("substring_index", text, by if isinstance(by, Column) else F.lit(by), F.lit(n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(F.col("subkey"), *parts), 256)


def of_hex(h: Column) -> Column:
    return F.conv(h, 16, 10)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def shifted(part: Column, h: Column, letters: Column) -> Column:
    """Each character of `part` moved on in its alphabet (of those in `letters`, see among()) by a byte of the hex hash `h`."""

    def moved(c: Column, i: Column, hx: Column) -> Column:
        own = F.concat(cut(cut(letters, c, 1), "\n", -1), c, cut(cut(letters, c, -1), "\n", 1))
        on = of_hex(substr(hx, (i % 32) * 2 + 1, 2)).cast("int")
        there = let(own, lambda al: substr(al, (F.instr(al, c) - 1 + on) % F.length(al) + 1, 1))
        return F.when(c == "", "").when(F.instr(letters, c) > 0, there).otherwise(c)

    return let(h, lambda hx: F.array_join(F.transform(F.split(part, ""), lambda c, i: moved(c, i, hx)), ""))


def permuted(text: Column, tweak: Column, letters: Column) -> Column:
    """`text` by a four-round Feistel network over its characters; each keeps its alphabet. Texts of one form and one
    tweak get different results. The key is the column `subkey`."""
    half = F.shiftright(F.length(text), 1)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(3)),
        F.struct(substr(text, 1, half).alias("l"), substr(text, half + 1).alias("r")),
        lambda a, j: F.struct(a["r"].alias("l"), shifted(a["l"], sha(tweak, j, a["r"]), letters).alias("r")),
        lambda a: F.concat(a["l"], a["r"]),
    )


def luhn(digits: Column) -> Column:
    """What the check digit after `digits` would be."""

    def added(s: Column, p: Column) -> Column:
        d = substr(digits, F.length(digits) - p, 1).cast("int")
        return s + F.when(p % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return (F.lit(10) - F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), added) % 10) % 10


def laid_over(digits: Column, form: Column) -> Column:
    """`digits` in place of the digits of `form`."""

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["out"], F.when(digit, substr(digits, a["k"], 1)).otherwise(c)).alias("out"), F.when(digit, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda a: a["out"])


def recased(new: Column, old: Column) -> Column:
    """`new`, of lower case, with the letters in upper case that are in `old`."""
    return F.array_join(F.zip_with(F.split(new, ""), F.split(old, ""), lambda a, b: F.when(b != F.lower(b), F.upper(a)).otherwise(a)), "")


def real(e: Column) -> Column:
    """Whether what a pattern matches is an entity: a card number has its check digit right."""
    d = digits_of(e)
    return ~e.rlike(f"^(?:{PATTERNS['card']})$") | (luhn(substr(d, 1, F.length(d) - 1)) == F.right(d, F.lit(1)).cast("int"))


def surrogate(e: Column, kind: Column, draw: Column) -> Column:
    """The surrogate of entity `e` of type `kind` at a draw (0, 1, ...), by the key in column `subkey`. A type's texts to permute come as
    an array, so that one network serves all types; then each type puts its surrogate together."""

    def part(text: Column, what: str, letters: Column, *more: Column) -> Column:
        return F.struct(text.alias("text"), F.concat(F.lit(what), draw, *more).alias("tweak"), letters.alias("letters"))

    def chosen(kd: Column, by: dict[str, Column], other: Column) -> Column:
        out = F
        for k, v in by.items():
            out = out.when(kd == k, v)
        return out.otherwise(other)

    def given(w: Column, other: Column) -> Column:
        out = F
        for g, names in GIVEN.items():
            of = F.split(F.lit(" ".join(names)), " ")
            moved = F.array_position(of, w) + of_hex(substr(sha(F.lit(g), draw), 1, 6)) % (len(names) - 1)
            out = out.when(F.array_contains(of, w), F.element_at(of, (moved % len(names)).cast("int") + 1))
        return out.otherwise(other)

    def body(e: Column, kd: Column) -> Column:
        titled = rf"^{TITLES}\.?[ \xa0]"
        words = F.split(F.regexp_replace(e, titled, ""), " ")
        kept = lambda w: F.greatest(F.length(w) - 1, F.lit(1))
        # Addresses that differ in case only are one; their characters are ASCII.
        local, host = cut(e, "@", 1), cut(e, "@", -1)
        top = cut(host, ".", -1)
        label = substr(host, 1, F.length(host) - F.length(top) - 1)
        d = digits_of(e)
        # The digits after the country's code or trunk 0 change, whatever stands between them; the first one stays one that can begin a number or not.
        code = F.regexp_extract(e, r"^(?:\+\d{1,3}(?=[ .(-])|\+\d{2}|0)?", 0)
        number = substr(e, F.length(code) + 1)
        digits, mail, key = among(*LETTERS[:1]), among(*ALPHABETS[:3]), among(*LETTERS)
        plain = e.rlike("^[0-9a-f]+$")
        parts = chosen(
            kd,
            {
                "email": F.array(part(F.lower(local), "mail", mail, F.lower(host)), part(F.lower(label), "host", mail, F.lower(top))),
                "card": F.array(part(substr(d, 2, F.length(d) - 2), "card", digits, F.length(d))),
                "phone": F.array(part(substr(digits_of(number), 2), "phone", digits)),
                "hexid": F.array(part(e, "hexid", F.when(e.rlike("[A-F]"), among(HEX[0].upper())).otherwise(among(*HEX)))),
                "ssn": F.array(part(e, "ssn", digits)),
                "iban": F.array(part(substr(e, 3), "iban", key)),
                "secret": F.array(F.when(plain, part(e, "hex", among(*HEX))).otherwise(part(substr(e, 5), "key", key))),
            },
            F.transform(words, lambda w: part(substr(w, 1, kept(w)), "name", among(*ALPHABETS))),
        )
        ip_half = lambda a, j: of_hex(substr(sha(F.lit("ip"), draw, j, a["r"]), 1, 4)).cast("bigint")
        of_bytes = lambda x: F.concat_ws(".", F.shiftright(x, 8).cast("string"), (x % 256).cast("string"))
        ip = let(
            F.transform(F.split(e, r"\."), lambda x: x.cast("bigint")),
            lambda o: F.aggregate(
                F.sequence(F.lit(0), F.lit(3)),
                F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r")),
                lambda a, j: F.struct(a["r"].alias("l"), a["l"].bitwiseXOR(ip_half(a, j)).alias("r")),
                lambda a: F.concat_ws(".", of_bytes(a["l"]), of_bytes(a["r"])),
            ),
        )

        def together(new: Column) -> Column:
            first = new[0]
            check = lambda b: (substr(d, F.length(d), 1).cast("int") - luhn(substr(d, 1, F.length(d) - 1)) + 10 + luhn(b)) % 10
            card = let(F.concat(substr(d, 1, 1), first), lambda b: laid_over(F.concat(b, check(b)), e))
            lead = F.concat(shifted(F.left(digits_of(number), F.lit(1)), sha(F.lit("lead"), draw, first), among("01", "23456789")), first)
            name = F.transform(words, lambda w, i: given(w, F.concat(F.get(new, i), substr(w, kept(w) + 1))))
            return chosen(
                kd,
                {
                    "email": F.concat(recased(first, local), F.lit("@"), recased(new[1], label), F.lit("."), top),
                    "card": card,
                    "phone": F.concat(code, laid_over(lead, number)),
                    "hexid": first,
                    "ssn": first,
                    "iban": F.concat(substr(e, 1, 2), first),
                    "secret": F.when(plain, first).otherwise(F.concat(substr(e, 1, 4), first)),
                },
                F.concat(F.regexp_extract(e, titled, 0), F.array_join(name, " ")),
            )

        networks = let(F.transform(parts, lambda p: permuted(p["text"], p["tweak"], p["letters"])), together)
        # When draws don't help (an alphabet that isn't known, a form with few members): a tag from a hash.
        last = F.concat(kd, F.lit("-"), substr(sha(kd, draw, e), 1, 24))
        return F.when(draw >= DRAWS, last).when(kd == "ip", ip).otherwise(networks)

    return let(e, lambda x: let(kind, lambda kd: body(x, kd)))


def kind_of(e: Column) -> Column:
    """The type of a detected entity."""
    out = F
    for k, p in PATTERNS.items():
        out = out.when(e.rlike(f"^(?:{p})$"), F.lit(k))
    return out.otherwise("name")


def found(text: str = "text") -> Column:
    """The entities of the text, in order."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), F.array())


def keyed(spark: SparkSession, key: str) -> DataFrame:
    """One row with the column `subkey`, made from the key. Data of a table, it is in the text of no plan and in no event log."""
    return spark.sql("select subkey from values (:subkey) as t(subkey)", args={"subkey": hashlib.sha256(f"surrogates:{key}".encode()).hexdigest()})


def redrawn(docs: DataFrame, secret: DataFrame) -> DataFrame:
    """(entity, kind, draw, surrogate) of the entities whose first draw would not do: all others are draw 0."""
    all_of = docs.select(F.explode(found()).alias("entity")).distinct().where(real(F.col("entity"))).withColumn("kind", kind_of(F.col("entity"))).withColumn("draw", F.lit(0))
    drawn = surrogate(F.col("entity"), F.col("kind"), F.col("draw"))
    names = ["entity", "kind", "draw", "surrogate"]
    state = written(all_of.crossJoin(F.broadcast(secret)).withColumn("surrogate", drawn).select(names), "entities")
    # A surrogate is no entity of any text, in any case.
    own = state.select(F.lower("entity").alias("low")).distinct()
    moved = False
    for _ in range(DRAWS + 2):
        twice = state.groupBy("surrogate").agg(F.count("*").alias("n"), F.min(F.struct("draw", "entity")).alias("keeps")).where("n > 1")
        met = state.join(twice, "surrogate").where(F.col("entity") != F.col("keeps.entity")).select("entity")
        bad = written(met.union(state.withColumn("low", F.lower("surrogate")).join(own, "low", "left_semi").select("entity")).distinct(), "again")
        if bad.isEmpty():
            return state.where("draw > 0") if moved else state.limit(0)
        moved = True
        next_draw = state.join(bad.withColumn("bad", F.lit(1)), "entity", "left").withColumn("draw", F.col("draw") + F.coalesce("bad", F.lit(0)))
        state = written(next_draw.crossJoin(F.broadcast(secret)).withColumn("surrogate", F.when(F.col("bad").isNull(), F.col("surrogate")).otherwise(drawn)).select(names), "entities")
    raise RuntimeError("surrogates still collide")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, and n_entities (mentions)."""
    secret = keyed(docs.sparkSession, key)
    other = redrawn(docs, secret)
    # The row is one column until the end, so that no other column's name can clash. The key's table has one row.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text").withColumn("hits", found()).crossJoin(F.broadcast(secret))
    # Column functions and not SQL text: the parser keeps what it has learnt of long nested texts for good, over 100 MB of the driver's memory.
    def one(x: Column) -> Column:
        first = F.when(real(x), surrogate(x, kind_of(x), F.lit(0))).otherwise(x)
        return F.coalesce(F.element_at("drawn", x), first) if again else first

    if again := not other.isEmpty():
        # Only documents that mention a redrawn entity take part: by text, as doc_id may repeat.
        rows = rows.withColumn("th", F.xxhash64("text"))
        mentions = rows.select("th", F.explode("hits").alias("entity")).join(other, "entity").groupBy("th").agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("drawn"))
        rows = rows.join(written(mentions, "mentions"), "th", "left")
    rows = rows.withColumn("new", F.transform("hits", one))
    # Names found after a title, longest first, and the surrogates that their mentions without one get.
    title = rf"^{TITLES}\.?[ \xa0]"
    bare = lambda x: F.regexp_replace(x, title, "")
    named = F.zip_with("hits", "new", lambda x, s: F.when(x.rlike(title), F.struct((-F.length(x)).alias("n"), bare(x).alias("bare"), bare(s).alias("other"))))
    rows = rows.withColumn("names", F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))))
    edge = r"[\p{L}\p{M}\d]"
    mention = F.concat(F.lit(f"(?<!{edge})(?:"), F.array_join(F.transform("names", lambda x: F.concat(F.lit(r"\Q"), x["bare"], F.lit(r"\E"))), "|"), F.lit(f")(?!{edge})"))

    def told(p: Column) -> Column:
        by_name = lambda t: F.try_element_at(F.filter("names", lambda x: x["bare"] == t), F.lit(1))["other"]
        parts = F.zip_with(F.split(p, mention, -1), F.regexp_extract_all(p, mention, F.lit(0)), lambda q, t: F.concat(q, F.coalesce(by_name(t), F.lit(""))))
        return F.when(F.size("names") == 0, p).otherwise(F.array_join(parts, ""))

    parts = F.zip_with(F.split("text", ANY, -1), "new", lambda p, s: F.concat(told(p), F.coalesce(s, F.lit(""))))
    text = F.when(F.size("hits") == 0, F.col("row.text")).otherwise(F.array_join(parts, ""))
    count = F.coalesce(F.greatest(F.size(F.filter("hits", real)), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_entities"), count.alias("n_entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")
