"""PII surrogates, in DataFrame functions only.

Entities are found by patterns. Every different entity gets a surrogate from a keyed hash: letters stay letters of
their script, case and kind (vowel or consonant), digits stay digits, and what makes up the type (country code, card
number's check digit, title and gender of a name) is kept. One entity has one surrogate in all documents and in all its
spellings. Names are made of parts with surrogates of their own, so a surname is replaced alike with and without a given name.
Surrogates are checked against one another and against all entities found; where they meet, all but one draw anew, and
after some rounds from longer strings, so no number of entities exhausts a type.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Given names by gender and titles by gender (fixed values).
MALE = ["George", "Edward", "Henry", "Frank", "Brian", "Kevin", "Mark", "Steven", "Joseph", "Christopher", "Karl", "Heinz", "Jens", "Uwe", "Louis", "Luc", "Marco", "Luigi", "Javier", "Diego", "Иван", "Алексей", "Дмитрий", "Сергей", "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Paul", "Andrew", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Michel", "Philippe", "Antoine", "Carlos", "José", "Juan", "Miguel", "Pedro"]
FEMALE = ["Anna", "Julia", "Alice", "Sophie", "Emma", "Olivia", "Ruth", "Carol", "Donna", "Amanda", "Heike", "Renate", "Ingrid", "Anke", "Camille", "Chloé", "Giulia", "Francesca", "Elena", "Rosa", "Ольга", "Елена", "Наталья", "Татьяна", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Emily", "Laura", "Helen", "Ursula", "Monika", "Petra", "Sabine", "Claudia", "Marie", "Françoise", "Nathalie", "Isabelle", "Sylvie", "Carmen", "María", "Lucía", "Isabel", "Pilar"]
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
TITLES_N = ["Dr", "Prof"]
_NAMES = "|".join(MALE + FEMALE)
_TITLES = "|".join(sorted(TITLES_M + TITLES_F + TITLES_N, key=len, reverse=True))
_SURNAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:['’-]?\p{Lu}\p{Ll}+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: The patterns, in the order in which a type is decided.
PATTERNS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,6}\.\p{L}{2,24}(?![\p{L}\p{N}-])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|passphrase|pwd|secret|token|api[-_.]?key|access[-_.]?key|private[-_.]?key|auth[-_.]?key)(?:[-_.][A-Za-z0-9]{1,20}){0,3}[\"']?\s{0,3}[=:]\s{0,3}(?:\"[^\"\n]{6,}+|'[^'\n]{6,}+|[^\s\"']{6,}+)"
    r"|(?<![A-Za-z])(?i:bearer)\s{1,3}(?=\S*\d)[A-Za-z0-9._~+/=-]{12,}+",
    "access_key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:(?:{_TITLES})\.? (?:(?:{_NAMES}) ){{0,3}}(?:\p{{Lu}}[\p{{Ll}}'-]+ )?{_SURNAME}|(?:(?:{_NAMES}) ){{1,4}}{_SURNAME})(?![\p{{L}}])",
}
_ANY_OF = lambda *kinds: "(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in kinds) + ")"
#: All patterns; a glance at the next character spares most places the patterns that cannot start there.
ANY = "|".join(["(?:" + PATTERNS["email"] + ")", "(?=[pPsStTaAbB])" + _ANY_OF("secret"), "(?=[A-Z])" + _ANY_OF("access_key", "iban"), "(?=\\p{Lu})" + _ANY_OF("name"), "(?=[0-9+(])" + _ANY_OF("ip", "ssn", "phone", "card")])
#: What a text must hold for any pattern but the names.
SIGNS = "[0-9@=:]|AKIA"
NAME_ONLY = "(?=\\p{Lu})" + _ANY_OF("name")

#: Characters replaced within their kind (fixed values): vowels, consonants and digits.
POOLS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789"]
#: Other letters and digits by class, each replaced by one of a range of its script (fixed values); the first class that fits counts.
CLASSES = [
    (r"[\p{IsLatin}&&\p{Ll}]", 0xDF, 0xF6), (r"[\p{IsLatin}&&\p{Lu}]", 0xC0, 0xD6), (r"[\p{IsGreek}&&\p{Ll}]", 0x3B1, 0x3C9), (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 0x3A1),
    (r"[\p{IsCyrillic}&&\p{Ll}]", 0x430, 0x44F), (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 0x42F), (r"[\p{IsArmenian}&&\p{Ll}]", 0x561, 0x586), (r"[\p{IsArmenian}&&\p{Lu}]", 0x531, 0x556),
    (r"\p{IsGeorgian}", 0x10D0, 0x10F0), (r"\p{IsHebrew}", 0x5D0, 0x5EA), (r"\p{IsArabic}", 0x627, 0x63A), (r"\p{IsDevanagari}", 0x915, 0x939), (r"\p{IsThai}", 0xE01, 0xE2E),
    (r"\p{IsHiragana}", 0x304B, 0x3082), (r"\p{IsKatakana}", 0x30AB, 0x30E2), (r"\p{IsHangul}", 0xAC00, 0xAC80), (r"\p{IsHan}", 0x4E00, 0x4E80), (r"\p{L}", 0x61, 0x7A), (r"\p{N}", 0x30, 0x39),
]
#: Rounds of drawing: strings grow by one character after every WIDER; known entities are barred in the first BARRED.
ROUNDS, WIDER, BARRED = 40, 4, 16


def entity_type(e: Column) -> Column:
    """The first type whose pattern fits, else null; a card number has a right check digit."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        fits = e.rlike(f"^(?:{pattern})$")
        if name == "card":
            fits &= F.call_function("luhn_check", F.regexp_replace(e, r"\D", ""))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def _head(e: Column) -> Column:
    """What stands before the value of a secret."""
    return F.regexp_extract(e, r"^(?:(?i:bearer)\s+|[\w.-]+[\"']?\s*[=:]\s*[\"']?)", 0)


def _canonical(kind: Column, e: Column) -> Column:
    """What all spellings of an entity have in common."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(e.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind.isin("email", "name"), F.lower(F.regexp_replace(e, r"\.? ", " ")))
        .when(kind == "secret", F.substr(e, F.length(_head(e)) + 1))
        .otherwise(e)
    )


def _draw(seed: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place i of an entity."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 16).cast("string")), 256)
    return F.conv(F.substr(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _mapped(text: Column, seed: Column, keep: int | Column = 0) -> Column:
    """text with each letter and digit drawn anew within its kind, but for the first `keep` characters."""

    def one(c: Column, i: Column) -> Column:
        of = lambda pool: F.substr(F.lit(pool), _draw(seed, i) % len(pool) + 1, F.lit(1))
        out = F.when(i < keep, c)
        for pool in POOLS:
            out = out.when(F.instr(F.lit(pool), c) > 0, of(pool))
        for kind, first, last in CLASSES:
            out = out.when((c > "\x7f") & c.rlike(kind), of("".join(map(chr, range(first, last + 1)))))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _longer(text: Column, extra: int) -> Column:
    return F.concat(text, F.repeat(F.substring(text, -1, 1), F.lit(extra)))


def _surrogates(df: DataFrame, extra: int) -> DataFrame:
    """df (kind, canon, seed) with `surrogate`, a draw for a canonical entity or a part of a name; `extra` characters longer."""
    kind, canon, seed = F.col("kind"), F.col("canon"), F.col("seed")
    own = _longer(canon, extra)
    host = F.regexp_extract(canon, r"^[^@]*@[^.]*", 0)
    country = F.when(canon.startswith("+"), F.greatest(F.length(canon) - 10, F.lit(2))).otherwise(F.lit(0))
    source = F.when(kind == "email", _longer(host, extra)).when(kind == "card", F.substr(own, F.lit(1), F.length(own) - 1)).otherwise(own)
    keep = F.when(kind == "card", 1).when(kind == "phone", country).when(kind == "iban", 2).when(kind == "access_key", 4).otherwise(0)
    # Columns of their own, so that each is made once.
    df = df.withColumn("source", source).withColumn("keep", keep).withColumn("mapped", _mapped(F.col("source"), seed, F.col("keep")))
    mapped = F.col("mapped")
    email = F.concat(mapped, F.lit(".example."), F.regexp_extract(canon, r"([a-z]+)$", 1))
    octet = lambda o, i: (_draw(seed, i) % 256 if extra else F.when(F.length(o) == 3, 100 + _draw(seed, i) % 156).when(F.length(o) == 2, 10 + _draw(seed, i) % 90).otherwise(_draw(seed, i) % 10)).cast("string")
    octets = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    hexed = F.array_join(F.transform(F.split("source", ""), lambda c, i: F.lower(F.hex(_draw(seed, i) % 16))), "")
    checked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(mapped, d.cast("string"))), lambda x: F.call_function("luhn_check", x))
    out = F.when(kind == "email", email).when(kind == "ip", octets).when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), hexed).when(kind == "card", F.get(checked, F.lit(0))).otherwise(mapped)
    return df.withColumn("surrogate", out).drop("seed", "source", "keep", "mapped")


def _cased(e: Column, s: Column) -> Column:
    """s with capitals where e has them."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(F.substr(e, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def _spelled(kind: Column, e: Column, s: Column) -> Column:
    """The surrogate s of the canonical entity in the spelling of e."""
    plain = F.regexp_replace(s, r"^\+", "")
    poured = F.array_join(
        F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(r"[A-Z0-9]"), F.substr(plain, F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), "[^A-Z0-9]", "")), F.lit(1))).otherwise(c)), ""
    )
    rest = F.substr(plain, F.length(F.regexp_replace(e, "[^A-Z0-9]", "")) + 1)
    return (
        F.when(s.startswith("["), s).when(kind.isin("card", "ssn", "phone", "iban"), F.concat(poured, rest)).when(kind == "secret", F.concat(_head(e), s))
        .when((kind == "email") & (e == F.upper(e)), F.upper(s)).otherwise(s)
    )


def _drawn(each: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate): one surrogate for each row, different within a kind and from the entity itself.

    Of rows that draw the same surrogate the first in order keeps it; the others, and those that drew a known entity, draw
    again, after WIDER rounds from a longer string (addresses: from all numbers). After BARRED rounds known entities are no
    longer avoided. What is left after all rounds becomes `[kind-hash]`.
    """
    listed = each.sparkSession.createDataFrame([("given", n.lower()) for n in MALE + FEMALE], "kind string, surrogate string")
    known, taken, pending, done = each.select("kind", F.col("canon").alias("surrogate")).unionByName(listed), None, each, []
    for attempt in range(rounds):
        seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.when(F.length("canon") > 512, F.sha2("canon", 256)).otherwise(F.regexp_replace("canon", r"\|", "/")), F.lit(attempt))
        # A column of its own, and short, as every character hashes it.
        drawn = written(_surrogates(pending.withColumn("seed", seed), attempt // WIDER), "drawn")
        order = Window.partitionBy("kind", "surrogate").orderBy("canon")
        won = drawn.withColumn("turn", F.row_number().over(order)).where("turn = 1 and surrogate <> canon").drop("turn")
        for bar in ([known] if attempt < BARRED else []) + ([taken] if taken is not None else []):
            won = won.join(bar, ["kind", "surrogate"], "left_anti")
        won = written(won, "won")
        done.append(won)
        pending = drawn.join(won, ["kind", "canon"], "left_anti").select("kind", "canon")
        if not pending.take(1):
            break
        mine = won.select("kind", "surrogate")
        taken = mine if taken is None else taken.unionByName(mine)
    else:
        done.append(pending.withColumn("surrogate", F.concat(F.lit("["), "kind", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon"), 256), 1, 16), F.lit("]"))))
    out = done[0].select("kind", "canon", "surrogate")
    for more in done[1:]:
        out = out.unionByName(more.select("kind", "canon", "surrogate"))
    return out


def _given(key: str) -> dict[str, str]:
    """The listed given names, each with the next of its gender in a keyed order."""
    out = {}
    for names in (MALE, FEMALE):
        order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def assign(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(entity, kind, surrogate) for a table with a column `entity`; each canonical entity has a surrogate of its own.

    Strings that are no entity, and those without a letter or digit to replace (`password: ********`), are not listed.
    """
    known = entities.where("entity is not null").select("entity").distinct().withColumn("kind", entity_type(F.col("entity"))).where("kind is not null")
    known = known.withColumn("canon", _canonical(F.col("kind"), F.col("entity"))).where(F.col("canon").rlike(r"[\p{L}\p{N}]"))
    words, titles = F.split("canon", " "), [t.lower() for t in TITLES_M + TITLES_F + TITLES_N]
    titled = words[0].isin(*titles)
    # The word before the surname; those before it are listed names.
    given = F.when((F.col("kind") == "name") & (~titled | (F.size(words) > 2)), F.element_at(words, -2))
    known = written(known.withColumn("given", given).withColumn("surname", F.when(F.col("kind") == "name", F.element_at(words, -1))), "entities")
    static = _given(key)
    parts = [("surname", F.col("surname")), ("given", F.when(~F.col("given").isin(*static), F.col("given")))]
    each = known.where("kind <> 'name'").select("kind", "canon")
    for kind, part in parts:
        each = each.unionByName(known.select(F.lit(kind).alias("kind"), part.alias("canon")).where("canon is not null"))
    table = written(_drawn(written(each.distinct(), "parts"), key, rounds), "surrogates")
    plain = known.where("kind <> 'name'").join(table, ["kind", "canon"]).select("entity", "kind", _spelled(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("surrogate"))
    of = lambda kind: table.where(F.col("kind") == kind).select(F.col("canon").alias(kind), F.col("surrogate").alias(f"new_{kind}"))
    names = known.where("kind = 'name'").join(of("surname"), "surname").join(of("given"), "given", "left")
    fixed = F.create_map(*[F.lit(x) for pair in static.items() for x in pair])
    names = names.withColumn("new_given", F.coalesce("new_given", F.element_at(fixed, F.col("given"))))
    own = F.split("entity", " ")
    title = F.when(titled, own[0])
    first = F.when(titled, 2).otherwise(1)
    more = F.transform(F.slice(own, first, F.greatest(F.size(own) - 1 - first, F.lit(0))), lambda x: _cased(x, F.coalesce(F.element_at(fixed, F.lower(x)), F.lower(x))))
    spelled = F.concat_ws(" ", title, F.when(F.size(more) > 0, F.array_join(more, " ")), _cased(F.element_at(own, -2), F.col("new_given")), _cased(F.element_at(own, -1), F.col("new_surname")))
    return plain.unionByName(names.select("entity", "kind", spelled.alias("surrogate")))


def replace(docs: DataFrame, key: str = "strandlake", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with all entities in the text replaced, all columns kept; `count_col` adds (or replaces) how many there were.

    Null and empty texts are returned as they are (count 0). Rows are judged by their text alone, so null or
    repeated ids and repeated rows are fine. Columns of other names are carried along, whatever they are called. An empty table
    gives an empty result. The same key gives the same surrogates for the same entities unless they collide.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    text = quoted(text_col)
    kept = [c for c in docs.columns if c != count_col]
    held = F.coalesce(F.when(text.rlike(SIGNS), text.rlike(ANY)).otherwise(text.rlike(NAME_ONLY)), F.lit(False))
    other = docs.where(~held).select(*map(quoted, kept), *([F.lit(0).alias(count_col)] if count_col else []))
    # A row is carried as one column, so that no name of it meets those used here.
    own = written(docs.where(held).select(F.struct(*map(quoted, kept)).alias("row"), text.alias("body"), F.sha2(text, 256).alias("digest")), "personal")
    entities = F.regexp_extract_all("body", F.lit(ANY), F.lit(0))
    each = own.select("digest", "body").dropDuplicates(["digest"])
    pairs = written(each.select("digest", F.explode(entities).alias("entity")).distinct(), "found")
    maps = pairs.join(assign(pairs, key), "entity").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("map"))
    joined = own.join(maps, "digest", "left")
    new = F.array_join(F.zip_with(F.split("body", ANY, -1), entities, lambda gap, e: F.concat(gap, F.when(e.isNull(), F.lit("")).otherwise(F.coalesce(F.element_at(F.col("map"), e), e)))), "")
    n = F.size(F.filter(entities, lambda e: F.map_contains_key(F.col("map"), e)))
    done = joined.select("row", new.alias("body"), F.coalesce(n, F.lit(0)).alias("n"))
    out = done.select(*((done["body"] if c == text_col else done["row"].getField(c)).alias(c) for c in kept), *([done["n"].alias(count_col)] if count_col else []))
    return other.unionByName(out)
