"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers and number words, units after numbers and names (capitalised words, at the start of a sentence too unless listed as plain
words) become typed placeholders. Windows of the
template of a document are hash-joined with those of the benchmark items; a window that holds placeholders counts only if the
values behind them map one to one, over all matching windows of the occurrence of the item. So a question asked anew
with other numbers or names is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Numbers, words, and ends of sentences.
TOKEN = r"\p{N}[\p{N}.,]*\p{N}|\p{N}|\p{L}[\p{L}\p{M}]*|[.!?\n]"
#: Unit words taken as units right behind a number (fixed values).
UNITS = ["mm", "cm", "m", "km", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "s", "sec", "min", "h", "hr", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "years", "year", "miles", "mile", "feet", "foot", "inches", "inch", "meters", "metres", "meter", "metre", "kilometers", "kilograms", "grams", "liters", "litres", "dollars", "dollar", "cents", "euros", "euro", "pounds", "percent", "degrees", "mph", "kmh"]
#: Number words taken as numbers (fixed values).
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "zwanzig", "dreißig", "hundert", "tausend", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "vingt", "trente", "cent", "mille", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "veinte", "treinta", "cien", "mil"]
#: Words that begin sentences without being names (fixed values): articles, pronouns, question words, conjunctions, prepositions, auxiliaries and what exercises ask for.
PLAIN = ["the", "an", "this", "that", "these", "those", "he", "she", "it", "we", "you", "they", "his", "her", "its", "our", "your", "their", "my", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "if", "and", "or", "but", "so", "as", "at", "by", "for", "from", "in", "into", "of", "on", "to", "with", "after", "before", "then", "there", "here", "each", "every", "some", "all", "both", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "should", "not", "no", "yes", "compute", "find", "solve", "calculate", "determine", "evaluate", "simplify", "let", "suppose", "given", "show", "prove", "explain", "describe", "write", "list", "name", "consider", "assume", "der", "die", "das", "ein", "eine", "er", "sie", "es", "wir", "was", "wer", "wie", "wo", "wann", "warum", "welche", "und", "oder", "im", "ist", "le", "la", "les", "un", "une", "il", "elle", "nous", "vous", "que", "qui", "quel", "quelle", "comment", "combien", "et", "ou", "dans", "est", "el", "los", "las", "una", "ella", "qué", "quién", "cómo", "cuándo", "dónde", "cuánto", "en", "es"]
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Most windows of the benchmark (each under 100 bytes) that are sent to every executor; beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000
#: Most contaminated documents (an id and a hash each) that are sent to every executor; beyond, the join shuffles.
BROADCAST_FOUND = 500_000


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _typed(t: Column, i: Column) -> Column:
    """Token t at place i of the column `tokens`: a placeholder, its lower case, or '' for the end of a sentence."""
    before = F.when(i > 0, F.get("tokens", i - 1)).otherwise(F.lit("."))
    first = F.substring(t, 1, 1)
    lower = F.lower(t)
    return (
        F.when(first.isin(".", "!", "?", "\n"), F.lit(""))
        .when(((first >= "0") & first.rlike(r"\p{N}")) | lower.isin(*NUMBERS), F.lit(NUM))
        .when((t != lower) & t.rlike(r"^\p{Lu}\p{Ll}+$") & ~lower.isin(*PLAIN) & (_ends(before) | before.rlike(r"\p{Ll}$|^\p{N}")), F.lit(NAME))
        .when((F.length(t) <= 10) & lower.isin(*UNITS) & (before.rlike(r"^\p{N}") | F.lower(before).isin(*NUMBERS)), F.lit(UNIT))
        .otherwise(lower)
    )


def _ends(t: Column) -> Column:
    return F.substring(t, 1, 1).isin(".", "!", "?", "\n")


def _templated(df: DataFrame, starts: bool = False) -> DataFrame:
    """df with `template` for its `text`; the tokens get a column of their own, so that they are made once a row.

    `starts` adds whether each token of the template is the first of a sentence.
    """
    held = df.withColumn("tokens", _tokens(F.col("text")))
    out = held.withColumn("template", F.filter(F.transform("tokens", _typed), lambda x: x != ""))
    if starts:
        first = lambda t, i: F.when(~_ends(t), (i == 0) | _ends(F.get("tokens", i - 1)))
        out = out.withColumn("starts", F.filter(F.transform("tokens", first), lambda x: x.isNotNull()))
    return out.drop("tokens")


def _raw(text: Column) -> Column:
    return F.filter(_tokens(text), lambda x: ~_ends(x))


def _readings(t: Column) -> Column:
    """All readings of an item's first token: as a word, as a name where it begins a sentence or is one, as a unit behind a number."""
    lower = F.lower(t)
    name = F.when(lower.rlike(r"^\p{Ll}{2,}$") & ~lower.isin(*PLAIN), F.lit(NAME))
    return F.when(t.rlike(r"^\p{N}") | lower.isin(*NUMBERS), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(lower, name, F.when(lower.isin(*UNITS), F.lit(UNIT)))))


def _places(template: Column, width: int) -> Column:
    last = F.size(template) - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _windows(template: Column, width: int) -> Column:
    """(place, hash) of the windows of `width` tokens."""
    return F.transform(_places(template, width), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(template, i + 1, width)).alias("key")))


def _slots(part: Column) -> Column:
    return F.size(F.filter(part, lambda x: x.isin(NUM, UNIT, NAME)))


def _item_windows(own: DataFrame, w: int) -> DataFrame:
    """The windows of `w` tokens of items: (tid, item_id, item_at, key, slotted, first, whole, n_all, bare, w).

    Windows more than half of placeholders are used only for items that have no others; such an item is `whole`, met
    where all its `n_all` windows are. `bare` items are placeholders alone. A window with `first` is the item's first one
    read in another way: as a plain word, a name or a unit.
    """
    template = F.col("template")
    each = F.transform(_places(template, w), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(template, i + 1, w)).alias("key"), _slots(F.slice(template, i + 1, w)).alias("slots")))
    own = own.withColumn("each", each).withColumn("whole", ~F.exists("each", lambda x: 2 * x["slots"] <= w))
    own = own.withColumn("bare", _slots(template) == F.col("n")).withColumn("n_all", F.size("each"))
    head = F.get("each", F.lit(0))
    early = F.transform("firsts", lambda f: F.struct(F.lit(0).alias("at"), F.xxhash64(F.concat(F.array(f), F.slice(template, 2, w - 1))).alias("key"), head["slots"].alias("slots"), F.lit(True).alias("first")))
    plain = F.transform("each", lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key"), x["slots"].alias("slots"), F.lit(False).alias("first")))
    out = own.select("tid", "item_id", "whole", "n_all", "bare", F.explode(F.concat(plain, early)).alias("x")).where(F.col("whole") | (2 * F.col("x.slots") <= w))
    return out.select("tid", "item_id", F.col("x.at").alias("item_at"), F.col("x.key").alias("key"), (F.col("x.first") | (F.col("x.slots") > 0)).alias("slotted"), F.col("x.first").alias("first"), "whole", "n_all", "bare", F.lit(w).alias("w"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 8) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, reparameterised): the documents that hold windows of an item.

    Documents and items are read at every place, so a shared passage of `width` tokens is met unless more than half of
    it are placeholders. Items shorter than `width` are sought as a whole; those under 4 tokens only from the start of a sentence
    to the end of one. Items whose windows are all more than half of placeholders are sought as a whole, and those
    of placeholders alone with equal values only. Values are judged for each occurrence (the windows of an item at one
    alignment in a document) against each list of values that items of that template have. Items with equal templates
    are listed as the one with the smallest id. text_hash
    is xxhash64 of the text. Null and empty texts match nothing; rows with a null id are judged and listed with it;
    repeated rows are listed once. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    bench = _templated(bench).withColumn("raw", _raw(F.col("text"))).where(F.size("template") > 0)
    lists = F.collect_set(F.transform("raw", F.lower))
    bench = bench.groupBy("template").agg(F.min("item_id").alias("item_id"), F.array_distinct(F.flatten(F.collect_list(_readings(F.get("raw", F.lit(0)))))).alias("firsts"), lists.alias("lists"))
    bench = bench.withColumn("firsts", F.array_except("firsts", F.slice("template", 1, 1)))
    bench = written(bench.withColumn("n", F.size("template")).withColumn("tid", F.xxhash64("template")), "items")
    widths = sorted({min(r["n"], width) for r in bench.select(F.least("n", F.lit(width)).alias("n")).distinct().collect()})  # `width` values at most
    hits = None
    for w in widths:
        there = written(_item_windows(bench.where(F.col("n") >= w if w == width else F.col("n") == w), w), "item_windows")
        bounded = w < min(4, width)
        here = _templated(src.where(F.length("text") > 0), bounded)
        windows = _windows(F.col("template"), w)
        if bounded:
            windows = F.filter(windows, lambda x: F.get("starts", x["at"]) & F.coalesce(F.get("starts", x["at"] + w), F.lit(True)))  # noqa: B023
        here = here.select("doc_id", "text_hash", F.explode(windows).alias("x"))
        here = here.select("doc_id", "text_hash", F.col("x.at").alias("at"), F.col("x.key").alias("key"))
        small = there.count() <= BROADCAST_WINDOWS
        found = here.join(F.broadcast(there) if small else there, "key").select("doc_id", "text_hash", (F.col("at") - F.col("item_at")).alias("align"), *[c for c in there.columns if c != "key"])
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, n_windows long, reparameterised boolean")
    place = ["doc_id", "text_hash", "tid", "item_id", "align", "whole", "n_all", "bare", "w"]
    met = hits.groupBy(*place).agg(F.collect_set("item_at").alias("ats"), F.collect_set(F.when(F.col("slotted"), F.col("item_at"))).alias("slotted"), F.bool_or("first").alias("first"))
    met = written(met.where(~F.col("whole") | (F.size("ats") == F.col("n_all"))), "hits")
    plain = met.where(F.size("ats") > F.size("slotted")).select("doc_id", "text_hash", "item_id", (F.size("ats") - F.size("slotted")).alias("n"), F.lit(False).alias("other"))
    slotted = met.where(F.size("slotted") > 0)
    if slotted.take(1):
        plain = plain.unionByName(_consistent(slotted, src, bench))
    return plain.groupBy("doc_id", "text_hash", "item_id").agg(F.sum("n").alias("n_windows"), F.bool_or("other").alias("reparameterised"))


def _consistent(slotted: DataFrame, src: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n, other) of the occurrences whose values map one to one to those of any list of the item.

    `other` is false if they equal those of a list.
    """
    texts = src.join(slotted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    raw = texts.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), _raw(F.col("text")).alias("raw"))
    values = slotted.join(raw, slotted["doc_id"].eqNullSafe(raw["d"]) & (slotted["text_hash"] == raw["h"])).join(bench.select("tid", "template", "lists"), "tid")
    cover = F.array_distinct(F.flatten(F.transform("slotted", lambda at: F.sequence(at, at + F.col("w") - 1))))
    places = F.filter(cover, lambda p: F.get("template", p).isin(NUM, UNIT, NAME))
    seen = F.transform(places, lambda p: F.struct(p.alias("p"), F.get("template", p).alias("typed"), F.lower(F.get("raw", F.col("align") + p)).alias("a")))
    values = values.withColumn("seen", seen).withColumn("head", F.when(F.col("first"), F.lower(F.get("raw", F.col("align")))))
    pairs = F.transform("lists", lambda own: F.struct(F.get(own, F.lit(0)).alias("head"), F.array_distinct(F.transform("seen", lambda x: F.struct(x["typed"].alias("typed"), x["a"].alias("a"), F.get(own, x["p"]).alias("b")))).alias("pairs")))
    values = values.select("doc_id", "text_hash", "item_id", "bare", "head", F.size("slotted").alias("n"), pairs.alias("held"))

    def judge(x: Column) -> Column:
        one_to_one = F.lit(True)
        for side in ("a", "b"):
            one_to_one &= F.size(x["pairs"]) == F.size(F.array_distinct(F.transform(x["pairs"], lambda y: F.struct(y["typed"], y[side]))))  # noqa: B023
        other = F.exists(x["pairs"], lambda y: y["a"] != y["b"])
        return F.struct((one_to_one & F.coalesce(F.col("head") == x["head"], F.lit(True)) & ~(F.col("bare") & other)).alias("good"), other.alias("other"))

    values = values.withColumn("judged", F.transform("held", judge)).where(F.exists("judged", lambda x: x["good"]))
    return values.select("doc_id", "text_hash", "item_id", "n", (~F.exists("judged", lambda x: x["good"] & ~x["other"])).alias("other"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whatever they are called, without those whose text holds a benchmark item.

    Null and empty texts stay; repeated rows share their fate.
    """
    found = written(contaminated(docs, items, id_col, text_col).select("doc_id", "text_hash").distinct(), "found")
    found, rows = (F.broadcast(found) if found.count() <= BROADCAST_FOUND else found).alias("found"), docs.alias("rows")
    quoted = lambda c: F.col("rows.`" + c.replace("`", "``") + "`")
    same = quoted(id_col).cast("long").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64(quoted(text_col)) == F.col("found.text_hash"))
    return rows.join(found, same, "left_anti").select(*map(quoted, docs.columns))
