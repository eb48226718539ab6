"""The registered queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, hnsw, language_id, ngram_join, packing, pii, quality, sharding, spelling, substring, url_filter, warc
from .common import fold, table, written


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    out = language_id.labelled(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str, size: int = 1024) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files(), size=size)


def tokenizer_files(tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> tuple[str, str, str]:
    """Paths of the public tokenizer and of its vocabulary as ranks, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(tokenizer), public_tokenizers.path(ranks), public_tokenizers.PATTERN


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, count_col="n_entities")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(quality.features(table(spark, sf_dir, "documents")), "features")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", (F.col("quality") == 1).alias("good"))
    out = quality.scored(measured, quality.fit(measured, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93).drop("recall")


#: (verdict, rule) of the URL filter.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = warc.archive_folder(spark)
    return warc.read(warc.write(table(spark, sf_dir, "pages"), base), base)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "reparameterised")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), size=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_resharding(spark: SparkSession, sf_dir: str, old: int = 32, new: int = 40) -> DataFrame:
    """The documents as a table of `old` shards by id, brought to `new` shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    before = sharding.write_shards(docs, fold("doc_id", old), old)
    after = sharding.reshard(before, sharding.equal_capacities(sum(before.sizes()), new))
    return sharding.slots(after).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    _, ranks, pattern = tokenizer_files()
    return alignment.align(table(spark, sf_dir, "documents"), ranks, pattern, public_tokenizers.path(model))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_quality": op4_quality,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_resharding": op12_resharding,
    "op13_token_alignment": op13_token_alignment,
}

UNIT_LIST, NUMBER_LIST, PLAIN_LIST = ("(" + ", ".join(f"'{u}'" for u in words) + ")" for words in (decontaminate.UNITS, decontaminate.NUMBERS, decontaminate.PLAIN))



def _crc_step(value: int) -> int:
    for _ in range(4):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


#: The checksum of four bits, by rule; SQL takes the bytes' halves from the hexadecimal text, the lower one first.
CRC_LIST = "[" + ", ".join(f"{_crc_step(i)}::UBIGINT" for i in range(16)) + "]"
#: One ASCII character for each letter that has two bytes, so that a distance in bytes is one in characters.
WIDE, NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(33, 97))).replace("'", "''")

#: SQL for the operators whose results it can express; the others are tested in tests/llm against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    # Links of equal labels, their closure, the least id reached.
    "op5_embedding_dedup": r"""WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY 1) n ON n.u = e.vec_id LEFT JOIN (SELECT u, min(w) AS least FROM reach GROUP BY 1) c ON c.u = e.vec_id""",
    # Shingle sets, classes of equal sets, links between their representatives, the closure.
    "op7_ngram_join": r"""WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, md5(s) AS s FROM (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM ws WHERE len(w) > 0))),
sized AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS class FROM sh GROUP BY 1),
lead AS MATERIALIZED (SELECT class, min(doc_id) AS node, any_value(n) AS n FROM sized GROUP BY 1),
shared AS MATERIALIZED (SELECT sh.s, lead.node, lead.n FROM sh JOIN lead ON lead.node = sh.doc_id),
links AS MATERIALIZED (SELECT a.node AS u, b.node AS w FROM shared a JOIN shared b ON a.s = b.s AND a.node <> b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
root AS (SELECT u, min(w) AS least FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(coalesce(lead.node, d.doc_id), coalesce(root.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized z ON z.doc_id = d.doc_id LEFT JOIN lead ON lead.class = z.class LEFT JOIN root ON root.u = lead.node""",
    "op8_warc": r"""SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM (SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest, CASE WHEN strlen(p) >= 100 THEN min(page_id) OVER (PARTITION BY p) END AS least FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))""",
    # Typed templates of documents and items, their windows joined by text, values judged for each occurrence and list of values.
    "op9_decontamination": rf"""WITH src AS (SELECT 'd' AS kind, row_number() OVER () AS r, id, text FROM (SELECT DISTINCT doc_id AS id, text FROM documents WHERE length(text) > 0)
 UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark WHERE text IS NOT NULL),
tok AS (SELECT kind, r, id, i, tokens[i] AS t, coalesce(tokens[i - 1], '.') AS b FROM (SELECT kind, r, id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (SELECT kind, r, id, regexp_extract_all(text, '{decontaminate.TOKEN}') AS tokens FROM src))),
typed AS (SELECT kind, r, id, i, t, b IN ('.', '!', '?', chr(10)) AS starts, CASE WHEN regexp_matches(t, '^\p{{N}}') OR lower(t) IN {NUMBER_LIST} THEN '<num>'
 WHEN t <> lower(t) AND regexp_matches(t, '^\p{{Lu}}\p{{Ll}}+$') AND lower(t) NOT IN {PLAIN_LIST} AND regexp_matches(b, '\p{{Ll}}$|^\p{{N}}|^[.!?\n]') THEN '<name>'
 WHEN length(t) <= 10 AND lower(t) IN {UNIT_LIST} AND (regexp_matches(b, '^\p{{N}}') OR lower(b) IN {NUMBER_LIST}) THEN '<unit>' ELSE lower(t) END AS x FROM tok WHERE t NOT IN ('.', '!', '?', chr(10))),
line AS MATERIALIZED (SELECT kind, r, id, list(x ORDER BY i) AS template, list(lower(t) ORDER BY i) AS raw, list(starts ORDER BY i) AS starts, arg_min(t, i) AS head FROM typed GROUP BY kind, r, id),
item AS MATERIALIZED (SELECT *, len(template) AS n, least(len(template), 8) AS w, row_number() OVER () AS tid FROM (SELECT template, min(id) AS item_id, list(DISTINCT raw) AS lists,
 list_filter(list_distinct(flatten(list(CASE WHEN regexp_matches(head, '^\p{{N}}') OR lower(head) IN {NUMBER_LIST} THEN [] ELSE [lower(head), CASE WHEN regexp_matches(lower(head), '^\p{{Ll}}{{2,}}$') AND lower(head) NOT IN {PLAIN_LIST} THEN '<name>' END, CASE WHEN lower(head) IN {UNIT_LIST} THEN '<unit>' END] END))), lambda x: x <> template[1]) AS firsts FROM line WHERE kind = 'i' GROUP BY template)),
part AS (SELECT tid, w, n, firsts, pos, list_slice(template, pos + 1, pos + w) AS part, len(list_filter(template, lambda x: x IN ('<num>', '<unit>', '<name>'))) = n AS bare FROM (SELECT *, unnest(range(0, n - w + 1)) AS pos FROM item)),
slots AS MATERIALIZED (SELECT *, bool_and(2 * slots > w) OVER (PARTITION BY tid) AS whole FROM (SELECT *, len(list_filter(part, lambda x: x IN ('<num>', '<unit>', '<name>'))) AS slots FROM part)),
there AS (SELECT tid, w, n, pos, whole, bare, slots, array_to_string(part, ' ') AS key, false AS early FROM slots
 UNION ALL SELECT tid, w, n, pos, whole, bare, slots, array_to_string(list_concat([f], list_slice(part, 2, w)), ' '), true FROM (SELECT *, unnest(firsts) AS f FROM slots WHERE pos = 0) WHERE f IS NOT NULL),
here AS (SELECT r, w, pos, array_to_string(list_slice(template, pos + 1, pos + w), ' ') AS key FROM (SELECT r, template, starts, w, unnest(range(0, len(template) - w + 1)) AS pos FROM line, (SELECT DISTINCT w FROM item) WHERE kind = 'd') WHERE w >= 4 OR (starts[pos + 1] AND coalesce(starts[pos + w + 1], true))),
hit AS MATERIALIZED (SELECT r, tid, w, n, whole, bare, here.pos - there.pos AS align, there.pos AS pos, early, early OR slots > 0 AS slotted FROM here JOIN there USING (w, key) WHERE whole OR 2 * slots <= w),
met AS MATERIALIZED (SELECT r, tid, align, w, bare, count(DISTINCT pos) AS n_at, count(DISTINCT pos) FILTER (slotted) AS n_slotted, bool_or(early) AS early FROM hit GROUP BY r, tid, align, w, n, whole, bare HAVING NOT whole OR count(DISTINCT pos) = n - w + 1),
place AS (SELECT DISTINCT r, tid, align, p FROM (SELECT r, tid, align, unnest(range(pos, pos + w)) AS p FROM hit SEMI JOIN met USING (r, tid, align) WHERE slotted)),
pair AS (SELECT DISTINCT r, tid, align, own, typed, a, b FROM (SELECT r, tid, align, own, template[p + 1] AS typed, raw[align + p + 1] AS a, own[p + 1] AS b
 FROM place JOIN (SELECT tid, template, unnest(lists) AS own FROM item) USING (tid) JOIN (SELECT r, raw FROM line WHERE kind = 'd') USING (r)) WHERE typed IN ('<num>', '<unit>', '<name>')),
judged AS (SELECT r, tid, align, own, count(typed) = count(DISTINCT typed || ' ' || a) AND count(typed) = count(DISTINCT typed || ' ' || b) AS one_to_one, coalesce(bool_or(a <> b), false) AS other
 FROM (SELECT r, tid, align, own FROM met JOIN (SELECT tid, unnest(lists) AS own FROM item) USING (tid) WHERE n_slotted > 0) LEFT JOIN pair USING (r, tid, align, own) GROUP BY r, tid, align, own),
good AS (SELECT r, tid, align, any_value(n_slotted) AS n, bool_and(other) AS other FROM judged JOIN met USING (r, tid, align) JOIN (SELECT r, raw FROM line WHERE kind = 'd') USING (r)
 WHERE one_to_one AND NOT (bare AND other) AND (NOT early OR raw[align + 1] = own[1]) GROUP BY r, tid, align),
found AS (SELECT r, tid, n_at - n_slotted AS n, false AS other FROM met WHERE n_at > n_slotted UNION ALL SELECT r, tid, n, other FROM good)
SELECT id AS doc_id, item_id, sum(found.n)::BIGINT AS n_windows, bool_or(other) AS reparameterised FROM found JOIN item USING (tid) JOIN line ON line.kind = 'd' AND line.r = found.r GROUP BY line.r, id, item_id""",
    # All windows, those that also start in an earlier document, the places they cover.
    "op10_substring_dedup": r"""WITH ws AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM ws WHERE len(w) >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
cov AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM gone),
words AS (SELECT doc_id, w[pos] AS word, pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM ws WHERE doc_id IN (SELECT doc_id FROM cov))),
cut AS (SELECT doc_id, count(*) FILTER (cov.pos IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (cov.pos IS NULL), '') AS kept FROM words LEFT JOIN cov USING (doc_id, pos) GROUP BY 1)
SELECT ws.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256 FROM ws LEFT JOIN cut ON cut.doc_id = ws.doc_id""",
    # Checksums by halves of bytes, words at distance one of those with an equal beginning or end, chains of forms.
    "op11_spelling_variants": rf"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
hexed AS (SELECT *, hex(doc_id || ':' || run) AS hx FROM runs),
summed AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(0, length(hx)), lambda i: (instr('0123456789ABCDEF', substr(hx, xor(i, 1) + 1, 1)) - 1)::UBIGINT)),
 lambda s, x: xor(s >> 4, {CRC_LIST}[(xor(s, x) & 15)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM hexed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM summed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
plain AS MATERIALIZED (SELECT word, n, translate(word, '{WIDE}', '{NARROW}') AS p FROM words),
meet AS (SELECT a.word AS u, a.p AS pu, b.word AS w, b.p AS pw FROM plain a JOIN plain b ON left(a.p, 3) = left(b.p, 3) AND abs(strlen(a.p) - strlen(b.p)) <= 1
 UNION SELECT a.word, a.p, b.word, b.p FROM plain a JOIN plain b ON right(a.p, 3) = right(b.p, 3) AND abs(strlen(a.p) - strlen(b.p)) <= 1),
near AS MATERIALIZED (SELECT u, w FROM meet WHERE u <> w AND levenshtein(pu, pw) = 1),
best AS MATERIALIZED (SELECT u, count(*) AS n_near, first(w ORDER BY n DESC, w COLLATE "binary") AS form, max(n) AS form_n FROM near JOIN words ON word = w GROUP BY 1),
joined AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best ON u = word),
chain AS (SELECT word, word AS root, 0 AS step FROM joined UNION ALL SELECT chain.word, joined.form, step + 1 FROM chain JOIN joined ON joined.word = chain.root WHERE joined.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM joined JOIN (SELECT word, last(root ORDER BY step) AS root FROM chain GROUP BY 1) USING (word)""",
}
