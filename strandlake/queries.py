"""The registered k-mer queries and their SQL.

Reads are the documents with letters recoded to ACGT; everything else stays an invalid symbol.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as K
from . import operators as O
from .operators.setops import MODES
from .plans import evaluate
from .sources.kff import read_kff, write_kff
from .sources.shared import shared_dir

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = ("ACGT" * 7)[:26] * 2
K_COUNT, K_READS, K_LONG, K_WIDE, SIG = 11, 5, 27, 64, 5


#: The tables that sequences are read from, all rows of each: (table, id, text).
DOCUMENTS, TURNS, PAGES = ("documents", "doc_id", "text"), ("conversations", "conv_id", "text"), ("pages", "page_id", "html")


def reads(spark: SparkSession, sf_dir: str, source: tuple[str, str, str] = DOCUMENTS) -> DataFrame:
    name, ident, text = source
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(F.col(ident).alias("read_id"), F.translate(text, LETTERS, SYMBOLS).alias("seq"))


def _table(spark: SparkSession, d: str, source: tuple[str, str, str] = DOCUMENTS, k: int = K_COUNT, low: int = 1, top: int = 1_000_000) -> O.KmerTable:
    return O.count(reads(spark, d, source), O.CountConfig(k=k, min_count=low, max_counter=top))


def _kff(s: SparkSession, d: str) -> DataFrame:
    """The counts of the documents, written as KFF files and read back."""
    path = f"{shared_dir(s)}/strandlake-kff-{uuid.uuid4().hex}"
    write_kff(_table(s, d), path)
    return read_kff(s, path).df


def _pair(s: SparkSession, d: str) -> tuple[O.KmerTable, O.KmerTable]:
    return _table(s, d), _table(s, d, TURNS)


def _multi(s: SparkSession, d: str) -> DataFrame:
    return O.simple_rows(*_pair(s, d), {"i": ("intersect", None), "u": ("union", None), "s": ("kmers_subtract", None)})


def _read_counters(s: SparkSession, d: str) -> DataFrame:
    held = O.counters(reads(s, d), _table(s, d, k=K_READS, low=100), "read_id")
    return held.select("read_id", F.posexplode("counters").alias("pos", "n"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("read_id"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, SYMBOLS).alias("seq"))


def _check_kmer(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([("AACTG", _table(s, d, k=K_READS).check("AACTG"))], "kmer string, count long")


def _estimate_audit(s: SparkSession, d: str) -> DataFrame:
    """(count, n_exact, within) for all k-mers (count 0) and those of count 1 to 20: is the sketch within 2 % of all k-mers of it?"""
    exact = O.totals(reads(s, d), O.CountConfig(k=K_COUNT)).groupBy("count").agg(F.count("*").alias("n"))
    exact = exact.unionByName(exact.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).cast("long").alias("count"), "n"))
    sketch = O.sketch_histogram(reads(s, d), K_COUNT, 20, 1, 20)
    both = sketch.join(exact, "count", "left").select("count", "n_kmers", F.coalesce("n", F.lit(0)).cast("long").alias("n_exact"))
    every = F.max(F.when(F.col("count") == 0, F.col("n_exact"))).over(Window.partitionBy(F.lit(0)))  # of these 21 rows
    return both.select("count", "n_exact", (F.abs(F.col("n_kmers") - F.col("n_exact")) <= every * 0.02).alias("within"))


def _support(s: SparkSession, d: str) -> O.KmerTable:
    return _table(s, d, k=K_READS, low=1500)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "count_canonical": lambda s, d: O.totals(reads(s, d), O.CountConfig(k=K_COUNT)),
    "count_forward": lambda s, d: O.totals(reads(s, d), O.CountConfig(k=K_COUNT, canonical=False)),
    "count_long": lambda s, d: O.totals(_joined(s, d), O.CountConfig(k=K_LONG)),
    "count_wide": lambda s, d: O.totals(_joined(s, d), O.CountConfig(k=K_WIDE)),
    "count_cutoff_clamp": lambda s, d: O.count(reads(s, d), O.CountConfig(k=K_COUNT, min_count=2, max_count=50, max_counter=5)).df,
    "run_stats": lambda s, d: O.statistics(reads(s, d), O.CountConfig(k=K_COUNT, min_count=2, max_count=50)),
    "histogram_dense": lambda s, d: _table(s, d).histogram(1, 40),
    "reduce": lambda s, d: _table(s, d).reduce(2, 20, 7).df,
    "compact": lambda s, d: _table(s, d).compact(2).df,
    "set_counts": lambda s, d: _table(s, d).set_counts(9).df,
    "sort": lambda s, d: _table(s, d).sort().df,
    "dump": lambda s, d: _table(s, d).dump(2),
    "kff_round_trip": _kff,
    **{f"intersect_{m}": (lambda s, d, m=m: O.combine(*(t.cut() for t in _pair(s, d)), "intersect", m)) for m in MODES},
    **{f"union_{m}": (lambda s, d, m=m: O.combine(*(t.cut() for t in _pair(s, d)), "union", m)) for m in MODES},
    **{n: (lambda s, d, n=n: O.combine(*(t.cut() for t in _pair(s, d)), n)) for n in ("kmers_subtract", "reverse_kmers_subtract", "counters_subtract", "reverse_counters_subtract")},
    "simple_multi_output": _multi,
    "compare": lambda s, d: s.createDataFrame([(O.same(*_pair(s, d)),)], "same boolean"),
    "complex_expr": lambda s, d: evaluate("(a + min b) * max c", {"a": _table(s, d), "b": _table(s, d, TURNS), "c": _table(s, d, PAGES)}).df,
    "read_counters": _read_counters,
    "read_filter_int": lambda s, d: O.filter_reads(reads(s, d), _support(s, d), 10, 400).select("read_id"),
    "read_filter_frac": lambda s, d: O.filter_reads(reads(s, d), _support(s, d), 0.05, 0.7).select("read_id"),
    "read_trim": lambda s, d: O.trim_reads(_joined(s, d), _support(s, d), 1500),
    "read_hard_mask": lambda s, d: O.mask_reads(reads(s, d), _support(s, d), 1500),
    "kmer_count": lambda s, d: _table(s, d).reduce(2, 30).df.agg(F.count("*").alias("n")),
    "info": lambda s, d: _table(s, d).info().select("k", "canonical", "min_count", "total_kmers"),
    "check_kmer": _check_kmer,
    "homopolymer": lambda s, d: O.totals(reads(s, d), O.CountConfig(k=K_COUNT, homopolymer=True)),
    "signature": lambda s, d: O.signatures(reads(s, d), K_COUNT, SIG),
    "superkmers": lambda s, d: O.super_kmers(reads(s, d), K_COUNT, SIG),
    "revcomp": lambda s, d: _table(s, d).df.select("kmer", K.reverse_complement(F.col("kmer")).alias("revcomp"), K.symbol_at(F.col("kmer"), 3).alias("symbol"), K.symbol_number(K.symbol_at(F.col("kmer"), 3)).cast("int").alias("number")),
    "kmers_of_kmers": lambda s, d: O.kmers_of_kmers(_table(s, d), 7),
    "estimate_hist_sketch": lambda s, d: O.sketch_histogram(reads(s, d), K_COUNT, 1000, 1, 20),
    "estimate_audit": _estimate_audit,
    "estimate_hist_sampled": lambda s, d: O.estimated_histogram(reads(s, d), K_COUNT),
}


def _cte(k: int = K_COUNT, source: tuple[str, str, str] = DOCUMENTS, name: str = "cnt", text: str | None = None) -> str:
    rows, ident, column = source
    text = text or f"translate({column},'{LETTERS}','{SYMBOLS}')"
    canon = "least(f, reverse(translate(f,'ACGT','TGCA')))"
    return (
        f"runs_{name} AS (SELECT {ident} AS doc_id, unnest(regexp_split_to_array({text},'[^ACGT]+')) AS s FROM {rows}), "
        f"km_{name} AS (SELECT doc_id, substr(s,i,{k}) AS f FROM (SELECT doc_id, s, unnest(range(1,length(s)-{k}+2)) AS i FROM runs_{name} WHERE length(s)>={k})), "
        f'{name} AS (SELECT {canon} AS kmer, count(*) AS "count" FROM km_{name} GROUP BY 1)'
    )


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes or (_cte(),))} {body}"


_SQL_MODES = {"min": "least(a.count,b.count)", "max": "greatest(a.count,b.count)", "sum": "a.count+b.count", "diff": "greatest(a.count-b.count,0)", "left": "a.count", "right": "b.count"}
_AB = (_cte(name="a"), _cte(source=TURNS, name="b"))
_JOINED = f"translate(regexp_replace(text,'[^A-Za-z]','','g'),'{LETTERS}','{SYMBOLS}')"
_HPC = "regexp_replace(translate(text,'{0}','{1}'),'[^ACGT]+','N','g')".format(LETTERS, SYMBOLS)
for _c in "ACGT":
    _HPC = f"regexp_replace({_HPC},'{_c}+','{_c}','g')"
_OK = "(NOT regexp_matches({0},'(TT.|TGT)$') AND instr(substr({0},2),'AA')=0 AND NOT {0} LIKE 'ACA%' AND NOT {0} LIKE 'AAA%')"
_REV = "reverse(translate({0},'ACGT','TGCA'))"
_NORM = f"least(CASE WHEN {_OK.format('m')} THEN m ELSE '~' END, CASE WHEN {_OK.format(_REV.format('m'))} THEN {_REV.format('m')} ELSE '~' END)"
_SIGNED = f"""sg AS (SELECT kmer, "count", min({_NORM}) AS signature FROM (SELECT kmer, "count", substr(kmer,i,{SIG}) AS m FROM (SELECT kmer, "count", unnest(range(1,{K_COUNT - SIG + 2})) AS i FROM cnt)) GROUP BY 1, 2)"""
_POS = f"""p AS (SELECT doc_id AS read_id, i-1 AS pos, substr(t,i,{K_READS}) AS f FROM (SELECT doc_id, t, unnest(range(1,length(t)-{K_READS}+2)) AS i FROM (SELECT doc_id, translate(text,'{LETTERS}','{SYMBOLS}') AS t FROM documents))),
pc AS (SELECT read_id, pos, coalesce(c.count, 0) AS n FROM p LEFT JOIN (SELECT * FROM cnt WHERE "count" >= {{low}}) c ON c.kmer = CASE WHEN regexp_matches(p.f,'[^ACGT]') THEN NULL ELSE least(p.f, {_REV.format('p.f')}) END)"""


def _reads_sql(body: str, low: int) -> str:
    return _with(body, _cte(K_READS), _POS.replace("{low}", str(low)))


_SEQ = f"translate(text,'{LETTERS}','{SYMBOLS}')"
# All windows of all runs with their signatures, islands of equal ones by lag.
_SUPER = f"""WITH runs AS (SELECT doc_id, unnest(rs) AS s, unnest(range(len(rs))) AS run_no FROM (SELECT doc_id, list_filter(regexp_split_to_array({_SEQ},'[^ACGT]+'), lambda x: x <> '') AS rs FROM documents)),
win AS (SELECT doc_id, run_no, i-1 AS place, substr(s,i,{K_COUNT}) AS kmer FROM (SELECT *, unnest(range(1,length(s)-{K_COUNT}+2)) AS i FROM runs WHERE length(s)>={K_COUNT})),
sg AS (SELECT doc_id, run_no, place, min({_NORM}) AS signature FROM (SELECT doc_id, run_no, place, substr(kmer,i,{SIG}) AS m FROM (SELECT *, unnest(range(1,{K_COUNT - SIG + 2})) AS i FROM win)) GROUP BY 1, 2, 3),
heads AS (SELECT *, CASE WHEN signature IS DISTINCT FROM lag(signature) OVER (PARTITION BY doc_id, run_no ORDER BY place) THEN 1 ELSE 0 END AS head FROM sg),
isles AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, run_no ORDER BY place) AS n FROM heads)
SELECT doc_id AS read_id, run_no::INTEGER AS run_no, min(place)::INTEGER AS start, (count(*)+{K_COUNT - 1})::INTEGER AS length, signature FROM isles GROUP BY doc_id, run_no, n, signature"""
# The places before the first k-mer without support.
_TRIM = _with(f"""SELECT read_id, substr(t,1,(good+{K_READS - 1})::BIGINT) AS seq FROM (SELECT read_id, coalesce(min(pos) FILTER (n=0), count(*)) AS good FROM pc GROUP BY 1) JOIN (SELECT doc_id, {_JOINED} AS t FROM documents) ON doc_id = read_id WHERE good > 0""", _cte(K_READS), _POS.replace("{low}", "1500").replace(_SEQ, _JOINED))
# A base is masked if one of the windows that hold it has no support.
_MASK = _reads_sql(f"""SELECT d.doc_id AS read_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.seq,'') END AS seq FROM documents d LEFT JOIN (
SELECT read_id, string_agg(CASE WHEN least_n = 0 THEN 'N' ELSE c END, '' ORDER BY pos) AS seq FROM (
SELECT b.read_id, b.pos, b.c, min(pc.n) OVER (PARTITION BY b.read_id ORDER BY b.pos ROWS BETWEEN {K_READS - 1} PRECEDING AND CURRENT ROW) AS least_n FROM (SELECT doc_id AS read_id, i-1 AS pos, substr(t,i,1) AS c FROM (SELECT doc_id, t, unnest(range(1,length(t)+1)) AS i FROM (SELECT doc_id, {_SEQ} AS t FROM documents))) b LEFT JOIN pc USING (read_id, pos)) GROUP BY 1) m ON m.read_id = d.doc_id""", 1500)

ORACLE_SQL: dict[str, str] = {
    "count_canonical": _with('SELECT kmer, "count" FROM cnt'),
    "count_forward": _with('SELECT f AS kmer, count(*) AS "count" FROM km_cnt GROUP BY 1'),
    "count_long": _with('SELECT kmer, "count" FROM cnt', _cte(K_LONG, text=_JOINED)),
    "count_wide": _with('SELECT kmer, "count" FROM cnt', _cte(K_WIDE, text=_JOINED)),
    "count_cutoff_clamp": _with('SELECT kmer, least("count",5) AS "count" FROM cnt WHERE "count" BETWEEN 2 AND 50'),
    "run_stats": _with('SELECT count(*) FILTER ("count"<2) AS n_below, count(*) FILTER ("count">50) AS n_above, count(*) AS n_unique, count(*) FILTER ("count" BETWEEN 2 AND 50) AS n_unique_counted, sum("count")::BIGINT AS n_total, (SELECT count(*) FROM documents) AS n_reads FROM cnt'),
    "histogram_dense": _with('SELECT r.i AS "count", count(kmer) AS n_kmers FROM (SELECT unnest(range(1,41)) AS i) r LEFT JOIN cnt ON cnt."count"=r.i GROUP BY 1'),
    "reduce": _with('SELECT kmer, least("count",7) AS "count" FROM cnt WHERE "count" BETWEEN 2 AND 20'),
    "kff_round_trip": _with('SELECT kmer, "count" FROM cnt'),
    "compact": _with('SELECT kmer, 1::BIGINT AS "count" FROM cnt WHERE "count">=2'),
    "set_counts": _with('SELECT kmer, 9::BIGINT AS "count" FROM cnt'),
    "sort": _with('SELECT kmer, "count" FROM cnt ORDER BY kmer'),
    "dump": _with("""SELECT kmer || chr(9) || "count" AS value FROM cnt WHERE "count">=2"""),
    **{f"intersect_{m}": _with(f'SELECT * FROM (SELECT kmer, {e} AS "count" FROM a JOIN b USING (kmer)) WHERE "count">0', *_AB) for m, e in _SQL_MODES.items()},
    **{f"union_{m}": _with(f'SELECT * FROM (SELECT kmer, CASE WHEN a.count IS NULL THEN b.count WHEN b.count IS NULL THEN a.count ELSE {e} END AS "count" FROM a FULL JOIN b USING (kmer)) WHERE "count">0', *_AB) for m, e in _SQL_MODES.items()},
    "kmers_subtract": _with("SELECT * FROM a WHERE kmer NOT IN (SELECT kmer FROM b)", *_AB),
    "reverse_kmers_subtract": _with("SELECT * FROM b WHERE kmer NOT IN (SELECT kmer FROM a)", *_AB),
    "counters_subtract": _with('SELECT kmer, a.count-coalesce(b.count,0) AS "count" FROM a LEFT JOIN b USING (kmer) WHERE a.count-coalesce(b.count,0)>0', *_AB),
    "reverse_counters_subtract": _with('SELECT kmer, b.count-coalesce(a.count,0) AS "count" FROM b LEFT JOIN a USING (kmer) WHERE b.count-coalesce(a.count,0)>0', *_AB),
    "simple_multi_output": _with("SELECT 'i' AS name, kmer, least(a.count,b.count) AS \"count\" FROM a JOIN b USING (kmer) UNION ALL SELECT 'u', kmer, coalesce(a.count,0)+coalesce(b.count,0) FROM a FULL JOIN b USING (kmer) UNION ALL SELECT 's', kmer, \"count\" FROM a WHERE kmer NOT IN (SELECT kmer FROM b)", *_AB),
    "compare": _with("SELECT count(*)=0 AS same FROM a FULL JOIN b USING (kmer) WHERE a.count IS DISTINCT FROM b.count", *_AB),
    "complex_expr": _with('SELECT kmer, greatest(u."count", c."count") AS "count" FROM (SELECT kmer, CASE WHEN a.count IS NULL THEN b.count WHEN b.count IS NULL THEN a.count ELSE least(a.count,b.count) END AS "count" FROM a FULL JOIN b USING (kmer)) u JOIN c USING (kmer)', *_AB, _cte(source=PAGES, name="c")),
    "read_counters": _reads_sql("SELECT read_id, pos::INTEGER AS pos, n FROM pc", 100),
    "read_filter_int": _reads_sql("SELECT read_id FROM pc GROUP BY 1 HAVING count(*) FILTER (n>0) BETWEEN 10 AND 400", 1500),
    "read_filter_frac": _reads_sql("SELECT read_id FROM pc GROUP BY 1 HAVING count(*) FILTER (n>0) BETWEEN floor(0.05::FLOAT*count(*)::FLOAT) AND floor(0.7::FLOAT*count(*)::FLOAT) UNION ALL SELECT doc_id FROM documents WHERE coalesce(length(text),0)<{K_READS}".replace("{K_READS}", str(K_READS)), 1500),
    "kmer_count": _with('SELECT count(*) AS n FROM cnt WHERE "count" BETWEEN 2 AND 30'),
    "info": _with(f"SELECT {K_COUNT} AS k, true AS canonical, 1 AS min_count, count(*) AS total_kmers FROM cnt"),
    "check_kmer": _with("SELECT * FROM cnt WHERE kmer='AACTG'", _cte(K_READS)),
    "homopolymer": _with('SELECT kmer, "count" FROM cnt', _cte(text=_HPC)),
    "signature": _with('SELECT signature, sum("count")::BIGINT AS n FROM sg GROUP BY 1', _cte(), _SIGNED),
    "revcomp": _with(f"SELECT kmer, {_REV.format('kmer')} AS revcomp, substr(kmer,4,1) AS symbol, instr('ACGT',substr(kmer,4,1))::INTEGER-1 AS number FROM cnt"),
    "kmers_of_kmers": _with(f"SELECT least(f,{_REV.format('f')}) AS kmer, count(*) AS \"count\" FROM (SELECT substr(kmer,i,7) AS f FROM (SELECT kmer, unnest(range(1,{K_COUNT - 7 + 2})) AS i FROM cnt)) GROUP BY 1"),
    "superkmers": _SUPER,
    "read_trim": _TRIM,
    "read_hard_mask": _MASK,
    "estimate_audit": _with('SELECT r.i AS "count", CASE r.i WHEN 0 THEN (SELECT count(*) FROM cnt) ELSE (SELECT count(*) FROM cnt WHERE "count"=r.i) END AS n_exact, true AS within FROM (SELECT unnest(range(0,21)) AS i) r'),
    "estimate_hist_sampled": _with("""SELECT least("count",65536) AS "count", count(*)*16 AS n_kmers FROM cnt WHERE md5(kmer) LIKE '0%' GROUP BY 1"""),
}
