"""Column expressions on sequences and k-mers; all are built-in functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for "no allowed signature"; sorts after every m-mer.
NO_SIGNATURE = "~"
#: Most symbols that a long holds.
PACKED = 31


def normalize(seq: Column) -> Column:
    """ACGT in upper case; every other symbol is left and breaks k-mers."""
    return F.translate(seq, "acgt", "ACGT")


def runs(seq: Column) -> Column:
    """Maximal runs of valid symbols; null gives none."""
    return F.filter(F.split(F.coalesce(normalize(seq), F.lit("")), "[^ACGT]+"), lambda s: s != "")


def homopolymer_compressed(seq: Column) -> Column:
    """Equal neighbours collapsed, after normalisation; runs of invalid symbols collapse to one break."""
    return F.regexp_replace(F.regexp_replace(normalize(seq), "[^ACGT]+", "N"), r"([ACGT])\1+", "$1")


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def windows(run: Column, k: int) -> Column:
    """All k-mers of a run, in order; none if it is shorter than k."""
    starts = F.when(F.length(run) >= k, F.sequence(F.lit(1), F.greatest(F.length(run) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(run, i, F.lit(k)))


def chunks(run: Column, k: int, size: int) -> Column:
    """A run, as binary, cut into parts of `size` windows, neighbours sharing k - 1 symbols, each with the place of its first."""
    last = F.length(run) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.substr(run, i + 1, F.lit(size + k - 1)).cast("string").alias("part")))


def symbol_at(kmer: Column, pos: int) -> Column:
    """The symbol at a 0-based place."""
    return F.substring(kmer, pos + 1, 1)


def symbol_number(symbol: Column) -> Column:
    """A, C, G, T as 0 to 3; -1 for anything else."""
    return F.when(F.length(symbol) == 1, F.instr(F.lit("ACGT"), symbol) - 1).otherwise(F.lit(-1))


def to_long(kmer: Column) -> Column:
    """The packed value, 2 bits a symbol, as decimal(38,0); up to 63 symbols, null for longer ones."""
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(F.length(kmer) <= 63, F.aggregate(F.split(kmer, ""), zero, lambda s, c: (s * 4 + F.instr(F.lit("ACGT"), c) - 1).cast("decimal(38,0)")))


def to_words(kmer: Column) -> Column:
    """The packed value of a k-mer of any length as an array of unsigned 64-bit words of 32 symbols, the highest first."""
    words = F.ceil(F.length(kmer) / 32).cast("int")
    full = F.lpad(kmer, words * 32, "A")
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: to_long(F.substr(full, i * 32 + 1, F.lit(32))).cast("decimal(20,0)"))


def unpack(packed: Column, k: int) -> Column:
    """The k-mer of a packed value, put together from strings of four symbols."""
    four = F.array(*(F.lit("".join(x)) for x in product("ACGT", repeat=4)))
    parts = [F.get(four, F.shiftright(packed, 8 * i).bitwiseAND(F.lit(255)).cast("int")) for i in reversed(range(-(-k // 4)))]
    return F.right(F.concat(*parts), F.lit(k))


def _allowed(m: Column) -> Column:
    return ~m.rlike("(TT.|TGT)$") & (F.instr(F.substring(m, 2, 256), "AA") == 0) & ~m.startswith("AAA") & ~m.startswith("ACA")


def normalized_mmer(m: Column) -> Column:
    """The smaller allowed one of an m-mer and its reverse complement, else the sentinel."""
    r = reverse_complement(m)
    return F.least(F.when(_allowed(m), m).otherwise(F.lit(NO_SIGNATURE)), F.when(_allowed(r), r).otherwise(F.lit(NO_SIGNATURE)))


def signature(kmer: Column, size: int) -> Column:
    """The smallest normalised m-mer of a k-mer (its canonical minimizer)."""
    return F.array_min(F.transform(windows(kmer, size), normalized_mmer))


def signature_number(sig: Column, size: int) -> Column:
    """A signature packed as a number; the sentinel is 4**size."""
    return F.when(sig == NO_SIGNATURE, F.lit(4**size).cast("decimal(38,0)")).otherwise(to_long(sig))


def counter_bytes(value: int) -> int:
    """Bytes that hold a counter; at least one."""
    return max(1, (int(value).bit_length() + 7) // 8)
