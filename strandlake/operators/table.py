"""K-mer tables: (kmer, count) with unique k-mers, and the metadata that later operations default to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KmerMeta:
    k: int
    canonical: bool = True
    min_count: int = 1
    max_count: int = 1_000_000_000
    counter_size: int = 4
    signature_len: int = 9


def _catalog_name(path: str) -> str:
    return f"kmers_{sha256(path.rstrip('/').encode()).hexdigest()[:24]}"


@dataclass(frozen=True)
class KmerTable:
    """A DataFrame (kmer string, count long) and its metadata; buckets is their number where df reads files saved in buckets."""

    df: DataFrame
    meta: KmerMeta
    buckets: int | None = None

    def cut(self, min_count: int | None = None, max_count: int | None = None) -> DataFrame:
        """Rows within cutoffs (inclusive), by default those of the metadata; 0 means the default."""
        low, high = min_count or self.meta.min_count, max_count or self.meta.max_count
        return self.df.where(F.col("count").between(low, high))

    def limited_to(self, min_count: int | None = None, max_count: int | None = None) -> KmerTable:
        """The table seen within narrower cutoffs; raises where they lie outside those it was made with."""
        low, high = min_count or self.meta.min_count, max_count or self.meta.max_count
        if not self.meta.min_count <= low <= high <= self.meta.max_count:
            raise ValueError(f"cutoffs must lie within {self.meta.min_count} to {self.meta.max_count}")
        return KmerTable(self.df, replace(self.meta, min_count=low, max_count=high), self.buckets)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Writes Parquet in k-mer order and one line of JSON beside it.

        With `buckets`, k-mers are dealt by hash into that many sorted files. Two tables of equally many buckets are joined
        from their files without a shuffle, and a lookup reads one file.
        """
        spark, rows = self.df.sparkSession, self.df.select("kmer", "count")
        if buckets:
            # The partition of a row is its bucket, so each bucket is one file.
            out = rows.repartition(buckets, "kmer").write.bucketBy(buckets, "kmer").sortBy("kmer").format("parquet")
            out.option("path", f"{path}/kmers").mode("overwrite").saveAsTable(_catalog_name(path))
        else:
            rows.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/kmers")
        about = json.dumps(asdict(self.meta) | ({"buckets": buckets} if buckets else {}))
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KmerTable:
        """A saved table; one in buckets is declared to the session's catalog under a name made of its path, unless it is there."""
        about = json.loads(spark.read.text(f"{path}/meta").first()[0])
        buckets = about.pop("buckets", None)
        if not buckets:
            return KmerTable(spark.read.parquet(f"{path}/kmers"), KmerMeta(**about))
        name, where = _catalog_name(path), f"{path}/kmers".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (kmer STRING, count BIGINT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
        return KmerTable(spark.table(name), KmerMeta(**about), buckets)

    def check(self, kmer: str) -> int:
        """The counter of a k-mer as given (not made canonical), 0 if absent."""
        if len(kmer) != self.meta.k or set(kmer) - set("ACGT"):
            raise ValueError(f"not a {self.meta.k}-mer: {kmer!r}")
        row = self.cut().where(F.col("kmer") == kmer).first()
        return row["count"] if row else 0

    def is_kmer(self, kmer: str) -> bool:
        return self.check(kmer) > 0

    def n_kmers(self) -> int:
        return self.cut().count()

    def info(self) -> DataFrame:
        """One row of metadata, with the number of k-mers."""
        return self.cut().agg(F.count("*").alias("total_kmers")).select(*(F.lit(v).alias(n) for n, v in asdict(self.meta).items()), "total_kmers")

    def rows(self):
        """Iterates over (kmer, count) within the cutoffs, partition by partition."""
        return ((r["kmer"], r["count"]) for r in self.cut().toLocalIterator())

    # Transforms. Each takes optional cutoffs on the stored counters and a ceiling for the result.

    def reduce(self, min_count: int | None = None, max_count: int | None = None, max_counter: int | None = None) -> KmerTable:
        kept = self.cut(min_count, max_count)
        if max_counter:
            kept = kept.withColumn("count", F.least("count", F.lit(max_counter).cast("long")))
        return KmerTable(kept, replace(self.meta, min_count=min_count or self.meta.min_count, max_count=max_count or self.meta.max_count))

    def sort(self) -> KmerTable:
        return KmerTable(self.cut().orderBy("kmer"), self.meta)

    def compact(self, min_count: int | None = None, max_count: int | None = None) -> KmerTable:
        """All counters 1; the result's minimum is 1, so that reading it again keeps its rows."""
        return KmerTable(self.cut(min_count, max_count).withColumn("count", F.lit(1).cast("long")), replace(self.meta, min_count=1, counter_size=1))

    def set_counts(self, value: int) -> KmerTable:
        if value < 1:
            raise ValueError("the counter must be positive")
        return KmerTable(self.cut().withColumn("count", F.lit(value).cast("long")), replace(self.meta, min_count=1, max_count=(1 << 32) - 1, counter_size=4))

    def histogram(self, min_count: int | None = None, max_count: int | None = None) -> DataFrame:
        """(count, n_kmers) for every value within the limits, zeros included."""
        low = min_count or self.meta.min_count
        high = max_count or min(self.meta.max_count, 10_000, (1 << (8 * max(1, self.meta.counter_size))) - 1)
        there = self.cut(low, high).groupBy("count").agg(F.count("*").alias("n"))
        every = self.df.sparkSession.range(low, high + 1).withColumnRenamed("id", "count")
        return every.join(there, "count", "left").select("count", F.coalesce("n", F.lit(0)).cast("long").alias("n_kmers"))

    def dump(self, min_count: int | None = None, max_count: int | None = None, ordered: bool = False) -> DataFrame:
        """One text line per k-mer: kmer, tab, counter. Cutoffs outside those of the table are an error."""
        kept = self.limited_to(min_count, max_count).cut()
        return (kept.orderBy("kmer") if ordered else kept).select(F.concat_ws("\t", "kmer", F.col("count").cast("string")).alias("value"))
