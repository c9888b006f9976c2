"""First rows, exact samples, running offsets and dense positions, without a single-task sort of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sievra.session import settle

# Vectors per training list, entries per mapping bucket.
TRAIN_VECTORS_PER_LIST = 100
MAPPING_BUCKET = 1_000_000

# Keys of a random sample that the ranges of a histogram are read off, ranges of a histogram, keys that may be left beyond the
# first ones, and how many keys one task may sort.
SAMPLED_KEYS = 10_000
RANGES = 64
BEYOND = 2_000
SORT_LIMIT = 1_000_000


def filter_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose ``col`` starts with ``prefix``, case-sensitive; the scan gets the filter."""
    return df.where(F.col(col).startswith(prefix))


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the order of ``order``, which should be unique.

    The rows are found by their keys and filtered where they are; only they are sorted.
    """
    return head_sample(df, n, *order).orderBy(*order).limit(n)


def _key(keys: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def _up_to_nth(df: DataFrame, n: int, keys: list[Column]) -> DataFrame:
    """The rows whose key is at most the ``n``-th smallest.

    ``df`` should have about ``n`` rows. Up to ``SORT_LIMIT`` of them the key is found by a sort with a limit, which
    takes as many keys to one task as there are rows at most; beyond, by numbering all keys in ranges.
    """
    key = _key(keys)
    ordered = df.select(key.alias("__key"))
    if n > SORT_LIMIT:
        numbered = assign_positions(ordered.select("__key.*"), *[f"k{i}" for i in range(len(keys))])
        last = numbered.where(F.col("pos") == n - 1).select(_key([F.col(f"k{i}") for i in range(len(keys))]).alias("__key"))
        last = last.agg(F.max("__key"))
    else:
        last = ordered.orderBy("__key").limit(n).agg(F.max("__key"))
    return df.where(F.coalesce(key <= last.scalar(), F.lit(n > 0)))


def _range_limits(keys: DataFrame) -> DataFrame:
    """One row, ``limits``: at most ``RANGES`` different keys that cut ``keys(__key)``, a small table, in even parts."""
    step = max(1, keys.count() // RANGES)
    placed = keys.select("__key", F.row_number().over(W.orderBy("__key")).alias("__place"))
    return placed.where(F.col("__place") % step == 0).agg(F.sort_array(F.collect_set("__key")).alias("limits"))


def _roughly_first(df: DataFrame, n: int, keys: list[Column], most: int = BEYOND) -> DataFrame:
    """At least the ``n`` smallest keys and not over ``most`` more, however many partitions there are.

    A search for the ``n``-th key: limits read off about ``SAMPLED_KEYS`` random keys of the range it lies in cut that range
    in up to ``RANGES`` parts, one pass counts the keys of each part, and the part with the ``n``-th key is the next range.
    Keys may be of any type that sorts, structs included: limits stay in one-row tables and are compared by Spark.
    Equal keys cannot be parted; then the search ends with all of them.
    """
    key = _key(keys)
    low, below, inside, near = None, 0, df.count(), df
    while below + inside > n + most:
        rows = near if low is None else near.where(key > low)
        thin = settle(rows.select(key.alias("__key")).sample(min(1.0, SAMPLED_KEYS / inside), seed=0), "sampled-keys")
        limits = settle(_range_limits(thin), "range-limits")
        # The number of limits below a key is its part; keys beyond the last limit are the last part.
        part = F.size(F.filter("limits", lambda limit: limit < F.col("__key")))
        parted = rows.select(key.alias("__key"), limits.scalar().alias("limits")).groupBy(part.alias("part"))
        sizes = {r["part"]: r["n"] for r in parted.agg(F.count("*").alias("n")).collect()}
        found, upto = 0, below + sizes.get(0, 0)
        while upto < n and found < max(sizes):
            found += 1
            upto += sizes.get(found, 0)
        if sizes[found] == inside:
            break
        if found:
            low = limits.select(F.get("limits", F.lit(found - 1))).scalar()
        if found < max(sizes):
            near = df.where(key <= limits.select(F.get("limits", F.lit(found))).scalar())
        below, inside = upto - sizes[found], sizes[found]
    return near


def head_sample(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows by the unique key ``order``; all rows if ``n`` is None.

    Only the keys are sorted; the rows themselves, token arrays included, stay where they are.
    """
    if n is None:
        return df
    keys = [F.col(c) for c in order]
    if n <= 0:
        return df.limit(0)
    near = _roughly_first(df, n, keys)
    return near if near.count() <= n else _up_to_nth(near, n, keys)


def random_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; the same ones for the same seed.

    ``ids`` must be unique. Rows are ordered by the MD5 of their ids and the seed. The first four hex
    digits split them in 65,536 even buckets; the counts tell in which bucket the ``n``-th row lies,
    so only about ``n`` keys go into the sort that finds the exact end of the sample.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    bucket = F.substring(digest, 1, 4)
    sizes = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    running = sizes.withColumn("upto", F.sum("n").over(W.orderBy("b")))
    last_bucket = running.where(F.col("upto") - F.col("n") < n).agg(F.max("b"))
    near = df.where(bucket <= last_bucket.scalar())
    return _up_to_nth(near, n, [digest, *[F.col(c) for c in ids]])


def file_offsets(counts: DataFrame, file_col: str = "file", n_col: str = "n") -> DataFrame:
    """Add ``start`` and ``end``, the running row offsets of each file, in file-name order.

    One row per file goes through one task; it is a listing, not data.
    """
    total = F.sum(n_col).over(
        W.orderBy(file_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return counts.withColumn("end", total).withColumn("start", F.col("end") - F.col(n_col))


def doc_counts(df: DataFrame) -> DataFrame:
    """``(file, n)``: rows of each input file of a scan."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))


def assign_positions(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """``order`` columns plus ``pos``, numbered from 0 in their order, and ``bucket``.

    The unique keys alone are range-partitioned and sorted, and numbered within their partition.
    That numbering is written down, so that a lost executor cannot change the partition limits
    between counting the partitions and using the counts; then the offset of each partition is added.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = df.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = settle(
        sorted_keys.select(
            *order,
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__seq"),
        ),
        "positions",
    )
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # One offset per partition: never more rows than partitions.
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .select(*order, (F.col("__offset") + F.col("__seq")).alias("pos"))
        .withColumn("bucket", F.floor(F.col("pos") / MAPPING_BUCKET).cast("int"))
    )
