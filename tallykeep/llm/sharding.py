"""Shards by extendible hashing (operator 2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, packed_row, written

#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: Bits of a key's hash.
BITS = 60
#: Levels that one pass over the sizes goes down.
LEVELS = 4


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves (low, depth, prefix, bytes) of the directory over sizes (h, bytes).

    A bucket is the hashes with some prefix. It stays whole if its bytes are within the limit, and else splits
    on the next bit. Each pass sums the sizes by a prefix some levels below the buckets still too large, adds
    those sums up to every level between, and takes for each hash the shallowest level that fits. A bucket that
    is too large and has one key alone can't be split; it takes the full depth. Nothing of it is on the driver.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    above, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + LEVELS)
    rest, leaves = sizes, None
    while True:
        low = rest.groupBy(_prefix(F.col("h"), depth).alias("low")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys"), F.min("h").alias("key"))
        low = written(low, "prefixes")
        up = low.select("low", "bytes", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("low"), (F.lit(depth) - F.col("depth")).cast("int")))
        fits = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
        best = up.join(fits, ["depth", "prefix"]).groupBy("low").agg(F.min(F.struct("depth", "prefix", "total")).alias("b"))
        low = low.join(best, "low", "left")
        done = low.where("b is not null or keys = 1")
        shift = F.lit(BITS - depth)
        done = done.select(
            F.call_function("shiftleft", F.col("low"), shift).alias("low"),
            F.lit(depth).alias("at"),
            F.coalesce("b.depth", F.lit(BITS)).alias("depth"),
            F.coalesce("b.prefix", "key").alias("prefix"),
            F.coalesce("b.total", "bytes").alias("bytes"),
        )
        done = written(done, "leaves")
        leaves = done if leaves is None else leaves.union(done)
        if depth == BITS:
            return leaves
        large = low.where("b is null and keys > 1").select(F.col("low").alias("_low"))
        if large.isEmpty():
            return leaves
        rest = written(rest.join(large, _prefix(F.col("h"), depth) == F.col("_low"), "left_semi"), "rest")
        above, depth = depth + 1, min(BITS, depth + 2 * LEVELS)


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """The shard of every row: doc_id, depth, prefix, page, bytes, shard_bytes.

    depth is the number of hash bits that name the shard and prefix their value; page is 0 but for a key whose
    own rows are over the limit, which no hash can part: those are dealt to pages by their contents' hash and
    then in order, each within the limit unless one row alone is larger.

    Null and empty texts have no bytes and still belong to a shard; a null id counts as an empty one; repeated
    ids go to the same shard. No rows give no rows. Other columns are ignored.
    """
    rows = written(_sized(docs, doc_id, text), "rows")
    fits, over = _placed(rows, rows, limit)
    out = ["doc_id", "depth", "prefix", "page", "bytes", "shard_bytes"]
    if over is None:
        return fits.select(out)
    over = written(over.drop("shard_bytes"), "pages")
    total = over.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return fits.select(out).union(over.join(total, ["h", "page"]).select(out))


def _sized(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes")
    return docs.select(F.col(doc_id).alias("doc_id"), key_hash(F.col(doc_id)).alias("h"), size, *more).withColumn("part", F.spark_partition_id())


def _placed(sized: DataFrame, rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """rows, of which sized has the sizes, with depth, prefix, page: those of shards within the limit, and those of larger keys.

    The place follows from the row itself, whose other columns go with it: so rows that repeat an id keep a page each.
    """
    leaves = directory(written(sized.groupBy("h").agg(F.sum("bytes").alias("bytes")), "sizes"), limit)
    keyed = None
    for (at,) in sorted(leaves.select("at").distinct().collect()):
        some = leaves.where(F.col("at") == at).drop("at")
        key = F.call_function("shiftleft", _prefix(F.col("h"), at), F.lit(BITS - at))
        got = rows.join(some.withColumnRenamed("bytes", "shard_bytes"), key == some["low"]).drop("low")
        keyed = got if keyed is None else keyed.union(got)
    if keyed is None:
        keyed = rows.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")})
    fits = keyed.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    if leaves.where(F.col("bytes") > limit).isEmpty():
        return fits, None
    # each input partition fills pages of its own, two of whose neighbours are always over half a limit together
    over = keyed.where(F.col("shard_bytes") > limit)
    by_part = F.expr("sum(bytes) OVER (PARTITION BY h, part ORDER BY bytes, doc_id ROWS UNBOUNDED PRECEDING)")
    over = over.withColumn("until", by_part).withColumn("step", F.floor((F.col("until") - 1) / F.lit(limit // 2)).cast("long"))
    return fits, over.withColumn("page", F.col("part").cast("long") * 2**32 + F.greatest("step", F.lit(0).cast("long")) + 1).drop("until", "step")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write the documents with one folder for each shard (depth=, prefix=, page=); every row is in the page that it was dealt to.

    Rows are kept as they are, with all columns: null and empty texts, null ids and repeats too. Pages of a key
    too large alone are folders of their own, so that no folder is over the limit unless one row is. No rows
    write an empty folder. The columns depth, prefix and page must not be among those of docs.
    """
    fits, over = _placed(_sized(docs, doc_id, text), _sized(docs, doc_id, text, packed_row(docs)), limit)
    place = ["depth", "prefix", "page"]
    both = fits.select("row.*", *place)
    if over is not None:
        both = both.union(over.select("row.*", *place))
    both.repartition(*place).write.partitionBy(*place).parquet(path)


def sharding_query(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the shards, and report what is in the files read back: the columns of assign_shards."""
    path = new_path(docs.sparkSession, "shards")
    write_shards(docs.select("doc_id", "text"), path, limit=limit)
    types = "doc_id {}, text string, depth int, prefix long, page long".format(docs.schema["doc_id"].dataType.simpleString())
    back = docs.sparkSession.read.schema(types).parquet(path)
    place = ["depth", "prefix", "page"]
    rows = back.select("doc_id", *place, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    total = rows.groupBy(*place).agg(F.sum("bytes").alias("shard_bytes"))
    return rows.join(F.broadcast(total), place).select("doc_id", *place, "bytes", "shard_bytes")


def sharding_sql(limit: int = SHARD_BYTES) -> str:
    """SQL for sharding_query's rows, where no id has more bytes than the limit."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes
  FROM documents
), l AS (SELECT doc_id, h, bytes, CAST(k AS INTEGER) AS depth, h >> (60 - k) AS prefix FROM d, range(0, 21) t(k)),
s AS (SELECT depth, prefix, sum(bytes) AS total FROM l GROUP BY ALL HAVING sum(bytes) <= {limit}),
b AS (SELECT l.*, total, row_number() OVER (PARTITION BY doc_id, h ORDER BY l.depth) AS r FROM l JOIN s USING (depth, prefix))
SELECT doc_id, depth, prefix, CAST(0 AS BIGINT) AS page, bytes, CAST(total AS BIGINT) AS shard_bytes FROM b WHERE r = 1
"""


SHARDING_SQL = sharding_sql()
