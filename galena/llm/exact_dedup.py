"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text (its white space deleted) is cut into blocks of a fixed number of
bytes.  Distinct blocks are sorted into integer names; adjacent names are then
paired and the distinct pairs sorted into names again, until one name is left
for each document.  Documents with equally many blocks have equal names if and
only if their texts are equal: names come from comparing contents.  A document is
known by the number of its row, never by a hash.

Sorting is sharded: a block's shard and its place in the shard's order come
from a 64-bit hash, and blocks of equal hash are ordered by their bytes, so a
hash collision costs time and never merges two texts.  Names depend on the
contents alone, so a recomputed task gives the same ones.

Only distinct blocks (combined before the shuffle) travel with their bytes;
everything after that moves integers.  A block or pair that a third of all
documents hold is one row for each map task when it is named, and its join
back has plain shuffles on both sides, which AQE splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.scratch import Scratch, fresh

#: Characters deleted before texts are compared: space, tab to carriage return.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLOCK_BYTES = 2048
#: Shards of the name space; a shard sorts its own keys. Fixed, as names must not depend on the session.
SHARDS = 4096
SHARD_NAMES = 1 << 40


def without_white(text: Column) -> Column:
    for char in WHITE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", without_white(F.col("text")).alias("norm"))


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Adds n_blocks and blocks: the bytes of norm, cut; nothing of a text is left out."""
    sized = rows.withColumn("raw", F.encode("norm", "UTF-8")).withColumn("n_blocks", F.ceil(F.octet_length("raw") / block_bytes).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    return sized.withColumn("blocks", F.when(F.col("n_blocks") > 0, cut))


def _hash(block: Column, hash_bits: int) -> Column:
    h = F.xxhash64(block)
    return h if hash_bits >= 64 else F.pmod(h, F.lit(1 << hash_bits))


def _named(distinct: DataFrame, shard: Column, order: list[str], width: Column | None = None) -> DataFrame:
    """Integer names in sorted order, shard by shard; ``width`` names are set aside for each row."""
    within = Window.partitionBy("shard").orderBy(*order)
    rank = F.row_number().over(within).cast("long") if width is None else F.sum(width).over(within) - width + 1
    return distinct.withColumn("shard", shard).withColumn("name", F.col("shard") * F.lit(SHARD_NAMES) + rank).drop("shard")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: its number (row), doc_id, raw_len, text_sha256 and identity (n_blocks, name).

    ``hash_bits`` narrows the hash that routes blocks; results don't depend on it.
    """
    scratch = scratch or Scratch(docs.sparkSession, "naming")
    cut = _blocks(_rows(docs, id_col, text_col), block_bytes)

    # explode() would infer a filter on blocks, and Catalyst would push it down to where each block cuts its text anew.
    distinct = cut.select(F.explode_outer("blocks").alias("block")).filter("block is not null").select(_hash(F.col("block"), hash_bits).alias("h"), "block").groupBy("h", "block").agg(F.lit(1).alias("one"))
    hashes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    names = scratch.keep("names0", _named(hashes, F.pmod("h", F.lit(SHARDS)), ["h"], F.col("texts")))

    # Rows get their numbers once: from here on the written table has them.
    hashes = F.transform("blocks", lambda b: _hash(b, hash_bits)).alias("hashes")
    owners = cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").alias("raw_len"), F.sha2("raw", 256).alias("text_sha256"), "n_blocks", hashes)
    owners = scratch.keep("owners", owners)
    nodes = owners.select("row", "n_blocks", F.posexplode("hashes").alias("i", "h"))
    level0 = nodes.join(names.filter("texts = 1").select("h", "name"), "h").select("row", "n_blocks", "i", "name")
    clashes = names.filter("texts > 1")
    if not clashes.isEmpty():
        level0 = level0.unionByName(_clashing(cut, owners, clashes, hash_bits))
    level = scratch.keep("level0", level0)

    done, step = [], 0
    while True:
        at_top = F.col("n_blocks") <= (1 << step)
        done.append(level.filter(at_top).select("row", "name"))
        rest = level.filter(~at_top)
        if rest.isEmpty():
            break
        pairs = rest.groupBy("row", "n_blocks", (F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
        )
        step += 1
        pairs = scratch.keep(f"pairs{step}", pairs)
        names = scratch.keep(f"names{step}", _named(pairs.select("a", "b").distinct(), F.pmod(F.xxhash64("a", "b"), F.lit(SHARDS)), ["a", "b"]))
        level = scratch.keep(f"level{step}", pairs.join(names, ["a", "b"]).select("row", "n_blocks", "i", "name"))
        scratch.drop(f"pairs{step}", f"names{step}")
    tops = done[0]
    for more in done[1:]:
        tops = tops.unionByName(more)
    owners = owners.drop("hashes")
    empty = owners.filter("n_blocks = 0").withColumn("name", F.lit(0).cast("long"))
    return owners.filter("n_blocks > 0").join(tops, "row").unionByName(empty)


def _clashing(cut: DataFrame, owners: DataFrame, clashes: DataFrame, hash_bits: int) -> DataFrame:
    """Nodes whose block shares its hash with another block: named by their bytes, which rows of equal text_sha256 share."""
    held = cut.select(F.sha2("raw", 256).alias("text_sha256"), F.posexplode_outer("blocks").alias("i", "block")).filter("block is not null").withColumn("h", _hash(F.col("block"), hash_bits))
    held = held.join(clashes.select("h", F.col("name").alias("base")), "h").distinct()
    order = held.select("h", "base", "block").distinct().withColumn("name", F.col("base") + F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1)
    named = held.join(order.drop("base"), ["h", "block"]).select("text_sha256", "i", "name")
    return owners.select("row", "n_blocks", "text_sha256").join(named, "text_sha256").select("row", "n_blocks", "i", "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the one with the most code points before white space was
    deleted stays, then the smallest doc_id (a null doc_id comes last).  A null
    text counts as empty; all empty texts form one group.  Rows that agree in
    doc_id and text are repeated: each has its row, and one of them at most is
    kept.  Other columns are not looked at.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    named = scratch.keep("named", identities(docs, id_col, text_col, block_bytes, hash_bits, scratch))
    scratch.drop("names0", "owners", *(f"level{i}" for i in range(64)))
    best = F.min(F.struct((-F.col("raw_len")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = scratch.keep("groups", named.groupBy("n_blocks", "name").agg(best, F.count(F.lit(1)).alias("group_size")))
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256", "raw_len")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a better row holds; columns unchanged.

    Of rows that agree in doc_id and text one stays.  Edge cases as in exact_groups.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256", "raw_len").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    groups = scratch.keep("groups", groups.filter("not stays or rows > 1"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha, size, gone_id, gone_sha, gone_size = (fresh() for _ in range(5))
    going = groups.filter("not stays").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), F.col("raw_len").alias(gone_size))
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)) & (F.col(size) == F.col(gone_size))
    left = docs.withColumns({sha: F.sha2(F.encode(without_white(text), "UTF-8"), 256), size: F.length(text)}).join(going, same, "left_anti")
    if not groups.filter("rows > 1").isEmpty():
        left = left.dropDuplicates([id_col, sha, size])
    return left.drop(sha, size)
