"""Document fingerprints in DataFrame functions only: bottom-k sketches of shingle hashes.

A sketch is the ascending array of the k smallest distinct hashes of a text's
five-word shingles: 16 hex digits of their MD5, which SQL engines have as well.  Two texts' sketches give the sketch of both together
(``merged``), so a text can be sketched in parts, and all estimates are made
from the k smallest hashes of the union: resemblance (Jaccard similarity),
containment and the number of distinct shingles.

``edited_fingerprints`` compares each document with an edited form of itself and
with the next document.  Which document comes next is found without a global
window: ids are cut into ranges of nearly equal size, each range is ordered by
itself, and the first row of a range is put behind the last one of the range
before as well.  So texts move once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.llm.scratch import fresh

SHINGLE_WORDS = 5
#: Hashes of a sketch: a resemblance J is estimated with a standard error of sqrt(J (1 - J) / k).
SKETCH = 128
#: Hex digits of a hash.
DIGITS = 16
#: What stands between words: everything of ASCII but letters and digits.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shares of a group that are merged by themselves first, so that no group is one task's work.
_SHARES = 32


def words_of(text: Column) -> Column:
    """Words in lower case; capital sigma first, as the lower case of the others doesn't depend on what follows."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))), _GAPS), "")


def _shingles(words: Column) -> Column:
    """A hash for each run of five words; fewer words, but not none, are one run. ``words`` should be a column, not an expression: it is looked at often."""
    runs = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0)))
    hashed = F.transform(runs, lambda i: F.left(F.md5(F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE_WORDS)])), F.lit(DIGITS)))
    return F.when(F.size(words) > 0, hashed).otherwise(F.array().cast("array<string>"))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketched(docs: DataFrame, text: Column, name: str, k: int = SKETCH) -> DataFrame:
    """``docs`` with the sketch of ``text`` (null: empty) as ``name``."""
    words = fresh()
    split = docs.withColumn(words, words_of(F.coalesce(text.cast("string"), F.lit(""))))
    return split.withColumn(name, _least(_shingles(F.col(words)), k)).drop(words)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(rows: DataFrame, by: Sequence[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """by, sketch: one sketch for each group of rows, as if its texts had been one set of shingles.

    Equal hashes of a group are one row before they are shuffled, and shares of a
    group are cut to k by themselves first.  A null sketch counts as empty; a group
    without hashes has an empty sketch, an empty table no rows.
    """
    share = fresh()
    place = fresh()
    least = lambda df, *keys: df.withColumn(place, F.row_number().over(Window.partitionBy(*by, *keys).orderBy(F.col(sketch).asc_nulls_last()))).filter(F.col(place) <= k).drop(place)
    hashes = rows.select(*by, F.explode_outer(sketch).alias(sketch)).distinct().withColumn(share, F.pmod(F.xxhash64(sketch), F.lit(_SHARES)))
    return least(least(hashes, share)).groupBy(*by).agg(F.sort_array(F.collect_list(sketch)).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity of two sketches' sets; exact while both hold fewer than k hashes, 1 if both are empty."""
    return _resemblance(a, b, merged(a, b, k))


def _resemblance(a: Column, b: Column, union: Column) -> Column:
    common = F.array_intersect(F.array_intersect(a, b), union)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(common) / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's set that is in b's; 1 if a is empty, null where the union's k smallest hold none of a."""
    return _containment(a, b, merged(a, b, k))


def _containment(a: Column, b: Column, union: Column) -> Column:
    own = F.array_intersect(a, union)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(own, b)), F.size(own)))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.conv(F.left(F.element_at(a, -1), F.lit(12)), 16, 10).cast("double") + 1) / float(1 << 48)  # of the space, up to the k-th hash
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(sketch: Column) -> Column:
    """The hashes' digits, in order."""
    return F.array_join(sketch, "")


def from_text(text: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    n = (F.length(text) / DIGITS).cast("int")
    read = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * DIGITS + 1, F.lit(DIGITS)))
    return F.when(n > 0, read).otherwise(F.array().cast("array<string>"))


def _ranges(rows: DataFrame) -> list:
    """The least (doc_id, tie) of each of some ranges of nearly equal size: as many numbers as there are ranges."""
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc_id", "tie").repartitionByRange(parts, "doc_id", "tie")
    found = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "tie")).alias("least"))
    return [r["least"] for r in found.orderBy("part").collect()]


def _with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, tie, text) with bucket and last; a bucket's last row by (last, doc_id, tie) is the first of the next bucket."""
    spark, cuts = rows.sparkSession, _ranges(rows)
    if not cuts:
        return rows.withColumns({"bucket": F.lit(0), "last": F.lit(0)})
    key = T.StructType([rows.schema["doc_id"], rows.schema["tie"]])
    step = int(len(cuts) ** 0.5) or 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = spark.createDataFrame([([g[0] for g in groups], groups)], T.StructType([T.StructField("firsts", T.ArrayType(key)), T.StructField("groups", T.ArrayType(T.ArrayType(key)))]))
    own = F.struct("doc_id", "tie")
    upto = lambda of: F.size(F.filter(of, lambda c: c <= own)) - 1
    dealt = rows.crossJoin(F.broadcast(table)).withColumn("group", upto(F.col("firsts")))  # one row
    dealt = dealt.withColumn("bucket", F.col("group") * step + upto(F.get("groups", F.col("group")))).select(*rows.columns, "bucket", F.lit(0).alias("last"))
    before = [(c["doc_id"], c["tie"], (i - 1) % len(cuts)) for i, c in enumerate(cuts)]
    heads = spark.createDataFrame(before, T.StructType([T.StructField("of", key["doc_id"].dataType), T.StructField("at", key["tie"].dataType), T.StructField("bucket", T.IntegerType())]))
    firsts = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("at"))).select(*rows.columns, "bucket", F.lit(1).alias("last"))
    return dealt.unionByName(firsts.dropDuplicates(["bucket"]))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited: a row for each row of ``docs``.

    The edited text is the text with the last quarter of its code points (rounded
    down) replaced by as many first ones, or all, of the next document; documents
    are ordered by doc_id (null first), rows of one doc_id by a hash of their text,
    and the first one comes after the last.  ``near_edited`` and ``near_next`` are
    the resemblance to the edited text's fingerprint and to the next document's,
    ``contained_edited`` the share of the text's shingles that the edited text has.

    A null text counts as empty, and texts without words are alike (1).  Repeated
    rows each have their row and come after each other.  The only document of a
    table comes after itself.  An empty table gives no rows; other columns aren't
    looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    order = Window.partitionBy("bucket").orderBy("last", "doc_id", "tie")
    rows = _with_next(rows).withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("head", F.left("text", F.col("n_chars") - quarter)).withColumn("added", F.coalesce(F.left("next", quarter), F.lit("")))

    # Shingles of the head's words but its last, which the cut may have gone through, are in both texts: hashed once.
    rows = rows.withColumns({"words": words_of(F.col("text")), "head_words": words_of(F.col("head"))})
    gap = F.when(F.lower(F.right("head", F.lit(1))).rlike(rf"\A{_GAPS}\z"), " ").otherwise("")
    ends = F.slice("head_words", F.greatest(F.size("head_words") - SHINGLE_WORDS + 1, F.lit(1)), F.lit(SHINGLE_WORDS))
    rows = rows.select(
        "bucket", "last", "doc_id", "tie", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.concat("head", "added"), 256).alias("edited_sha256"),
        F.greatest(F.size("head_words") - SHINGLE_WORDS, F.lit(0)).alias("shared"), "words", words_of(F.concat(F.array_join(ends, " "), gap, "added")).alias("w"),
    )
    rows = rows.withColumns({"h": _shingles(F.col("words")), "new": _shingles(F.col("w"))}).drop("words", "w")
    rows = rows.withColumns({"sketch": _least(F.col("h"), k), "kept": _least(F.slice("h", F.lit(1), F.col("shared")), k)}).drop("h")
    rows = rows.withColumn("edited", merged(F.col("kept"), F.array_distinct("new"), k)).drop("kept", "new", "shared")

    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter("last = 0")
    a, b, after = F.col("sketch"), F.col("edited"), F.col("next_sketch")
    rows = rows.withColumns({"with_edited": merged(a, b, k), "with_next": merged(a, after, k)})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"), _resemblance(a, b, F.col("with_edited")).alias("near_edited"),
        _resemblance(a, after, F.col("with_next")).alias("near_next"), _containment(a, b, F.col("with_edited")).alias("contained_edited"),
    )
