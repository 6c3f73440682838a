"""Reading questions, logs and specifications, and writing releases.

Scans look at a schema once and build one expression over the columns that
exist, where row-by-row code would probe each record.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.functions.text import last_user_text, strip

#: Names a field goes by, in order of preference (fixed values).
ALIASES = {
    "prompt": ("prompt", "messages", "conversation", "query", "question"),
    "rubric": ("rubric", "rubrics", "Rubrics", "criteria"),
    "problem": ("problem", "query", "question"),
    "id": ("id", "sample_id", "prompt_id", "uid", "tid"),
}
#: Names that a criterion's text and weight go by (fixed values).
CRITERION = ("criterion", "criteria", "description", "text", "rubric", "content")
WEIGHT = ("weight", "points", "score", "importance")


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, JSON lines or a JSON array, by suffix."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".parquet"):
        return reader.parquet(path)
    return reader.json(path, multiLine=path.endswith(".json"))


def read_by_id(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object keyed by id: one row a key; ``value`` is the DDL of what a key holds. One object can't be read in parts: a file is one task."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.explode("m").alias("id", "row")).select("id", "row.*")


def read_log(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with file and ln, counts of bad lines by file) of JSON lines; blank lines are skipped.

    file is the whole path, as logs of one name may lie in several folders. ln orders the lines of a
    file: where their block begins, and their place in it. So a large file is read in blocks, by as
    many tasks.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    files = spark.read.text(path if isinstance(path, str) else list(path)).select(F.col("_metadata.file_path").alias("file"), place.alias("ln"), F.col("value").alias("line"))
    parsed = files.filter(F.trim("line") != "").select("file", "ln", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r is not null and r._bad is null").select("file", "ln", "r.*").drop("_bad")
    return good, parsed.filter("r is null or r._bad is not null").groupBy("file").agg(F.count(F.lit(1)).alias("bad"))


def grades_of(spark: SparkSession, refs: Sequence[tuple[str, str]]) -> DataFrame:
    """path, arm, id, k, met of the (path, arm) pairs asked for: a path is a log or a folder of logs, and is read once however many arms are taken from it.

    A row for each criterion that was tried: met is its last verdict in file order, or null if every
    call failed. So the ids that were attempted and those that have verdicts come from one aggregation.
    Blank lines are skipped, a malformed line is an error. The pairs are a parameter table and are broadcast.
    Rows are dealt once, by id, into as many partitions as shuffles have: what follows by id moves them no more.
    """
    files = {path: _qualified(spark, path) for path in sorted({p for p, _ in refs})}
    wanted = spark.createDataFrame([(files[p], p, a) for p, a in sorted(set(refs))], "_root string, path string, _arm string")
    lines, _ = read_log(spark, sorted(set(files.values())), "arm string, id string, k int, met boolean")
    place = F.regexp_replace("file", "^file:/+", "file:/")
    inside = (place == F.col("_root")) | F.startswith(place, F.concat("_root", F.lit("/")))
    rows = lines.join(F.broadcast(wanted), (F.col("arm") == F.col("_arm")) & inside)
    dealt = rows.select("path", "arm", "id", "k", "met", "file", "ln").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.groupBy("path", "arm", "id", "k").agg(F.max_by("met", F.when(F.col("met").isNotNull(), F.struct("file", "ln"))).alias("met"))


def _qualified(spark: SparkSession, path: str, encoded: bool = True) -> str:
    """A path as a scan's metadata shows it, or as file listings do (not encoded)."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there)
    return re.sub("^file:/+", "file:/", (whole.toUri() if encoded else whole).toString().rstrip("/"))


def rollouts(spark: SparkSession, path: str, schema: str, last: int = 300) -> DataFrame:
    """Rows of a folder of ``<step>.jsonl`` files with their step, that of the newest file left out while it may still be written.

    A run has ended when its newest step is ``last`` or more.
    """
    step = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl$", 1).cast("int")
    rows = spark.read.schema(schema).json(path, pathGlobFilter="*.jsonl").withColumn("step", step)
    newest = spark.read.text(path, pathGlobFilter="*.jsonl").select(step.alias("s")).agg(F.max("s").alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).filter((F.col("step") < F.col("_newest")) | (F.col("_newest") >= last)).drop("_newest")  # one row


def suite_baselines(rows: DataFrame, answer: str) -> DataFrame:
    """id and text of the last message, whose content is text or a struct with an ``answer``."""
    kind = rows.schema[answer].dataType.elementType["content"].dataType
    last = F.element_at(answer, -1)["content"]
    return rows.select("id", (last["answer"] if isinstance(kind, T.StructType) else last).alias("text"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds JSON lines to a log; each call commits its own files, and readers see all of a call or nothing."""
    rows.write.mode("append").json(path)


def first_of(schema: T.StructType, names: Sequence[str], places: Sequence[str] = ("", "extra_info", "reward_model"), kinds: type = T.DataType) -> Column | None:
    """coalesce over the places and names that the schema has, of a kind of type; those of another type than the first aren't looked at."""
    found: list[tuple[Column, T.DataType]] = []
    for place in places:
        held = schema if not place else schema[place].dataType if place in schema.names else None
        if isinstance(held, T.StructType):
            found += [(F.col(f"{place}.{n}" if place else n), held[n].dataType) for n in names if n in held.names and isinstance(held[n].dataType, kinds)]
    return F.coalesce(*[c for c, kind in found if kind.simpleString() == found[0][1].simpleString()]) if found else None


def normalised_rubric(rubric: Column, kind: T.ArrayType) -> Column:
    """array<struct<criterion, weight double>> from whatever names an element's fields have."""
    names = kind.elementType.names
    text, weight = next((n for n in CRITERION if n in names), None), next((n for n in WEIGHT if n in names), None)
    if text is None:
        raise ValueError(f"no criterion among {names}")
    one = F.lit(1.0)
    return F.transform(rubric, lambda x: F.struct(strip(x[text]).alias("criterion"), (F.coalesce(x[weight].cast("double"), one) if weight else one).alias("weight")))


def contract(rows: DataFrame) -> DataFrame:
    """id, messages, problem, rubric of a question table of any of the accepted shapes.

    A string prompt is one user turn. The problem is the field of that name (or an alias) if it says
    anything, else the last user turn that does, else the last turn. Rows without a problem or a usable
    rubric raise when read: weights must be finite and one of them positive.
    """
    prompt, rubric, key = (first_of(rows.schema, ALIASES[n]) for n in ("prompt", "rubric", "id"))
    named = first_of(rows.schema, ALIASES["problem"], kinds=T.StringType)
    if prompt is None or rubric is None:
        raise ValueError("neither a prompt nor a rubric column")
    shaped = rows.select((key if key is not None else F.lit(None)).cast("string").alias("id"), prompt.alias("prompt"), rubric.alias("rubric"), (named if named is not None else F.lit(None)).cast("string").alias("problem"))
    kind = shaped.schema["prompt"].dataType
    if isinstance(kind, T.StringType):
        messages = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")))
    else:
        name = "content" if "content" in kind.elementType.names else "text"
        messages = F.transform("prompt", lambda m: F.struct(F.coalesce(m.role, F.lit("user")).alias("role"), F.coalesce(m[name].cast("string"), F.lit("")).alias("text")))
    fit = normalised_rubric(F.col("rubric"), shaped.schema["rubric"].dataType)
    good = F.exists(fit, lambda c: c.weight > 0) & F.forall(fit, lambda c: ~F.isnan(c.weight) & (F.abs(c.weight) < float("inf")))
    checked = F.when(good, fit).otherwise(F.raise_error(F.concat(F.lit("no usable rubric in "), F.coalesce("id", F.lit("a row")))))
    shaped = shaped.select("id", messages.alias("messages"), "problem", checked.alias("rubric"))
    said = F.coalesce(*[F.nullif(strip(x), F.lit("")) for x in (F.col("problem"), last_user_text(F.col("messages")))])
    return shaped.withColumn("problem", F.coalesce(said, F.raise_error(F.concat(F.lit("no problem in "), F.coalesce("id", F.lit("a row"))))))


def unique_ids(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows``; reading them raises if an id repeats."""
    repeated = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    checked = repeated.select(F.when(F.col("n") > 1, F.raise_error(F.lit("repeated id"))).cast("string").alias("_ok"))
    return rows.crossJoin(F.broadcast(checked)).filter("_ok is null").drop("_ok")  # one row


def read_ids(spark: SparkSession, path: str, sets: Sequence[str] = ()) -> DataFrame:
    """id, pos of a JSON list, an object with ``ids``, the named ``sets`` of an object of such objects one after the other, or one id a line; a list of ids is the driver's."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        found = [x.strip() for x in text.splitlines() if x.strip()]
    if isinstance(found, Mapping):
        if not sets and "ids" not in found:
            raise ValueError(f"{path} holds sets: name some of {', '.join(found)}")
        found = [x for name in sets for x in found[name]["ids"]] if sets else found["ids"]
    return spark.createDataFrame([(str(x), i) for i, x in enumerate(found)], "id string, pos int")


def gated(responses: DataFrame, suite: str) -> DataFrame:
    """Usable responses: of the suite or of none, without an error, not empty."""
    mine = F.col("data_source").isNull() | (F.col("data_source") == suite)
    return responses.filter(mine & (F.coalesce("error", F.lit("")) == "") & (F.length("response") > 0))


def write_release(rows: DataFrame, path: str, metrics: Mapping[str, Column], readme: str = "") -> DataFrame:
    """Writes ``path``/rows, ``path``/README.md and ``path``/manifest: counts, metrics, and the files' names, sizes and digests.

    content is a digest of the rows that doesn't depend on their order or on how they are cut into
    files; tree and files are what ``tree_digest`` and ``file_digests`` give for the written files.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    digest = F.sha2(F.to_json(F.struct(*sorted(written.columns))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    counts = written.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *parts), 256).alias("content"), *[c.alias(n) for n, c in metrics.items()])
    files = file_digests(spark, f"{path}/rows")
    outputs = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("outputs"))  # as many as there are files
    manifest = counts.crossJoin(F.broadcast(outputs)).crossJoin(F.broadcast(tree_digest(files)))  # one row each
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    _put(spark, f"{path}/README.md", readme)
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), bytes, sha256 of every file below ``path`` but hidden ones (names that begin with . or _): executors read and digest them."""
    root = _qualified(spark, path, encoded=False)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substr(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(root) + 2))
    found = files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    empty = [(n, 0, hashlib.sha256().hexdigest()) for n in _empty_files(spark, path, root)]  # scans pass over these
    return found.unionByName(spark.createDataFrame(empty, "path string, bytes long, sha256 string"))


def _empty_files(spark: SparkSession, path: str, root: str) -> list[str]:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, out = there.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(there, True), []
    while listed.hasNext():
        file = listed.next()
        name = re.sub("^file:/+", "file:/", file.getPath().toString())[len(root) + 1 :]
        if file.getLen() == 0 and not any(part[:1] in "._" for part in name.split("/")):
            out.append(name)
    return out


def tree_digest(files: DataFrame) -> DataFrame:
    """tree, files, bytes: one SHA-256 over the names and digests of ``file_digests``, folder by folder with a folder's own files first; one row."""
    parts = F.split("path", "/")
    own_first = F.transform(parts, lambda x, i: F.struct((i < F.size(parts) - 1).alias("deeper"), x.alias("name")))
    whole = F.array_sort(F.collect_list(F.struct(own_first.alias("at"), F.concat("path", "sha256").alias("leaf"))))  # a name and a digest for each file
    return files.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["leaf"]), ""), 256).alias("tree"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def export(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``rows`` as zstd Parquet and beside each of its files one of the same name and .sha256, in the form that checking tools read; returns their digests."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = file_digests(spark, path).filter(F.endswith("path", F.lit(".parquet")))
    for r in found.toLocalIterator():  # a name and a digest for each file
        _put(spark, f"{path}/{r['path']}.sha256", f"{r['sha256']}  {r['path'].rpartition('/')[2]}\n")
    return found


def _put(spark: SparkSession, path: str, text: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, True)
    out.write(bytearray(text.encode()))
    out.close()
