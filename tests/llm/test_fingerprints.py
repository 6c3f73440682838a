"""Fingerprints against plain Python with the same hashes."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from galena.llm import fingerprints as P

GAPS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _shingles(text):
    words = [w for w in GAPS.split(text.replace("Σ", "σ").lower()) if w]
    return {hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(len(words) - 4, 1) if words else 0)}


def _least(s, k):
    return sorted(s)[:k]


def _alike(a, b, k):
    union = _least(a | b, k)
    return 1.0 if not union else len([h for h in union if h in a and h in b]) / len(union)


def _brute(docs, k):
    rows = sorted((d[0] is not None, d[0] or 0, d[1] or "") for d in docs)
    out = []
    for i, (known, doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c = map(_shingles, (text, edited, after))
        show = lambda s: "".join(_least(s, k))
        out.append((doc_id if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), _alike(a, b, k), _alike(a, c, k)))
    return out


def _docs(n=150):
    rng = random.Random(11)
    vocab = ["the", "Naïve", "ΣΟΦΟΣ", "Straße", "日本語", "x", "İz", "LOUD", "QUITE LOUD", "can't", "🙂", "9th"] + [f"w{i}" for i in range(300)]
    texts = [(rng.choice((" ", "  ", ". ", "-", "\n"))).join(rng.choices(vocab, k=rng.choice((0, 1, 3, 4, 5, 6, 7, 12, 60, 400)))) for _ in range(n)]
    return [(i * 3, t, i) for i, t in enumerate(texts)] + [(4, None, 0), (5, "", 0), (7, "  ...  ", 0), (8, "q" * 30_000, 0), (None, "no id", 0)]


def _rows(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


def test_edited_fingerprints_against_brute_force(spark):
    docs = _docs()
    table = spark.createDataFrame(docs, "doc_id long, text string, words int").repartition(6)
    for k in (8, P.SKETCH):
        assert _rows(P.edited_fingerprints(table, k=k)) == sorted(_brute(docs, k), key=repr)


def test_one_document_comes_after_itself_and_none_gives_nothing(spark):
    one = spark.createDataFrame([("a", "one two three four five six seven")], "doc_id string, text string")
    (row,) = P.edited_fingerprints(one).collect()
    assert row.near_next == 1.0 and row.n_chars == 33 and row.edited_sha256 == hashlib.sha256(b"one two three four five sone two ").hexdigest()
    assert P.edited_fingerprints(one.filter("false")).collect() == []


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "a b c d e f g h")] * 40 + [(2, "z")]
    got = P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == 41 and sorted(r.near_next for r in got if r.doc_id == 1) == [0.0] + [1.0] * 39


def test_sketches_merge_across_parts(spark):
    rng = random.Random(5)
    sets = [{f"{rng.randrange(1 << 64):016x}" for _ in range(60)} for _ in range(9)]
    table = spark.createDataFrame([("g" if i < 8 else None, sorted(s)[:16]) for i, s in enumerate(sets)] + [("none", []), ("g", None)], "k string, s array<string>")
    got = {r.k: r.s for r in P.merge_sketches(table, ["k"], "s", 16).collect()}
    assert got == {"g": sorted(set().union(*sets[:8]))[:16], None: sorted(sets[8])[:16], "none": []}
    two = spark.createDataFrame([(sorted(sets[0])[:16], sorted(sets[1])[:16])], "a array<string>, b array<string>")
    assert two.select(P.merged(F.col("a"), F.col("b"), 16)).first()[0] == sorted(sets[0] | sets[1])[:16]


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(7)
    pool = [f"{rng.randrange(1 << 64):016x}" for _ in range(3000)]
    a, b = set(pool[:2000]), set(pool[500:3000])
    table = spark.createDataFrame([(sorted(a)[:128], sorted(b)[:128], sorted(pool[:100]))], "a array<string>, b array<string>, c array<string>")
    both = F.col("a"), F.col("b")
    row = table.select(P.resemblance(*both).alias("j"), P.containment(*both).alias("c"), P.distinct_shingles(both[0]).alias("n"), P.distinct_shingles(F.col("c")).alias("few")).first()
    assert abs(row.j - 0.5) < 0.15 and abs(row.c - 0.75) < 0.15 and abs(row.n / 2000 - 1) < 0.3 and row.few == 100
    back = table.select(P.from_text(P.as_text(F.col("a"))).alias("a"), P.from_text(F.lit("")).alias("none")).first()
    assert back.a == sorted(a)[:128] and back.none == []


def test_no_python_in_the_plan(spark):
    plan = P.edited_fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
