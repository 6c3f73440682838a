"""Queries and operators without SQL, against plain Python."""

import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from galena.functions import records as C
from galena.functions import text as X
from galena.operators import builds as B
from galena.operators import evaluation as E
from galena.operators import judge as J
from galena.operators import sampling as S
from galena.operators import stats as ST
from galena.plans import REGISTRY

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_shuffle_and_subset_are_the_standard_library_s(spark):
    rows = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 7).alias("v"))
    got = [r.v for r in S.shuffled(rows, "pos", 50, 42).orderBy("draw_pos").collect()]
    want = list(range(50))
    random.Random(42).shuffle(want)
    assert got == [7 * p for p in want]
    seeds = spark.createDataFrame([("42:a:1:2", 9, 4), ("x", 3, 0), ("y", 5, 5)], "s string, n long, k long")
    got = {r.s: r.x for r in seeds.select("s", B.seeded_subset(F.col("s"), F.col("n"), F.col("k")).alias("x")).collect()}
    assert got == {s: sorted(random.Random(s).sample(range(n), k)) for s, n, k in (("42:a:1:2", 9, 4), ("x", 3, 0), ("y", 5, 5))}


@here
def py_place(pos, n, seed):
    a = math.ceil(math.sqrt(n))
    b, prime = -(-n // a), (1 << 31) - 1
    while True:
        left, right = divmod(pos, b)
        for i, (p, q, r) in enumerate(S.permutation_keys(seed)):
            t = ((right if i % 2 == 0 else left) * p + q) % prime
            if i % 2 == 0:
                left = (left + (t * t + r) % prime) % a
            else:
                right = (right + (t * t + r) % prime) % b
        pos = left * b + right
        if pos < n:
            return pos


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 200, 1000, 4097])
def test_keyed_places_are_a_permutation(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", S.keyed_place(F.col("id"), n, 7).alias("p")).collect()}
    assert got == {i: py_place(i, n, 7) for i in range(n)} and sorted(got.values()) == list(range(n))
    if n > 100:
        assert got != {i: py_place(i, n, 8) for i in range(n)} and abs(sum(i * p for i, p in got.items()) / n**3 - 0.25) < 0.02


def test_what_the_driver_makes_is_bounded(spark):
    rows = spark.range(3).withColumnRenamed("id", "pos")
    for f in (lambda: S.shuffled(rows, "pos", S.MOST_SEEDED + 1, 1), lambda: S.seeded_sample(rows, "pos", 1 << 40, S.MOST_SEEDED + 1, 1)):
        with pytest.raises(ValueError, match="too many"):
            f()


def test_domain_split_by_seed(spark):
    kept = sorted(r.conv_id for r in REGISTRY["domain_split_rows"](spark, DATA).filter("reason = 'kept'").collect())
    n = len(kept)
    place = {c: py_place(i, n, 42) for i, c in enumerate(kept)}
    want = {c: "held_out" if i < n // 10 else "train" if i < n // 10 + n * 7 // 10 else None for c, i in place.items()}
    assert {r.conv_id: r.split for r in REGISTRY["domain_split"](spark, DATA).collect()} == want


@here
def test_pool_split_covers_the_table(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    n = len(ids)
    at = {py_place(i, n, 42): d for i, d in enumerate(ids)}
    got = {r.pos: (r.doc_id, r.next_id) for r in REGISTRY["pool_split"](spark, DATA).collect()}
    assert got == {i: (at[i], at[(i + 1) % (n // 2)]) for i in range(n // 2)}


@here
def test_shards_are_of_the_whole_digest(spark):
    for r in REGISTRY["shard_assignment"](spark, DATA).limit(300).collect():
        key, shard = (r[c] for c in r.asDict() if c != "shard"), r.shard
        assert shard == int(hashlib.sha1(str(next(key)).encode()).hexdigest(), 16) % 7


def brute_repair(criteria, weights, n):
    good = [dict(c) for c in criteria if c["name"] and c["description"]]
    if len(good) < 2:
        good = [{"name": "Overall", "description": "-", "own": []}]
    taken = set()
    for c in good:
        c["own"] = [i for i in c["own"] if 1 <= i <= n and not (i in taken or taken.add(i))]
    for i in range(1, n + 1):
        if i not in taken:
            best = min((c for c in good if c["own"]), key=lambda c: abs(sum(c["own"]) / len(c["own"]) - i), default=good[0])
            best["own"].append(i)
    return [(c["name"], round(sum(abs(weights[i - 1]) for i in c["own"]), 2), sorted(c["own"])) for c in good if c["own"]]


def test_repair_of_generated_criteria(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        n = r.randint(1, 9)
        crit = [{"name": r.choice(["a", "b", "c", "", None]), "description": r.choice(["d", "e", "f", ""]), "own": [r.randint(-1, 12) for _ in range(r.randint(0, 5))]} for _ in range(r.randint(0, 5))]
        rows.append((i, [(c["name"], c["description"], c["own"]) for c in crit], [float(r.randint(-5, 5)) for _ in range(n)], n))
    df = spark.createDataFrame(rows, "id int, c array<struct<name:string,description:string,atomic_indices:array<int>>>, w array<double>, n int")
    for got in df.withColumn("x", J.repaired(F.col("c"), F.col("w"), F.col("n"))).collect():
        crit = [{"name": c["name"], "description": c["description"], "own": list(c["atomic_indices"])} for c in got.c]
        out = [(c["name"], c["weight"], sorted(c["atomic_indices"])) for c in got.x]
        assert out == brute_repair(crit, got.w, got.n), (crit, got.n)
        assert sorted(i for _, _, own in out for i in own) == list(range(1, got.n + 1))


def test_packaging_rules_in_order(spark):
    rubric = lambda *w: [(f"c{i}", float(x)) for i, x in enumerate(w)]
    questions = spark.createDataFrame([(i, rubric(1, -2, 3)) for i in range(9)] + [(9, rubric(0, 0))], "id long, r array<struct<criterion:string,weight:double>>")
    groups = {1: [[1, 2], [3]], 2: [[1], [2, 3]], 3: [[1, 2], [3]], 4: [[1, 2, 3]], 5: [[1, 2], []], 6: [[1, 2], [4]], 7: [[1, 2], [2]], 8: [[1], [2]], 9: [[1], [2]]}
    made = spark.createDataFrame([(i, i != 3, False, "m", g) for i, g in groups.items()], "id long, valid boolean, repaired boolean, model string, groups array<array<int>>")
    manual = spark.createDataFrame([(2, "odd")], "id long, why string")
    got = {r.id: r for r in B.packaged(questions, made, manual).collect()}
    assert {i: r.reason for i, r in got.items()} == {
        0: "no_generation", 1: None, 2: "manual:odd", 3: "invalid:unknown", 4: "n_criteria_out_of_range:1", 5: "criterion_without_indices",
        6: "index_out_of_range", 7: "coverage_not_exactly_once", 8: "coverage_not_exactly_once", 9: "nonpositive_weight",
    }
    assert [x.weight for x in got[1].dimensions] == [3.0, 3.0] and got[2].generation is None
    dealt = B.dealt_back(B.packaged(questions, made, manual).filter("id = 1").select("id", "r", F.posexplode("dimensions").alias("at", "x"))).collect()
    assert [(r.at, r.atom, round(r.weight, 6)) for r in dealt] == [(0, 1, 1.0), (0, 2, -2.0), (1, 3, 3.0)]


def test_rewrites_must_fit(spark):
    kinds = "id int, old array<string>", "id int, ok boolean, new array<string>"
    old = spark.createDataFrame([(1, ["A: x", "y"]), (2, ["z"])], kinds[0])
    good = spark.createDataFrame([(1, True, ["A: xx", "yy"]), (2, False, ["z"])], kinds[1])
    assert {r.id: r.criteria for r in B.rewritten(old, good).collect()} == {1: ["A: xx", "yy"], 2: ["z"]}
    for bad, why in ((good.filter("id = 1"), "missing"), (good.withColumn("new", F.array(F.lit("A: q"))), "length"), (good.withColumn("new", F.transform("new", lambda t: F.concat(F.lit("B: "), t))), "prefix")):
        with pytest.raises(Exception, match=why):
            B.rewritten(old, bad).collect()


def test_quantiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ST, "RANGES", 5)
    r = random.Random(8)
    values = [(g, v) for g in ("a", "b", None) for v in [float(r.choice([1, 2, 2, 3, 50, r.random() * 100])) for _ in range(r.randint(1, 400))]] + [("a", None), ("c", None)]
    df = spark.createDataFrame(values, "g string, v double")
    held = {g: sorted(v for k, v in values if k == g and v is not None) for g in ("a", "b", None)}
    assert {x.g: (x.upper_median, x.n) for x in ST.upper_median(df, ["g"], "v").collect()} == {g: (v[len(v) // 2], len(v)) for g, v in held.items()}
    assert {x.g: x.percentile for x in ST.floor_percentile(df, ["g"], "v", 0.9).collect()} == {g: v[int(0.9 * len(v))] for g, v in held.items()}
    assert {x.g: x.v for x in B.histogram_place(df, ["g"], "v", lambda n: F.floor(n / 2)).collect()} == {g: v[len(v) // 2] for g, v in held.items()}


def test_t_interval_ends_with_its_table(spark):
    for pairs, known in ((11, True), (12, False)):
        rows = [(p, a, float(p % 4) + (a == "x")) for p in range(pairs) for a in "xy"]
        got = ST.paired_t(spark.createDataFrame(rows, "p int, a string, v double").withColumn("g", F.lit(1)), ["g"], "p", "a", "x", "y", "v").first()
        assert got.n == pairs and got.delta == pytest.approx(1) and (got.lo is not None) == known


def test_independent_interval_is_wider_than_the_paired_one(spark):
    r = random.Random(2)
    rows = [(x := r.random() * 10, x + 1 + r.random() * 0.1) for _ in range(300)] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = ST.independent_delta(df, [], "a", "b").first()
    point = sum(b - a for a, b in rows[:-1]) / 300
    assert got.n == 300 and got.delta == pytest.approx(point) and got.lo < point < got.hi
    sd = math.sqrt(2 * 100 / 12 / 300)  # of the difference of two independent means of a uniform on 0..10
    assert 2.8 * sd < got.hi - got.lo < 5.2 * sd


def test_retry_passes_like_a_loop_of_anti_joins(spark):
    r = random.Random(6)
    rows = [(k, i, r.choice([None, None, True, False])) for k in range(40) for i in range(r.randint(1, 6))]
    got = {x.k: (x.met, x.tries) for x in E.passes(spark.createDataFrame(rows, "k int, i int, met boolean"), ["k"], "met", ["i"], 3).collect()}
    want = {}
    for key in range(40):
        own = [m for k, _, m in sorted(rows, key=lambda x: x[1]) if k == key][:3]
        good = [i for i, m in enumerate(own) if m is not None]
        want[key] = (own[good[0]], good[0] + 1) if good else (None, len(own))
    assert got == want


def test_reward_groups_fail_closed(spark):
    rows = spark.createDataFrame([("a", 2, 0.5, False), ("a", 2, 0.25, True), ("b", 2, 1.0, False), ("c", 2, None, False), ("d", 0, 1.0, False), ("e", 1, 1.0, None)], "g string, n int, s double, bad boolean")
    got = E.rewards(rows, F.col("g"), F.col("n"), F.col("s"), F.col("bad")).groupBy("group_id").agg(F.sum("reward").alias("r"), F.first("disposition").alias("d")).collect()
    assert {x.group_id: (x.r, x.d) for x in got} == {g: (0.0, "failed_closed") for g in "acde"} | {"b": (1.0, "scored")}


PARTS = ["Answer", "answer is", "ans", "final  answer", "correct option", "option", "Choice", ":", "-", "is", "(A)", "[b", "B", "C.", "I", " ", "no", "E", "\n", "A's", "x", "[[A>B]]", "[B>>A]", "[[a=b]]", "]]"]


def free_texts(seed, n, parts):
    r = random.Random(seed)
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 9))) for _ in range(n)]


def announced(text, words, links):
    """Letters behind one of ``words``, read by hand."""
    low, out, i = text.lower(), [], 0

    def skip(j):
        while j < len(low) and low[j].isspace():
            j += 1
        return j

    def ends(j, word):
        for n, part in enumerate(word.split()):
            after = skip(j) if n else j
            if n and after == j or not low.startswith(part, after):
                return None
            j = after + len(part)
        return j

    def letter(j):
        j = skip(j)
        for link in links:
            if low.startswith(link, j):
                for bracket in (1, 0):
                    k = skip(j + len(link))
                    if not bracket or low[k : k + 1] in ("(", "["):
                        k = skip(k + bracket)
                        if low[k : k + 1] and low[k] in "abcdefghij":
                            return k
        return None

    while i < len(low):
        at = next((k for w in words if (j := ends(i, w)) is not None and (k := letter(j)) is not None), None)
        if at is not None:
            out.append(text[at].upper())
        i = i + 1 if at is None else at + 1
    return out


def py_letter(text):
    text = text.strip()
    bare = text.lstrip("([").strip() if text[:1] in ("(", "[") and text[1:2] not in ("(", "[") else text
    bare = bare[:-1] if bare[-1:] in (".", ",", ";", ":") and len(bare) > 1 else bare
    bare = bare[:-1] if bare[-1:] in (")", "]") and len(bare) > 1 else bare
    stages = [announced(text, ("final answer", "answer", "ans", "correct option"), ("is", ":", "-", "")), announced(text, ("option", "choice"), ("",)), [bare.strip()] if len(bare.strip()) == 1 else []]
    stages.append([c for i, c in enumerate(text) if c in "ABCDEFGHJ" and not any(x.isascii() and x.isalpha() for x in (text[i - 1 : i] if i else "") + text[i + 1 : i + 2])])
    for found in stages:
        if ok := [x.upper() for x in found if x.upper() in list("ABCDEFGHIJ")]:
            return ok[-1]
    return None


def py_label(text):
    ok = [x for x in re.findall(r"\[\[?([AB<>=]+)\]\]?", text.upper()) if x in ("A>>B", "A>B", "A=B", "B>A", "B>>A")]
    return ok[-1] if ok else None


def py_clause(text):
    out, start = "", 0
    for i, c in enumerate(text + "."):
        if c in ".!?" or i == len(text):
            piece = text[start : i + 1]
            says = re.search(r"(?i)\bfails? (if|this dimension if|the criterion if)\b", piece)
            gone = says and i < len(text) and (start == 0 or piece[:1].isspace())
            out += (piece[:1] if start else "") if gone else piece
            start = i + 1
    rest = out.strip()
    return text if rest != text.strip() and len(rest) < 40 else rest


def test_parsers_on_free_text(spark):
    texts = free_texts(1, 500, PARTS)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.option_letter(F.col("t")).alias("letter"), X.arena_label(F.col("t")).alias("label")).collect()
    assert len({r.letter for r in got}) > 4 and len({r.label for r in got}) > 3
    for r in got:
        assert (r.letter, r.label) == (py_letter(r.t), py_label(r.t)), r.t
    clauses = free_texts(2, 300, ["It is so.", "Fails if not!", " it may fail if so. ", "It fails the criterion if here.", "It will fail this dimension if?", " Fails to.", "Failsafe if it is.", "x" * 30, "?", "\n", " One fails  if not."])
    for r in spark.createDataFrame([(t,) for t in clauses], "t string").select("t", X.without_failure_clause(F.col("t")).alias("c")).collect():
        assert r.c == py_clause(r.t), r.t


def test_json_replies_are_strict(spark):
    cases = {
        '{"score": 7, "reason": "good"}': 7, 'so: {"reason": "x", "score": 10} ok': 10, '{"score": 11, "reason": "x"}': None, '{"score": true, "reason": "x"}': None,
        '{"score": 3, "reason": " "}': None, '{"score": 0, "reason": "x"}': None, "none": None, '{"score": 2.5, "reason": "x"}': None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.graded_reply(F.col("t")).alias("g"))
    assert {r.t: r.g for r in df.collect()} == cases
    labels = {'{"labels": ["a", " B"]}': ["A", "B"], '{"labels": ["a"]}': None, '{"labels": ["a", "q"]}': None, '{"labels": ["a", "b"]}}': None, 'x {"labels": ["b", "b"]} y': ["B", "B"]}
    df = spark.createDataFrame([(t,) for t in labels], "t string").select("t", C.label_reply(F.col("t"), F.lit(2), ["A", "B"]).alias("g"))
    assert {r.t: r.g for r in df.collect()} == labels


def test_errors_are_raised(spark):
    one = spark.range(1)
    for bad in (C.content_text(F.lit("")), C.content_text(F.lit('[{"type": "text"}]')), C.teacher_message(F.lit("other"), F.lit("p"), F.lit("s"), "<<problem>><<solution>>"), C.teacher_message(F.lit("copy"), F.lit(" "), F.lit("s"), "<<problem>><<solution>>")):
        with pytest.raises(Exception, match="content|context"):
            one.select(bad).collect()
    with pytest.raises(ValueError, match="problem"):
        C.teacher_message(F.lit("copy"), F.lit("p"), F.lit("s"), "<<solution>>")
