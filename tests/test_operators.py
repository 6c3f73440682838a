"""Logs, sets, statistics, pairs, samples and streams on literal rows."""

import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from galena.operators import dynamics as D
from galena.operators import grades as G
from galena.operators import pairwise as P
from galena.operators import sampling as S
from galena.operators import stats as T
from galena.sources import scans
from galena.streaming import logs as L


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_failed_calls_never_replace_a_verdict(spark):
    log = spark.createDataFrame([("q", 1, True, 1), ("q", 1, None, 2), ("q", 2, None, 1), ("q", 2, False, 3), ("q", 2, True, 2), ("q", 3, None, 1)], "id string, k int, met boolean, ln int")
    assert rows(G.last_success(log, ["id", "k"], "met", ["ln"])) == [("q", 1, True), ("q", 2, False)]
    assert rows(G.last_write(log, ["id", "k"], ["ln"])) == [("q", 1, None, 2), ("q", 2, False, 3), ("q", 3, None, 1)]
    kept = G.last_good_or_first(log, ["id", "k"], F.col("met").isNotNull(), ["ln"])
    assert rows(kept) == [("q", 1, True, 1), ("q", 2, False, 3), ("q", 3, None, 1)]


def test_completeness_counts_the_questions_criteria(spark):
    criteria = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)], "id string, k int, weight double")
    grades = spark.createDataFrame([("x", "a", 0, True), ("x", "b", 0, False), ("y", "a", 0, True), ("y", "a", 1, False)], "arm string, id string, k int, met boolean")
    assert rows(G.complete(criteria, grades).select("arm", "id").distinct()) == [("x", "b"), ("y", "a")]
    assert rows(G.common_ids(grades, "arm")) == [("a",)]
    joined, ids = G.greedy_arms(grades, ["x"], ["y"], 0.5)
    assert joined == ["x", "y"] and rows(ids) == [("a",)]


def test_state_transitions(spark):
    pairs = spark.createDataFrame([([False, False], [True, False]), ([True, False], [True, True]), ([True, True], [False, True]), ([True], [True, False])], "before array<boolean>, after array<boolean>")
    got = {r.state: (r.n, r.to_all, r.fixed, r.lost) for r in G.state_transitions(pairs).collect()}
    assert got == {"zero": (1, 0, 1, 0), "one_short": (1, 1, 1, 0), "all": (1, 0, 0, 1), "overall": (3, 1, 2, 1)}


def test_statistics(spark):
    v = spark.createDataFrame([("g", float(x)) for x in (4, 1, 3, 2)], "g string, v double")
    assert rows(T.upper_median(v, ["g"], "v").select("upper_median")) == [(3.0,)]
    assert rows(T.floor_percentile(v, ["g"], "v", 0.9).select("percentile")) == [(4.0,)]
    single = spark.createDataFrame([("g", 1.0)], "g string, v double")
    assert rows(T.mean_sd(single, ["g"], "v")) == [("g", 1.0, None, 1)]
    tied = spark.createDataFrame([("g", 1.0, 3.0), ("g", 1.0, 2.0), ("g", 2.0, 1.0)], "g string, x double, y double")
    assert sorted(r.rank for r in T.average_rank(tied, ["g"], "x", "rank").collect()) == [1.5, 1.5, 3.0]
    assert T.spearman(tied, ["g"], "x", "y").first().rho == pytest.approx(-math.sqrt(3) / 2)
    a, b = (T.bootstrap(v, ["g"], "v", draws=50).first() for _ in range(2))
    assert a == b and a.lo <= a["mean"] <= a.hi
    pairs = spark.createDataFrame([("d", s, arm, x) for s, l, r in ((1, 3.0, 1.0), (2, 5.0, 2.0)) for arm, x in (("L", l), ("R", r))], "g string, seed int, arm string, v double")
    t = T.paired_t(pairs, ["g"], "seed", "arm", "L", "R", "v").first()
    assert t.delta == 2.5 and t.hi - t.delta == pytest.approx(12.706 * math.sqrt(0.5) / math.sqrt(2))


def test_pairs_need_both_orders(spark):
    log = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "y"), (3, 0, "y"), (4, 0, "y"), (4, 1, "y"), (5, 0, "tie"), (5, 1, "tie")], "id int, order int, winner string").withColumn("d", F.lit(1))
    r = P.stable_wins(log, ["id", "d"], ["d"]).first()
    assert (r.wins, r.losses, r.ties, r.n, r.rate) == (1, 1, 2, 4, 0.5)
    always_b = spark.createDataFrame([(1, 0, "y"), (1, 1, "x")], "id int, order int, winner string").withColumn("d", F.lit(1))
    assert P.stable_wins(always_b, ["id", "d"], ["d"]).first().ties == 1
    batches = spark.createDataFrame([("a", 0, [1] * 8, 10), ("a", 8, [5, 5], 10), ("b", 8, [5, 5], 10)], "id string, batch int, scores array<int>, size int")
    assert rows(P.batched_coverage(batches, ["id"], "size")) == [("a", 0.2)]


def test_drop_reasons(spark):
    t = spark.createDataFrame([(0, "x", True), (1, "x", False), (2, "x", True), (3, "", False), (4, "x", False)], "pos int, text string, bad boolean")
    got = S.drop_reasons(t, F.col("text"), F.col("pos"), [("bad", F.col("bad"))], F.col("text") == "")
    assert [r.reason for r in got.orderBy("pos").collect()] == ["bad", "kept", "dup", "empty", "dup"]


def test_samples(spark):
    ids = spark.range(100).withColumn("s", F.col("id") % 3)
    assert S.hash_sample(ids, "id", 10).count() == 10 and S.stratified_hash_sample(ids, "id", "s", 20).count() == 20
    splits = S.disjoint_split(ids, "id", {"a": 1, "b": 1})
    assert {r.split for r in splits.collect()} == {"a", "b"} and splits.count() == 100
    shards = ids.limit(3).select(S.shard_of(F.col("id"), 7).alias("x"))
    assert rows(shards) == sorted((int(hashlib.sha1(str(i).encode()).hexdigest(), 16) % 7,) for i in range(3))
    nxt = S.cyclic_next(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, v string"), "pos", 3, "v", "n")
    assert rows(nxt.select("v", "n")) == [("a", "b"), ("b", "c"), ("c", "a")]
    drawn = S.seeded_sample(spark.range(9).withColumnRenamed("id", "pos"), "pos", 9, 4, 42).orderBy("draw_pos").collect()
    assert [r.pos for r in drawn] == S.seeded_positions(9, 4, 42)


def test_training_logs(spark):
    tries = spark.createDataFrame([("g", 0, False, 0.9), ("g", 1, True, 0.4), ("h", 0, False, 0.7), ("h", 1, None, 0.7)], "g string, attempt int, ok boolean, r double")
    assert rows(D.fail_closed(tries, "g", "attempt", "ok", "r")) == [("g", 0.4, False), ("h", 0.0, True)]
    votes = spark.createDataFrame([("a", 0, True), ("a", 0, True), ("a", 0, False), ("a", 1, True), ("a", 1, False)], "id string, k int, met boolean")
    assert rows(D.repeat_merge(votes, ["id"], "k", "met").select("k", "met")) == [(0, True), (1, False)]


def test_contract_scan(spark):
    r = spark.createDataFrame([("q", [(" a ", 2)], (7,))], "question string, criteria array<struct<text:string,points:int>>, extra_info struct<id:int>")
    got = scans.contract(r).first()
    assert got.id == "7" and got.messages[0].role == "user" and (got.rubric[0].criterion, got.rubric[0].weight) == ("a", 2.0)
    bad = spark.createDataFrame([("q", [("a", -2)], (7,))], "question string, criteria array<struct<text:string,points:int>>, extra_info struct<id:int>")
    with pytest.raises(Exception, match="no usable rubric in 7"):
        scans.contract(bad).collect()
    with pytest.raises(Exception, match="repeated id"):
        scans.unique_ids(spark.createDataFrame([("a",), ("a",)], "id string")).collect()


def test_log_scan_and_release(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "met": true}\n\n{broken\n{"id": "y", "met": null}\n')
    good, bad = scans.read_log(spark, str(tmp_path / "a.jsonl"), "id string, met boolean")
    assert [tuple(r) for r in good.orderBy("file", "ln").select("id", "met").collect()] == [("x", True), ("y", None)]
    assert bad.first().bad == 1
    ids = tmp_path / "ids.txt"
    ids.write_text("b\na\n")
    assert rows(scans.read_ids(spark, str(ids)), "pos") == [("b", 0), ("a", 1)]
    ids.write_text('{"one": {"ids": [1, "a"]}, "two": {"ids": ["b", 1]}}')
    assert rows(scans.read_ids(spark, str(ids), ["two", "one"]), "pos") == [("b", 0), ("1", 1), ("1", 2), ("a", 3)]
    with pytest.raises(ValueError, match="one, two"):
        scans.read_ids(spark, str(ids))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.jsonl").write_text('{"id": "z", "met": false}\n')
    both, _ = scans.read_log(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b")], "id string, met boolean")
    assert both.select("file").distinct().count() == 2


def test_release_digests(spark, tmp_path):
    one = scans.write_release(spark.range(5), str(tmp_path / "one"), {"most": F.max("id")}, "hello\n").first()
    two = scans.write_release(spark.range(5).orderBy(F.desc("id")).coalesce(1), str(tmp_path / "two"), {"most": F.max("id")}).first()
    three = scans.write_release(spark.range(6), str(tmp_path / "three"), {}).first()
    assert one.content == two.content != three.content and (one["rows"], one.most) == (5, 4) and (tmp_path / "one" / "README.md").read_text() == "hello\n"
    root = tmp_path / "one" / "rows"
    files = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in root.iterdir() if p.name[0] not in "._"}
    assert one.outputs == files and one.files == len(files)


def test_tree_digest_is_that_of_the_files(spark, tmp_path):
    root = tmp_path / "t r+ee%"
    for name, text in (("z.txt", "1"), ("a/y.txt", "2"), ("a/b/x.txt", "3"), ("a-b/w.txt", "4"), ("a.txt", "")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def walked():
        whole = hashlib.sha256()
        for folder, inner, names in os.walk(root):
            inner.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                whole.update(os.path.relpath(path, root).encode() + hashlib.sha256(open(path, "rb").read()).hexdigest().encode())
        return whole.hexdigest()

    digest = lambda: scans.tree_digest(scans.file_digests(spark, str(root))).first()
    first = digest()
    assert (first.tree, first.files, first.bytes) == (walked(), 5, 4)
    (root / "z.txt").write_text("9")
    changed = digest().tree
    assert changed == walked() != first.tree
    (root / "z.txt").rename(root / "z2.txt")
    assert digest().tree == walked() != changed


def test_export_has_digests_beside_its_files(spark, tmp_path):
    out = tmp_path / "out"
    scans.export(spark.range(10).repartition(3), str(out))
    data = [p for p in out.iterdir() if p.suffix == ".parquet" and p.name[0] != "."]
    assert data and all((out / f"{p.name}.sha256").read_text() == f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.name}\n" for p in data)
    assert spark.read.option("pathGlobFilter", "*.parquet").parquet(str(out)).count() == 10


def test_grades_of_several_logs(spark, tmp_path):
    line = lambda arm, i, k, met: json.dumps({"arm": arm, "id": i, "k": k, "met": met} if met != "lost" else {"arm": arm, "id": i, "k": k})
    (tmp_path / "one.jsonl").write_text("\n".join([line("x", "a", 0, True), "", line("x", "a", 0, None), line("x", "a", 1, False), line("y", "a", 0, True), line("x", "b", 0, "lost"), line("z", "a", 0, True)]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.jsonl").write_text(line("x", "a", 0, False) + "\n" + line("x", "a", 0, True) + "\n" + line("x", 7, 0, False) + "\n")
    (tmp_path / "three.jsonl").write_text(line("x", "q", 0, True))
    one, sub = str(tmp_path / "one.jsonl"), str(tmp_path / "sub")
    got = scans.grades_of(spark, [(one, "x"), (one, "y"), (sub, "x"), (one, "x"), (sub, "nobody")])
    assert {tuple(r) for r in got.collect()} == {(one, "x", "a", 0, True), (one, "x", "a", 1, False), (one, "x", "b", 0, None), (one, "y", "a", 0, True), (sub, "x", "a", 0, True), (sub, "x", "7", 0, False)}
    assert len(got.inputFiles()) == 2
    rubrics = spark.createDataFrame([("a", [(0, 2.0), (1, -1.0)]), ("b", [(0, 1.0)]), ("7", [(0, -1.0)])], "id string, r array<struct<k int, weight double>>")
    cells = {(r.path, r.arm, r.id): (r.verdicts, r.full, r.score) for r in G.graded_cells(got, rubrics).collect()}
    assert cells == {(one, "x", "a"): (2, True, 1.0), (one, "x", "b"): (0, False, None), (one, "y", "a"): (1, False, None), (sub, "x", "a"): (1, False, None), (sub, "x", "7"): (1, True, None)}


def test_streams(spark, tmp_path):
    schema, src, out = "id string, k int, met boolean", tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for i, batch in enumerate(([("a", 1, True), ("a", 2, None)], [("a", 1, False), ("a", 2, True)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
        L.ingest(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "check"), ["id", "k"]).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("a", 1, True), ("a", 2, True)]
    (tmp_path / "roll").mkdir()
    stream = spark.readStream.schema("p string, step int, v double").json(str(tmp_path / "roll"))
    spark.createDataFrame([("p", 2, 0.5), ("p", 1, 0.25), ("q", 1, 1.0)], "p string, step int, v double").coalesce(1).write.mode("append").json(str(tmp_path / "roll"))
    query = L.first_exposure(stream, "p", "step", "v").writeStream.format("memory").queryName("later").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("later")) == [("p", 2, 0.25, 0.5)]


def _fed(spark, tmp_path, batches):
    """Runs the upsert after each batch, as a restarted job would."""
    schema, src, out = "id string, met boolean, ts long", tmp_path / "verdicts", str(tmp_path / "changes")
    src.mkdir(exist_ok=True)
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
        L.upsert(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "state"), ["id"], "met", ["ts"]).awaitTermination()
    return out


def test_upserts_are_what_the_batch_query_gives(spark, tmp_path):
    batches = [[("a", True, 5), ("a", False, 3), ("b", None, 1)], [("a", None, 9), ("b", False, 2), ("c", True, 1)], [("a", True, 5), ("b", True, 1), ("c", False, 7)]]
    out = _fed(spark, tmp_path, batches)
    now = lambda: rows(L.current(spark, out, ["id"], "met", ["ts"]))
    whole = spark.createDataFrame([r for b in batches for r in b], "id string, met boolean, ts long")
    assert [r[:2] for r in now()] == rows(G.last_success(whole, ["id"], "met", ["ts"])) == [("a", True), ("b", False), ("c", False)]
    changes = spark.read.parquet(out)
    assert sorted((r.batch, r.id, r.ts) for r in changes.collect()) == [(0, "a", 5), (1, "b", 2), (1, "c", 1), (2, "c", 7)]
    changes.filter("batch = 1").drop("batch").write.mode("overwrite").parquet(f"{out}/batch=1b")  # were it run again elsewhere
    assert now() == [("a", True, 5), ("b", False, 2), ("c", False, 7)]


def test_a_key_whose_state_expired_says_the_same(spark, tmp_path):
    schema, src, out = "id string, met boolean, ts long", tmp_path / "verdicts", str(tmp_path / "changes")
    add = lambda batch: spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
    add([("a", True, 5), ("b", True, 1)])
    with pytest.raises(ValueError, match="how often"):
        L.upsert(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "state"), ["id"], "met", ["ts"], 1)
    query = L.upsert(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "state"), ["id"], "met", ["ts"], 1, "1 second")
    query.awaitTermination(6)
    add([("a", False, 4), ("b", None, 3)])
    query.awaitTermination(6)
    query.stop()
    assert rows(L.current(spark, out, ["id"], "met", ["ts"])) == [("a", True, 5), ("b", True, 1)]


def test_problems_of_contract_rows(spark):
    kind = "id string, messages array<struct<role:string,content:string>>, problem string, question array<string>, rubric array<struct<criterion:string,weight:double>>"
    rubric = [("c", 1.0)]
    cases = [("a", [("user", "first"), ("assistant", "x"), ("User", " last ")], None, None, rubric), ("b", [("user", "u"), ("assistant", "x")], "  named ", ["q"], rubric), ("c", [("user", " "), ("system", "s")], " ", None, rubric)]
    got = {r.id: r.problem for r in scans.contract(spark.createDataFrame(cases, kind)).collect()}
    assert got == {"a": "last", "b": "named", "c": "s"}
    with pytest.raises(Exception, match="no problem in d"):
        scans.contract(spark.createDataFrame([("d", [("user", " ")], None, None, rubric)], kind)).collect()


def test_groups_are_judged_at_most_twice(spark):
    rows = [("a", 0, m, True, 1.0, None) for m in (1, 2)] + [("b", t, m, bool(t or m == 1), t + 1.0, None if t or m == 1 else "e") for t in (0, 1) for m in (1, 2)]
    rows += [("c", t, m, t == 2, 9.0, None if t == 2 else f"e{t}{m}") for t in (0, 1, 2) for m in (1, 2)] + [("d", 0, 1, None, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, t int, m int, ok boolean, s double, e string").repartition(3)
    got = {(r.g, r.m): (r.disposition, r.reward, r.attempts, r.error) for r in D.group_decisions(df, "g", "m", "t", F.coalesce("ok", F.lit(False)), "s", "e").collect()}
    assert got == {("a", 1): ("accepted", 1.0, 1, None), ("a", 2): ("accepted", 1.0, 1, None), ("b", 1): ("accepted", 2.0, 2, None), ("b", 2): ("accepted", 2.0, 2, None),
                   ("c", 1): ("failed", 0.0, 2, "e11"), ("c", 2): ("failed", 0.0, 2, "e11"), ("d", 1): ("failed", 0.0, 1, None)}


def test_replicates_that_drift_are_flagged(spark):
    rows = [("x", s, t, 10.0 if (s, t) != (2, 5) else 40.0, 1.0 + (t > 4) * drift) for s, drift in ((0, 0.1), (1, 0.2), (2, 0.24), (3, 0.3)) for t in range(1, 9)] + [("y", 2, 1, None, 1.0)]
    log = spark.createDataFrame(rows, "arm string, seed int, step int, norm double, entropy double")
    got = {(r.arm, r.seed): (r.steps, r.norm_median, [s.step for s in r.spikes or []], r.flagged) for r in D.stability(log, "arm", "seed", F.col("seed") < 2, "step", "norm", "entropy", (1, 4), (5, 8), 4).collect()}
    assert got == {("x", 2): (8, 10.0, [5], False), ("x", 3): (8, 10.0, [], True), ("y", 2): (1, None, [], False)}


def test_scaffold_subsets_of_both_kinds(spark):
    from galena.operators import builds as B

    df = spark.createDataFrame([("s", n, k) for n, k in ((0, 0), (1, 0), (1, 1), (6, 3), (9, 9))], "s string, n long, k long")
    for r in df.select("n", "k", B.keyed_subset(F.col("s"), F.col("n"), F.col("k")).alias("keyed"), B.seeded_subset(F.col("s"), F.col("n"), F.col("k")).alias("seeded")).collect():
        h = lambda i: hashlib.sha1(f"s:{i + 1}".encode()).hexdigest()
        assert r.keyed == sorted(sorted(range(r.n), key=h)[: r.k]) and len(r.seeded) == r.k == len(set(r.seeded))
