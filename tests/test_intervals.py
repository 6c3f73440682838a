"""Shared resampling, ranks by ranges and cells on axes, against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from galena.operators import axes as A
from galena.operators import intervals as I
from galena.operators import resampling as R
from galena.operators import sampling as S
from galena.operators import stats as T


def py_weight(seed, draw, key):
    block, j = divmod(draw, 16)
    byte = hashlib.md5(f"{seed}:{block}:{key}".encode()).digest()[j]
    return sum(byte >= s for s in (94, 188, 235, 251, 255))


def py_interval(rows, convention):
    """rows: (id, num, den)."""
    draws = []
    for d in range(convention.draws):
        w = [py_weight(convention.seed, d, i) for i, _, _ in rows]
        if den := sum(x * r[2] for x, r in zip(w, rows)):
            draws.append(sum(x * r[1] for x, r in zip(w, rows)) / den)
    draws.sort()
    return sum(r[1] for r in rows) / sum(r[2] for r in rows), *(draws[math.floor(len(draws) * p / convention.draws)] for p in (convention.low, convention.high))


@pytest.mark.parametrize("name", list(I.CONVENTIONS))
def test_every_convention_against_python(spark, name):
    convention = I.CONVENTIONS[name]
    rng = random.Random(4)
    rows = [("g", i, rng.random(), float(rng.randrange(1, 5))) for i in range(25)] + [("h", 1, 3.0, 2.0), (None, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, v double, w double").repartition(3)
    got = {r.g: r for r in I.intervals(df, ["g"], "id", {"m": (F.col("v"), F.lit(1)), "r": (F.col("v"), F.col("w"))}, convention).collect()}
    for g in ("g", "h", None):
        own = [r for r in rows if r[0] == g]
        for metric, den in (("m", lambda r: 1.0), ("r", lambda r: r[3])):
            want = py_interval([(r[1], r[2], den(r)) for r in own], convention)
            assert [got[g][metric], got[g][f"{metric}_lo"], got[g][f"{metric}_hi"]] == pytest.approx(want) and got[g].n == len(own)


def test_fixed_values_of_conventions():
    for c, low, high in ((1000, 25, 975), (2000, 50, 1950), (5000, 125, 4875)):
        assert (int(0.025 * c), min(c - 1, int(0.975 * c))) == (low, high)
    assert I.CONVENTIONS["audit"][2:] == (50, 1949) and I.CONVENTIONS["official"] == (5000, 67, 125, 4875) and I.CONVENTIONS["ghost"] == (2000, 67, 50, 1950)


def test_differences_stay_paired_and_widths_are_right(spark):
    rng = random.Random(9)
    base = [rng.gauss(0, 10) for _ in range(400)]
    rows = [(i, b, b + 1 + rng.gauss(0, 0.1)) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one = F.lit(1)
    r = I.intervals(df, [], "id", {"a": (F.col("a"), one), "d": (F.col("b") - F.col("a"), one)}, I.CONVENTIONS["tables"]).first()
    assert 1.5 < r.a_hi - r.a_lo < 2.5 and r.d_hi - r.d_lo < 0.03 and r.d_lo < 1 < r.d_hi + 0.02
    assert I.intervals(df.filter("false"), [], "id", {"a": (F.col("a"), one)}, I.CONVENTIONS["tables"]).count() == 0
    none = I.intervals(df.withColumn("a", F.lit(None).cast("double")), [], "id", {"a": (F.col("a"), one)}, I.CONVENTIONS["tables"]).first()
    assert none.n == 400 and none.a is None and none.a_lo is None


def test_independent_sides_are_drawn_apart(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 3), rng.gauss(1, 3)) for i in range(30)] + [(90, None, 1.0), (91, 1.0, None)]
    c = I.Convention(200, 5, 5, 195)
    r = I.independent(spark.createDataFrame(rows, "id long, l double, r double"), [], "id", F.col("l"), F.col("r"), c).first()
    both = [x for x in rows if None not in x]
    mean = lambda seed, d, k: sum(py_weight(seed, d, x[0]) * x[k] for x in both) / sum(py_weight(seed, d, x[0]) for x in both)
    deltas = sorted(mean(6, d, 2) - mean(5, d, 1) for d in range(200))
    assert [r.n, r.delta, r.lo, r.hi] == pytest.approx([30, sum(x[2] - x[1] for x in both) / 30, deltas[5], deltas[195]])
    grouped = I.independent(spark.createDataFrame([("g", *x) for x in rows] + [(None, 1, 1.0, 2.0)], "g string, id long, l double, r double"), ["g"], "id", F.col("l"), F.col("r"), c).collect()
    assert {x.g: x.delta for x in grouped} == pytest.approx({"g": r.delta, None: 1.0})


def py_ranks(values):
    return {v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in set(values)}


def test_ranks_by_ranges_against_python(spark):
    rng = random.Random(2)
    data = {"wide": [rng.gauss(0, 1) for _ in range(900)], "tied": [float(rng.randrange(5)) for _ in range(700)], "one": [3.0], None: [1.0, 1.0, 2.0]}
    rows = [(g, v, float(int(v * 3) % 7)) for g, vs in data.items() for v in vs] + [("wide", None, 1.0), ("wide", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    ranks = T.average_rank(df, ["g"], "x", "rank").collect()
    assert len(ranks) == len(rows)
    for g in data:
        want = py_ranks([x for k, x, _ in rows if k == g and x is not None])
        assert all(r["rank"] == (None if r.x is None else want[r.x]) for r in ranks if r.g == g)
    for r in T.spearman(df, ["g"], "x", "y").collect():
        both = [(x, y) for k, x, y in rows if k == r.g and x is not None and y is not None]
        rx, ry = py_ranks([b[0] for b in both]), py_ranks([b[1] for b in both])
        mean = (len(both) + 1) / 2
        c = lambda f, h: sum((f(b) - mean) * (h(b) - mean) for b in both)
        x, y = (lambda b: rx[b[0]]), (lambda b: ry[b[1]])
        whole = c(x, x) * c(y, y)
        assert r.n == len(both) and (r.rho is None if not whole else r.rho == pytest.approx(c(x, y) / math.sqrt(whole)))


def test_ranks_need_no_window_over_a_group(spark):
    plan = T.spearman(spark.range(10).selectExpr("id % 2 as g", "id as x", "-id as y"), ["g"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line for line in windows)


def test_stratified_sample_cuts_before_the_shuffle(spark):
    df = spark.range(4000).selectExpr("id", "case when id % 10 < 7 then 'big' when id % 10 = 9 then null else 'small' end as s")
    sample = S.stratified_hash_sample(df, "id", "s", 50)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "WindowGroupLimit [s#" in plan
    got = sorted(r.id for r in sample.collect())
    h = lambda i: (hashlib.sha1(str(i).encode()).hexdigest(), i)
    strata = {}
    for i in range(4000):
        strata.setdefault("big" if i % 10 < 7 else None if i % 10 == 9 else "small", []).append(i)
    chosen = [i for ids in strata.values() for i in sorted(ids, key=h)[: round(50 * len(ids) / 4000)]]
    rest = sorted((i for i in range(4000) if i not in set(chosen)), key=h)
    assert got == sorted((sorted(chosen, key=h) + rest)[:50])


def test_cells_on_axes(spark):
    rng = random.Random(6)
    cells, axes = (0, 1, 3, 70), ("a", "b")
    values = {(i, c): {x: rng.random() if rng.random() < 0.8 else None for x in axes} for i in range(120) for c in cells}
    df = spark.createDataFrame([(i, c, v["a"], v["b"], float(i)) for (i, c), v in values.items()], "id long, cell int, a double, b double, more double").repartition(4)
    assert A.coverage(df, "cell", {x: F.col(x).isNotNull() for x in axes}) == {c: {x: sum(values[i, c][x] is not None for i in range(120)) for x in axes} for c in cells}
    folds = A.folded(df, "id", "cell", axes, ["more"])
    groups, sets, means = {"two": (0, 70), "all": cells, "none": ()}, {"ab": axes, "b": ("b",)}, {"ab": ("a", "more"), "b": ("b",)}
    for only in (True, False):
        got = {(r.group, r.cell): r for r in A.on_common(folds, groups, sets, means, only).collect()}
        assert set(got) == {(g, c) for g, members in groups.items() for c in (members if only else cells)}
        for (g, c), r in got.items():
            for s, wanted in sets.items():
                ids = [i for i in range(120) if all(values[i, m][x] is not None for m in groups[g] for x in wanted)]
                here = [i for i in ids if all(values[i, c][x] is not None for x in wanted)]
                assert (r[f"n_{s}"], r[f"in_{s}"]) == (len(ids), len(here))
                for v in means[s]:
                    want = sum(float(i) if v == "more" else values[i, c][v] for i in here) / len(here) if here else None
                    assert r[v] == pytest.approx(want)


def py_f1(pairs):
    out = []
    for cls in (True, False):
        tp, fp, fn = (sum(1 for a, b in pairs if (a is cls, b is cls) == want) for want in ((True, True), (True, False), (False, True)))
        if not 2 * tp + fp + fn:
            return None
        out.append(2 * tp / (2 * tp + fp + fn))
    return sum(out) / 2


def test_pooled_f1_against_all_pairs(spark):
    rng = random.Random(12)
    labels = [(i, i % 3, f"r{r}", rng.random() < 0.3 + 0.2 * (i % 2)) for i in range(90) for r in range(5) if rng.random() < (0.9, 0.5, 0.5, 0.2, 0.05)[r]]
    labels += [(200, 7, "r0", True), (201, 7, "r1", True), (0, 0, "r9", None)]
    judged = [(i, i % 3, rng.random() < 0.4) for i in range(0, 90, 2)] + [(200, 7, True)]
    got = {r.c: r for r in T.pooled_f1(spark.createDataFrame(labels, "id long, c int, who string, label boolean"), spark.createDataFrame(judged, "id long, c int, label boolean"), ["id"], "c", "who").collect()}
    known = [x for x in labels if x[3] is not None]
    for c in (0, 1, 2, 7):
        of = lambda i: [x for x in known if x[0] == i]
        model = py_f1([(a, x[3]) for i, k, a in judged if k == c for x in of(i)])
        raters = {}
        for who in {x[2] for x in known if x[1] == c}:
            pairs = [(x[3], y[3]) for x in known if x[1] == c and x[2] == who for y in of(x[0]) if y[2] != who]
            if (f := py_f1(pairs)) is not None:
                raters[who] = (len(pairs), f)
        n = sum(k for k, _ in raters.values())
        assert got[c].judge == (None if model is None else pytest.approx(model)) and got[c].n_raters == len(raters)
        assert got[c].raters == (pytest.approx(sum(k * f for k, f in raters.values()) / n) if n else None)
        assert got[c].percentile == (pytest.approx(100 * sum(f < model for _, f in raters.values()) / len(raters)) if raters and model is not None else None)


def test_digests_are_md5_of_every_block_and_id():
    ids = [b"", b"7", *(str(i).encode() for i in range(95, 105)), "é　".encode(), b"x" * 48, b"x" * 49, b"y" * 200]
    got = R.digests(67, range(5, 120), ids)
    for i, block in enumerate(range(5, 120)):
        for j, key in enumerate(ids):
            assert got[i, j].tobytes() == hashlib.md5(f"67:{block}:".encode() + key).digest()
    assert R.weights(got[:1, 1:2]).tolist() == [[[float(py_weight(67, 80 + j, "7")) for j in range(16)]]]


def test_digests_are_made_once_for_an_ids_rows_and_conventions_of_a_seed(spark, monkeypatch):
    """Cells of an id and conventions of a seed cost no more digests than one; sums handed on early change nothing."""
    made, whole = [], R.digests
    monkeypatch.setattr(R, "digests", lambda seed, blocks, ids: made.append(len(blocks) * len(ids)) or whole(seed, blocks, ids))
    rows = [(g, i, float(i * (1 + len(g)))) for i in range(30) for g in ("a", "bb", "ccc")]
    import pyarrow as pa

    schema = pa.schema([("g", pa.string()), ("m", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), *((f"s{i}", pa.float64()) for i in range(32))])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([str(r[1]) for r in rows]), pa.array([r[2] for r in rows]), pa.array([1.0] * 90)], names=["g", "id", "a", "b"])
    monkeypatch.setattr(R, "ROWS", 90)
    out = list(R.summed(0, 63, 1, schema)([batch]))
    assert sum(made) == 63 * 30 and len(out) == 3 and all(x.num_rows == 64 for x in out)
    monkeypatch.setattr(R, "HELD", 0)
    monkeypatch.setattr(R, "ROWS", 7)
    early = pa.Table.from_batches(R.summed(0, 63, 1, schema)([batch])).group_by(["g", "m", "b"]).aggregate([("n", "sum"), ("s5", "sum"), ("s20", "sum")]).to_pylist()
    want = {(x["g"], x["b"]): x for x in pa.Table.from_batches(out).to_pylist()}
    assert len(early) == 192
    for x in early:
        y = want[x["g"], x["b"]]
        assert (x["s5_sum"], x["s20_sum"]) == pytest.approx((y["s5"], y["s20"])) and (x["b"] != -1 or x["n_sum"] == 30)
    seen, own = [], I.draws
    monkeypatch.setattr(I, "draws", lambda *a, **k: seen.append(a[4]) or own(*a, **k))
    df = spark.createDataFrame(rows, "g string, id long, v double")
    found = {(r.convention, r.g): r for r in I.by_convention(df, ["g"], "id", {"v": (F.col("v"), F.lit(1))}, I.CONVENTIONS).collect()}
    assert sorted((c.seed, c.draws) for c in seen) == [(0, 2000), (67, 5000)] and len(found) == 18
    for name, c in I.CONVENTIONS.items():
        assert list(found[name, "bb"])[3:] == pytest.approx(list(py_interval([(i, v, 1.0) for g, i, v in rows if g == "bb"], c)))
