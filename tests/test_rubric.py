"""Literal fixtures of the checklist transforms and scores."""

import pytest
from pyspark.sql import functions as F

from galena.functions import rubric as R
from galena.functions import text as X
from galena.operators import judge as J

RUBRIC = "array<struct<criterion:string,weight:double>>"


def one(spark, schema, *row):
    return spark.createDataFrame([row], schema)


def value(df, column):
    return df.select(column.alias("v")).first().v


def test_group_weights_and_mean_weight(spark):
    df = one(spark, f"r {RUBRIC}", [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", -4.0), ("e", 5.0)])
    r = F.col("r")
    assert [value(df, R.group_weight(r, F.array(*map(F.lit, g)))) for g in ((1, 2), (3, 4, 5))] == [3.0, 12.0]
    pair = one(spark, f"r {RUBRIC}", [("x", 3.0), ("y", 12.0)])
    more = value(pair, R.with_mean_weight(F.col("r"), "fits"))
    assert len(more) == 3 and more[-1].weight == 7.5
    labels = F.array(F.lit("CRITICAL"), F.lit("FORMAT"))
    two = one(spark, f"r {RUBRIC}", [("x", 1.5), ("y", 12.0)])
    assert [c.weight for c in value(two, R.reweighted(F.col("r"), labels, {"CRITICAL": 2.0, "NORMAL": 1.0, "FORMAT": 0.0}, "NORMAL"))] == [3.0, 0.0]
    short = value(two, R.reweighted(F.col("r"), F.array(F.lit("CRITICAL")), {"CRITICAL": 2.0, "NORMAL": 1.0}, "NORMAL"))
    assert [c.weight for c in short] == [1.5, 12.0]


@pytest.mark.parametrize("met,want", [([True, True, False], 1.0), ([False, False, True], 0.0), ([True, False, False], 0.25), ([True, True, True], 0.5)])
def test_score_is_signed_and_clipped(spark, met, want):
    df = one(spark, f"r {RUBRIC}, m array<boolean>", [("a", 1.0), ("b", 3.0), ("bad", -2.0)], met)
    assert value(df, R.array_score(F.col("r"), F.col("m"))) == want


def test_score_without_positive_weight_is_null(spark):
    df = one(spark, f"r {RUBRIC}, m array<boolean>", [("bad", -2.0)], [True])
    assert value(df, R.array_score(F.col("r"), F.col("m"))) is None


@pytest.mark.parametrize("groups,n,want", [([[1, 3], [2]], 3, True), ([[1], [1, 2]], 2, False), ([[1], [3]], 3, False), ([[1], [2, 4]], 3, False), ([[], [1]], 1, True)])
def test_exactly_once(spark, groups, n, want):
    df = one(spark, "g array<array<int>>, n int", groups, n)
    assert value(df, R.covers_once(F.col("g"), F.col("n"))) is want


def test_split_weight_keeps_total_and_signs(spark):
    df = one(spark, "w array<double>", [1.0, -3.0])
    assert value(df, R.split_weight(F.col("w"), F.lit(8.0))) == [2.0, -6.0]


def test_divergence_is_bounded_and_zero_for_equals(spark):
    df = one(spark, "p array<double>, q array<double>", [1.0, 0.0], [0.0, 1.0])
    assert abs(value(df, R.truncated_jsd(F.col("p"), F.col("q"))) - 0.6931) < 1e-3
    assert abs(value(df, R.truncated_jsd(F.col("p"), F.col("p")))) < 1e-9


LETTERS = [
    ("Answer: B", "B"), ("the answer is (c).", "C"), ("I do not know.", None), ("Answer: I", "I"), ("A or (B)", "B"), ("Answer: A then answer: D", "D"), ("I choose option B over A", "B"), ("correct option: C. Not D", "C"),
    ("Option (a) or choice [e", "E"), ("answer: because", "B"), (" (j) ", "J"), ("j", "J"), ("A1 b C", "C"), ("answer Z, option z, k", None), ("final\n answer - d", "D"), ("", None), (None, None), ("(I)", "I"), ("I, J", "J"),
]


@pytest.mark.parametrize("text,want", LETTERS)
def test_option_letter(spark, text, want):
    assert value(one(spark, "t string", text), X.option_letter(F.col("t"))) == want


def test_option_letter_keeps_to_the_options(spark):
    df = one(spark, "t string", "Answer: E. No, answer: b")
    assert value(df, X.option_letter(F.col("t"), ["e", " A "])) == "E" and value(df, X.option_letter(F.col("t"), ["A"])) is None


LONG = "Names the dose that is right for a grown patient."
CLAUSES = [
    (LONG + " The answer fails if it omits the dose.", LONG), ("Fails if it omits the dose. " + LONG, LONG), (LONG + " Fails to mention cost in a few cases only.", LONG + " Fails to mention cost in a few cases only."),
    (LONG + " It will fail this dimension if late! And more.", LONG + "  And more."), (LONG + " It fails the criterion if late? Yes.", LONG + "  Yes."), (LONG + "It fails if late.", LONG + "It fails if late."),
    ("Short. It fails if late.", "Short. It fails if late."), (LONG + " It fails if no end", LONG + " It fails if no end"), (LONG + " It fails iffy.", LONG + " It fails iffy."), ("  " + LONG + " ", LONG), ("", ""), (None, None),
]


@pytest.mark.parametrize("text,want", CLAUSES)
def test_failure_clauses(spark, text, want):
    assert value(one(spark, "t string", text), X.without_failure_clause(F.col("t"))) == want


def test_categories(spark):
    cases = {("Essential Criteria: x", None): "essential", (" importance : x", 0.0): "important", ("Esssential criteria: x", None): "essential", ("option: x", -1.0): "optional", ("Pitfall", 5.0): "essential", ("what: x", -2.0): "pitfall", ("no prefix", 1.0): "optional", ("x", 3.0): "important"}
    df = spark.createDataFrame(list(cases), "t string, w double")
    assert {(r.t, r.w): r.c for r in df.select("t", "w", X.category(F.col("t"), F.col("w")).alias("c")).collect()} == cases
    for text, weight in (("no prefix", None), ("what: x", 0.5), ("x", float("nan"))):
        with pytest.raises(Exception, match="no class"):
            value(one(spark, "t string, w double", text, weight), X.category(F.col("t"), F.col("w")))


def test_numbers_have_six_digits(spark):
    values = [0.0, 1.0, -2.5, 0.1, 1 / 3, 123456.0, 1234567.0, 0.0001, 0.00001234, 1e300, -5e-300, 100000.0, 999999.4, 12.0000001, 0.30000000000000004, float("inf"), float("nan"), -0.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").select(X.number(F.col("v")).alias("n"))
    assert [r.n for r in df.collect()] == [f"{v:g}" for v in values] + [None]


def test_text_functions(spark):
    df = one(spark, "t string, w double", " \t日本 a b\n", 2.5)
    assert value(df, X.strip(F.col("t"))) == "日本 a b" and value(df, X.word_count(F.col("t"))) == 3 and value(df, X.has_cjk(F.col("t")))
    assert [value(one(spark, "w double", w), X.number(F.col("w"))) for w in (2.0, 2.5, -4.0, 0.125, 100.0, 0.0)] == ["2", "2.5", "-4", "0.125", "100", "0"]
    fenced = one(spark, "t string", '```json\n{"a": 1}\n```')
    assert value(fenced, X.without_fence(F.col("t"))) == '{"a": 1}'
    assert value(fenced, X.embedded_object(F.col("t"))) == '{"a": 1}'
    assert value(one(spark, "a string", "<<b>> %s {}"), X.filled("x<<a>>y", a=F.col("a"))) == "x<<b>> %s {}y"
    assert value(one(spark, "t string", "[[A>B]] no, [b>>a]"), X.arena_label(F.col("t"))) == "B>>A"


VERDICTS = [
    ('{"satisfied": [true, false]}', [True, False]), ('{"satisfied": {"2": false, "1": true}}', [True, False]), ('{"satisfied": ["true", false]}', None), ('{"satisfied": [true]}', None), ("nonsense", None), ("[true, false]", [True, False]),
    ('{"criteria_met": {" 1 ": true, "02": true}}', [True, True]), ('{"satisfied": null, "criteria_met": [false, false]}', [False, False]), ('{"satisfied": {"1": true, "2": 1}}', None), ('{"satisfied": {"1": true, "1": false, "2": true}}', None),
    ('{"satisfied": {"1": true, " 1": true}}', None), ('{"1": true, "2": true}', None), ('```json\n{"satisfied": [true, false]}\n```', [True, False]), ("```\n[false, true]```", [False, True]), ("```python\n[false, true]\n```", None), ("null", None), (None, None),
]


@pytest.mark.parametrize("reply,want", VERDICTS)
def test_verdicts_are_strict(spark, reply, want):
    assert value(one(spark, "r string", reply), J.verdicts(F.col("r"), F.lit(2))) == want


def test_other_reply_modes_are_strict(spark):
    two = F.lit(2)
    cases = [
        ('{"grades": {"1": 0, "2": 3}}', [0, 3], None, None), ('{"grades": {"1": 2.0, "2": 1}}', [2, 1], None, None), ('{"grades": {"1": 2.5, "2": 1}}', None, None, None), ('{"grades": {"1": true, "2": 1}}', None, None, None),
        ('{"grades": {"01": 1, "2": 1}}', None, None, None), ('{"grades": {"1": 4, "2": 1}}', None, None, None), ('{"grades": {"1": 1, "2": 1}, "x": 1}', None, None, None), ('{"grades": [1, 1]}', None, None, None), ('{"grades": {"1": "1", "2": 1}}', None, None, None),
        ("[0.5, 1]", None, [0.5, 1.0], None), ('{"probabilities": ["0.25", 0]}', None, [0.25, 0.0], None), ('{"probabilities": null, "satisfied_probabilities": [1, 1]}', None, [1.0, 1.0], None), ("[0.5, 1.01]", None, None, None), ("[true, 1]", None, None, None), ("[0.5, null]", None, None, None),
        ('{"rating": 10}', None, None, 10.0), ('{"rating": null, "score": "7.5"}', None, None, 7.5), ('{"rating": true}', None, None, None), ('{"rating": 0.9}', None, None, None), ('{"score": "x"}', None, None, None), ("7", None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    got = df.select("i", J.grades(F.col("r"), two).alias("g"), J.probabilities(F.col("r"), two).alias("p"), J.rating(F.col("r")).alias("l")).collect()
    assert {r.i: (r.g, r.p, r.l) for r in got} == {i: c[1:] for i, c in enumerate(cases)}


def test_substring_judge_divides_by_all_weight(spark):
    df = one(spark, f"r {RUBRIC}", [("Yes", 3.0), ("no", -1.0)])
    assert value(df, J.substring_score(F.lit("yes!"), F.col("r"))) == 1.0


def test_auto_repair():
    assert J.auto_repair([[1, 1, 9], [4], []], 5) == [[1, 2], [3, 4, 5]]
    assert J.auto_repair([[], [7]], 3) == [[1, 2, 3]]


def test_judge_adapter_never_loses_a_row(spark):
    def judge(text, temperature):
        if text == "bad":
            raise RuntimeError("down")
        return "1" if text == "late" and temperature else text

    tasks = spark.createDataFrame([("1",), ("x",), ("bad",), (None,), ("late",)], "prompt string")
    got = {r.prompt: (r.met, r.err, r.tries) for r in J.judged(tasks, judge, lambda reply: True if reply == "1" else None, "prompt", "met", "boolean", J.Calls(pause=0.0)).collect()}
    assert got == {"1": (True, None, 1), "x": (None, "unreadable reply", 3), "bad": (None, "RuntimeError: down", 3), None: (None, "no prompt", 0), "late": (True, None, 2)}


def test_throttled_calls_cost_no_attempt(spark):
    class Busy:
        def __init__(self, times):
            self.left = times

        def __call__(self, text, temperature):
            if self.left:
                self.left -= 1
                raise RuntimeError("HTTP 429: slow down")
            return text

    tasks = spark.createDataFrame([("1",)], "prompt string")
    ask = lambda times: tuple(J.judged(tasks, Busy(times), lambda reply: reply == "1", "prompt", "met", "boolean", J.Calls(waits=5, pause=0.0)).first())
    assert ask(5) == ("1", True, None, 1) and ask(9) == ("1", None, "RuntimeError: HTTP 429: slow down", 0)


def test_error_classes_by_status():
    class Status(Exception):
        def __init__(self, **kw):
            self.__dict__.update(kw)

    class Response:
        status_code = 503

    assert [J.error_class(e) for e in (Status(status=429), Status(status_code=500), Status(response=Response()), ValueError("429 times"), Status(status_code=404), ValueError("no"))] == ["throttled", "server", "server", "throttled", "other", "other"]


class Slow:
    """Notes when calls begin and how many are open; replies after a while, the first ones last."""

    def __init__(self, path):
        self.path, self.open, self.lock = path, 0, None

    def __call__(self, text, temperature):
        import threading
        import time

        self.lock = self.lock or threading.Lock()
        with self.lock:
            self.open += 1
            with open(self.path, "a") as log:
                log.write(f"{self.open} {time.monotonic()}\n")
        time.sleep(0.06 if int(text) % 2 else 0.02)
        with self.lock:
            self.open -= 1
        return text

    def __getstate__(self):
        return {"path": self.path, "open": 0, "lock": None}


def test_calls_are_open_together_in_order_and_within_their_budget(spark, tmp_path):
    tasks = spark.range(40, numPartitions=1).selectExpr("cast(id as string) as prompt", "id")
    free = J.judged(tasks, Slow(str(tmp_path / "free")), int, "prompt", "v", "long", J.Calls(in_flight=6)).collect()
    assert [r.v for r in free] == [r.id for r in free] == list(range(40))
    opened = [int(line.split()[0]) for line in (tmp_path / "free").read_text().splitlines()]
    assert len(opened) == 40 and 3 <= max(opened) <= 6
    J.judged(tasks.limit(12), Slow(str(tmp_path / "paced")), int, "prompt", "v", "long", J.Calls(in_flight=6, per_minute=1200)).collect()
    times = [float(line.split()[1]) for line in (tmp_path / "paced").read_text().splitlines()]
    assert times[-1] - times[0] >= 11 / 20 - 0.02
    J.judged(tasks.limit(12), Slow(str(tmp_path / "tokens")), int, "prompt", "v", "long", J.Calls(in_flight=6, tokens_per_minute=6000, tokens=lambda text: 5)).collect()
    times = [float(line.split()[1]) for line in (tmp_path / "tokens").read_text().splitlines()]
    assert times[-1] - times[0] >= 11 * 5 / 100 - 0.02
