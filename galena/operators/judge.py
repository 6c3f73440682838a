"""Judges: a deterministic one in SQL, and an adapter for any callable."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions import text as X
from galena.functions.rubric import clipped, total


def substring_verdicts(response: Column, rubric: Column) -> Column:
    """Whether each criterion occurs in the response, case aside."""
    return F.transform(rubric, lambda c: F.contains(F.lower(response), F.lower(c.criterion)))


def substring_score(response: Column, rubric: Column) -> Column:
    """Earned weight over all weight, negative ones included: this judge's own rule."""
    earned = total(F.filter(rubric, lambda c: F.contains(F.lower(response), F.lower(c.criterion))), lambda c: c.weight)
    return clipped(F.try_divide(earned, total(rubric, lambda c: c.weight)))


#: Fields that hold verdicts, probabilities and a rating, in order of preference, and the field of grades (fixed values).
VERDICT_FIELDS = ("satisfied", "criteria_met")
PROBABILITY_FIELDS = ("probabilities", "criterion_probabilities", "satisfied_probabilities")
RATING_FIELDS = ("rating", "score")
GRADES_FIELD, MOST_GRADE, RATINGS = "grades", 3, (1.0, 10.0)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), 0)


def payload(reply: Column) -> Column:
    """The reply's JSON, of which a fence of its own lines (bare or json) may stand around; null if it isn't JSON or repeats a key."""
    bare = X.strip(reply)
    inside = F.regexp_replace(bare, r"(?is)\A```(?:json)?[^\S\n]*\n(.*)```\z", "$1")
    return F.try_parse_json(X.strip(inside))


def _kind(value: Column) -> Column:
    """BOOLEAN, STRING, BIGINT, DECIMAL, DOUBLE, FLOAT, ARRAY, OBJECT or VOID."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def _field(value: Column, names: Sequence[str]) -> Column:
    """The first of an object's fields that is there and not null."""
    return F.coalesce(*[_let(F.try_variant_get(value, f"$.{n}", "variant"), lambda f: F.when(_kind(f) != "VOID", f)) for n in names])


def _field_or_root(root: Column, names: Sequence[str]) -> Column:
    return F.when(_kind(root) == "OBJECT", _field(root, names)).otherwise(root)


def _items(value: Column) -> Column:
    return F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def _by_index(value: Column, n: Column, key: Callable[[Column], Column]) -> Column:
    """An object's values at the keys 1..n, each there once after ``key``, and no others."""
    entries = F.when(_kind(value) == "OBJECT", F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")))
    numbered = F.transform(entries, lambda e: F.struct(key(e["key"]).alias("at"), e["value"].alias("value")))

    def ordered(pairs: Column) -> Column:
        whole = (F.size(pairs) == n) & F.forall(pairs, lambda e: e["at"].isNotNull()) & (F.array_sort(F.transform(pairs, lambda e: e["at"])) == F.sequence(F.lit(1), n))
        return F.when((n > 0) & whole, F.transform(F.sequence(F.lit(1), n), lambda i: F.get(F.filter(pairs, lambda e: e["at"] == i), 0)["value"]))

    return _let(numbered, ordered)


def _number(value: Column, text: bool) -> Column:
    """A finite number that isn't a boolean, or (with ``text``) a string of one."""
    kinds = ("BIGINT", "TINYINT", "SMALLINT", "INT", "DECIMAL", "DOUBLE", "FLOAT", *(("STRING",) if text else ()))
    return _let(F.when(_kind(value).isin(*kinds), F.try_variant_get(value, "$", "double")), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def _all(values: Column, n: Column) -> Column:
    return _let(values, lambda vs: F.when((F.size(vs) == n) & F.forall(vs, lambda v: v.isNotNull()), vs))


def verdicts(reply: Column, n: Column) -> Column:
    """array<boolean>: of a list, or of a field that is a list or an object keyed 1..n; null unless it has exactly n strict booleans."""
    index = lambda k: F.regexp_extract(k, r"\A\s*(\+?[0-9]+)\s*\z", 1).try_cast("int")
    listed = lambda held: F.coalesce(_items(held), _by_index(held, n, index))
    held = _let(payload(reply), lambda root: _let(_field_or_root(root, VERDICT_FIELDS), lambda h: F.when((_kind(root) == "OBJECT") | (_kind(h) == "ARRAY"), listed(h))))
    return _all(F.transform(held, lambda v: F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))), n)


def grades(reply: Column, n: Column) -> Column:
    """array<int> of 0 to 3: of an object whose only field is grades, keyed 1..n in plain digits; null otherwise."""
    plain = lambda k: F.when(k.rlike(r"\A[1-9][0-9]*\z"), k.try_cast("int"))
    whole = lambda x: F.when((x == F.floor(x)) & x.between(0, MOST_GRADE), x.cast("int"))
    alone = lambda root: F.map_keys(F.try_variant_get(root, "$", "map<string,variant>")) == F.array(F.lit(GRADES_FIELD))
    held = _let(payload(reply), lambda root: F.when((_kind(root) == "OBJECT") & alone(root), F.try_variant_get(root, f"$.{GRADES_FIELD}", "variant")))
    return _all(F.transform(_let(held, lambda h: _by_index(h, n, plain)), lambda v: _let(_number(v, False), whole)), n)


def probabilities(reply: Column, n: Column) -> Column:
    """array<double> of 0 to 1: of a list or a field that is one; numbers or strings of numbers; null otherwise."""
    held = _let(payload(reply), lambda root: _let(_field_or_root(root, PROBABILITY_FIELDS), _items))
    return _all(F.transform(held, lambda v: _let(_number(v, True), lambda x: F.when(x.between(0, 1), x))), n)


def rating(reply: Column) -> Column:
    """A rating from 1 to 10, a number or a string of one; null otherwise."""
    said = _let(payload(reply), lambda root: _number(F.when(_kind(root) == "OBJECT", _field(root, RATING_FIELDS)), True))
    return _let(said, lambda x: F.when(x.between(*RATINGS), x))


def winner(reply: Column) -> Column:
    said = F.get_json_object(reply, "$.winner")
    return F.when(said.isin("A", "B", "tie"), said)


@dataclass(frozen=True)
class Calls:
    """How a task calls a judge.

    ``in_flight`` calls are open at once. ``per_minute`` calls and ``tokens_per_minute`` (of ``tokens(prompt)``) are this
    task's share of the endpoint's quota: the quota over the number of tasks that run at once. A throttled
    call (429) costs none of the ``tries`` but one of the ``waits``; a server's error (5xx) and an
    unreadable reply cost a try, after a pause; any other error does, too. After the first try the judge is
    asked at ``retry_temperature``, and otherwise at 0.
    """

    tries: int = 3
    waits: int = 20
    in_flight: int = 8
    per_minute: float = float("inf")
    tokens_per_minute: float = float("inf")
    tokens: Callable[[str], int] = len
    retry_temperature: float = 0.7
    pause: float = 0.25
    longest: float = 10.0


def error_class(error: BaseException) -> str:
    """throttled, server or other, by a status of the error or of its response, or by 429 in its text."""
    status = next((x for x in (getattr(error, "status", None), getattr(error, "status_code", None), getattr(getattr(error, "response", None), "status_code", None)) if x is not None), None)
    if status == 429 or "429" in str(error):
        return "throttled"
    return "server" if isinstance(status, int) and 500 <= status < 600 else "other"


class _Pace:
    """Deals out moments so that no more than ``rate`` units a second are started."""

    def __init__(self, rate: float):
        self.rate, self.next, self.lock = rate, 0.0, threading.Lock()

    def wait(self, units: float) -> None:
        if self.rate == float("inf"):
            return
        with self.lock:
            now = time.monotonic()
            start = max(now, self.next)
            self.next = start + units / self.rate
        time.sleep(start - now)


def judged(tasks: DataFrame, judge: Callable[[str, float], str], parse: Callable[[str], object | None], prompt: str, out: str, kind: str, calls: Calls = Calls()) -> DataFrame:
    """``tasks`` with the parsed reply of ``judge(prompt, temperature)``, or null and err when its tries are used up; and how many tries it took.

    A row is never lost, rows keep their order, and each task keeps to its ``calls``. A null prompt is an error of its row.
    """
    fields = tasks.schema.names

    def asked(text: str | None, paces: tuple[_Pace, _Pace]) -> tuple[object | None, str | None, int]:
        if text is None:
            return None, "no prompt", 0
        error, tried, waited = None, 0, 0
        while tried < calls.tries and waited <= calls.waits:
            paces[0].wait(1)
            paces[1].wait(calls.tokens(text))
            try:
                if (value := parse(judge(text, calls.retry_temperature if tried else 0.0))) is not None:
                    return value, None, tried + 1
                error, step = "unreadable reply", tried
            except Exception as e:  # noqa: BLE001  whatever a judge raises is the row's error
                error, step = f"{type(e).__name__}: {e}", tried
                if error_class(e) == "throttled":
                    waited += 1
                    time.sleep(min(calls.longest, calls.pause * 2 ** min(waited, 5)))
                    continue
            tried += 1
            if tried < calls.tries:
                time.sleep(min(calls.longest, calls.pause * 2**step))
        return None, error, tried

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paces = _Pace(calls.per_minute / 60), _Pace(calls.tokens_per_minute / 60)
        with ThreadPoolExecutor(calls.in_flight) as pool:
            for batch in batches:
                replies = list(pool.map(lambda text: asked(text, paces), batch[prompt]))
                yield batch[fields].assign(**{out: [v for v, _, _ in replies], "err": [e for _, e, _ in replies], "tries": [n for _, _, n in replies]})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.mapInPandas(run, f"{kept}, `{out}` {kind}, err string, tries int")


def usable_criteria(criteria: Column, least: int = 2) -> Column:
    """Of array<struct<name, description, atomic_indices>> those with a name and a description; fewer than ``least`` become one overall criterion."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = F.filter(criteria, lambda c: text(c["name"]) & text(c["description"]))
    overall = F.array(F.struct(F.lit("Overall").alias("name"), F.lit("How good the answer is as a whole.").alias("description"), F.array().cast("array<int>").alias("atomic_indices")))
    return F.when(F.size(F.coalesce(good, F.array().cast("array<struct<name:string,description:string,atomic_indices:array<int>>>"))) >= least, good).otherwise(overall)


def repaired(criteria: Column, weights: Column, n: Column, absolute: bool = True, least: int = 2) -> Column:
    """array<struct<name, description, weight, atomic_indices>>: every index of 1..n once, weights summed again, empty criteria gone."""
    usable = usable_criteria(criteria, least)
    groups = _repaired_groups(F.transform(usable, lambda c: c["atomic_indices"]), n)
    of = (lambda i: F.abs(F.element_at(weights, i))) if absolute else (lambda i: F.element_at(weights, i))
    made = F.zip_with(usable, groups, lambda c, g: F.struct(c["name"].alias("name"), c["description"].alias("description"), F.round(total(F.coalesce(g, F.array().cast("array<int>")), of), 2).alias("weight"), g.alias("atomic_indices")))
    return F.filter(made, lambda c: F.size(c.atomic_indices) > 0)


def _repaired_groups(groups: Column, n: Column) -> Column:
    """``repaired_groups`` in SQL: one fold over the groups, then one over the orphans; sums and sizes are part of the state."""
    none, ints = F.array().cast("array<int>"), "array<struct<own:array<int>,total:bigint>>"
    group = lambda own, total: F.struct(own.alias("own"), total.cast("long").alias("total"))
    add = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda acc, i: acc + i)

    def claim(state: Column, wanted: Column) -> Column:
        own = F.array_distinct(F.filter(F.coalesce(wanted, none), lambda i: i.between(1, n) & ~F.array_contains(state["taken"], i)))
        return F.struct(F.concat(state["taken"], own).alias("taken"), F.concat(state["made"], F.array(group(own, add(own)))).alias("made"))

    claimed = F.aggregate(groups, F.struct(none.alias("taken"), F.array().cast(ints).alias("made")), claim)

    def place(made: Column, orphan: Column) -> Column:
        apart = F.transform(made, lambda g: F.when(F.size(g["own"]) > 0, F.abs(g["total"] / F.size(g["own"]) - orphan)).otherwise(float("inf")))
        nearest = F.array_position(apart, F.array_min(apart)) - 1  # the first of equals; the first of all if none has an index
        return F.transform(made, lambda g, at: F.when(at == nearest, group(F.concat(g["own"], F.array(orphan)), g["total"] + orphan)).otherwise(g))

    start = F.when(F.size(groups) > 0, claimed["made"]).otherwise(F.array(group(none, F.lit(0))))
    orphans = F.when(n > 0, F.array_except(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), claimed["taken"])).otherwise(none)
    return F.transform(F.aggregate(orphans, start, place), lambda g: g["own"])


def auto_repair(groups: list[list[int]], n: int) -> list[list[int]]:
    """Groups that hold each of 1..n once, without empty ones, in order; see repaired_groups."""
    return [sorted(g) for g in repaired_groups(groups, n) if g]


def repaired_groups(groups: list[list[int]], n: int) -> list[list[int]]:
    """Groups of 1-based indices made to hold each of 1..n once.

    The first claim of an index counts; an orphan goes to the non-empty group of the
    nearest mean index, which then moves; the earliest group wins ties. Without any
    non-empty group the first one takes them all.
    """
    taken: set[int] = set()
    out = []
    for group in groups:
        own = [i for i in group if 1 <= i <= n and i not in taken and not taken.add(i)]
        out.append(own)
    out = out or [[]]
    for orphan in (i for i in range(1, n + 1) if i not in taken):
        min((g for g in out if g), key=lambda g: abs(sum(g) / len(g) - orphan), default=out[0]).append(orphan)
    return out
