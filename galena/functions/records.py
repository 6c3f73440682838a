"""Fields of records as they come: fallbacks, replies, prompts, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.functions.text import embedded_object, filled, strip


def strict_json(text: Column, kind: str) -> Column:
    """An array of the one value that ``text`` is; null if anything follows it, which from_json passes over."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>")


def label_reply(text: Column, n: Column, labels: Sequence[str]) -> Column:
    """array of n labels, in capitals, from the JSON object in a reply; null if it doesn't parse, is of another length or has a strange one."""
    said = F.get(strict_json(embedded_object(text), "struct<labels: array<string>>"), 0)["labels"]
    found = F.transform(said, lambda x: F.upper(strip(x)))
    return F.when((F.size(found) == n) & F.forall(found, lambda x: x.isin(*labels)), found)


def teacher_message(mode: Column, problem: Column, solution: Column, template: str) -> Column:
    """The solution itself (mode copy) or the template filled (mode template); any other mode, or an empty part, is an error."""
    for name in ("problem", "solution"):
        if f"<<{name}>>" not in template:
            raise ValueError(f"the template lacks <<{name}>>")
    wrong = F.raise_error(F.concat(F.lit("no such context: "), F.coalesce(mode, F.lit("null"))))
    empty = (strip(F.coalesce(problem, F.lit(""))) == "") | (strip(F.coalesce(solution, F.lit(""))) == "")
    return F.when(empty, F.raise_error(F.lit("a context needs its problem and its solution"))).when(mode == "copy", solution).when(mode == "template", filled(template, problem=problem, solution=solution)).otherwise(wrong)


def seeded_prompts(rows: DataFrame, id_col: str, prompt: Column, modifiers: Column, first: int = 3) -> DataFrame:
    """id, prompt, seed_no: one row per prompt and each of its first seed modifiers."""
    out = rows.select(F.col(id_col).cast("string").alias("_id"), prompt.alias("_prompt"), F.posexplode(F.slice(modifiers, 1, first)).alias("_i", "_mod"))
    return out.select(F.concat("_id", F.lit("/"), (F.col("_i") + 1).cast("string")).alias("id"), F.replace("_prompt", F.lit("<SEED>"), F.col("_mod")).alias("prompt"), (F.col("_i") + 1).alias("seed_no"))


def unit_rubric(criteria: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(1.0).alias("weight")) for c in criteria])


def first_text(*fields: Column, default: str | None = None) -> Column:
    """The first field that has text."""
    out = F.coalesce(*[F.when(strip(f.cast("string")) != "", f.cast("string")) for f in fields])
    return out if default is None else F.coalesce(out, F.lit(default))


def group_id(*fields: Column) -> Column:
    """The id of a group from the first of its names that a row has; ``unknown`` without."""
    return first_text(*fields, default="unknown")


def reward_rubric(text: Column) -> Column:
    """array<struct<criterion, weight>> from a JSON list: no empty criterion, finite weights (1 if absent), some positive weight; else null.

    Negative weights stay.
    """
    items = F.from_json(text, "array<struct<criterion: string, weight: double>>")
    out = F.transform(items, lambda c: F.struct(strip(c.criterion).alias("criterion"), F.coalesce(c.weight, F.lit(1.0)).alias("weight")))
    good = F.forall(out, lambda c: (F.coalesce(c.criterion, F.lit("")) != "") & ~F.isnan(c.weight) & (F.abs(c.weight) != float("inf")))
    return F.when(good & F.exists(out, lambda c: c.weight > 0), out)


def option(text: Column) -> Column:
    """A boolean option as people write it; null if it isn't one. The text ``false`` is false."""
    low = F.lower(strip(text))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off", ""), False)


def conformed(row: dict[str, Column], schema: dict[str, object]) -> list[Column]:
    """Columns of a fixed schema of names and defaults: what is absent or null takes its default, what isn't scalar becomes JSON, and nothing else stays."""
    out = []
    for name, default in schema.items():
        value = row.get(name)
        if value is None:
            out.append(F.lit(default).alias(name))
        elif isinstance(default, str):
            out.append(F.coalesce(value.cast("string"), F.lit(default)).alias(name))
        else:
            out.append(F.coalesce(value, F.lit(default)).alias(name))
    return out


def anchor_text(rubric: Column, notes: Column, absent: str = "(none)") -> Column:
    """A reference checklist and notes, whichever there are, apart by a blank line."""
    part = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("\n\n", part(rubric), part(notes)), F.lit("")), F.lit(absent))


def content_text(content: Column) -> Column:
    """A reply's content: text, or a JSON list of parts with text, put together; an error if neither has any."""
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "")
    text = F.when(F.startswith(content, F.lit("[")) & parts.isNotNull(), joined).otherwise(content)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("a reply without content"))).otherwise(text)


def graded_reply(text: Column) -> Column:
    """The integer score 1 to 10 of a JSON reply with a reason; null for another number, a boolean or a reply without reason."""
    raw = F.from_json(embedded_object(text), "struct<score: string, reason: string>")
    plain = F.get_json_object(embedded_object(text), "$.score")
    number = F.when(plain.rlike(r"^\d{1,2}$"), plain.cast("int"))
    return F.when(number.between(1, 10) & (strip(F.coalesce(raw.reason, F.lit(""))) != ""), number)


def winner_arm(letter: Column, left: Column, right: Column) -> Column:
    """The arm behind a verdict's letter A or B; ``tie`` for tie, null for anything else."""
    return F.when(letter == "A", left).when(letter == "B", right).when(F.lower(letter) == "tie", "tie")


def error_class(status: Column, message: Column) -> Column:
    """throttled (by status or message), retryable (5xx) or final."""
    throttled = F.coalesce(status == 429, F.lit(False)) | F.coalesce(message, F.lit("")).contains("429") | F.lower(F.coalesce(message, F.lit(""))).contains("too many requests")
    return F.when(throttled, "throttled").when(status.between(500, 599), "retryable").otherwise("final")


def choices(options: Column, count: Column) -> Column:
    """Letters of a question's options: the sorted keys of their map, else as many letters as there are, else A to D."""
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    return F.when(F.size(options) > 0, F.array_sort(F.map_keys(options))).when(count > 0, F.slice(letters, F.lit(1), count)).otherwise(F.slice(letters, F.lit(1), F.lit(4)))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)
