"""Replies and records as they come: scores, labels, edits, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galena.functions.text import strip


def named_scores(text: Column, top: float = 20.0) -> Column:
    """map of ``name: n`` and ``name: [n]`` after the last ``[Scores]``; out of range is left out, the bracket form wins."""
    tail = F.substring_index(text, "[Scores]", -1)
    number = r"(-?\d+(?:\.\d+)?)"

    def found(pattern: str) -> Column:
        names = F.regexp_extract_all(tail, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(tail, F.lit(pattern), F.lit(2))
        pairs = F.zip_with(names, values, lambda n, v: F.struct(strip(n).alias("key"), v.cast("double").alias("value")))
        return F.filter(pairs, lambda p: (p.value >= 0) & (p.value <= top))

    plain, boxed = found(rf"([A-Za-z][A-Za-z ]*):\s*{number}"), found(rf"([A-Za-z][A-Za-z ]*):\s*\[{number}\]")
    boxed_names = F.transform(boxed, lambda p: p.key)
    kept = F.concat(F.filter(plain, lambda p: ~F.array_contains(boxed_names, p.key)), boxed)
    names = F.array_distinct(F.transform(kept, lambda p: p.key))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(kept, lambda p: p.key == n), -1).value)))


def listed_labels(text: Column, labels: dict[str, int], n: Column) -> Column:
    """Scores of the lines that start, after a bullet or number, with a label; null unless there are n."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])?\s*", "")))

    def score(line: Column) -> Column:
        out = F.lit(None).cast("int")
        for label in sorted(labels, key=len):
            out = F.when(F.startswith(line, F.lit(label.lower())), labels[label]).otherwise(out)
        return out

    found = F.filter(F.transform(lines, score), lambda s: s.isNotNull())
    return F.when(F.size(found) == n, found)


def prefixed(text: Column) -> Column:
    """struct<prefix, body>: what stands before the first colon, with it, and the rest."""
    pattern = r"(?s)^([^:\n]{1,40}:\s*)(.*)$"
    return F.struct(F.regexp_extract(text, pattern, 1).alias("prefix"), F.when(F.regexp_extract(text, pattern, 1) == "", text).otherwise(F.regexp_extract(text, pattern, 2)).alias("body"))


def inserted(text: Column, anchor: Column, addition: Column) -> Column:
    """struct<text, error>: the addition after the first place of the anchor."""
    at = F.instr(text, anchor)
    done = F.concat(F.left(text, at + F.length(anchor) - 1), addition, F.substring(text, at + F.length(anchor), F.length(text)))
    return F.struct(F.when(at > 0, done).alias("text"), F.when(at == 0, "anchor missing").alias("error"))


def deleted(text: Column, span: Column, least: float, most: float) -> Column:
    """struct<text, error>: without the first place of the span, if that takes a share between the bounds."""
    at, share = F.instr(text, span), F.length(span) / F.length(text)
    done = F.concat(F.left(text, at - 1), F.substring(text, at + F.length(span), F.length(text)))
    error = F.when(at == 0, "span missing").when(~share.between(least, most), "size")
    return F.struct(F.when(error.isNull(), done).alias("text"), error.alias("error"))


def point_key(arm: Column, seed: Column, step: Column) -> Column:
    return F.format_string("%s/s%s/st%03d", arm, seed, step)


def point_parts(key: Column) -> Column:
    pattern = r"^(.*)/s([^/]*)/st(\d+)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("arm"), F.regexp_extract(key, pattern, 2).alias("seed"), F.regexp_extract(key, pattern, 3).cast("int").alias("step"))


def criteria_payload(rubric: Column) -> Column:
    """The checklist as JSON for a judge: index, criterion, weight, polarity."""
    item = lambda c, i: F.struct((i + 1).alias("index"), c.criterion.alias("criterion"), c.weight.alias("weight"), F.when(c.weight < 0, "negative").otherwise("positive").alias("polarity"))
    return F.to_json(F.transform(rubric, item))


def graded_score(weight: Column, grade: Column, top: float = 3.0) -> Column:
    """Aggregate: like the weighted score, with partial credit grade / top."""
    whole = F.sum(F.greatest(weight, F.lit(0.0)))
    return F.when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(weight * grade / top) / F.nullif(whole, F.lit(0.0)))))


def likert(rating: Column) -> Column:
    """1 to 10 as 0 to 1."""
    return F.when(rating.between(1, 10), (rating - 1) / 9)


def theme(tag: Column, themes: dict[str, str]) -> Column:
    out = F.lit("other")
    for prefix, name in themes.items():
        out = F.when(F.startswith(tag, F.lit(prefix)), name).otherwise(out)
    return out
