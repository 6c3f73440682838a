"""Text columns: cleaning, rendering, parsing of judge replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; F.trim takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def number(value: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g; a half at the seventh digit is rounded up."""
    shown = F.format_string("%.5e", value.cast("double"))  # d.ddddde+xx
    power = F.split_part(shown, F.lit("e"), F.lit(2)).try_cast("int")
    mantissa = F.split_part(shown, F.lit("e"), F.lit(1))
    sign, digits = F.when(mantissa.startswith("-"), "-").otherwise(""), F.regexp_replace(mantissa, r"[^0-9]", "")
    trimmed = lambda text: F.regexp_replace(text, r"\.?0*$", "")
    large = F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.concat(trimmed(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))), F.lit("e"), F.split_part(shown, F.lit("e"), F.lit(2)))
    body = F.when(power.between(0, 5), trimmed(large)).when(power.between(-4, -1), trimmed(small)).otherwise(wide)
    odd = F.when(F.isnan(value.cast("double")), "nan").when(value.cast("double") > 0, "inf").otherwise("-inf")
    return F.when(value.isNotNull(), F.when(power.isNull(), odd).otherwise(F.concat(sign, body)))


def numbered_items(rubric: Column, pattern: str = "numbered") -> Column:
    """One line a criterion of array<struct<criterion, weight>>: ``i. [weight=w] text`` or ``- [w] text``."""
    if pattern == "numbered":
        line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". [weight="), number(x.weight), F.lit("] "), strip(x.criterion))
    else:
        line = lambda x, i: F.concat(F.lit("- ["), number(x.weight), F.lit("] "), strip(x.criterion))
    return F.array_join(F.transform(rubric, line), "\n")


def conjunction(items: Column, indices: Column, head: str) -> Column:
    """Items of array<struct<criterion, weight>> at 1-based ``indices`` as one demand; negative ones must not hold."""
    bar = lambda i: F.when(F.element_at(items, i).weight < 0, "[must NOT hold] ").otherwise("")
    part = lambda i, p: F.concat(F.lit("("), (p + 1).cast("string"), F.lit(") "), bar(i), F.element_at(items, i).criterion)
    return F.concat(F.lit(head), F.array_join(F.transform(indices, part), " "))


def conversation(messages: Column, style: str = "colon") -> Column:
    """array<struct<role, text>> as one text, turns apart by a blank line."""
    show = (lambda m: F.concat(m.role, F.lit(": "), m.text)) if style == "colon" else (lambda m: F.concat(F.lit("["), m.role, F.lit("] "), m.text))
    return F.array_join(F.transform(messages, show), "\n\n")


def last_user_text(messages: Column) -> Column:
    """The last non-empty user turn, else the last turn."""
    users = F.filter(messages, lambda m: (F.lower(m.role) == "user") & (strip(m.text) != ""))
    return F.coalesce(F.try_element_at(users, F.lit(-1)).text, F.try_element_at(messages, F.lit(-1)).text)


def append_to_last_user(messages: Column, addition: Column) -> Column:
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size(messages) - 1), lambda i: F.lower(F.get(messages, i).role) == "user"))
    return F.transform(messages, lambda m, i: F.struct(m.role.alias("role"), F.when(i == last, F.concat(m.text, addition)).otherwise(m.text).alias("text")))


def without_fence(text: Column, any_tag: bool = True) -> Column:
    """The inside of a reply wrapped in a code fence; an unterminated fence is taken as it is."""
    tag = "[A-Za-z0-9_+-]*" if any_tag else "(?:json)?"
    return strip(F.regexp_replace(F.regexp_replace(strip(text), rf"^```{tag}\s*", ""), r"\s*```$", ""))


def without_fence_line(text: Column) -> Column:
    """The inside of a reply whose first line begins a fence, whatever else that line says; the end of the fence may be missing."""
    bare = strip(text)
    inside = F.regexp_replace(F.regexp_replace(bare, r"(?s)\A```[^\n]*\n?", ""), r"(?U)\s*```\s*\z", "")
    return F.when(F.startswith(bare, F.lit("```")), strip(inside)).otherwise(bare)


def embedded_object(text: Column) -> Column:
    """From the first brace to the last; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


#: Words that announce an answer, then words that name an option, and the letters that options have (fixed values).
ANSWER_WORDS = (r"final\s+answer", "answer", "ans", r"correct\s+option")
OPTION_WORDS = ("option", "choice")
LETTERS = tuple("ABCDEFGHIJ")


def option_letter(text: Column, letters: Sequence[str] = LETTERS) -> Column:
    """The last allowed letter of the first kind of statement that has one; null if there is none.

    Kinds: after a word that announces an answer (and "is", a colon or a dash), after a word that
    names an option, a reply that is a letter and nothing else, and a bare capital other than I.
    Letters of the first two may begin a word; brackets before a letter are passed over.
    """
    bare, bracket, any_letter = strip(F.coalesce(text, F.lit(""))), r"[\[(]?\s*", f"([{''.join(LETTERS)}])"
    after = lambda words, link: rf"(?iU)(?:{'|'.join(words)})\s*{link}{bracket}{any_letter}"
    found = lambda pattern: F.regexp_extract_all(bare, F.lit(pattern), F.lit(1))
    only = rf"(?iU)\A{bracket}{any_letter}\s*[\])]?[.,;:]?\z"
    capitals = F.filter(found(f"(?<![A-Za-z]){any_letter}(?![A-Za-z])"), lambda x: x != "I")
    kinds = [found(after(ANSWER_WORDS, r"(?:is|[-:])?\s*")), found(after(OPTION_WORDS, "")), found(only), capitals]
    allowed = F.array(*[F.lit(x.strip().upper()) for x in letters])
    pick = lambda hits: F.try_element_at(F.filter(F.transform(hits, F.upper), lambda x: F.array_contains(allowed, x)), F.lit(-1))
    return F.coalesce(*map(pick, kinds))


def arena_label(text: Column, labels: Sequence[str] = ("A>>B", "A>B", "A=B", "B>A", "B>>A")) -> Column:
    """The last valid label in single or double brackets."""
    found = F.transform(F.regexp_extract_all(F.upper(text), F.lit(r"\[\[?([AB<>=]+)\]\]?"), F.lit(1)), strip)
    return F.try_element_at(F.filter(found, lambda x: x.isin(*labels)), F.lit(-1))


#: A criterion's classes, and other names that prefixes give them (fixed values).
CATEGORIES = ("essential", "important", "optional", "pitfall")
CATEGORY_ALIASES = {"importance": "important", "esssential": "essential", "mandatory": "essential", "option": "optional"}


def category(text: Column, weight: Column, aliases: dict[str, str] = CATEGORY_ALIASES) -> Column:
    """A criterion's class: its prefix before a colon, by alias, else by its weight (5, 3 and 1 or more, pitfalls below 0).

    A text without a class whose weight is null, not a number or below 1 raises when read.
    """
    prefix = strip(F.regexp_replace(strip(F.lower(F.split_part(text, F.lit(":"), F.lit(1)))), " criteria$", ""))
    prefix = F.when(text.contains(":"), prefix)
    named = F.coalesce(*[F.when(prefix == a, b) for a, b in aliases.items()], F.when(prefix.isin(*CATEGORIES), prefix))
    w = F.when(~F.isnan(weight.try_cast("double")), weight.try_cast("double"))
    by_weight = F.when(w < 0, "pitfall").when(w >= 5, "essential").when(w >= 3, "important").when(w >= 1, "optional")
    return F.coalesce(named, by_weight, F.raise_error(F.concat(F.lit("no class: "), F.coalesce(text, F.lit("null")))))


#: What a failure clause says, after "fail" or "fails" (fixed values).
FAILS = ("if", "this dimension if", "the criterion if")
#: Characters that a criterion has at least when its failure clauses are gone.
LEAST_LEFT = 40


def without_failure_clause(text: Column, least: int = LEAST_LEFT) -> Column:
    """Without the sentences that say, anywhere in them, what fails; the text as it was if too little is left.

    A sentence ends with a mark, and begins the text or behind a mark and white space, which stays.
    """
    sentence = F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+\z"), F.lit(0))
    says = lambda x: x.rlike(rf"(?iU)\bfails? (?:{'|'.join(FAILS)})\b[^.!?]*[.!?]\z")
    kept = F.transform(sentence, lambda x, i: F.when(says(x) & ((i == 0) | x.rlike(r"(?U)\A\s")), F.when(i > 0, F.left(x, F.lit(1))).otherwise("")).otherwise(x))
    rest = strip(F.array_join(kept, ""))
    return F.when((rest != strip(text)) & (F.length(rest) < least), text).otherwise(rest)


def hash_id(source: str, text: Column) -> Column:
    """An id that depends on the text alone."""
    return F.concat(F.lit(f"{source}:"), F.left(F.sha2(text, 256), F.lit(16)))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\u4e00-\u9fff]")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def filled(template: str, **values: Column) -> Column:
    """``<<name>>`` replaced by columns; nothing in a value is taken for a place."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find(f"<<{n}>>"), n) for n in values if f"<<{n}>>" in rest]
        if not hits:
            break
        at, name = min(hits)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 4 :]
    return F.concat(*parts, F.lit(rest))
