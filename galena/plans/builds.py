"""Data-set builds from end to end: splits, releases and their control arms, schedules, exports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from galena.functions import records as C
from galena.functions import rubric as R
from galena.functions import text as X
from galena.operators import builds as B
from galena.operators import judge as J
from galena.operators import sampling as S
from galena.plans import shaping as SH
from galena.plans import views as V

QUERIES, SQL = {}, {}
#: Multipliers of labels, and weights of classes (fixed values).
LABELS = {"CRITICAL": 3.0, "NORMAL": 1.0, "FORMAT": 0.0, "DUPLICATE": 0.0, "OVERCLINICAL": -1.0}
CATEGORY_WEIGHTS = {"essential": 1.0, "important": 0.7, "optional": 0.3, "pitfall": -0.9}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = V.SQL_WITH + sql
        return f

    return add


# A generation for nine of ten questions: groups of the odd and the even places, of which one index is lost where n is a multiple of three.
SQL_MADE = """places AS (SELECT id, r, len(r) AS n, list_filter(range(1, len(r) + 1), lambda i: i % 2 = 1) AS one,
      list_filter(range(1, len(r) + 1), lambda i: i % 2 = 0 AND NOT (len(r) % 3 = 0 AND i >= len(r) - 1)) AS two FROM rubric),
    made AS (SELECT p.*, o_orderstatus <> 'P' AS valid, o_orderkey % 7 = 0 AS repaired, o_orderpriority AS model,
      CASE WHEN len(two) > 0 THEN [one, two] ELSE [one] END AS groups FROM places p JOIN orders ON o_orderkey = id WHERE o_orderkey % 10 <> 0)"""


def _made(spark, d):
    """id, valid, repaired, model, groups: what a generator answered, by question."""
    places = F.sequence(F.lit(1), F.size("r"))
    odd = F.filter(places, lambda i: i % 2 == 1)
    even = F.filter(places, lambda i: (i % 2 == 0) & ~((F.size("r") % 3 == 0) & (i >= F.size("r") - 1)))
    orders = V.table(spark, d, "orders").filter("o_orderkey % 10 <> 0")
    made = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_orderkey") % 7 == 0).alias("repaired"), F.col("o_orderpriority").alias("model"))
    return V.rubric(spark, d).join(made, "id").withColumn("groups", F.when(F.size(even) > 0, F.array(odd, even)).otherwise(F.array(odd))).drop("r")


SQL_PACKED = f"""{SQL_MADE}, packed AS (
    SELECT r.id, r.r, m.groups, m.repaired, m.model, CASE WHEN m.id IS NULL THEN 'no_generation' WHEN r.id % 97 = 0 THEN 'manual:' || CASE WHEN r.id % 2 = 0 THEN 'even' ELSE 'odd' END
        WHEN NOT (m.valid OR m.repaired) THEN 'invalid:unknown' WHEN len(m.groups) NOT BETWEEN 2 AND 5 THEN 'n_criteria_out_of_range:' || len(m.groups)
        WHEN list_sum([len(x) FOR x IN m.groups]) <> len(r.r) THEN 'coverage_not_exactly_once' END AS reason
    FROM rubric r LEFT JOIN made m USING (id))"""


def _packed(spark, d):
    manual = V.table(spark, d, "orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("why"))
    return B.packaged(V.rubric(spark, d), _made(spark, d), manual)


@query(f""", {SQL_PACKED} SELECT id, reason, CASE WHEN reason IS NULL THEN list_transform(groups, lambda g: list_sum(list_transform(g, lambda i: abs(r[i].weight)))) END AS weights,
    CASE WHEN reason IS NULL THEN to_json(struct_pack(names := list_transform(groups, lambda g, i: 'group ' || i), atomic_indices := groups, repaired := repaired, model := model)) END AS generation FROM packed""")
def release_packaging(spark, d):
    """Every question with the first rule that keeps it out, or its dimensions' weights and the generation as JSON."""
    return _packed(spark, d).select("id", "reason", F.col("dimensions.weight").alias("weights"), "generation")


@query(f""", {SQL_PACKED}, w AS (SELECT unnest([len(x) * 2 + 1 FOR x IN groups]) AS words FROM packed WHERE reason IS NULL)
    SELECT count(*) AS rows_in, count(*) FILTER (WHERE reason IS NULL) AS rows_out, count(*) FILTER (WHERE reason IS NULL AND repaired) AS repaired_kept,
      min(len(groups)) FILTER (WHERE reason IS NULL) AS fewest, max(len(groups)) FILTER (WHERE reason IS NULL) AS most, round(avg(len(groups)) FILTER (WHERE reason IS NULL), 6) AS mean,
      (SELECT list_sort(list(words))[count(*) // 2 + 1] FROM w) AS median_words FROM packed""")
def release_stats(spark, d):
    """The manifest of a release; the median is the upper one, from a histogram of word counts."""
    packed = _packed(spark, d)
    kept = packed.filter("reason is null")
    words = kept.select(F.explode(F.transform("dimensions", lambda x: X.word_count(x.criterion).cast("long"))).alias("words"))
    middle = B.histogram_place(words, [], "words", lambda n: F.floor(n / 2)).select(F.col("words").alias("median_words"))
    size = F.when(F.col("reason").isNull(), F.size("dimensions")).cast("long")
    row = packed.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("reason").isNull()).alias("rows_out"), F.count_if(F.col("reason").isNull() & F.col("repaired")).alias("repaired_kept"), F.min(size).alias("fewest"), F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"))
    return row.crossJoin(F.broadcast(middle))  # one row each


@query(f""", {SQL_PACKED} SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM packed WHERE reason IS NOT NULL GROUP BY 1""")
def release_reasons(spark, d):
    return _packed(spark, d).filter("reason is not null").groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


SQL_PROMPTS = """prompts AS (SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: x.text <> ''), lambda x: x.text), chr(10)) AS raw,
      len(list_filter(m, lambda x: x.role = 'user')) AS items, list_sum(list_transform(m, lambda x, i: CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END)) AS plus FROM chat),
    shown AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') AS text FROM prompts),
    passing AS (SELECT min(conv_id) AS first_id, sha256(text) AS key FROM shown WHERE text <> '' AND items BETWEEN 1 AND 3 AND plus > 0 GROUP BY 2),
    split AS (SELECT conv_id, text, sha256(text) AS key, items, CASE WHEN text = '' THEN 'empty' WHEN conv_id > first_id THEN 'dup' WHEN items NOT BETWEEN 1 AND 3 THEN 'items' WHEN plus <= 0 THEN 'weights' ELSE 'kept' END AS reason
      FROM shown LEFT JOIN passing p ON p.key = sha256(text))"""


def _domain_rows(spark, d):
    texts = F.transform(F.filter("m", lambda x: x.text != ""), lambda x: x.text)
    rows = V.messages(spark, d).select("conv_id", X.strip(F.array_join(texts, "\n")).alias("text"), F.size(F.filter("m", lambda x: x.role == "user")).cast("long").alias("items"), F.ceil(F.size("m") / 3).alias("plus"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    return S.drop_reasons(rows, F.col("key"), F.col("conv_id"), [("items", ~F.col("items").between(1, 3)), ("weights", F.col("plus") <= 0)], F.col("text") == "")


@query(f""", {SQL_PROMPTS} SELECT conv_id, reason, CASE WHEN reason = 'kept' THEN 'chat:' || left(key, 16) END AS id, CASE WHEN reason = 'kept' THEN CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'other' END END AS lang FROM split""")
def domain_split_rows(spark, d):
    """Cleaned prompts with hash ids and a language mark; a failing earlier copy shadows nothing."""
    kept = F.col("reason") == "kept"
    return _domain_rows(spark, d).select("conv_id", "reason", F.when(kept, X.hash_id("chat", F.col("text"))).alias("id"), F.when(kept, F.when(X.has_cjk(F.col("text")), "zh").otherwise("other")).alias("lang"))


@query(f""", {SQL_PROMPTS}, kept AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS place, count(*) OVER () AS n_all FROM split WHERE reason = 'kept')
    SELECT conv_id, draw_pos, CASE WHEN draw_pos < n_all // 10 THEN 'held_out' WHEN draw_pos < n_all // 10 + n_all * 7 // 10 THEN 'train' END AS split FROM {S.keyed_place_sql("kept", "place", 42)}""")
def domain_split(spark, d):
    """Kept prompts by a keyed shuffle: the first tenth held out, the next seven tenths for training."""
    kept, n = S.placed(_domain_rows(spark, d).filter("reason = 'kept'").select("conv_id"), "conv_id", "pos")
    shuffled = kept.withColumn("draw_pos", S.keyed_place(F.col("pos"), n, 42))
    return shuffled.select("conv_id", "draw_pos", F.when(F.col("draw_pos") < n // 10, "held_out").when(F.col("draw_pos") < n // 10 + n * 7 // 10, "train").alias("split"))


SQL_SCIENCE = """sci AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n, [
      struct_pack(t := 'Essential Criteria: names ' || p_name, c := 'essential'),
      struct_pack(t := CASE WHEN p_size % 2 = 0 THEN 'Pitfall: ' || p_type ELSE 'says ' || p_brand END, c := CASE WHEN p_size % 2 = 0 THEN 'pitfall' WHEN p_size >= 5 THEN 'essential' WHEN p_size >= 3 THEN 'important' ELSE 'optional' END)] AS items FROM part),
    w AS (SELECT id, pos, n, list_transform(items, lambda x: CASE x.c WHEN 'essential' THEN 1 WHEN 'important' THEN 0.7 WHEN 'optional' THEN 0.3 ELSE -0.9 END) AS ws,
      array_to_string(list_transform(items, lambda x, i: i || '. [weight=' || CASE x.c WHEN 'essential' THEN '1' WHEN 'important' THEN '0.7' WHEN 'optional' THEN '0.3' ELSE '-0.9' END || '] ' || x.t), chr(10)) AS shown FROM sci)"""


@query(f""", {SQL_SCIENCE} SELECT a.id, a.shown AS rubric_correct, b.shown AS rubric_permuted, CAST(list_sum(list_transform(a.ws, lambda x: CASE WHEN x < 0 THEN 1 ELSE 0 END)) AS BIGINT) AS negative
    FROM w a JOIN w b ON b.pos = (a.pos + 1) % a.n""")
def science_split(spark, d):
    """Category weights from prefixes (or the source weight), the rendered checklist and the next row's, cyclically."""
    text = F.array(F.concat(F.lit("Essential Criteria: names "), "p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Pitfall: "), "p_type")).otherwise(F.concat(F.lit("says "), "p_brand")))
    weights = F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair])
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.transform(text, lambda t: F.struct(t.alias("criterion"), weights[X.category(t, F.col("p_size"))].alias("weight"))).alias("r"))
    rows = rows.select("id", X.numbered_items(F.col("r")).alias("rubric_correct"), F.size(F.filter("r", lambda c: c.weight < 0)).cast("long").alias("negative"))
    placed, n = S.placed(rows, "id", "pos")
    return S.cyclic_next(placed, "pos", n, "rubric_correct", "rubric_permuted").select("id", "rubric_correct", "rubric_permuted", "negative")


@query(f""", {SH.SQL_CLAUSES} SELECT doc_id, criterion, rest <> trim(t, ' ' || chr(9) || chr(10) || chr(13)) AND length(rest) >= 40 AS stripped,
    rest <> trim(t, ' ' || chr(9) || chr(10) || chr(13)) AND length(rest) < 40 AS kept_short FROM cleared JOIN left_over USING (doc_id, t)""")
def failure_clause_release(spark, d):
    """Criteria without their failure clauses; one that would be left too short stays as it was."""
    t, criterion = F.col("t"), F.col("criterion")
    rows = SH.clauses(spark, d).select("doc_id", "t", X.without_failure_clause(t).alias("criterion"), X.without_failure_clause(t, 0).alias("rest"))
    said = F.col("rest") != X.strip(t)
    return rows.select("doc_id", "criterion", (said & (F.length("rest") >= X.LEAST_LEFT)).alias("stripped"), (said & (F.length("rest") < X.LEAST_LEFT)).alias("kept_short"))


@query(f""", {SQL_PACKED}, k AS (SELECT id, len(groups) AS k FROM packed WHERE reason IS NULL), m AS (SELECT avg(k) AS mean FROM k),
    w AS (SELECT r.id, k.k IS NULL AS without_k, list_sum(list_transform(r, lambda c: abs(c.weight))) AS whole, coalesce(k.k, m.mean) AS k FROM rubric r LEFT JOIN k USING (id), m)
    SELECT id, without_k, round(whole / k, 6) AS added, round((whole / k) / (whole + whole / k), 6) AS share FROM w""")
def appropriateness_atomic(spark, d):
    """One criterion more, of the same share as in the packaged arm; questions without a package take the mean number of dimensions."""
    k = _packed(spark, d).filter("reason is null").select("id", F.size("dimensions").alias("k"))
    mean = k.agg(F.avg("k").alias("mean"))  # one row
    rows = V.rubric(spark, d).join(k, "id", "left").crossJoin(F.broadcast(mean)).withColumn("without_k", F.col("k").isNull())
    more = rows.select("id", "without_k", R.with_share(F.col("r"), "fits the question", F.coalesce(F.col("k").cast("double"), "mean")).alias("r"))
    own, whole = F.element_at("r", -1).weight, R.total(F.col("r"), lambda c: F.abs(c.weight))
    return more.select("id", "without_k", F.round(own, 6).alias("added"), F.round(own / whole, 6).alias("share"))


@query(f""", {SQL_PACKED} SELECT id, round(list_sum(list_transform(groups, lambda g: list_sum(list_transform(g, lambda i: abs(r[i].weight))))) / len(groups), 6) AS added, len(groups) + 1 AS n FROM packed WHERE reason IS NULL""")
def appropriateness_protocol(spark, d):
    """One criterion more, of the mean weight of the question's dimensions."""
    kept = _packed(spark, d).filter("reason is null").withColumn("r", F.transform("dimensions", lambda x: F.struct(x.criterion.alias("criterion"), x.weight.alias("weight"))))
    more = R.with_mean_weight(F.col("r"), "fits the question")
    return kept.select("id", F.round(F.element_at(more, -1).weight, 6).alias("added"), F.size(more).cast("long").alias("n"))


@query(f""", {SQL_PACKED}, x AS (SELECT id, r, unnest(groups) AS g, generate_subscripts(groups, 1) AS place FROM packed WHERE reason IS NULL),
    y AS (SELECT id, place, list_sum(list_transform(g, lambda i: abs(r[i].weight))) AS whole, r, unnest(g) AS atom FROM x)
    SELECT id, place AS dimension, atom, r[atom].criterion AS criterion, round(whole * abs(r[atom].weight) / whole * sign(r[atom].weight), 6) AS weight FROM y""")
def grouped_mean_release(spark, d):
    """Each dimension replaced by its own criteria, its weight dealt to them by their absolute weights."""
    kept = _packed(spark, d).filter("reason is null").select("id", "r", F.posexplode("dimensions").alias("at", "x"))
    return B.dealt_back(kept).select("id", (F.col("at") + 1).cast("long").alias("dimension"), F.col("atom").cast("long").alias("atom"), "criterion", F.round("weight", 6).alias("weight"))


@query("""SELECT id, n, label, CASE label WHEN 'CRITICAL' THEN 3 * weight WHEN 'NORMAL' THEN weight WHEN 'OVERCLINICAL' THEN -weight ELSE 0 END AS weight, label <> 'NORMAL' AS changed FROM (
    SELECT id, unnest(list_transform(r, lambda c, i: i)) AS n, unnest(list_transform(r, lambda c: c.weight)) AS weight,
      unnest(list_transform(r, lambda c, i: CASE WHEN id % 5 IN (3, 4) THEN 'NORMAL' ELSE ['CRITICAL', 'NORMAL', 'FORMAT', 'DUPLICATE', 'OVERCLINICAL'][1 + (id + i) % 5] END)) AS label FROM rubric)""")
def weighted_atomic_release(spark, d):
    """Weights times the multiplier of their label. Labels come as JSON in a reply; one that doesn't parse, or is too short, makes all NORMAL."""
    names = F.array(*map(F.lit, LABELS))
    labels = F.transform("r", lambda c, i: F.lower(F.element_at(names, ((F.col("id") + i + 1) % 5 + 1).cast("int"))))
    said = F.when(F.col("id") % 5 == 3, F.slice(labels, F.lit(2), F.size("r"))).otherwise(labels)
    reply = F.concat(F.lit("Here: "), F.to_json(F.struct(said.alias("labels"))), F.when(F.col("id") % 5 == 4, "}").otherwise(""))
    rows = V.rubric(spark, d).withColumn("labels", C.label_reply(reply, F.size("r"), list(LABELS)))
    own = F.coalesce("labels", F.transform("r", lambda c: F.lit("NORMAL")))
    done = rows.withColumn("own", own).withColumn("new", R.reweighted(F.col("r"), F.col("own"), LABELS, "NORMAL"))
    x = done.select("id", F.posexplode(F.arrays_zip("own", "new")).alias("n", "x"))
    return x.select("id", (F.col("n") + 1).cast("long").alias("n"), F.col("x.own").alias("label"), (F.col("x.new.weight") + 0.0).alias("weight"), (F.col("x.own") != "NORMAL").alias("changed"))


@query("SELECT ['CRITICAL', 'NORMAL', 'FORMAT', 'DUPLICATE', 'OVERCLINICAL'][1 + (id + k) % 5] AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM criteria GROUP BY 1")
def label_mix(spark, d):
    names = F.array(*map(F.lit, LABELS))
    n = V.criteria(spark, d).groupBy(F.element_at(names, ((F.col("id") + F.col("k")) % 5 + 1).cast("int")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


@query("""SELECT r.id, unnest(list_transform(r.r, lambda c, i: i)) AS n, unnest(list_transform(r.r, lambda c, i: CASE WHEN l.ok THEN 'P: ' || c.criterion || ' (new)' ELSE 'P: ' || c.criterion END)) AS criterion, NOT l.ok AS kept_original
    FROM rubric r JOIN (SELECT id, bool_or(met IS NOT NULL) AS ok FROM log GROUP BY id) l USING (id)""")
def atomic_rewrite_release(spark, d):
    """Rewritten criteria zipped onto the old ones: every id must have a rewrite, of the same length and with the same prefixes."""
    old = V.rubric(spark, d).select("id", F.transform("r", lambda c: F.concat(F.lit("P: "), c.criterion)).alias("old"))
    log = V.log(spark, d).groupBy("id").agg(F.max(F.col("met").isNotNull()).alias("ok"))
    new = old.join(log, "id").select("id", "ok", F.transform("old", lambda t: F.when(F.col("ok"), F.concat(t, F.lit(" (new)"))).otherwise(t)).alias("new"))
    rows = B.rewritten(old, new)
    return rows.select("id", F.posexplode("criteria").alias("n", "criterion"), (~F.col("ok")).alias("kept_original")).select("id", (F.col("n") + 1).cast("long").alias("n"), "criterion", "kept_original")


SQL_SCHEDULE = """s AS (SELECT r.id, len(r.r) AS n, unnest(range(1, 9)) AS member, 1 + r.id % 20 AS step FROM rubric r),
    t AS (SELECT id, n, member, step, 1 / (1 + exp(12.0 * (step / 20.0 - 0.5))) AS ls FROM s),
    u AS (SELECT *, ls * (8 - member) / 7.0 AS lam FROM t)"""


@query(f""", {SQL_SCHEDULE} SELECT id, CAST(member AS BIGINT) AS member, round(ls, 4) AS lambda_step, round(lam, 4) AS lam, CAST(round_even(lam * n, 0) AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM u""")
def scaffold_counts(spark, d):
    """One row per member of a group: the step's sigmoid strength, the member's and how many criteria it is shown."""
    rows = V.rubric(spark, d).select("id", F.size("r").cast("long").alias("n"), (1 + F.col("id") % 20).alias("step"))
    out = B.scaffold_members(rows, "step", 20, 8, 12.0, 0.5, "n")
    return out.select("id", F.col("member").cast("long").alias("member"), F.round("lambda_step", 4).alias("lambda_step"), F.round("lam", 4).alias("lam"), "k", "n")


@query(f""", {SQL_SCHEDULE}, k AS (SELECT n, round_even(lam * n, 0) AS k FROM u) SELECT count(*) AS rows_out, round(avg(CASE WHEN k > 0 THEN 1 ELSE 0 END), 6) AS scaffolded_share, round(avg(k / greatest(n, 1)), 6) AS mean_fraction FROM k""")
def schedule_stats(spark, d):
    k = scaffold_counts(spark, d)
    return k.agg(F.count(F.lit(1)).alias("rows_out"), F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("scaffolded_share"), F.round(F.avg(F.col("k") / F.greatest("n", F.lit(1))), 6).alias("mean_fraction"))


@query()
def seeded_subset(spark, d):
    """Which criteria a member is shown: the standard library's sample under a seed of the row's own, sorted."""
    rows = V.rubric(spark, d).select("id", F.size("r").cast("long").alias("n"), (1 + F.col("id") % 20).alias("step"))
    out = B.scaffold_members(rows, "step", 20, 8, 12.0, 0.5, "n")
    seed = F.concat_ws(":", F.lit("42"), F.col("id").cast("string"), F.col("step").cast("string"), F.col("member").cast("string"))
    return out.select("id", F.col("member").cast("long").alias("member"), B.seeded_subset(seed, F.col("n"), F.col("k")).alias("shown"))


@query(f""", {SQL_SCHEDULE}, asked AS (SELECT u.id, u.step, u.member, ls, lam, n, CAST(round_even(lam * n, 0) AS BIGINT) AS k, r.r, c.m FROM u JOIN rubric r ON r.id = u.id JOIN chat c ON c.conv_id = u.id),
    places AS (SELECT id, member, k, i, row_number() OVER (PARTITION BY id, member ORDER BY sha1('42:' || id || ':' || step || ':' || member || ':' || i)) AS place, r[i].criterion AS criterion FROM asked, unnest(range(1, n + 1)) AS t(i)),
    shown AS (SELECT id, member, string_agg('- ' || criterion, chr(10) ORDER BY i) AS said FROM places WHERE place <= k GROUP BY id, member),
    last_user AS (SELECT conv_id AS id, max(i) AS last FROM (SELECT conv_id, unnest(range(1, len(m) + 1)) AS i, m FROM chat) WHERE lower(m[i].role) = 'user' GROUP BY conv_id)
    SELECT 'scaffold:' || step || ':' || a.id || ':' || a.member AS uid, sha256(array_to_string(list_transform(m, lambda x, i: x.role || ': ' || CASE WHEN k > 0 AND i = last THEN regexp_replace(x.text, '\\s+$', '') || chr(10) || chr(10) || 'Keep in mind:' || chr(10) || said ELSE x.text END), chr(10) || chr(10))) AS prompt,
      round(ls, 4) AS lambda_step, round(lam, 4) AS lambda, k, CAST(n AS BIGINT) AS n_criteria FROM asked a LEFT JOIN shown s ON s.id = a.id AND s.member = a.member LEFT JOIN last_user l ON l.id = a.id""")
def scaffold_records(spark, d):
    """The records of a scaffolded run: each member's prompt with the criteria that it is shown behind the last user turn."""
    rows = V.rubric(spark, d).join(V.messages(spark, d), F.col("id") == F.col("conv_id")).select("id", "r", "m", F.size("r").cast("long").alias("n"), (1 + F.col("id") % 20).alias("step"))
    out = B.scaffold_records(B.scaffold_members(rows, "step", 20, 8, 12.0, 0.5, "n"), "id", "step", "m", "r", "Keep in mind:\n", 42)
    return out.withColumn("prompt", F.sha2(X.conversation(F.col("prompt")), 256))


class Generator:
    """A generator by rules of the prompt: two dimensions of the odd and the even places, in a fence; every fourth question's lose one place, every sixth's first reply is prose."""

    def __call__(self, prompt: str, temperature: float) -> str:
        key, n = map(int, prompt.rpartition("#")[2].split("/"))
        if key % 6 == 5 and temperature == 0:
            return "Here are the dimensions: lead and rest."
        even = list(range(2, n + 1, 2))
        groups = {"lead": list(range(1, n + 1, 2)), "rest": even[:-1] if key % 4 == 1 else even}
        return "```json\n" + json.dumps({"criteria": [{"name": k, "description": f"covers {k}", "atomic_indices": v} for k, v in groups.items()]}) + "\n```"


def _read_dimensions(reply: str) -> str | None:
    """The reply's JSON, if it is an object with criteria."""
    try:
        said = json.loads(reply.strip().removeprefix("```json").removesuffix("```"))
    except ValueError:
        return None
    return json.dumps(said) if isinstance(said, dict) and isinstance(said.get("criteria"), list) else None


@query(""", g AS (SELECT id, r, CAST(len(r) AS INTEGER) AS n, list_filter(range(1, len(r) + 1), lambda i: i % 2 = 1) AS odd, list_filter(range(1, len(r) + 1), lambda i: i % 2 = 0) AS even FROM rubric),
    h AS (SELECT *, id % 4 = 1 AND len(even) > 0 AS gap FROM g), d AS (SELECT id, r, n, gap, CASE WHEN gap THEN list_sort(list_append(odd, even[-1])) ELSE odd END AS a, CASE WHEN gap THEN even[1:len(even) - 1] ELSE even END AS b FROM h),
    w AS (SELECT *, list_sum(list_transform(a, lambda i: abs(r[i].weight))) AS wa, list_sum(list_transform(b, lambda i: abs(r[i].weight))) AS wb FROM d)
    SELECT id, NOT gap AS valid, CASE WHEN id % 6 = 5 THEN 2 ELSE 1 END AS tries, 'lead=' || CAST(CAST(wa AS BIGINT) AS VARCHAR) || '@' || array_to_string(a, ',') || CASE WHEN len(b) > 0 THEN ';rest=' || CAST(CAST(wb AS BIGINT) AS VARCHAR) || '@' || array_to_string(b, ',') ELSE '' END AS dims FROM w""")
def generated_dimensions(spark, d):
    """A generator's dimensions for every checklist: parsed, held against exactly-once coverage, repaired and weighed by their criteria."""
    rubrics = V.rubric(spark, d).select("id", "r", F.size("r").alias("n"))
    tasks = rubrics.select("id", F.concat(F.lit("Group the criteria of #"), F.col("id").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("prompt"))
    said = J.judged(tasks, Generator(), _read_dimensions, "prompt", "reply", "string", J.Calls(pause=0.0)).filter("reply is not null").select(F.col("id").alias("_id"), "reply", "tries")
    made = F.from_json("reply", "criteria array<struct<name:string,description:string,atomic_indices:array<int>>>").criteria
    rows = rubrics.join(said, F.col("id") == F.col("_id")).withColumn("made", made)
    whole = F.array_sort(F.flatten(F.transform("made", lambda c: c["atomic_indices"]))) == F.sequence(F.lit(1), F.col("n"))
    shown = F.transform(J.repaired(F.col("made"), F.transform("r", lambda c: c["weight"]), F.col("n")), lambda c: F.concat(c["name"], F.lit("="), X.number(c["weight"]), F.lit("@"), F.array_join(F.transform(F.array_sort(c["atomic_indices"]), lambda i: i.cast("string")), ",")))
    return rows.select("id", whole.alias("valid"), "tries", F.array_join(shown, ";").alias("dims"))


SQL_SFT = r"""sft AS (SELECT conv_id, trim(m[1].text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS q, trim(coalesce(m[2].text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS a FROM chat),
    fit AS (SELECT *, CASE WHEN q = '' OR a = '' THEN 'empty' WHEN ceil(length(q) / 4) + ceil(length(a) / 4) > 120 THEN 'long' ELSE 'kept' END AS reason, CAST(ceil(length(q) / 4) + ceil(length(a) / 4) AS BIGINT) AS tokens FROM sft)"""


@query(f", {SQL_SFT} SELECT conv_id, reason, tokens FROM fit")
def sft_corpus(spark, d):
    """Question and answer pairs; empty ones and those over the token budget are dropped whole, never cut."""
    rows = V.messages(spark, d).select("conv_id", X.strip(F.get("m", 0).text).alias("q"), X.strip(F.coalesce(F.get("m", 1).text, F.lit(""))).alias("a"))
    tokens = X.token_estimate(F.col("q")) + X.token_estimate(F.col("a"))
    return rows.select("conv_id", F.when((F.col("q") == "") | (F.col("a") == ""), "empty").when(tokens > 120, "long").otherwise("kept").alias("reason"), tokens.alias("tokens"))


@query(f", {SQL_SFT}, l AS (SELECT list_sort(list(tokens)) AS t, count(*) AS n FROM fit WHERE reason = 'kept') SELECT n AS kept, t[n // 2 + 1] AS median, t[CAST(floor(0.9 * n) AS BIGINT) + 1] AS p90, t[n] AS longest FROM l")
def sft_lengths(spark, d):
    """Places in the order of lengths, from their histogram: no task sorts all rows."""
    kept = sft_corpus(spark, d).filter("reason = 'kept'").select("tokens")
    at = lambda f, name: B.histogram_place(kept, [], "tokens", f).select(F.col("tokens").alias(name), "n")
    rows = at(lambda n: F.floor(n / 2), "median").select("median", F.col("n").alias("kept"))
    return rows.crossJoin(F.broadcast(at(lambda n: F.floor(n * 0.9), "p90").drop("n"))).crossJoin(F.broadcast(kept.agg(F.max("tokens").alias("longest")))).select("kept", "median", "p90", "longest")  # one row each


@query(f""", {SQL_PACKED} SELECT id, len(r) AS atoms, array_to_string(list_transform(groups, lambda g, i: 'group ' || i || '=' || CAST(CAST(list_sum(list_transform(g, lambda j: abs(r[j].weight))) AS BIGINT) AS VARCHAR) || '@' || g[1]), ';') AS dims, repaired FROM packed WHERE reason IS NULL""")
def export_protocol(spark, d):
    """The public form of a release: names, weights and groups zipped, their lengths asserted to agree."""
    kept = _packed(spark, d).filter("reason is null")
    whole = F.assert_true(F.size("dimensions") == F.size("groups"), "dimensions and groups differ in number")
    zipped = F.transform(F.arrays_zip("dimensions", "groups"), lambda x: F.concat(x.dimensions["name"], F.lit("="), X.number(x.dimensions.weight), F.lit("@"), F.get(x.groups, 0).cast("string")))
    return kept.withColumn("checked", whole).filter("checked is null").select("id", F.size("r").cast("long").alias("atoms"), F.array_join(zipped, ";").alias("dims"), "repaired")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Problem: ' || p_name || chr(10) || 'Guide: ' || p_type END AS context FROM part""")
def teacher_context(spark, d):
    """A teacher's message: an exact copy, or a template that must hold both of its places."""
    mode = F.when(F.col("p_size") % 3 == 0, "copy").otherwise("template")
    return V.table(spark, d, "part").select("p_partkey", C.teacher_message(mode, F.col("p_name"), F.col("p_type"), "Problem: <<problem>>\nGuide: <<solution>>").alias("context"))


@query("""SELECT conv_id || '/' || mod AS id, replace('Write: <SEED> ' || text, '<SEED>', ['sea', 'sky', 'sun'][mod]) AS prompt, 2 AS n_criteria, mod AS seed_no FROM
    (SELECT conv_id, text, unnest([1, 2, 3]) AS mod FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id))""")
def benchmark_inputs(spark, d):
    """One row per prompt and each of its first three seed modifiers, with a checklist of unit weights."""
    rows = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return C.seeded_prompts(rows, "conv_id", F.concat(F.lit("Write: <SEED> "), "text"), F.array(*map(F.lit, ["sea", "sky", "sun", "rain"]))).select("id", "prompt", F.size(C.unit_rubric(["clear", "lower is better: dull"])).alias("n_criteria"), "seed_no")


@query("""SELECT o_orderkey AS id, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 7 / count(*) OVER ()) AS BIGINT) AS shard FROM orders""")
def contiguous_shards(spark, d):
    """Seven ranges of places of equal length, as shards of a generation run."""
    placed, n = S.placed(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "pos")
    return placed.select("id", F.floor(F.col("pos") * 7 / n).alias("shard"))


@query("""SELECT count(*) AS n, count(DISTINCT id) AS ids, count(*) = count(DISTINCT id) AND count(*) = (SELECT count(*) FROM orders) AS equal FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1)""")
def shard_coverage(spark, d):
    """Shards put together again: their union must be the whole set, each id once."""
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return B.set_equality(orders.filter("id % 2 = 0").unionByName(orders.filter("id % 2 = 1")), orders, "id")


@query("""SELECT round(avg(n), 6) AS mean, min(n) AS fewest, max(n) AS most, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS in_range, round(avg(CASE WHEN covered THEN 1 ELSE 0 END), 6) AS coverage FROM
    (SELECT len(r) AS n, len(r) % 3 <> 0 AS covered FROM rubric)""")
def fidelity_summary(spark, d):
    n = F.size("r").cast("long")
    return V.rubric(spark, d).agg(F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("fewest"), F.max(n).alias("most"), F.count_if(n.between(2, 5)).alias("in_range"), F.round(F.avg((n % 3 != 0).cast("double")), 6).alias("coverage"))


@query("SELECT n, count(*) AS rows FROM (SELECT len(r) AS n FROM rubric) GROUP BY n")
def criteria_histogram(spark, d):
    return V.rubric(spark, d).groupBy(F.size("r").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY k) AS place FROM criteria")
def enumerated_items(spark, d):
    """1-based places of a checklist's criteria, without a window."""
    rows = V.criteria(spark, d).groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("ks")).select("id", F.posexplode("ks").alias("p", "k"))
    return rows.select("id", "k", (F.col("p") + 1).cast("long").alias("place"))

