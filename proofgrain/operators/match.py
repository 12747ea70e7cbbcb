"""Matching labels to fields: exact, alias, containment and fuzzy joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.functions import rules
from proofgrain.functions import text as tx
from proofgrain.session import cut_lineage, rule_table


GRAM = 3


def _grams(text: Column, upto: int = GRAM) -> Column:
    """Distinct substrings of 1 to ``upto`` characters."""
    size = F.length(text)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(upto)),
        lambda g: F.when(size >= g, F.transform(F.sequence(F.lit(1), size - g + 1), lambda i: F.substr(text, i, g)))
        .otherwise(F.array().cast("array<string>")),
    )))


def containment_pairs(needles: DataFrame, hays: DataFrame, on: Sequence[str], needle: str, hay: str, gram: int = GRAM) -> DataFrame:
    """Pairs where ``needle`` is a substring of ``hay``, without a nested loop.

    The first characters of the needle must occur in the hay, so both sides are joined on
    that gram (and ``on``) and the rest is checked on the joined rows.
    """
    n = needles.where(F.col(needle) != "").withColumn("_gram", F.substring(needle, 1, gram))
    h = hays.where(F.col(hay) != "").withColumn("_gram", F.explode(_grams(F.col(hay), gram)))
    return n.join(h, [*on, "_gram"]).where(F.contains(F.col(hay), F.col(needle))).drop("_gram")


@dataclass(frozen=True)
class ContextRule:
    """Fields whose generic labels count only next to the field's own words.

    The defaults are fixed values."""

    prefixes: tuple[str, ...] = ("pitp.", "pitp_")
    generic_labels: tuple[str, ...] = (
        "procedurename", "procedureid", "documentname", "0procedurename", "0procedureid", "0documentname")
    generic_keys: tuple[str, ...] = ("procedurename", "procedureid", "documentname", "pitpdocumentname")
    exempt_chunk: str = "section.procedures"
    exempt_label: str = "0"
    generic_words: tuple[str, ...] = ("id", "name", "type", "date", "number", "code")
    dropped_tokens: tuple[str, ...] = ("tco", "lco")


def field_keys(fields: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(form_id, field_id, key): every spelling under which a field is known.

    ``extra`` adds (form_id, field_id, key) rows: structured keys and approved aliases.
    """
    live = fields.where("not never_write")
    spellings = F.array("field_id", F.lower("label"), F.replace("field_id", F.lit("."), F.lit("_")), F.replace("field_id", F.lit("."), F.lit(" ")))
    own = live.select("form_id", "field_id", F.explode(spellings).alias("key"))
    if extra is not None:
        own = own.unionByName(extra.join(live.select("form_id", "field_id"), ["form_id", "field_id"], "left_semi").select("form_id", "field_id", "key"))
    return own.where("key <> ''").distinct()


def _context(field: Column, text: Column, rule: ContextRule) -> Column:
    words = F.filter(F.split(field, "[._]"), lambda w: (w != "") & ~w.isin(*rule.generic_words))
    return F.exists(words, lambda w: F.contains(text, w))


def match_labels(labels: DataFrame, keys: DataFrame, rule: ContextRule = ContextRule()) -> DataFrame:
    """Best key of each (form_id, label, field_id), apart for keys that need context.

    Works on distinct labels, which are few however many pairs there are.
    """
    # One equi-join finds every pair that can match: equal spellings without a dropped token,
    # or the head of one side among the grams of the other.  The joined rows decide.
    def entry(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    def when(cond: Column, values: Column) -> Column:
        return F.when(cond, values).otherwise(F.array().cast("array<string>"))

    def short(col: Column) -> list[Column]:
        out = []
        for token in rule.dropped_tokens:
            cut = F.replace(col, F.lit(token), F.lit(""))
            out.append(entry(token, when(F.length(cut) > 4, F.array(cut))))
        return out

    def head(col: Column) -> Column:
        return F.array(F.substring(col, 1, GRAM))

    l_norm, k_norm, raw, k_low = F.col("l_norm"), F.col("k_norm"), F.col("label"), F.col("k_low")
    lab = labels.select("form_id", "label").distinct().withColumn("l_norm", tx.compact_key(raw)).withColumn("e", F.explode(F.concat(
        entry("in", _grams(l_norm)), entry("around", when(l_norm != "", head(l_norm))),
        entry("raw_in", _grams(raw)), entry("raw_around", when(l_norm == "", head(raw))), *short(l_norm))))
    key = keys.select("form_id", "field_id", "key", F.lower("key").alias("k_low"), tx.compact_key(F.col("key")).alias("k_norm")).withColumn("e", F.explode(F.concat(
        entry("in", when(k_norm != "", head(k_norm))), entry("around", _grams(k_norm)),
        entry("raw_in", when(k_norm == "", head(k_low))), entry("raw_around", _grams(k_low)), *short(k_norm))))
    same = (raw == k_low) | ((l_norm != "") & (l_norm == k_norm)) | F.col("e.kind").isin(*rule.dropped_tokens)
    inside = (l_norm != "") & (k_norm != "") & (F.contains(l_norm, k_norm) | F.contains(k_norm, l_norm))
    strength = F.when(same, 1.0).when(inside, 0.72).when(F.contains(raw, k_low) | F.contains(k_low, raw), 0.7)
    found = lab.join(key, ["form_id", "e"]).withColumn("strength", strength).where("strength is not null")
    special = F.col("field_id").rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in rule.prefixes) + ")")
    needs = special & (l_norm.isin(*rule.generic_labels) | k_norm.isin(*rule.generic_keys))
    hit, order = F.struct("strength", "key"), F.struct(-F.col("strength"), "key")
    return (
        found.withColumn("needs", needs).withColumn("special", special)
        .groupBy("form_id", "label", "l_norm", "field_id", "special").agg(
            F.min_by(hit, F.when(~F.col("needs"), order)).alias("plain"),
            F.min_by(hit, F.when(F.col("needs"), order)).alias("contextual"))
        .withColumn("dot_bad", F.col("label").contains(".") & (F.col("l_norm") != "") & ~_context(F.col("field_id"), F.col("l_norm"), rule))
    )


def match_fields(fields: DataFrame, pairs: DataFrame, extra_keys: DataFrame | None = None, rule: ContextRule = ContextRule()) -> DataFrame:
    """Candidates: every pair that speaks for a field, with the strength of the match.

    1.0 exact or normalised equal, .72 normalised containment, .70 raw containment; .45 at
    most for a wrong context, a swallowed label or a non-date in a date field; +.08 for
    JSON evidence.
    """
    # distinct labels are few, pairs are many: written, the matches show their size, so that the
    # pairs need not be dealt by form and label, of which there are fewer than tasks
    best = cut_lineage(match_labels(pairs, field_keys(fields, extra_keys), rule))
    names = fields.select("form_id", "field_id", F.lower("label").alias("_own"))
    c = pairs.join(best, ["form_id", "label"]).join(names, ["form_id", "field_id"])
    exempt = F.col("special") & F.col("chunk_id").contains(rule.exempt_chunk) & F.col("l_norm").startswith(rule.exempt_label)
    near = _context(F.col("field_id"), F.concat("l_norm", tx.compact_key(F.col("chunk_id"))), rule) | exempt
    dotted = F.col("dot_bad") & ~exempt

    def capped(s: Column, cond: Column) -> Column:
        return F.when(cond, F.least(s, F.lit(0.45))).otherwise(s)

    s0 = capped(F.col("plain.strength"), dotted)
    s1 = capped(F.col("contextual.strength"), dotted | ~near)
    second = s0.isNull() | (s1 > s0)
    strength = F.when(second, s1).otherwise(s0)
    key = F.when(second, F.col("contextual.key")).otherwise(F.col("plain.key"))
    strength = F.when(F.col("source_type") == "json", F.least(F.lit(1.0), strength + F.lit(0.08))).otherwise(strength)
    not_date = F.col("field_id").rlike(rules.DATE_FIELDS) & ~F.col("value").rlike(rules.DATE_VALUE)
    strength = capped(strength, tx.overcaptured(F.col("value")) | not_date)
    return c.select(
        *pairs.columns, "field_id", strength.alias("strength"),
        F.when((key != F.col("field_id")) & (key != F.col("_own")), key).alias("alias_used"))


# ------------------------------------------------------------------ aliases
ALIAS_SCHEMA = "from_key string, field_id string, direction string, forms array<string>, risk string, authority string"


def resolve_aliases(pairs: DataFrame, alias_rules: Sequence[tuple]) -> DataFrame:
    """Pairs whose label is an alias that holds for their form.

    Only a write_bridge alias gives authority to write."""
    rows = rule_table(pairs.sparkSession, alias_rules, ALIAS_SCHEMA)
    keyed = pairs.withColumn("alias_key", F.regexp_replace(F.lower("label"), r"[^a-z0-9]+", "_"))
    hits = keyed.join(rows, F.col("alias_key") == F.col("from_key"))
    return hits.where((F.size("forms") == 0) | F.array_contains("forms", F.col("form_id"))).withColumn(
        "authorises_write", F.col("direction") == "write_bridge").drop("forms", "alias_key")


def grade_aliases(proposals: DataFrame, auto_max: int = 2) -> DataFrame:
    """Adds ``auto_usable`` (a tier of ``auto_max`` or better) and ``route`` to alias proposals
    with label, from_text and tier: 'use', or 'review' for a person.  A proposal without a text
    of its own stands for its label; one without a tier is never used."""
    usable = F.coalesce(F.col("tier") <= auto_max, F.lit(False))
    text = F.when(F.coalesce("from_text", F.lit("")) != "", F.col("from_text")).otherwise(F.col("label"))
    return proposals.withColumn("from_text", text).withColumn("auto_usable", usable).withColumn(
        "route", F.when(usable, "use").otherwise("review"))


def alias_keys(forms: DataFrame, alias_rules: Sequence[tuple]) -> DataFrame:
    """(form_id, field_id, key) of the aliases each form may read."""
    rows = F.array(*[
        F.when(F.lit(not only) | F.col("form_id").isin(*only), F.struct(F.lit(target).alias("field_id"), F.lit(source).alias("key")))
        for source, target, _direction, only, _risk, _authority in alias_rules
    ])
    return forms.select("form_id").distinct().select("form_id", F.inline(F.array_compact(rows)))


def expand_aliases(cands: DataFrame, alias_rules: Sequence[tuple[str, str]], group: Sequence[str] = ("packet_id", "form_id")) -> DataFrame:
    """A missing target field copies the candidate of its source field, in rule order.

    ``cands`` has one row per (group, field_id); ``origin`` names the copied field.  The few
    fields the rules name are laid side by side once per group, so rules that build on each
    other need no further join.
    """
    group = list(group)
    columns = [c for c in cands.columns if c not in (*group, "field_id")]
    named = list(dict.fromkeys(f for rule in alias_rules for f in rule))
    slot = {f: f"f{i}" for i, f in enumerate(named)}
    wide = cands.where(F.col("field_id").isin(*named)).groupBy(*group).agg(*[
        F.max(F.when(F.col("field_id") == f, F.struct(*columns))).alias(slot[f]) for f in named])
    now = {f: (F.col(slot[f]), F.lit(None).cast("string")) for f in named}
    for source, target in alias_rules:
        (value, origin), (offer, _) = now[target], now[source]
        now[target] = (F.coalesce(value, offer), F.when(value.isNotNull(), origin).when(offer.isNotNull(), F.lit(source)))
    targets = list(dict.fromkeys(t for _, t in alias_rules))
    copies = F.array_compact(F.array(*[
        F.when(F.col(slot[t]).isNull() & now[t][0].isNotNull(), F.struct(
            F.lit(t).alias("field_id"), now[t][0].alias("copy"), now[t][1].alias("origin"))) for t in targets]))
    made = wide.select(*group, F.inline(copies)).select(*group, "field_id", "copy.*", "origin")
    return cands.withColumn("origin", F.lit(None).cast("string")).unionByName(made)


def combine_identity(cands: DataFrame, mark: str, number: str, targets: Sequence[str], group: Sequence[str] = ("packet_id", "form_id")) -> DataFrame:
    """The cleaned number (else mark) code overrides the identity fields of its packet."""
    group = list(group)
    code = tx.identity_code(F.col("value"))
    ids = cands.where(F.col("field_id").isin(mark, number)).groupBy(*group).agg(
        F.max(F.when(F.col("field_id") == number, F.nullif(code, F.lit("")))).alias("_n"),
        F.max(F.when(F.col("field_id") == mark, F.nullif(code, F.lit("")))).alias("_m"),
    ).select(*group, F.coalesce("_n", "_m").alias("_id"))
    hit = F.col("field_id").isin(*targets) & F.col("_id").isNotNull()
    return cands.join(ids, group, "left").withColumn("value", F.when(hit, F.col("_id")).otherwise(F.col("value"))).withColumn(
        "confidence", F.when(hit, F.greatest("confidence", F.lit(0.95))).otherwise(F.col("confidence"))).drop("_id")


# ------------------------------------------------------------------ fuzzy labels
#: What holding all of the other side's tokens, or one of the guarded pairs, adds to a score.
BONUS = 0.25
#: Labels grow with their groups.  Where they come from a short column of a table, its file is
#: small and Spark would send all of them through the driver to every task.
GROWS = "merge"


def _rare_first(rows: DataFrame, tokens: Column, ranks: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows with their distinct tokens, rarest first in their group."""
    each = rows.select(*by, F.explode(F.array_distinct(tokens)).alias("token")).hint(GROWS).join(ranks, [*group, "token"])
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("r")).select(*by, F.col("r.token").alias("tokens"))


def overlapping(labels: DataFrame, keys: DataFrame, group: Sequence[str], floor: float) -> DataFrame:
    """(group, label_id, l_key, key, lt, kt, n): every label beside the keys that could suit it
    best, with their distinct tokens and how many they share.

    Labels of three and more tokens need two shared ones.  So both sides leave out their
    commonest token (in one order of all tokens of a group, the rarest first): two sets that
    share two tokens share one of the others, and a token that all labels and keys hold never
    joins.  For shorter labels, keys of one size, the same shared tokens and the same guarded
    words score alike, so the first of them by name stands for all.
    """
    group = list(group)
    ranks = labels.select(*group, F.explode(F.array_distinct(F.split("l_key", " "))).alias("token")).unionByName(
        keys.select(*group, F.explode(F.array_distinct(F.split("key", " "))).alias("token"))).groupBy(*group, "token").agg(F.count("*").alias("n"))
    # each is read three times
    lab = cut_lineage(_rare_first(labels, F.split("l_key", " "), ranks, [*group, "label_id", "l_key"], group).withColumnRenamed("tokens", "lt"))
    held = cut_lineage(_rare_first(keys, F.split("key", " "), ranks, [*group, "key"], group).withColumnRenamed("tokens", "kt"))

    def without_last(name: str) -> Column:
        return F.slice(name, F.lit(1), F.size(name) - 1)

    long = lab.where(F.size("lt") > 2).withColumn("token", F.explode(without_last("lt"))).hint(GROWS).join(
        held.where(F.size("kt") > 1).withColumn("token", F.explode(without_last("kt"))), [*group, "token"])
    columns = [*group, "label_id", "l_key", "key", "lt", "kt"]
    long = long.select(*columns).distinct()

    # what the guards and the bonuses ask of a key
    asked = ("date", "permission", "drawing", "number", "thickness", "pitp")
    looks = [F.array_contains("kt", w) for w in asked] + [
        F.arrays_overlap("kt", F.array(*[F.lit(w) for w in ws])) for ws in (rules.NUMERIC_LABEL_TOKENS, rules.SENSITIVE_LABEL_TOKENS)]
    alike = held.withColumn("size", F.size("kt")).withColumn("looks", F.array(*looks))
    sorted_kt = F.array_sort("kt")
    # one shared token and one bonus reach the floor up to this size
    longest = 1 / (floor - BONUS) if floor > BONUS else float("inf")
    one = alike.where(F.col("size") <= F.lit(longest)).select(*group, F.explode("kt").alias("t"), "size", "looks", "key", "kt").groupBy(*group, "t", "size", "looks").agg(
        F.min_by(F.struct("key", "kt"), "key").alias("m"))
    short = lab.where(F.size("lt") <= 2)
    by_one = short.withColumn("t", F.explode("lt")).hint(GROWS).join(one, [*group, "t"]).select(*group, "label_id", "l_key", F.col("m.key").alias("key"), "lt", F.col("m.kt").alias("kt"))
    # keys that hold both tokens of a label of two
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.concat_ws(" ", x, y))))
    two = alike.withColumn("s", sorted_kt).select(*group, F.explode(pairs).alias("t"), "size", "looks", "key", "kt")
    wanted = short.where(F.size("lt") == 2).withColumn("t", F.array_join(F.array_sort("lt"), " "))
    two = two.join(wanted.select(*group, "t").distinct().hint(GROWS), [*group, "t"], "left_semi").groupBy(*group, "t", "size", "looks").agg(F.min_by(F.struct("key", "kt"), "key").alias("m"))
    by_two = wanted.hint(GROWS).join(two, [*group, "t"]).select(*group, "label_id", "l_key", F.col("m.key").alias("key"), "lt", F.col("m.kt").alias("kt"))
    found = long.unionByName(by_one.unionByName(by_two).distinct())
    return found.withColumn("n", F.size(F.array_intersect("lt", "kt")).cast("bigint"))


def fuzzy_labels(labels: DataFrame, evidence: DataFrame, preferred_keys: Sequence[tuple[Sequence[str], Sequence[str]]],
                 group: Sequence[str] = ("packet_id",), floor: float = 0.38) -> DataFrame:
    """The evidence value that suits each label best.

    ``labels``: (group, label_id, label); ``evidence``: (group, key, value, ord) with keys as
    made by label_pairs; ``preferred_keys``: (tokens that a label must hold, keys to try in
    order), which depend on the forms in use.  First the label's own key, then its preferred keys, then the one
    key with the highest token overlap; at each step the value must suit the label.
    """
    group = list(group)
    # what several joins read is made once
    evidence = cut_lineage(evidence.select(*group, "key", "value", "ord"))
    lab = cut_lineage(labels.withColumn("l_key", tx.label_key(F.col("label"))).where("l_key <> ''"))
    distinct_keys = cut_lineage(evidence.select(*group, "key").distinct())
    direct = lab.hint(GROWS).join(distinct_keys, (lab["l_key"] == distinct_keys["key"]) & _same(lab, distinct_keys, group)).select(
        *[lab[g] for g in group], "label_id", "l_key", "key", F.lit(0).alias("stage"))

    words = F.split("l_key", " ")
    wanted, n = [], 1
    for required, names in preferred_keys:
        has = F.array_contains(words, required[0])
        for r in required[1:]:
            has = has & F.array_contains(words, r)
        for name in names:
            wanted.append(F.when(has, F.struct(F.lit(n).alias("stage"), F.lit(name).alias("key"))))
            n += 1
    preferred = lab.select(*group, "label_id", "l_key", F.inline(F.array_compact(F.array(*wanted).cast("array<struct<stage:int,key:string>>")))).hint(GROWS).join(
        distinct_keys, [*group, "key"]).select(*group, "label_id", "l_key", "key", "stage")

    overlap = overlapping(lab.select(*group, "label_id", "l_key"), distinct_keys, group, floor)

    def both(*names: str) -> Column:
        cond = F.lit(True)
        for name in names:
            cond = cond & F.array_contains("lt", name) & F.array_contains("kt", name)
        return cond

    def lit_words(ws: Sequence[str]) -> Column:
        return F.array(*[F.lit(w) for w in ws])

    sizes = F.greatest(F.size("lt"), F.size("kt"))
    subset = (F.col("n") == F.size("lt")) | (F.col("n") == F.size("kt"))
    numeric, sensitive = lit_words(rules.NUMERIC_LABEL_TOKENS), F.array_intersect("lt", lit_words(rules.SENSITIVE_LABEL_TOKENS))
    bonus = F.lit(0.0)
    for cond in (subset, both("date", "permission"), both("drawing", "number"),
                 F.array_contains("lt", "material") & F.array_contains("lt", "thickness") & F.array_contains("kt", "thickness")):
        bonus = bonus + F.when(cond, BONUS).otherwise(0.0)
    pitp_clash = (F.array_contains("lt", "date") & F.array_contains("lt", "approved")
                  & ~F.array_contains("lt", "pitp") & F.array_contains("kt", "pitp"))
    guarded = (
        overlap.where(~F.array_contains("lt", "date") | F.array_contains("kt", "date"))
        .where(~F.arrays_overlap("lt", numeric) | F.arrays_overlap("kt", numeric))
        .where(~pitp_clash)
        .where((F.size(sensitive) == 0) | F.arrays_overlap("kt", sensitive))
        .where((F.size("lt") < 3) | (F.col("n") >= 2))
        .withColumn("score", F.col("n") / sizes + bonus)
    )
    fuzzy = guarded.groupBy(*group, "label_id", "l_key").agg(F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), "key")).alias("m")).where(
        F.col("m.score") >= floor).select(*group, "label_id", "l_key", F.col("m.key").alias("key"), F.lit(n).alias("stage"))

    tries = direct.unionByName(preferred).unionByName(fuzzy)
    values = tries.hint(GROWS).join(evidence, [*group, "key"]).where(
        tx.label_accepts(F.col("l_key"), F.col("value")))
    dated = F.array_contains(F.split("l_key", " "), "date")
    order = F.struct("stage", F.when(dated, F.length("value")).otherwise(0), "ord", "value")
    best = values.groupBy(*group, "label_id").agg(F.min_by(F.struct("value", "key", "stage"), order).alias("m"))
    step = F.when(F.col("m.stage") == 0, "direct").when(F.col("m.stage") == n, "fuzzy").otherwise("preferred")
    return best.select(*group, "label_id", F.col("m.value").alias("value"), F.col("m.key").alias("matched_key"), step.alias("step"))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & (a[name] == b[name])
    return cond


# ------------------------------------------------------------------ schema paths
def field_type(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.rlike(r"\bdate\b"), "date").when(low.rlike(r"\b(?:number|no\.|#|qty|count|amps|volts)\b"), "number")
        .when(low.rlike(r"\b(?:yes|no|applicable|n/a)\b"), "boolean").otherwise("narrative")
    )


def infer_paths(labels: DataFrame, paths: DataFrame, rule_rows: Sequence[tuple[str, str]]) -> DataFrame:
    """(form_id, label, path, confidence, field_type): map labels to schema paths.

    Ordered rules first: .75 when the path, or one with the same last step, is in the
    schema, else .55; then the first path that contains a label word longer than three
    characters: .45.
    """
    lab = labels.select("form_id", "label").distinct()
    ruled = F.lit(None).cast("string")
    for pattern, path in reversed(list(rule_rows)):
        ruled = F.when(F.lower("label").rlike(pattern), F.lit(path)).otherwise(ruled)
    by_rule = lab.withColumn("path", ruled)
    last = F.element_at(F.split("path", r"\."), -1)
    known = paths.select("form_id", F.col("path").alias("p")).distinct()
    # 'a path that ends with the last step': compare the tails of that length
    steps = by_rule.where("path is not null").select("form_id", "path").distinct().withColumn("step", last)
    have = steps.join(known, "form_id").where(F.expr("p = path or endswith(p, step)")).select("form_id", "path").distinct().withColumn("known", F.lit(True))
    words = lab.join(by_rule.where("path is null").select("form_id", "label"), ["form_id", "label"], "left_semi").select(
        "form_id", "label", F.explode(F.array_distinct(F.filter(F.split(F.lower("label"), r"\s+"), lambda w: F.length(w) > 3))).alias("word"))
    hits = containment_pairs(words, known.withColumn("low", F.lower("p")), ["form_id"], "word", "low", gram=4)
    by_word = hits.groupBy("form_id", "label").agg(F.min("p").alias("word_path"))
    joined = by_rule.join(have, ["form_id", "path"], "left").join(by_word, ["form_id", "label"], "left")
    confidence = (
        F.when(F.col("known"), 0.75).when(F.col("path").isNotNull(), 0.55)
        .when(F.col("word_path").isNotNull(), 0.45).otherwise(0.0)
    )
    return joined.select("form_id", "label", F.coalesce("path", "word_path").alias("path"), confidence.alias("confidence"), field_type(F.col("label")).alias("field_type"))
