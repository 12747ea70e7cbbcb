"""From candidates to one ledger entry per (packet, form, field).

Candidates of one field may be many, so nothing here gathers them: they are dealt by field
once, reduced to one row per distinct value, and every later aggregate and join of fields finds
its rows where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrain.functions import text as tx

FIELD = ["packet_id", "form_id", "field_id"]


# ------------------------------------------------------------------ scopes
def assign_scope(
    chunks: DataFrame,
    name_rules: Sequence[tuple[str, str]],
    exact_rules: Sequence[tuple[str, str]],
    loose_rules: Sequence[tuple[str, str]],
) -> DataFrame:
    """Adds ``scope_hint``: the form of the file name if exactly one fits, else of the first
    exact, then the first loose text rule that fits, else null."""
    names = F.array_compact(F.array(*[F.when(F.col("source_file").rlike(p), F.lit(f)) for f, p in name_rules]))
    by_text = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(f)) for f, p in [*exact_rules, *loose_rules]])
    return chunks.withColumn("scope_hint", F.when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise(by_text))


def multi_scope_sources(chunks: DataFrame) -> DataFrame:
    """(packet_id, source_file) of sources whose chunks name two or more scopes."""
    spread = chunks.groupBy("packet_id", "source_file").agg(F.min("scope_hint").alias("a"), F.max("scope_hint").alias("b"))
    return spread.where("a <> b").select("packet_id", "source_file")


# ------------------------------------------------------------------ best candidate
def pick_best(cands: DataFrame, multi: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, alternates).

    ``universe`` holds every (packet_id, form_id, field_id) that must have an entry.
    Candidates of single-scope sources are preferred when the best of them is within .05 of
    the best of all.  Alternates are the other values of a field, one row each.
    """
    # values seldom repeat, and the facts of one are wider than its candidates: these are dealt, not those
    flagged = cands.join(multi.withColumn("multi", F.lit(True)), ["packet_id", "source_file"], "left").repartition(*FIELD)
    alone = F.col("multi").isNull()
    where = F.struct("source_file", "chunk_id", "line_no")
    hit = F.struct("strength", "source_file", "source_type", "page", "chunk_id", "source_text", "scope_hint", "alias_used")
    place = F.struct("source_file", "page", "chunk_id")

    def facts(only: Column | None) -> Column:
        """What is known of one value, over all its candidates or the single-scope ones."""
        def of(col: Column) -> Column:
            return col if only is None else F.when(only, col)

        return F.struct(
            F.max(of(F.col("strength"))).alias("strength"),
            F.min_by(hit, of(F.struct(-F.col("strength"), where))).alias("best"),
            F.min_by(place, of(where)).alias("first"), F.min(of(where)).alias("first_at"),
            F.min(of(F.col("source_file"))).alias("src_a"), F.max(of(F.col("source_file"))).alias("src_b"))

    values = flagged.groupBy(*FIELD, "value").agg(facts(None).alias("all"), facts(alone).alias("single"))

    def summary(of: str) -> Column:
        """The best value of a field and how the other values compare."""
        v = F.when(F.col(f"{of}.strength").isNotNull(), F.struct(-F.col(f"{of}.strength"), F.col(f"{of}.first_at"), F.col("value")))
        return F.struct(
            F.min_by(F.struct("value", F.col(f"{of}.best").alias("best")), v).alias("top"),
            F.max(f"{of}.strength").alias("strength"), F.count(v).alias("n_values"),
            F.count_if(F.col(f"{of}.strength") > 0.55).alias("n_strong"),
            (F.min(f"{of}.src_a") == F.max(f"{of}.src_b")).alias("one_file"))

    fields = values.groupBy(*FIELD).agg(
        summary("all").alias("all"), summary("single").alias("single"),
        F.bool_and(F.col("single.strength").isNull()).alias("all_multi"))
    # single-scope candidates win when their best is within .05 of the best of all
    own = F.col("single.strength").isNotNull() & (F.col("single.strength") >= F.col("all.strength") - F.lit(0.05))
    top = fields.withColumn("use_single", own).withColumn("f", F.when(own, F.col("single")).otherwise(F.col("all"))).select(
        *FIELD, "use_single", "all_multi", "f.top.value", "f.top.best", F.col("f.strength").alias("s1"), "f.n_values", "f.n_strong", "f.one_file")
    conf = F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.35) * F.col("best.strength"))
    # the runner-up is at most .55 exactly when only one value is above it
    clear = (F.col("s1") >= 0.75) & (F.col("n_strong") == 1)
    clash = F.col("n_values") > 1
    vague = F.col("all_multi") | F.col("one_file")
    confidence = F.when(~clash | clear, conf).when(vague, 0.5).otherwise(0.55)
    decision = (
        F.when(~clash, F.when(conf >= 0.65, "usable").otherwise("weak")).when(clear, "usable")
        .when(vague, "weak").otherwise("conflict")
    )
    decided = top.select(
        *FIELD, "value", "best.source_file", "best.source_type", "best.page", "best.chunk_id", "best.source_text",
        confidence.alias("confidence"), F.col("best.scope_hint").alias("scope"), decision.alias("decision"),
        "best.alias_used", (F.col("n_values") - 1).alias("n_alternates"))
    entry = universe.select(*FIELD).join(decided, FIELD, "left")
    missing = F.col("decision").isNull()
    ledger = (
        entry.withColumn("scope", F.when(missing, F.split("field_id", r"\.")[0]).otherwise(F.col("scope")))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("n_alternates", F.coalesce("n_alternates", F.lit(0)).cast("bigint"))
        .withColumn("decision", F.coalesce("decision", F.lit("missing")))
    )
    chosen = top.select(*FIELD, "use_single", F.col("value").alias("chosen"))
    alternates = (
        values.join(chosen, FIELD).where("value <> chosen")
        .withColumn("f", F.when(F.col("use_single"), F.col("single")).otherwise(F.col("all")))
        .where("f.strength is not null").select(*FIELD, "value", "f.first.source_file", "f.first.page", "f.first.chunk_id")
    )
    return ledger, alternates


def apply_targeted(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """Ledger entries improved by targeted_search; all others unchanged."""
    f = found.select(*FIELD, *[F.col(c).alias(f"_{c}") for c in ("value", "source_file", "chunk_id", "source_text", "scope", "confidence", "decision")])
    hit = F.col("_decision").isNotNull()
    out = ledger.join(f, FIELD, "left")
    for c in ("source_file", "chunk_id", "source_text", "confidence", "decision"):
        out = out.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)))
    out = out.withColumn("value", F.coalesce("_value", "value")).withColumn("scope", F.coalesce("_scope", "scope"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def guard_scope(ledger: DataFrame, multi: DataFrame, global_fields: Sequence[str] = ()) -> DataFrame:
    """Reject values of another form; lower trust in values without a scope.

    A rejected value is kept beside the entry with the scope it was seen in.
    """
    flagged = ledger.join(multi.withColumn("_multi", F.lit(True)), ["packet_id", "source_file"], "left")
    exempt = F.col("value").isNull() | F.col("field_id").isin(*global_fields)
    no_scope = F.col("scope").isNull()
    foreign = ~exempt & ~no_scope & (F.col("scope") != F.col("form_id"))
    open_scope = ~exempt & no_scope & (F.col("source_type") != "json")
    mixed = F.coalesce(F.col("_multi"), F.lit(False))
    cap = F.when(mixed, F.least("confidence", F.lit(0.5))).otherwise(F.least("confidence", F.lit(0.85)))
    return flagged.select(
        *FIELD,
        F.when(~foreign, F.col("value")).alias("value"),
        "source_file", "source_type", "page", "chunk_id", "source_text",
        F.when(foreign, 0.0).when(open_scope, cap).otherwise(F.col("confidence")).alias("confidence"),
        "scope",
        F.when(foreign, "out_of_scope").when(open_scope & mixed & (F.col("decision") == "usable"), "weak").otherwise(F.col("decision")).alias("decision"),
        "alias_used",
        (F.col("n_alternates") + F.when(foreign, 1).otherwise(0)).cast("bigint").alias("n_alternates"),
        F.when(foreign, F.col("value")).alias("rejected_value"),
        F.when(foreign, F.lit("cross_form_contamination")).alias("rejected_reason"),
    )


# ------------------------------------------------------------------ run level
def run_level_values(cands: DataFrame, bonus_pattern: str, group: Sequence[str] = ("packet_id",)) -> DataFrame:
    """The best value of each field over all documents of a run: confidence, then a bonus
    for trusted sources, then clean characters, then the value."""
    bonus = F.when(F.lower("source_file").rlike(bonus_pattern), 2).otherwise(0)
    clean = F.length(F.regexp_replace("value", r"[^\p{L}\p{N}\s-]", ""))
    columns = F.struct("value", "confidence", "source_file", "chunk_id")
    best = cands.groupBy(*group, "field_id").agg(
        F.max_by(columns, F.struct("confidence", bonus, clean, "value", "source_file", "chunk_id")).alias("m"))
    return best.select(*group, "field_id", "m.*")


def fill_gaps(cands: DataFrame, run_values: DataFrame, forms: DataFrame, skip: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Candidates plus run-level values for (packet, form) pairs that lack the field.

    ``forms`` is (packet_id, form_id); ``skip`` lists (form, field) that stay empty."""
    offers = forms.join(run_values, "packet_id")
    for form, field in skip:
        offers = offers.where(~((F.col("form_id") == form) & (F.col("field_id") == field)))
    gaps = offers.join(cands.select(*FIELD), FIELD, "left_anti")
    columns = [*FIELD, "value", "confidence", "source_file", "chunk_id"]
    return cands.select(*columns, F.lit(False).alias("run_level")).unionByName(gaps.select(*columns, F.lit(True).alias("run_level")))


# ------------------------------------------------------------------ records
def merge_records(parts: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], shared: str | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """One record per key: for each column the first non-null value in ``order``.

    ``shared``: when all records of a scope that have this column agree on one value, the
    records that lack it get that value too.
    """
    merged = parts.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in values])
    if shared is None:
        return merged
    one = merged.groupBy(*scope).agg(F.min(shared).alias("_a"), F.max(shared).alias("_b")).where("_a = _b").select(*scope, "_a")
    joined = merged.join(one, list(scope), "left") if scope else merged.withColumn("_a", one.select("_a").scalar())
    return joined.withColumn(shared, F.coalesce(shared, "_a")).drop("_a")
