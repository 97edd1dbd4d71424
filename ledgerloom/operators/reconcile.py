"""Pairs to verdicts: differences, rules, model merge, verification, budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.values import units_compatible, with_agreement
from ledgerloom.operators.pairing import MAX_PAIRS, affected, candidate_pairs
from ledgerloom.session import cut
from ledgerloom.sources.sinks import upsert

# Qualifiers that tell who reported, not what was measured.
PROVENANCE = ("source", "publisher", "attribution", "reported_by", "reporter", "author", "institution")
# Verdicts a model may give, and transforms that can be checked.
MODEL_VERDICTS = ("corroborates", "contradicts", "reconciled_by_context", "unrelated")
QUALIFIER_KINDS = ("basis", "vintage", "scope", "segment")
TOLERANCE = 1e-3
#: What ends an adjudication without a provider.
NO_ANSWER = "NoAnswer"
_FACT = ["doc_id", "value_raw", "qualifiers", "claim_type", "confidence", "canon_value", "canon_unit", "period_start", "period_end", "entity_id"]


def pair_rows(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with both facts as structs a and b (JOIN-2); pairs with an unknown fact fall out."""
    f = facts.select("id", F.struct(*_FACT).alias("f"))
    return (pairs.join(f.select(F.col("id").alias("fact_a"), F.col("f").alias("a")), "fact_a")
            .join(f.select(F.col("id").alias("fact_b"), F.col("f").alias("b")), "fact_b"))


def differences(a: Column, b: Column) -> Column:
    """``array<struct<k, a, b>>`` of what differs, by name, with both sides (SCL-32).

    A qualifier on one side only is unknown, not different.  Differing subjects
    (both known), periods (one unknown counts) and units are differences too,
    and replace qualifiers of their names; a period reads start/end.
    """
    none = F.create_map().cast("map<string,string>")
    l, r = F.coalesce(a["qualifiers"], none), F.coalesce(b["qualifiers"], none)
    full = lambda c: F.nullif(c, F.lit(""))
    item = lambda k, x, y: F.struct(F.lit(k).alias("k"), x.cast("string").alias("a"), y.cast("string").alias("b"))
    span = lambda q: F.when(q["period_start"].isNotNull() | q["period_end"].isNotNull(), F.concat_ws("/", F.coalesce(q["period_start"], F.lit("")), F.coalesce(q["period_end"], F.lit(""))))
    period = ~(a["period_start"].eqNullSafe(b["period_start"]) & a["period_end"].eqNullSafe(b["period_end"]))
    extra = F.array_compact(F.array(
        F.when(F.coalesce(full(a["entity_id"]) != full(b["entity_id"]), F.lit(False)), item("subject", a["entity_id"], b["entity_id"])),
        F.when(period, item("period", span(a), span(b))),
        F.when(~units_compatible(a["canon_unit"], b["canon_unit"]), item("unit", a["canon_unit"], b["canon_unit"]))))
    keys = F.filter(F.map_keys(l), lambda k: F.coalesce(F.element_at(l, k) != F.element_at(r, k), F.lit(False)) & ~F.array_contains(F.transform(extra, lambda x: x["k"]), k))
    own = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(l, k).alias("a"), F.element_at(r, k).alias("b")))
    return F.array_sort(F.concat(own, extra))


def diff_json(diff: Column) -> Column:
    """Differences as JSON: name to both sides, in order of names."""
    return F.to_json(F.map_from_entries(F.transform(diff, lambda x: F.struct(x["k"], F.struct(x["a"].alias("a"), x["b"].alias("b"))))))


def material(keys: Column) -> Column:
    """What bears on the measurement: the difference without provenance (SCL-33)."""
    return F.filter(keys, lambda k: ~k.isin(*PROVENANCE))


def rule_verdict(a: Column, b: Column, keys: Column, agree: Column) -> Column:
    """The decision table (REL-1); rows in order."""
    m = material(keys)
    attribute = F.coalesce(a["claim_type"] == "attribute", F.lit(False)) | F.coalesce(b["claim_type"] == "attribute", F.lit(False))
    return (F.when(attribute | a["canon_value"].isNull() | b["canon_value"].isNull(), "needs_model")
            .when(~units_compatible(a["canon_unit"], b["canon_unit"]), "unrelated")
            .when(agree & (F.size(keys) == 0), "corroborates").when(agree, "corroborates_with_caveat")
            .when(a["period_start"].isNull() | b["period_start"].isNull(), "insufficient_context")
            .when((F.size(m) == 1) & F.array_contains(m, "period"), "different_period")
            .when(F.size(m) == 1, "reconcilable").when(F.size(m) == 0, "contradiction_candidate").otherwise("needs_model"))


def classify(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs with ``differs`` (both sides), ``diff`` (names), ``agree``, ``rule_verdict`` and both facts.

    The verdict is the end of a long chain of columns: take what is needed and
    cut it before filtering on it, as adjudicate does.
    """
    a, b = F.col("a"), F.col("b")
    p = pair_rows(pairs, facts).withColumn("differs", differences(a, b)).withColumn("diff", F.transform("differs", lambda x: x["k"]))
    p = with_agreement(p, a["canon_value"], b["canon_value"], a["value_raw"], b["value_raw"], TOLERANCE)
    return p.withColumn("rule_verdict", rule_verdict(a, b, F.col("diff"), F.col("agree")))


# Sentences that explain verdicts of the rules.
OTHER_PERIODS = "The two facts cover different periods, so their values are not in conflict."
RULE_CONFLICT = ("Same metric, period and unit; the values differ and no recorded qualifier distinguishes them. "
                 "Decided by rule alone; no model review.")
NO_REVIEW = "no adjudication available for this pair"


def rules_only(rule: Column) -> tuple[Column, Column, Column]:
    """Final verdict, reason and explanation where no model is asked (REL-2, REL-3)."""
    final = (F.when(rule.isin("corroborates", "corroborates_with_caveat"), "corroborates").when(rule == "unrelated", "unrelated")
             .when(rule == "different_period", "reconciled_by_context").when(rule == "contradiction_candidate", "contradicts")
             .otherwise("insufficient_context"))
    reason = F.when(rule == "different_period", "different_period").when(rule == "contradiction_candidate", "genuine_disagreement")
    why = (F.when(rule == "different_period", OTHER_PERIODS).when(rule == "contradiction_candidate", RULE_CONFLICT)
           .when(rule.isin("corroborates", "corroborates_with_caveat", "unrelated", "insufficient_context"), F.lit(None)).otherwise(NO_REVIEW))
    return final, reason, why


def is_rule_final(rule: Column) -> Column:
    return rule.isin("corroborates", "corroborates_with_caveat", "insufficient_context", "unrelated", "different_period")


@F.arrow_udf(T.StringType())
def _short(value: pa.Array) -> pa.Array:
    """Numbers with six significant digits, without trailing zeros."""
    return pa.array([None if v is None else f"{v:g}" for v in value.to_pylist()], pa.string())


def verify(a: Column, b: Column, kind: Column, factor: Column) -> tuple[Column, Column]:
    """Whether a claimed transform holds when worked out again, and a note why (REL-5)."""
    number = factor.try_cast("double")
    f = F.when(factor.isNull() | (factor == "") | (number == 0), F.lit(1.0)).otherwise(number)
    close = lambda x, y: F.coalesce((x == y) | (F.abs(x - y) <= F.lit(TOLERANCE) * F.greatest(F.abs(x), F.abs(y))), F.lit(False))
    va, vb = a["canon_value"], b["canon_value"]
    scale = close(va * f, vb) | close(va, vb * f)
    one = lambda q: F.when(q["qualifiers"].isNotNull(), F.try_element_at(q["qualifiers"], kind))
    differs = F.when(kind == "period", ~(a["period_start"].eqNullSafe(b["period_start"]) & a["period_end"].eqNullSafe(b["period_end"]))).otherwise(~one(a).eqNullSafe(one(b)))
    contextual = kind.isin("period", *QUALIFIER_KINDS)
    ok = F.coalesce(F.when(kind == "scale", scale).when(contextual, differs).when(kind == "none", F.lit(True)), F.lit(False))
    note = (F.when(kind.isNull(), "no transform claimed; nothing to verify")
            .when((kind == "scale") & f.isNull(), F.concat(F.lit("scale factor is not a number: "), factor))
            .when((kind == "scale") & (va.isNull() | vb.isNull()), "missing canonical values")
            .when((kind == "scale") & scale, F.concat(F.lit("values reconcile under a factor of "), _short(f)))
            .when(kind == "scale", F.concat(F.lit("values do not reconcile under a factor of "), _short(f), F.lit(": "), _short(va), F.lit(" vs "), _short(vb)))
            .when(contextual & differs, F.concat(kind, F.lit(" genuinely differs between the two facts")))
            .when(contextual, F.concat(kind, F.lit(" was claimed to differ but both facts agree on it")))
            .when(kind == "none", "no transform needed").otherwise(F.concat(F.lit("unrecognised transform kind: "), kind)))
    return ok, note


def budget_rank(asked: DataFrame) -> DataFrame:
    """``fact_a, fact_b, call_rank`` of pairs ``fact_a, fact_b, rule_verdict, same, total`` a model would be asked about, most informative first (TOPK-3)."""
    rank = (F.when(F.col("rule_verdict") == "contradiction_candidate", 0).when(F.col("rule_verdict") == "reconcilable", 1)
            .when(F.col("rule_verdict") == "needs_model", 2).otherwise(9))
    asked = asked.where(~is_rule_final(F.col("rule_verdict"))).select("fact_a", "fact_b", "same", rank.alias("rank"), "total")
    return global_rank(asked, [F.col("same"), F.col("rank"), F.desc("total"), F.col("fact_a"), F.col("fact_b")], "call_rank").select("fact_a", "fact_b", "call_rank")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the rank (from 1) in a total order: a range sort, the sizes of its partitions, then ranks inside them."""
    s = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    n = s.groupBy("part").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return s.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("inside")).drop("part", "inside", "before")


ANSWER = ("verdict", "reason_code", "explanation", "kind", "factor", "confidence")


def adjudicate(classified: DataFrame, facts: DataFrame, answers: DataFrame, budget: int | None = None) -> DataFrame:
    """Relations of classified pairs (REL-2 to REL-6, SEQ-9): ``fact_a, fact_b, rule_verdict, model_verdict,
    final_verdict, reason_code, explanation, qualifier_diff, claimed_transform, verified, agreed, confidence``.

    answers holds ``fact_a, fact_b`` and the fields of ANSWER, one row per pair
    (absent fields are null); a verdict outside the vocabulary is unrelated
    (SCL-38), confidence that is missing is 0.  Pairs are asked in the order of
    the budget; a pair without an answer ends the adjudication: it and all
    later ones get the rule's verdict.  Only scalars are ranked and kept; the
    facts come back for the transforms that are to be verified.
    """
    total = F.coalesce("a.confidence", F.lit(0.0)) + F.coalesce("b.confidence", F.lit(0.0))
    same = F.when(F.col("a.doc_id") == F.col("b.doc_id"), 1).otherwise(0)
    c = cut(classified.select("fact_a", "fact_b", "rule_verdict", diff_json(F.col("differs")).alias("qualifier_diff"), material(F.col("diff")).alias("material"), same.alias("same"), total.alias("total")))
    rk = cut(budget_rank(c))
    have = [F.col(x) if x in answers.columns else F.lit(None).cast("double" if x == "confidence" else "string").alias(x) for x in ANSWER[1:]]
    ans = cut(answers.select("fact_a", "fact_b", F.when(F.col("verdict").isin(*MODEL_VERDICTS), F.col("verdict")).otherwise("unrelated").alias("mv"), *have))
    claims = pair_rows(ans.where("mv = 'reconciled_by_context'").select("fact_a", "fact_b", "kind", "factor"), facts)
    ok, note = verify(F.col("a"), F.col("b"), F.col("kind"), F.col("factor"))
    checked = claims.select("fact_a", "fact_b", ok.alias("ok"), note.alias("note"))
    miss = rk.join(ans.select("fact_a", "fact_b"), ["fact_a", "fact_b"], "left_anti").agg(F.min("call_rank").alias("first_miss"))  # one row
    j = c.join(rk, ["fact_a", "fact_b"], "left").join(ans, ["fact_a", "fact_b"], "left").join(checked, ["fact_a", "fact_b"], "left").crossJoin(F.broadcast(miss))
    rank = F.col("call_rank")
    called = rank.isNotNull() & (rank < F.coalesce("first_miss", F.lit(2**62)))
    fails = rank == F.col("first_miss")
    if budget is not None:
        called, fails = called & (rank <= budget), fails & (rank <= budget)
    rule, mv = F.col("rule_verdict"), F.when(called, F.col("mv"))
    plain, reason, why = rules_only(rule)
    why = F.when(fails, F.concat(why, F.lit(f" ({NO_ANSWER})"))).otherwise(why)
    unproved = (mv == "reconciled_by_context") & ~F.coalesce("ok", F.lit(False))
    apart = (mv == "contradicts") & (F.size("material") > 0)
    held = unproved | (mv == "corroborates") | apart
    said = F.coalesce("explanation", F.lit(""))
    told = (F.when(unproved, F.concat(said, F.lit(" [unverified: "), F.coalesce("note", F.lit("no transform claimed; nothing to verify")), F.lit("]")))
            .when(apart, F.concat(said, F.lit(" [held: "), F.array_join("material", ", "), F.lit(" differs, so the two may not be comparable]"))).otherwise(said))
    transform = F.when(F.col("kind").isNotNull(), F.to_json(F.struct("kind", "factor")))
    return j.select("fact_a", "fact_b", "rule_verdict", mv.alias("model_verdict"),
                    F.when(mv.isNull(), plain).when(held, "needs_review").otherwise(mv).alias("final_verdict"),
                    F.when(mv.isNull(), reason).otherwise(F.coalesce("reason_code", F.lit(""))).alias("reason_code"),
                    F.when(mv.isNull(), why).otherwise(told).alias("explanation"), "qualifier_diff",
                    F.when(mv.isNotNull(), transform).alias("claimed_transform"),
                    F.when(mv == "reconciled_by_context", ~unproved).alias("verified"), F.when(mv.isNotNull(), ~held).alias("agreed"),
                    F.when(mv.isNotNull(), F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def build_relations(facts: DataFrame, answers: DataFrame, cap: int = MAX_PAIRS, budget: int | None = None) -> DataFrame:
    """Relations of all facts worth comparing, from pairs to verdicts (REL-1 to REL-6); columns of adjudicate.

    Fewer than two facts give none.  The result is the input of the upsert
    (SNK-6): run again on the same facts and answers it changes nothing.
    """
    pairs = cut(candidate_pairs(facts, cap))
    return adjudicate(classify(pairs.select("fact_a", "fact_b"), facts), facts, answers, budget)


def refresh_relations(relations: DataFrame, facts: DataFrame, new_facts: DataFrame, answers: DataFrame, cap: int = MAX_PAIRS) -> DataFrame:
    """Relations after new facts arrived: only what they can affect is paired and judged again, the rest stays (STR-1, STR-3, SNK-6).

    ``facts`` holds the new ones too.  Pairs that are no candidates any more
    stay, as in every upsert; sinks.prune removes them.
    """
    touched = cut(affected(facts, new_facts))
    new = build_relations(touched, answers, cap)
    return upsert(relations.select(*new.columns), new, ["fact_a", "fact_b"])
