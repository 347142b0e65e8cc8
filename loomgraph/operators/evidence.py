"""Authority: which evidence covers a question, and how far an answer may be trusted (O-128 to O-140).

Receipts are (provider, version, capability, configuration, language, scope_kind, scope_id, status). A scope is the whole
repository, a language, or a project unit of a language; required scopes are (language, unit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: From least to most specific.
SPECIFICITY = {"repository": 0, "language": 1, "unit": 3}


def covering(receipts: DataFrame, capability: str, required: DataFrame) -> DataFrame:
    """Receipts joined to the required scopes that they cover, with their specificity. Each scope kind is an equi-join of its own."""
    own = receipts.where(F.col("capability") == capability).select("provider", "version", "status", "scope_kind", F.col("language").alias("r_language"), "scope_id")
    asked = required.select("language", "unit").distinct()
    whole = asked.join(F.broadcast(own.where("scope_kind = 'repository'")))
    by_language = asked.join(own.where("scope_kind = 'language'"), F.col("language") == F.col("r_language"))
    by_unit = asked.join(own.where("scope_kind = 'unit'"), (F.col("unit") == F.col("scope_id")) & (F.col("language") == F.col("r_language")))
    out = whole.unionByName(by_language).unionByName(by_unit)
    rank = F.when(F.col("scope_kind") == "repository", 0).when(F.col("scope_kind") == "language", 1).otherwise(3)
    return out.select("language", "unit", "provider", "version", "status", rank.alias("specificity"))


def resolve_provider(receipts: DataFrame, capability: str, required: DataFrame, preferred: str | None = None) -> DataFrame:
    """O-128, relational division: one row (status, provider): the provider whose complete receipts cover every required scope; unavailable without one, ambiguous with several unless one is preferred."""
    need = required.select("language", "unit").distinct().agg(F.count(F.lit(1)).alias("need"))
    have = covering(receipts, capability, required).where("status = 'complete'").groupBy("provider").agg(F.countDistinct(F.struct("language", "unit")).alias("have"))
    able = have.join(F.broadcast(need), (F.col("have") == F.col("need")) & (F.col("need") > 0))
    if preferred:
        able = able.where(F.col("provider") == preferred)
    counted = able.agg(F.count(F.lit(1)).alias("n"), F.min("provider").alias("first"))
    return counted.select(F.when(F.col("n") == 0, F.lit("unavailable")).when(F.col("n") == 1, F.lit("complete")).otherwise(F.lit("ambiguous")).alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("provider"))


def most_specific(receipts: DataFrame, capability: str, required: DataFrame, provider: str) -> DataFrame:
    """O-129: per required scope (language, unit, outcome, status, version): its most specific receipt; a tie is a conflict, none is missing, and versions that differ over the scopes are mixed."""
    own = covering(receipts, capability, required).where(F.col("provider") == provider)
    place = W.partitionBy("language", "unit").orderBy(F.desc("specificity"))
    top = own.withColumn("r", F.rank().over(place)).where("r = 1").groupBy("language", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status"), F.min("version").alias("version"))
    versions = top.agg(F.countDistinct("version").alias("versions"))
    joined = required.select("language", "unit").distinct().join(top, ["language", "unit"], "left").join(F.broadcast(versions))
    outcome = F.when(F.col("n").isNull(), F.lit("missing")).when(F.col("n") > 1, F.lit("conflict")).when(F.col("versions") > 1, F.lit("mixed_versions")).otherwise(F.lit("resolved"))
    return joined.select("language", "unit", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("status")).alias("status"), F.when(outcome == "resolved", F.col("version")).alias("version"))


def assess(receipts: DataFrame, capability: str, required: DataFrame) -> DataFrame:
    """O-130, O-131: per language (language, status, scopes, covered, gap): complete, partial or unavailable, with the reason of the gap."""
    found = covering(receipts, capability, required)
    best = found.groupBy("language", "unit").agg(F.bool_or(F.col("status") == "complete").alias("full"), F.bool_or(F.col("status") == "partial").alias("part"))
    joined = required.select("language", "unit").distinct().join(best, ["language", "unit"], "left")
    by = joined.groupBy("language").agg(
        F.count(F.lit(1)).alias("scopes"), F.count_if(F.coalesce("full", F.lit(False))).alias("covered"), F.count_if(F.coalesce("part", F.lit(False)) & ~F.coalesce("full", F.lit(False))).alias("parts")
    )
    status = F.when(F.col("covered") == F.col("scopes"), F.lit("complete")).when((F.col("parts") > 0) | (F.col("covered") > 0), F.lit("partial")).otherwise(F.lit("unavailable"))
    gap = F.when(F.col("covered") == F.col("scopes"), F.lit(None)).when(F.col("parts") > 0, F.lit("partial_receipt")).otherwise(F.lit("no_receipt"))
    return by.select("language", status.alias("status"), "scopes", "covered", gap.alias("gap"))


def inventory_coverage(issues: DataFrame, languages: DataFrame) -> DataFrame:
    """O-132: (language, coverage): complete iff no issue applies; an issue with a null language applies to all."""
    hits = issues.select(F.col("language").alias("l"))
    named = languages.join(hits.where("l is not null").distinct(), F.col("language") == F.col("l"), "left")
    any_all = hits.agg(F.coalesce(F.bool_or(F.col("l").isNull()), F.lit(False)).alias("everywhere"))
    return named.join(F.broadcast(any_all)).select("language", F.when(F.col("l").isNotNull() | F.col("everywhere"), F.lit("partial")).otherwise(F.lit("complete")).alias("coverage"))


def classification_failures(states: DataFrame) -> DataFrame:
    """O-134: states (authority, stamp, graph_identity, prover, expected_prover, freshness) with ``failures``: why a stored classification is not current, in fixed order; empty if it is."""
    both = F.col("stamp").isNotNull() & F.col("graph_identity").isNotNull()
    checks = [
        ("authority_missing", ~F.coalesce("authority", F.lit(False))),
        ("stamp_absent", F.col("stamp").isNull()),
        ("identity_unavailable", F.col("graph_identity").isNull()),
        ("identity_mismatch", both & (F.col("stamp") != F.col("graph_identity"))),
        ("configuration_mismatch", ~F.col("prover").eqNullSafe(F.col("expected_prover"))),
        ("index_stale", ~F.col("freshness").eqNullSafe(F.lit("fresh"))),
    ]
    return states.withColumn("failures", F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks])))


def status_verdict(rows: DataFrame) -> DataFrame:
    """O-135: the first rung of the ladder that applies, over rows (indexed, loaded, origin_matches, freshness, calls_complete)."""
    return rows.withColumn(
        "verdict",
        F.when(~F.col("indexed"), F.lit("unindexed"))
        .when(~F.col("loaded"), F.lit("load_failed"))
        .when(~F.col("origin_matches"), F.lit("origin_mismatch"))
        .when(F.col("freshness") == "unknown", F.lit("freshness_unknown"))
        .when(F.col("freshness") == "stale", F.lit("stale"))
        .when(~F.col("calls_complete"), F.lit("calls_incomplete"))
        .otherwise(F.lit("ok")),
    )


def unit_liveness(members: DataFrame, native: DataFrame, closure: DataFrame, complete_units: DataFrame) -> DataFrame:
    """O-137: (memory_id, unit, production, test, basis): the native payload of a unit if it has one, else the calls closure where its evidence is complete, else incomplete with nulls.

    ``members`` is (memory_id, unit), ``native`` (unit, memory_id, production, test), ``closure`` (memory_id, production, test).
    """
    told = native.select(F.col("unit").alias("nu")).distinct()
    base = members.join(told, F.col("unit") == F.col("nu"), "left").join(complete_units.select(F.col("unit").alias("cu")).distinct(), F.col("unit") == F.col("cu"), "left")
    n = native.select(F.col("memory_id").alias("nm"), F.col("production").alias("np"), F.col("test").alias("nt"))
    c = closure.select(F.col("memory_id").alias("cm"), F.col("production").alias("cp"), F.col("test").alias("ct"))
    joined = base.join(n, F.col("memory_id") == F.col("nm"), "left").join(c, F.col("memory_id") == F.col("cm"), "left")
    basis = F.when(F.col("nu").isNotNull(), F.lit("native")).when(F.col("cu").isNotNull(), F.lit("calls")).otherwise(F.lit("incomplete"))
    pick = lambda a, b: F.when(F.col("nu").isNotNull(), F.coalesce(a, F.lit(False))).when(F.col("cu").isNotNull(), F.coalesce(b, F.lit(False)))
    return joined.select("memory_id", "unit", pick("np", "cp").alias("production"), pick("nt", "ct").alias("test"), basis.alias("basis"))


def with_live_inputs(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """O-138: every row of a generation-bound result with the one-row state of its current inputs."""
    return rows.join(F.broadcast(fresh.select(F.col("status").alias("live_inputs"))))


def risk_signals(affected: DataFrame, nodes: DataFrame, tests: DataFrame, bindings: DataFrame) -> DataFrame:
    """O-139: counts of an impact (node, depth), without a score."""
    info = nodes.select(F.col("memory_id").alias("node"), "file_path", F.substring_index("file_path", "/", 1).alias("unit"))
    counts = affected.join(info, "node").agg(
        F.count(F.lit(1)).alias("affected_symbols"), F.countDistinct("file_path").alias("affected_files"), F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") > 1).alias("transitive"), (F.countDistinct("unit") > 1).alias("crosses_units"), F.max("depth").alias("max_depth"),
    )
    of = lambda df, name: affected.join(df.select(F.col("node")).distinct(), "node", "left_semi").agg(F.count(F.lit(1)).alias(name))
    return counts.join(F.broadcast(of(tests, "tests"))).join(F.broadcast(of(bindings, "bindings")))


def guidance(tier: str, authority: bool, scip: bool) -> str:
    """O-140: a reason code for the next step."""
    if tier == "degenerate":
        return "index_is_empty"
    if tier == "unavailable" or not scip:
        return "add_call_evidence"
    return "ready" if authority else "refresh_classification"
