"""Name lookup and search (O-45 to O-49e)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions import predicates as P
from loomgraph.plans.checkpoint import cut


def name_tiers(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """O-45: (query, memory_id, symbol_name, tier) for many names at once: 0 equal, 1 ends with ::name, 2 contains.

    Equal and suffix matches need the same last segments, so they are found by an equi-join on every suffix of a
    qualified name; containment is a filter per name, so ``names`` should be a request, not a table.
    """
    own = nodes.select("memory_id", "symbol_name")
    joined = own.join(F.broadcast(names.select("query")), F.col("symbol_name").contains(F.col("query")))
    tier = F.when(F.col("symbol_name") == F.col("query"), 0).when(F.col("symbol_name").endswith(F.concat(F.lit("::"), F.col("query"))), 1).otherwise(2)
    return joined.select("query", "memory_id", "symbol_name", tier.alias("tier"))


def exact_and_suffix(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Tiers 0 and 1 of O-45 for any number of names: (query, memory_id, tier), by an equi-join on name suffixes."""
    segments = F.split("symbol_name", "::")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "::"))
    ends = nodes.select("memory_id", F.posexplode(suffixes).alias("skipped", "query"))
    return ends.join(names.select("query").distinct(), "query").select("query", "memory_id", F.least(F.col("skipped"), F.lit(1)).alias("tier"))


def _best_tier(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, memory_id, at): the candidates of each name's best tier. The tier depends on the name alone, not on the request."""
    found = exact_and_suffix(nodes, asked)
    best = found.groupBy("query").agg(F.min("tier").alias("tier"))
    at = nodes.select("memory_id", F.col("file_path").alias("at"))
    return found.join(best, ["query", "tier"], "left_semi").join(at, "memory_id").select("query", "memory_id", "at")


def _summed(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Distinct requests (query, file, crate) with the number and the least id of candidates: all (n, any), in the file and in the crate.

    Candidates are summed up by name, file and crate first: no row per request and candidate.
    """
    asked = requests.select("query", "file").distinct().withColumn("crate", P.crate_name("file"))
    sums = lambda n, one: [F.count(F.lit(1)).alias(n), F.min("memory_id").alias(one)]
    overall = found.groupBy("query").agg(*sums("n", "any"))
    by_file = found.groupBy("query", F.col("at").alias("file")).agg(*sums("n_file", "in_file"))
    by_crate = found.groupBy("query", P.crate_name("at").alias("crate")).agg(*sums("n_crate", "in_crate"))
    out = asked.join(overall, "query", "left").join(by_file, ["query", "file"], "left").join(by_crate, ["query", "crate"], "left")
    return out.na.fill(0, ["n", "n_file", "n_crate"])


def resolve_unique(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """O-46: (query, status, memory_id, candidates) for requests (query, file).

    The best non-empty tier counts. One candidate is unique; else the only one in the request's file, or, when none is in
    that file, the only one in its crate; else the answer is ambiguous, or not_found. Candidates are gathered once per name,
    for names with an ambiguous request only. Repeated requests are one.
    """
    found = cut(_best_tier(nodes, requests), "candidates")
    counted = _summed(found, requests)
    pick = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_file") == 1, F.col("in_file")).when((F.col("n_file") == 0) & (F.col("n_crate") == 1), F.col("in_crate"))
    status = F.when(F.col("n") == 0, F.lit("not_found")).when(pick.isNotNull(), F.lit("unique")).otherwise(F.lit("ambiguous"))
    answered = counted.select("query", "file", status.alias("status"), pick.alias("memory_id"))
    unsure = answered.where("status = 'ambiguous'").select("query").distinct()
    listed = found.join(unsure, "query", "left_semi").groupBy("query").agg(F.sort_array(F.collect_list("memory_id")).alias("all"))
    return answered.join(listed, "query", "left").select("query", "file", "status", "memory_id", F.when(F.col("status") == "ambiguous", F.col("all")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def resolve_in_file(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """O-47: (query, file, status, memory_id): unique if exactly one candidate of the best tier lies in the file, wrong_file if none or several do, not_found without any."""
    out = _summed(_best_tier(nodes, requests), requests)
    status = F.when(F.col("n") == 0, F.lit("not_found_in_file")).when(F.col("n_file") == 1, F.lit("unique")).otherwise(F.lit("wrong_file"))
    return out.select("query", "file", status.alias("status"), F.when(F.col("n_file") == 1, F.col("in_file")).alias("memory_id"))


def resolve_with_locality(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """O-48, the resolver of graph construction: (rel_id, memory_id) for relations (rel_id, target, file); unresolved ones are absent.

    Within the exact tier, then the suffix tier: one in the same file, or of several there the one with the shortest name,
    then name, then path; the same for the same crate; then a global singleton. Last, over both tiers, a candidate with a
    uniquely shortest name.
    """
    info = nodes.select(F.col("memory_id").alias("id"), F.col("file_path").alias("at"), "symbol_name")
    asked = relations.select(F.col("target").alias("query"), "file").distinct().withColumn("crate", P.crate_name("file"))
    found = exact_and_suffix(nodes, asked.select("query")).join(info, F.col("memory_id") == F.col("id")).drop("id")
    found = found.withColumn("in_crate", P.crate_name("at")).withColumn("order", F.struct(F.length("symbol_name").alias("n"), "symbol_name", "at", "memory_id"))
    #: The answer depends on the name, tier, file and crate alone, so candidates are summed up by these: no row per relation and candidate.
    best = F.min("order")["memory_id"]
    by_file = found.groupBy("query", "tier", F.col("at").alias("file")).agg(best.alias("of_file"))
    by_crate = found.where("in_crate is not null").groupBy("query", "tier", F.col("in_crate").alias("crate")).agg(best.alias("of_crate"))
    overall = found.groupBy("query", "tier").agg(F.when(F.count(F.lit(1)) == 1, F.min("memory_id")).alias("sole"))
    lengths = found.groupBy("query", F.length("symbol_name").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.min("memory_id").alias("id"))
    shortest = lengths.groupBy("query").agg(F.min_by(F.when(F.col("n") == 1, F.col("id")), F.col("len")).alias("short"))
    tiers = overall.join(asked, "query").join(by_file, ["query", "tier", "file"], "left").join(by_crate, ["query", "tier", "crate"], "left")
    pick = tiers.withColumn("hit", F.coalesce("of_file", "of_crate", "sole")).where("hit is not null").groupBy("query", "file").agg(F.min_by("hit", "tier").alias("hit"))
    answer = asked.join(shortest, "query").join(pick, ["query", "file"], "left").select(F.col("query").alias("target"), "file", F.coalesce("hit", "short").alias("memory_id")).where("memory_id is not null")
    return relations.join(answer, ["target", "file"]).select("rel_id", "memory_id")


def search_by_name(nodes: DataFrame, q: str, kind: str | None = None, definitions_only: bool = False, limit: int | None = 20) -> DataFrame:
    """O-49: glob on the full name if ``q`` has a star, else equal and suffix names; ranked, lines from 1, default signatures."""
    name = F.col("symbol_name")
    match = P.glob_match(name, q) if "*" in q else (name == q) | name.endswith("::" + q)
    rank = F.lit(0) if "*" in q else F.when(name == q, 0).otherwise(1)
    rows = nodes.where(match)
    if kind:
        rows = rows.where(F.lower("kind") == kind.lower())
    if definitions_only:
        rows = rows.where(P.has_role("kind", "definition"))
    signature = F.when(F.coalesce("signature", F.lit("")) == "", F.concat_ws(" ", "kind", P.short_name("symbol_name"))).otherwise(F.col("signature"))
    rows = rows.select(rank.cast("int").alias("rank"), "symbol_name", "file_path", (F.col("line_start") + 1).alias("line"), "kind", "memory_id", signature.alias("signature"))
    rows = rows.orderBy("rank", "symbol_name", "file_path", "line", "kind", "memory_id")
    return rows if limit is None else rows.limit(limit)


def search_by_path(nodes: DataFrame, q: str, limit: int | None = 20) -> DataFrame:
    """O-49b: independent symbols of a file (registered extension) or below a directory."""
    path = F.col("file_path")
    match = path == q if q.rpartition(".")[2] in model.LANGUAGES else path.startswith(q.rstrip("/") + "/")
    rows = nodes.where(match & P.has_role("kind", "independent")).select("file_path", (F.col("line_start") + 1).alias("line"), "symbol_name", "kind", "memory_id")
    rows = rows.orderBy("file_path", "line", "symbol_name", "kind", "memory_id")
    return rows if limit is None else rows.limit(limit)


def is_path_query(q: str) -> bool:
    """O-49c."""
    return "/" in q or q.rpartition(".")[2] in model.LANGUAGES


def suggestions(nodes: DataFrame, q: str, most: int = 5, distance: int = 3) -> DataFrame:
    """O-49d: up to ``most`` names within an edit distance, lower-cased, in characters; each name once."""
    d = F.levenshtein(F.lower("symbol_name"), F.lit(q.lower()), distance)
    rows = nodes.select("symbol_name", d.alias("distance")).where("distance >= 0").distinct()
    return rows.orderBy("distance", "symbol_name").limit(most)


def find(nodes: DataFrame, q: str, kind: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """O-49e: rows by name or path, and suggestions, which are empty when a name query has rows or a path is asked for."""
    if is_path_query(q):
        return search_by_path(nodes, q, limit), suggestions(nodes.limit(0), q)
    rows = search_by_name(nodes, q, kind, limit=limit)
    near = suggestions(nodes, q)
    none = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows, near.join(F.broadcast(none), F.col("n") == 0).drop("n")
