"""Runtime evidence: boundary resolution, notifications, registries, contracts, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import semi_naive

STATUSES = ("resolved", "alreadyIndexed", "lookupOnly", "unresolved", "ambiguous", "dynamic", "shadowed", "stale", "unindexed")


def resolve_names(boundaries: DataFrame, declarations: DataFrame) -> DataFrame:
    """Boundaries (boundary, name, freshness, kind) by runtime name: 0, 1 or more declarations (name, id) are
    unresolved, resolved or ambiguous; a name that is not known is dynamic; a stale file decides first."""
    found = declarations.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"), F.array_join(F.slice(F.sort_array(F.collect_set("id")), 1, 5), ",").alias("candidates"))
    j = boundaries.join(found, "name", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("freshness") == "stale", "stale").when(F.col("freshness") != "fresh", "unindexed").when(F.col("name").isNull(), "dynamic").when(n == 0, "unresolved").when(n > 1, "ambiguous").otherwise("resolved")
    return j.withColumn("status", status).withColumn("target", F.when(F.col("status") == "resolved", F.col("target"))).drop("n")


def classify_boundaries(boundaries: DataFrame, calls: DataFrame, system: DataFrame, proofs: DataFrame, declarations: DataFrame, indexed: DataFrame) -> DataFrame:
    """boundary, status, source, target, candidates: every boundary through its gates, the first that fails decides.

    ``boundaries``: boundary, kind, name, origin, freshness, reason, site, needs (of source evidence); ``calls``: site, source,
    target, resolved (compiler references at a place); ``system``: kind, target (what may be called for a kind);
    ``proofs``: boundary, site, target (name-building operations); ``declarations``: name, id; ``indexed``: source,
    target pairs the index has already.

    Stale or unknown files come first (a resource has none), then a resource's own reason. A call in code must stand at
    an indexed place (else unindexed), reach a system API of its kind (else shadowed), have one owner (else
    unindexed), and so must each operation that builds its name. What is left is looked up by name: a token alone
    is lookupOnly, an unknown name dynamic, then none, several or one declaration.
    """
    resource = F.col("origin").isin("resource", "bridge")
    at = calls.join(system.withColumn("ok", F.lit(True)), "target", "left")
    met = boundaries.select("boundary", F.col("kind").alias("k"), "site").join(at, "site")
    gate = met.groupBy("boundary").agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.coalesce(F.col("ok") & (F.col("kind") == F.col("k")) & ~F.col("resolved"), F.lit(False))).alias("n_ok"),
        F.count_distinct(F.when(F.col("ok") & (F.col("kind") == F.col("k")) & ~F.col("resolved"), F.col("source"))).alias("n_sources"),
        F.min(F.when(F.col("ok") & (F.col("kind") == F.col("k")) & ~F.col("resolved"), F.col("source"))).alias("source"),
    )
    shown = proofs.join(calls.select("site", F.col("target").alias("t"), F.col("resolved").alias("r")), "site", "left").groupBy("boundary", "site", "target").agg(
        F.count("t").alias("seen"), F.coalesce(F.bool_or((F.col("t") == F.col("target")) & ~F.col("r")), F.lit(False)).alias("proven")
    )
    # The worst of a boundary's proofs: one without any call is unindexed, one with other calls shadowed.
    shown = shown.groupBy("boundary").agg(F.coalesce(F.min(F.when(~F.col("proven"), F.when(F.col("seen") == 0, "unindexed").otherwise("shadowed"))), F.lit("")).alias("proof"))
    found = declarations.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"), F.array_join(F.slice(F.sort_array(F.collect_set("id")), 1, 5), ",").alias("candidates"))
    j = boundaries.join(gate, "boundary", "left").join(shown, "boundary", "left").join(found, "name", "left")
    known = indexed.select("source", F.col("target").alias("one")).distinct().withColumn("already", F.lit(True))
    j = j.join(known, ["source", "one"], "left")
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(~resource & (F.col("freshness") == "stale"), "stale")
        .when(~resource & (F.coalesce("freshness", F.lit("unknown")) != "fresh"), "unindexed")
        .when(resource & F.col("reason").isNotNull(), "unresolved")
        .when(~resource & F.col("n_calls").isNull(), "unindexed")
        .when(~resource & (F.col("n_ok") == 0), "shadowed")
        .when(~resource & (F.col("n_sources") != 1), "unindexed")
        .when(~resource & (F.coalesce("proof", F.lit("")) != ""), F.col("proof"))
        .when(F.col("name").isNull(), "dynamic")
        .when(F.col("kind") == "selectorLookup", "lookupOnly")
        .when(n == 0, "unresolved")
        .when(n > 1, "ambiguous")
        .when(F.col("already"), "alreadyIndexed")
        .otherwise("resolved")
    )
    target = F.when(F.col("status").isin("resolved", "alreadyIndexed"), F.col("one"))
    return j.withColumn("status", status).select("boundary", "status", F.when(~resource, F.col("source")).alias("source"), target.alias("target"), F.when(F.col("status") == "ambiguous", F.col("candidates")).alias("candidates"))


def ancestor_distances(parents: DataFrame) -> DataFrame:
    """(type, ancestor, distance) with the type itself at 0."""
    seed = parents.select("type").unionByName(parents.select(F.col("parent").alias("type"))).distinct().select("type", F.col("type").alias("ancestor"), F.lit(0).alias("distance"))
    up = parents.select(F.col("type").alias("ancestor"), F.col("parent").alias("next")).distinct()
    step = lambda new, known, k: new.join(up, "ancestor").groupBy("type", F.col("next").alias("ancestor")).agg((F.min("distance") + 1).alias("distance"))
    return semi_naive(seed, step, ["type", "ancestor"], label="distances")[0]


def nearest_members(lookups: DataFrame, members: DataFrame, parents: DataFrame) -> DataFrame:
    """lookups (lookup, type, name): the member (owner, name, id) of the nearest ancestor; two there are ambiguous."""
    d = ancestor_distances(parents)
    c = lookups.join(d, "type").join(members.withColumnRenamed("owner", "ancestor"), ["ancestor", "name"])
    per = c.groupBy("lookup", "distance").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    best = per.groupBy("lookup").agg(F.min(F.struct("distance", "n", "id")).alias("b"))
    j = lookups.join(best, "lookup", "left")
    return j.select("lookup", "type", "name", F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, "ambiguous").otherwise("resolved").alias("status"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("target"))


def notifications(observers: DataFrame, posts: DataFrame, removals: DataFrame) -> DataFrame:
    """(observer, post): of one channel, observed before posted and not removed between.

    The first removal after a registration is found in one sorted pass per channel and token, which leaves one
    interval per registration; a post then meets the intervals of its channel only.
    """
    from pyspark.sql.window import Window

    reg = observers.select("channel", "token", "at", F.lit(0).alias("_k"), "observer")
    rem = removals.select("channel", "token", "at", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("observer"))
    ahead = Window.partitionBy("channel", "token").orderBy("at", "_k").rowsBetween(1, Window.unboundedFollowing)
    until = F.min(F.when(F.col("_k") == 1, F.col("at"))).over(ahead)
    live = reg.unionByName(rem).withColumn("until", until).where("_k = 0").select("channel", "observer", "at", "until")
    p = posts.select("channel", "post", F.col("at").alias("posted"))
    return live.join(p, "channel").where("at < posted and (until is null or posted <= until)").select("channel", "observer", "post")


def resolve_registry(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """lookups (lookup, registry, key) in entries (registry, key, value): a key entered twice is ambiguous."""
    e = entries.groupBy("registry", "key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    j = lookups.join(e, ["registry", "key"], "left")
    return j.withColumn("status", F.when(F.col("key").isNull(), "dynamic").when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")).withColumn("value", F.when(F.col("status") == "resolved", F.col("value"))).drop("n")


def bind_entities(entities: DataFrame, fetches: DataFrame) -> DataFrame:
    """Targets of fetches (fetch, model, entity) over entities (model, name, target, parent).

    A model binds only when rows of one name agree, every parent is known and no parent chain is a cycle; a
    fetch then targets its entity and all below it.
    """
    agree = entities.groupBy("model", "name").agg(F.count_distinct("target").alias("nt"), F.count_distinct(F.coalesce("parent", F.lit(""))).alias("np"), F.min("target").alias("target"), F.min("parent").alias("parent"), F.bool_or(F.col("target").isNull()).alias("open"))
    known = agree.select("model", F.col("name").alias("parent"), F.lit(True).alias("here"))
    e = agree.join(known, ["model", "parent"], "left")
    bad = e.where("nt <> 1 or np > 1 or open or (parent is not null and here is null)").select("model")
    links = e.where("parent is not null").select("model", "name", F.col("parent").alias("up"))
    hop = links.select("model", F.col("name").alias("up"), F.col("up").alias("next"))
    step = lambda new, known, k: new.join(hop, ["model", "up"]).select("model", "name", F.col("next").alias("up")).distinct()
    above = semi_naive(links, step, ["model", "name", "up"], label="entities")[0]
    bad = bad.unionByName(above.where("name = up").select("model")).distinct()
    good = e.join(bad, "model", "left_anti").select("model", "name", "target")
    reach = above.select("model", "name", "up").unionByName(good.select("model", "name", F.col("name").alias("up")))
    return fetches.join(reach.withColumnRenamed("up", "entity"), ["model", "entity"]).join(good, ["model", "name"]).select("fetch", "model", "entity", "target").distinct()


def scenario_outcomes(contracts: DataFrame, observations: DataFrame) -> DataFrame:
    """id, scenario, state: failed when any observation failed or shows another value than expected, observed when
    there is one, else missing. Works on batches; the aggregate is the one that the stream keeps."""
    need = contracts.select("id", "expectedValue", F.explode("requiredScenarios").alias("scenario")).distinct()
    o = observations.withColumnRenamed("contract", "id")
    j = need.join(o, ["id", "scenario"], "left")
    wrong = (F.col("outcome") == "failed") | ((F.col("outcome") == "observed") & F.col("expectedValue").isNotNull() & ~F.col("value").eqNullSafe(F.col("expectedValue")))
    g = j.groupBy("id", "scenario").agg(F.count("outcome").alias("n"), F.coalesce(F.bool_or(wrong), F.lit(False)).alias("bad"))
    return g.select("id", "scenario", F.when(F.col("n") == 0, "missing").when(F.col("bad"), "failed").otherwise("observed").alias("state"))


def validate_contracts(contracts: DataFrame, targets: DataFrame, observations: DataFrame | None = None, plan_matches: bool = True, freshness: DataFrame | None = None) -> DataFrame:
    """id, status, observed, missing, failed (scenarios, joined by commas).

    ``targets``: name, n (declarations of that name), mechanism_ok. Precedence: invalid contract (no id, no
    scenario, repeated id), missing or ambiguous source, then target, wrong mechanism, unverified source and
    target (where ``freshness`` name, state is given), declared (no observations at all), stale observations,
    failed, observed, unobserved.
    """
    dup = contracts.groupBy("id").agg((F.count("*") > 1).alias("dup"))
    valid = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "") & (F.size(F.coalesce("requiredScenarios", F.array().cast("array<string>"))) > 0)
    t = targets.select(F.col("name").alias("target"), F.col("n").alias("tn"), "mechanism_ok")
    s = targets.select(F.col("name").alias("source"), F.col("n").alias("sn"))
    j = contracts.join(dup, "id").join(t, "target", "left").join(s, "source", "left")
    for side in ("source", "target"):
        if freshness is not None:
            j = j.join(freshness.select(F.col("name").alias(side), F.col("state").alias(f"{side}_state")), side, "left")
        else:
            j = j.withColumn(f"{side}_state", F.lit("fresh"))
    if observations is not None:
        states = scenario_outcomes(contracts, observations)
        names = lambda st: F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") == st, F.col("scenario")))), ",")
        j = j.join(states.groupBy("id").agg(names("observed").alias("observed"), names("missing").alias("missing"), names("failed").alias("failed")), "id", "left")
    else:
        j = j.withColumns({"observed": F.lit(""), "missing": F.lit(""), "failed": F.lit("")})
    bound = lambda n, who: F.when(F.coalesce(n, F.lit(0)) == 0, f"missing{who}").when(n > 1, f"ambiguous{who}")
    status = (
        F.when(F.col("dup") | ~valid, "invalidContract")
        .when(F.col("source").isNotNull() & bound(F.col("sn"), "Source").isNotNull(), bound(F.col("sn"), "Source"))
        .when(bound(F.col("tn"), "Target").isNotNull(), bound(F.col("tn"), "Target"))
        .when(~F.coalesce("mechanism_ok", F.lit(True)), "invalidMechanism")
        .when(F.col("source").isNotNull() & (F.coalesce("source_state", F.lit("unknown")) != "fresh"), "unverifiedSource")
        .when(F.coalesce("target_state", F.lit("unknown")) != "fresh", "unverifiedTarget")
    )
    if observations is None:
        status = status.otherwise("declared")
    elif not plan_matches:
        status = status.otherwise("staleObservations")
    else:
        status = status.when(F.col("failed") != "", "failed").when(F.col("missing") == "", "observed").otherwise("unobserved")
    return j.select("id", status.alias("status"), "observed", "missing", "failed")


def unexpected_contracts(contracts: DataFrame, observations: DataFrame) -> DataFrame:
    return observations.select(F.col("contract").alias("id")).distinct().join(contracts.select("id"), "id", "left_anti")


def trace_connections(events: DataFrame, symbols: DataFrame, evidence_fresh: bool = True) -> DataFrame:
    """source, target, kind, ordinals, n: events (ordinal, caller, callee, kind) whose both ends resolve to one
    symbol each. Stale evidence of any part makes all of it void."""
    one = symbols.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    e = events if evidence_fresh else events.limit(0)
    e = e.join(one.select(F.col("name").alias("caller"), F.col("id").alias("source")), "caller").join(one.select(F.col("name").alias("callee"), F.col("id").alias("target")), "callee")
    return e.groupBy("source", "target", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_set("ordinal")), lambda x: x.cast("string")), ",").alias("ordinals"), F.count_distinct("ordinal").alias("n"))


def match_external(retentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """retentions (ordinal, usr, qualifiedName) with id and status: by usr, else by qualified name, else by name;
    several nodes of a name are ambiguous, none unmatched."""
    q = F.when(F.coalesce("module", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws(".", "module", "name"))
    by = lambda key, c: nodes.select(key.alias(c), "id").groupBy(c).agg(F.count_distinct("id").alias(f"n_{c}"), F.min("id").alias(f"id_{c}"))
    j = retentions.join(by(F.col("id"), "usr"), "usr", "left").join(by(q, "qualifiedName"), "qualifiedName", "left")
    names = by(F.col("name"), "short")
    j = j.withColumn("short", F.element_at(F.split("qualifiedName", r"\."), -1)).join(names, "short", "left")
    n = F.coalesce("n_usr", "n_qualifiedName", "n_short", F.lit(0))
    return j.select("ordinal", "usr", "qualifiedName", F.when(n == 1, F.coalesce("id_usr", "id_qualifiedName", "id_short")).alias("id"), F.when(n == 0, "unmatched").when(n > 1, "ambiguous").otherwise("matched").alias("status"))
