"""Placement with every rule: hard filters, coarse top-k, operation cap, service levels, costs, risk and profitability.

What a request asks of nodes alone is its class (bits, trust, system, memory, plugin). Classes find their nodes by an inverted
index and keep a short list of the best by pressure, for each set of contents that nodes hold. A class with the contents asked for
(or the one node, of a request that stays on its own) and the task's type and bucket is a look: it fixes which candidates are
evaluated, and all of their costs that don't depend on the request's own session, levels and times. A look reads the short lists
of its class and contents only: content is the one bonus that the coarse order knows, so a node of the true top-k is among the
best k by pressure of those that hold the same of its contents. Looks grow with the requests at most, and each request meets its
look's candidates as one array: it is shuffled once, whatever number of candidates it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.fleet import has_bits
from fleetlens.operators.folds import fold

CLASS = ["required_bits", "minimum_trust", "required_os", "required_abi", "required_memory", "required_vram", "required_generation"]
#: A request's service level; the last two are optional and count for streams only.
LEVELS = ["deadline", "max_p95", "max_p99", "max_jitter", "max_failure", "max_ttft", "max_steady"]
KIND = [
    *CLASS, "task_type", "input_bucket", "latency_class", "local_only", "local_bound", "local_idx", "minimum_quality", "exact", "streaming", "session_idx", "migration", "dag_cross", "dag_benefit",
    "content_a", "content_b", *LEVELS,
]
#: What a request's candidates depend on; home is its own node if it has to stay there, and contents count if it hasn't.
LOOK = [*CLASS, "task_type", "input_bucket", "local_only", "home", "wanted_a", "wanted_b"]


@dataclass(frozen=True)
class Limits:
    """Bounds of the scheduler, for all requests."""

    top_k: int = 4
    max_operations: int = 12
    samples: int = 20


def bits_of(column: str, width: int) -> Column:
    """The masks of the bits that are set, ascending."""
    return F.filter(F.array(*[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(width)]), lambda m: F.col(column).cast("long").bitwiseAND(m) != 0)


def supply(nodes: DataFrame, width: int = 8) -> DataFrame:
    """mask and nodes: how many own each bit."""
    return nodes.select(F.explode(bits_of("bits", width)).alias("mask")).groupBy("mask").agg(F.count("*").alias("nodes"))


def with_required_bits(needs: DataFrame, nodes: DataFrame, width: int = 8) -> DataFrame:
    """needs x nodes that own all required_bits, by an inverted index: a requirement looks up the nodes of its rarest bit
    and checks the others there; one that asks for nothing looks up mask 0, under which every node is filed."""
    filed = nodes.withColumn("mask", F.explode(F.array_union(F.array(F.lit(0).cast("long")), bits_of("bits", width))))
    asked = needs.select("required_bits").distinct().withColumn("bit", F.explode_outer(bits_of("required_bits", width)))
    rarest = asked.join(supply(nodes, width), F.col("bit") == F.col("mask"), "left").groupBy("required_bits").agg(F.min(F.struct(F.coalesce("nodes", F.lit(0)).alias("n"), F.coalesce("bit", F.lit(0).cast("long")).alias("mask")))["mask"].alias("mask"))
    return needs.join(rarest, "required_bits").join(filed, "mask").where(has_bits(F.col("bits"), F.col("required_bits"))).drop("mask")


def as_one(columns: list[str]) -> Column:
    """One short digest for some columns, nulls included: what is the same in all of them has the same one.

    It comes out of an explode() of one element, as the optimiser would otherwise derive constraints from every way of
    writing its columns through their own definitions.
    """
    return F.explode(F.array(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))))


def with_look(requests: DataFrame) -> DataFrame:
    """requests with LOOK and look, one digest of it."""
    own = {"home": F.when(F.col("local_only"), F.col("local_idx")), "wanted_a": F.when(~F.col("local_only"), F.col("content_a")), "wanted_b": F.when(~F.col("local_only"), F.col("content_b"))}
    return requests.withColumns(own).withColumn("look", as_one(LOOK))


def with_kind(requests: DataFrame) -> DataFrame:
    """requests with kind, one digest for all that a request asks of nodes and variants."""
    return requests.withColumn("kind", as_one(KIND))


def hard_nodes(pairs: DataFrame) -> DataFrame:
    """The pairs of a class and a node that own the bits which pass the node's hard filter."""
    optional = lambda need, have: F.col(need).isNull() | (F.col(need) == F.col(have))
    return pairs.where(
        (F.col("health") == "healthy") & (F.col("identity") == "active") & F.col("integrity") & (F.col("trust") >= F.col("minimum_trust")) & optional("required_os", "os") & optional("required_abi", "abi")
        & (F.col("memory") >= F.col("required_memory")) & (F.col("vram") >= F.col("required_vram"))
    )


def with_plugin(pairs: DataFrame) -> DataFrame:
    """The pairs whose node has a variant of the plugin generation that is asked for, if one is."""
    return pairs.where(F.col("required_generation").isNull() | F.array_contains("generations", F.col("required_generation"))).drop("generations")


def hard_variants() -> Column:
    """What of a variant's hard filter its look decides: bits, memory, plugin generation."""
    fits = has_bits(F.col("bits"), F.col("need")) & (F.col("peak_memory") <= F.col("memory")) & (F.col("peak_vram") <= F.col("vram"))
    return fits & (F.col("required_generation").isNull() | (F.col("generation") == F.col("required_generation")))


def good_enough(c: Column) -> Column:
    """What of candidate c's hard filter the request decides: quality."""
    return (c["quality"] >= F.col("minimum_quality")) & (~F.col("exact") | (c["quality"] >= 1.0))


def total_cost() -> Column:
    """A variant's cost without energy and streaming latencies."""
    return F.col("queue") + F.col("rtt") + F.col("input_transfer") + F.col("execution") + F.col("output_transfer") + F.col("prewarm") + F.col("commit_cost") + F.col("recovery") + F.col("jitter")


def meets_levels(c: Column | None = None) -> Column:
    """A candidate (c, else the row's columns) within its request's service level; a stream's latencies count where the request
    bounds them."""
    of = lambda name: F.col(name) if c is None else c[name]
    bounded = lambda have, most: F.col(most).isNull() | F.coalesce(of(have) <= F.col(most), F.lit(False))
    return (
        (of("total") <= F.col("deadline")) & (of("p95") <= F.col("max_p95")) & (of("p99") <= F.col("max_p99")) & (of("jitter") <= F.col("max_jitter")) & (of("failure") <= F.col("max_failure"))
        & (~F.col("streaming") | (bounded("ttft", "max_ttft") & bounded("steady", "max_steady")))
    )


def rare_bits(nodes: DataFrame, least: int = 2) -> int:
    """The mask of the bits that no more than `least` nodes own: a row for each bit comes to the driver."""
    return sum(r["mask"] for r in supply(nodes, 64).where(F.col("nodes") <= least).collect())


def spare_rare(rare: int, penalty: float = 25.0) -> Column:
    """What using a node costs for each rare bit that it owns beyond the required ones."""
    spare = F.bit_count(F.col("bits").cast("long").bitwiseAND(F.lit(rare)).bitwiseAND(F.bitwise_not(F.col("required_bits").cast("long"))))
    return spare * F.lit(penalty)


def scarcity(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    """required_bits, idx and scarcity of every node that owns the required bits."""
    return with_required_bits(needs, nodes, 64).select("required_bits", "idx", spare_rare(rare_bits(nodes)).alias("scarcity"))


#: Where a node may stand out: by both contents, by either, or by none.
SPOTS = [(True, True), (True, False), (False, True), (False, False)]


def spots(a: str, b: str) -> list[Column]:
    """A key for each of SPOTS; null where a content that it names is."""
    return [F.concat(F.lit(f"{int(with_a)}{int(with_b)}"), *[F.concat(F.lit("/"), F.col(c).cast("string")) for c, on in ((a, with_a), (b, with_b)) if on]) for with_a, with_b in SPOTS]


def short_lists(kinds: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """kinds (kind, CLASS, local_only, local_idx, content_a, content_b) with the columns of the first `top` nodes of each in the
    coarse order and their place (from 1): pressure, less 5 for each content that the node holds; ties go to the smaller node_id.
    nodes have generations, those of their variants."""
    names = kinds.columns
    kinds = kinds.withColumn("class", as_one(CLASS))
    own = ["idx", "node_id", "pressure", "bits", "memory", "vram", "has_a", "has_b"]
    fits = with_plugin(hard_nodes(with_required_bits(kinds.select("class", *CLASS).distinct(), nodes, 64))).select("class", *own)
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pressure", "node_id"))
    near = fits.withColumn("rank", best("class", "has_a", "has_b")).where(F.col("rank") <= top)
    listed = [F.lit(True), best("class", "has_a") <= top, best("class", "has_b") <= top, best("class") <= top]
    near = near.withColumns({f"in_{i}": x for i, x in enumerate(listed)})
    near = near.withColumn("spot", F.explode(F.array(*[F.when(F.col(f"in_{i}"), key) for i, key in enumerate(spots("has_a", "has_b"))]))).select("class", "spot", *own)
    asked = kinds.where("not local_only").withColumn("spot", F.explode(F.array(*spots("content_a", "content_b"))))
    a, b = F.coalesce(F.col("has_a") == F.col("content_a"), F.lit(False)), F.coalesce(F.col("has_b") == F.col("content_b"), F.lit(False))
    # A node that holds more of the contents than a spot names is found at another spot.
    found = asked.join(near, ["class", "spot"]).where((F.substring("spot", 1, 2) == F.concat(a.cast("int").cast("string"), b.cast("int").cast("string"))))
    found = found.withColumn("coarse", F.col("pressure") - 5.0 * (a.cast("int") + b.cast("int")))
    at_home = kinds.where("local_only").join(nodes, F.col("idx") == F.col("local_idx")).where(has_bits(F.col("bits"), F.col("required_bits")))
    at_home = with_plugin(hard_nodes(at_home)).withColumn("coarse", F.col("pressure").cast("double"))
    columns = [*names, *own, "coarse"]
    place = F.row_number().over(Window.partitionBy("kind").orderBy("coarse", "node_id"))
    return found.select(*columns).unionByName(at_home.select(*columns)).withColumn("place", place).where(F.col("place") <= top)


#: What a request needs to know of a candidate.
KNOWN = ["node_id", "number", "variant_id", "idx", "quality", "total", "p95", "p99", "jitter", "failure", "ttft", "steady", "at_home", "away", "doubt", "spare", "energy"]


def candidates(looks: DataFrame, nodes: DataFrame, variants: DataFrame, predictions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """look, evaluated (how many variants are looked at for it, in order of evaluation) and found, KNOWN of those that pass the
    hard filter as far as the look decides it: costs up to the commit's and the expected recovery's, on the request's own node
    (at_home) and on another (away)."""
    plugins = variants.groupBy("idx").agg(F.collect_set("generation").alias("generations"))  # the plugin index, by node
    known = nodes.join(plugins, "idx").withColumnsRenamed({"content_a": "has_a", "content_b": "has_b"})
    kinds = looks.withColumnsRenamed({"look": "kind", "home": "local_idx", "wanted_a": "content_a", "wanted_b": "content_b"})
    near = short_lists(kinds, known, min(limits.top_k, limits.max_operations))
    rows = near.join(variants, "idx").withColumn("number", F.row_number().over(Window.partitionBy("kind").orderBy("place", "v"))).where(F.col("number") <= limits.max_operations)
    rows = rows.withColumn("total", total_cost())
    rows = rows.join(predictions, ["task_type", "variant_id", "input_bucket"], "left")
    rows = rows.withColumns({
        "failure": F.greatest(F.coalesce("failure", "base_failure"), "base_failure"), "p50": F.coalesce("p50", "execution"),
        "p95": F.coalesce("p95", F.col("execution") + F.col("jitter")), "p99": F.coalesce("p99", F.col("execution") + 2 * F.col("jitter")), "doubt": F.coalesce("doubt", F.lit(1.0)),
        "spare": spare_rare(rare_bits(nodes)),
    })
    cost = lambda transfer: F.col("queue") + F.col("rtt") + transfer + F.col("prewarm") + F.col("p50") + F.col("commit_cost") + F.col("jitter") + F.col("failure") * F.col("recovery")
    rows = rows.withColumns({"at_home": cost(F.lit(0.0)), "away": cost(F.col("input_transfer") + F.col("output_transfer"))})
    return rows.groupBy(F.col("kind").alias("look")).agg(F.count("*").alias("evaluated"), F.collect_list(F.when(hard_variants(), F.struct(*KNOWN))).alias("found"))


def ranked(c: Column) -> Column:
    """Candidate c as its request sees it, in the order of the best: risk_cost, node_id, number, ..."""
    is_local = c["idx"] == F.col("local_idx")
    moved = F.when(F.col("session_idx").isNull(), 0.0).when(F.col("session_idx") == c["idx"], -F.least(F.col("migration"), c["total"] * 0.25)).otherwise(F.col("migration"))
    remote = F.when(is_local, c["at_home"]).otherwise(c["away"]) + moved + F.greatest(F.lit(0.0), F.col("dag_cross") - F.col("dag_benefit"))
    urgent = F.col("latency_class").isin("cluster_safety", "hard_realtime", "soft_realtime")
    beyond = c["doubt"] * F.when(urgent, 50.0).otherwise(10.0)
    # The sum goes from left to right, as doubles add up differently in another order.
    risk = remote + F.greatest(F.lit(0.0), 1 - c["quality"]) * 1000 + c["spare"] + beyond + c["energy"]
    return F.struct(risk.alias("risk_cost"), c["node_id"].alias("node_id"), c["number"].alias("number"), c["variant_id"].alias("variant_id"), remote.alias("remote_cost"), is_local.alias("is_local"))


def place(requests: DataFrame, nodes: DataFrame, variants: DataFrame, predictions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each request: status (placed, unavailable or invalid), the best candidate, its fallbacks and margin."""
    requests = with_look(requests)
    lists = candidates(requests.select("look", *LOOK).distinct(), nodes, variants, predictions, limits)
    stays = F.col("local_only") | F.col("local_bound") | (F.col("local_cost") <= F.col("small_task")) | (F.col("latency_class") == "hard_realtime")
    needed = ["task_id", "look", "local_idx", "session_idx", "migration", "dag_cross", "dag_benefit", "latency_class", "minimum_quality", "exact", "streaming", *LEVELS, "local_cost", "safety_margin"]
    joined = requests.select(*needed, finite_request().alias("valid"), stays.alias("stays")).join(lists, "look", "left")
    fit = F.transform(F.filter("found", lambda c: F.coalesce(good_enough(c) & meets_levels(c), F.lit(False))), ranked)
    good = F.filter(fit, lambda c: c["is_local"] | (~F.col("stays") & (F.col("local_cost") > c["remote_cost"] + F.col("safety_margin"))))
    joined = joined.select("task_id", "valid", "local_cost", "safety_margin", "evaluated", F.when(F.col("valid"), good).alias("good"))
    joined = joined.withColumns({"first": F.array_min("good"), "many": F.size("good")})
    first = F.col("first")
    status = F.when(~F.col("valid"), "invalid").when(first.isNull(), "unavailable").otherwise("placed")
    return joined.select(
        "task_id", status.alias("status"), first["node_id"].alias("node_id"), first["variant_id"].alias("variant_id"), first["risk_cost"].alias("risk_cost"), first["remote_cost"].alias("remote_cost"),
        F.when(first.isNotNull(), F.least(F.col("many") - 1, F.lit(limits.top_k))).cast("long").alias("fallbacks"), F.when(F.col("valid"), F.coalesce("evaluated", F.lit(0))).cast("long").alias("evaluated"),
        F.when(first.isNotNull(), F.col("local_cost") - first["remote_cost"] - F.col("safety_margin")).alias("margin"),
    )


#: The numbers of a request that must be finite, and those of them that may not be negative.
FINITE = ["local_cost", "safety_margin", "small_task", "migration", "dag_cross", "dag_benefit", "deadline", "max_p95", "max_p99", "max_jitter", "max_failure", "minimum_quality"]
NOT_NEGATIVE = ["local_cost", "safety_margin", "minimum_quality", "max_failure"]


def finite_request() -> Column:
    """All of a request's numbers are there and finite, and those that must be are not negative."""
    out = F.lit(True)
    for c in FINITE:
        v = F.col(c).cast("double")
        out = out & ~F.isnan(v) & (F.abs(v) < float("inf"))
    for c in NOT_NEGATIVE:
        out = out & (F.col(c) >= 0)
    return F.coalesce(out, F.lit(False))


#: The ten keys of scheduling priority, all descending.
PRIORITY = ["safety", "recovery", "class_rank", "local_origin", "deadline", "dag", "unlock", "business", "age", "fair_share"]


def priority_order(tasks: DataFrame, queue: str) -> DataFrame:
    """tasks with place: the order in which each queue gives them out; ties go to the smaller task_id."""
    return tasks.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(*[F.desc(c) for c in PRIORITY], "task_id")))


@dataclass(frozen=True)
class LocalBudget:
    """A node's resources, and the parts of them that remote work may not take."""

    cpu: int = 8
    memory: int = 200
    vram: int = 60
    threads: int = 8
    kept_cpu: int = 4
    kept_memory: int = 80
    kept_vram: int = 20
    kept_threads: int = 4
    pressure: int = 70
    version: int = 1


def admit_reservations(rows: DataFrame, budget: LocalBudget = LocalBudget()) -> DataFrame:
    """node, tick, outcome and the cpu and memory held after it (node, reservation_id, cpu, memory, vram, threads, remote,
    version, pressure, tick, lasts). What has run out leaves first; an id that comes again replaces its reservation, but is
    counted beside it when it is admitted."""
    b = budget

    def step(live: dict, r: dict) -> tuple:
        for gone in [i for i, x in live.items() if x[4] <= r["tick"]]:
            del live[gone]
        cpu, memory, vram, threads = (sum(x[k] for x in live.values()) for k in range(4))
        kept = (b.kept_cpu, b.kept_memory, b.kept_vram, b.kept_threads) if r["remote"] else (0, 0, 0, 0)
        if r["version"] != b.version:
            outcome = "capability_changed"
        elif r["lasts"] <= 0:
            outcome = "retry_after"
        elif r["remote"] and r["pressure"] >= b.pressure:
            outcome = "overloaded"
        elif memory + r["memory"] > b.memory - kept[1] or vram + r["vram"] > b.vram - kept[2]:
            outcome = "insufficient_memory"
        elif cpu + r["cpu"] > b.cpu - kept[0] or threads + r["threads"] > b.threads - kept[3]:
            outcome = "overloaded"
        else:
            outcome = "accept"
            live[r["reservation_id"]] = (r["cpu"], r["memory"], r["vram"], r["threads"], r["tick"] + r["lasts"])
        return r["node"], r["tick"], outcome, sum(x[0] for x in live.values()), sum(x[1] for x in live.values())

    return fold(rows, ["node"], ["tick"], dict, step, "node long, tick long, outcome string, cpu long, memory long")
