"""What-if questions over device and reservation snapshots (all sizes in MiB)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions import scan
from meterloom.session import settle

OVERCOMMIT_MARGIN_MIB = 512
DEFAULT_PRIORITY = 50
DEFAULT_LIFECYCLE = "on_demand"
#: Generations of a process tree kept as tables of their own before they are brought together.
GENERATIONS = 20


def slot_fit(wants: DataFrame, devices: DataFrame, reservations: DataFrame, freed: DataFrame, optimistic: bool = False) -> DataFrame:
    """Needed against available per (scenario, slot).

    `freed` lists (scenario, service) whose reservations do not count. Their sum
    is taken off the slot's total, so scenarios never multiply reservations.
    The optimistic form trusts the pledge book and ignores the device reading.
    """
    book = reservations.groupBy("slot").agg(F.sum("mib").alias("__reserved"))
    given = freed.distinct().join(reservations, "service").groupBy("scenario", "slot").agg(F.sum("mib").alias("__given"))
    joined = wants.join(devices, "slot", "left").join(book, "slot", "left").join(given, ["scenario", "slot"], "left")
    free = F.coalesce("free_mib", F.lit(0))
    total = F.coalesce("total_mib", free)
    pledged = F.coalesce("__reserved", F.lit(0)) - F.coalesce("__given", F.lit(0))
    room = F.greatest(total - pledged, F.lit(0))
    available = room if optimistic else F.least(free, room)
    return joined.select("scenario", "slot", F.col("want_mib").alias("needed_mib"), available.alias("available_mib"), (available >= F.col("want_mib")).alias("fits"))


def fit_check(slots: DataFrame) -> DataFrame:
    """One row per scenario: whether every slot fits, and the first that does not."""
    bad = F.when(~F.col("fits"), F.struct("slot", "needed_mib", "available_mib"))
    out = slots.groupBy("scenario").agg(F.bool_and("fits").alias("fits"), F.min(bad).alias("b"))
    return out.select("scenario", "fits", F.col("b.slot").alias("failing_slot"), F.col("b.needed_mib").alias("needed_mib"), F.col("b.available_mib").alias("available_mib"))


def shortfalls(slots: DataFrame) -> DataFrame:
    return slots.select("scenario", "slot", "needed_mib", "available_mib")


def evictable(priority: Column, idle: Column, lifecycle: Column, want_priority: Column, want_lifecycle: Column) -> Column:
    """Lower priority always yields; otherwise only idle services do, and an idle
    persistent one never to an on-demand request."""
    protected = (lifecycle == "persistent") & (want_lifecycle == "on_demand")
    return (priority < want_priority) | (idle & ~protected)


def eviction_set(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """The shortest prefix of evictable services that frees enough; nothing when none does.

    Order: idle first, lowest priority, smallest allocation. `requests`: scenario,
    slot, want_mib, free_mib, priority, lifecycle. `candidates`: service, slot,
    mib, idle, priority, lifecycle.
    """
    needed = F.col("want_mib") - F.col("free_mib")
    kind = ["slot", "want_priority", "want_lifecycle"]
    asked = requests.select(
        "scenario", "slot", needed.alias("needed"), F.col("priority").alias("want_priority"), F.col("lifecycle").alias("want_lifecycle")
    ).filter("needed > 0")
    # Who may be evicted depends on the kind of request only, so candidates are
    # ranked once per kind, however many requests ask.
    rows = asked.select(*kind).distinct().join(candidates.filter("mib > 0"), "slot").filter(
        evictable(F.col("priority"), F.col("idle"), F.col("lifecycle"), F.col("want_priority"), F.col("want_lifecycle"))
    )
    # Rank and size make one line, so that services of one rank are spread by their size.
    rank = F.when(F.col("idle"), 0).otherwise(256) + F.col("priority")
    ranked = rows.withColumn("place", rank * F.lit(1 << 40) + F.col("mib"))
    ranked = scan.running(ranked, kind, ["place", "service"], {"freed": scan.total(F.col("mib")), "taken": scan.count()}, width=256)
    ranked = settle(ranked.select(*kind, "service", "mib", "freed", "taken"), "evictable")
    # How far down the list a request reaches: requests and list positions share
    # one line by size, and each request reads the last position before it.
    none = F.lit(None).cast("long")
    marks = ranked.select(*kind, (F.col("freed") - F.col("mib")).alias("size"), F.lit(1).alias("side"), F.col("taken").alias("tie"), "taken")
    wants = asked.select(*kind, F.col("needed").alias("size"), F.lit(0).alias("side"), F.col("scenario").alias("tie"), none.alias("taken"))
    reach = scan.running(marks.unionByName(wants), kind, ["size", "side", "tie"], {"reach": scan.last_seen(F.col("taken"))}, width=1024)
    enough = ranked.groupBy(*kind).agg(F.max("freed").alias("every"))
    reached = reach.filter("side = 0 and reach is not null").join(enough, kind).filter("every >= size")
    each = reached.select(F.col("tie").alias("scenario"), *kind, F.explode(F.sequence(F.lit(1).cast("long"), F.col("reach"))).alias("taken"))
    return each.join(ranked, [*kind, "taken"]).select("scenario", "service", "mib", "freed")


def overcommitted(reservations: DataFrame, devices: DataFrame, margin: int = OVERCOMMIT_MARGIN_MIB) -> DataFrame:
    """(service, slot) pairs where the slot's pledges plus the margin exceed the device."""
    pledged = reservations.groupBy("slot").agg(F.sum("mib").alias("pledged_mib"))
    over = pledged.join(devices, "slot").filter(F.col("pledged_mib") + margin > F.col("total_mib")).select("slot", "pledged_mib", "total_mib")
    return reservations.select("service", "slot").distinct().join(over, "slot").select("service", "slot", "pledged_mib", "total_mib")


def contention(reservations: DataFrame, devices: DataFrame, services: DataFrame) -> DataFrame:
    """Each service on an over-committed device against its first peer in name order.

    The first peer is the smallest other name on any shared device, which the
    two smallest names per device already decide. `services`: service, priority,
    lifecycle (both may be null).
    """
    held = overcommitted(reservations, devices)
    on_slot = reservations.filter("mib > 0").groupBy("slot", "service").agg(F.count(F.lit(1)).alias("__n"))
    known = on_slot.join(services.select("service"), "service", "left_semi")
    low = scan.top_per_key(known, ["slot"], [F.asc("service")], 2).groupBy("slot").agg(F.min("service").alias("first"), F.max("service").alias("second"))
    near = held.join(low, "slot").select("service", F.when(F.col("first") != F.col("service"), F.col("first")).when(F.col("second") != F.col("service"), F.col("second")).alias("peer"))
    peers = near.filter(F.col("peer").isNotNull()).groupBy("service").agg(F.min("peer").alias("peer"))
    info = services.select("service", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("p"), F.coalesce("lifecycle", F.lit(DEFAULT_LIFECYCLE)).alias("l"))
    both = peers.join(info, "service").join(info.select(F.col("service").alias("peer"), F.col("p").alias("pp"), F.col("l").alias("pl")), "peer")
    wins = (F.col("p") > F.col("pp")) | ((F.col("p") == F.col("pp")) & (F.col("l") == "persistent") & (F.col("pl") == "on_demand"))
    return both.select("service", "peer", F.when(wins, "evict_peer").otherwise("yield_self").alias("verdict"))


def best_device(choices: DataFrame, devices: DataFrame) -> DataFrame:
    """The allowed device with most room per request, preferring those that reach the target.

    `choices`: request, slot, min_mib, prefer_mib (null = no preference).
    """
    rows = choices.join(devices.select("slot", "available_mib"), "slot").filter(F.col("available_mib") >= F.col("min_mib"))
    short = F.coalesce(F.col("available_mib") < F.col("prefer_mib"), F.lit(False))
    best = rows.groupBy("request").agg(F.min(F.struct(short.alias("s"), (-F.col("available_mib")).alias("a"), F.col("slot").alias("slot"))).alias("b"))
    return best.select("request", F.col("b.slot").alias("slot"), (-F.col("b.a")).alias("available_mib"))


def descendants(registered: DataFrame, processes: DataFrame) -> DataFrame:
    """Registered pids and everything below them: (tick, service, pid), each pid once.

    Walks one generation per round and stops when a round finds nobody new; pids
    already seen are left out, which also ends a parent loop in a torn snapshot.
    """
    keys = ["tick", "service", "pid"]
    frontier = settle(registered.select(*keys).distinct(), "pids")
    generations = [frontier]
    children = processes.select("tick", F.col("ppid").alias("__parent"), F.col("pid").alias("__child"))
    while True:
        below = frontier.join(children, (frontier["tick"] == children["tick"]) & (frontier["pid"] == children["__parent"])).select(
            frontier["tick"], "service", F.col("__child").alias("pid")
        )
        seen = reduce(DataFrame.unionByName, generations)
        frontier = settle(below.distinct().join(seen, keys, "left_anti"), "pids")
        if frontier.isEmpty():
            return seen
        generations.append(frontier)
        if len(generations) > GENERATIONS:
            # Many small tables make slow plans: bring what is seen together now and then.
            generations = [settle(reduce(DataFrame.unionByName, generations), "pids")]


def attribute_memory(registered: DataFrame, processes: DataFrame, gpu: DataFrame, cgroups: DataFrame | None = None) -> DataFrame:
    """Memory per (tick, service) over registered pids, their descendants and their cgroup.

    `processes`: tick, pid, ppid, cgroup, rss_total, rss_owned, rss_file. `gpu`:
    tick, pid, used_bytes. `cgroups`: service, cgroup. Ticks that attribute
    nothing are gaps, not zeroes, and are left out.
    """
    pids = descendants(registered, processes)
    if cgroups is not None:
        inside = processes.join(cgroups, "cgroup").select("tick", "service", "pid")
        pids = pids.unionByName(inside).distinct()
    vram = gpu.groupBy("tick", "pid").agg(F.sum("used_bytes").alias("__vram"))
    rss = processes.select("tick", "pid", "rss_total", "rss_owned", "rss_file")
    joined = pids.join(rss, ["tick", "pid"], "left").join(vram, ["tick", "pid"], "left")
    sums = joined.groupBy("tick", "service").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in [("__vram", "vram_bytes"), ("rss_total", "rss_total"), ("rss_owned", "rss_owned"), ("rss_file", "rss_file")]
    ])
    return sums.filter(F.col("vram_bytes") + F.col("rss_total") > 0)
