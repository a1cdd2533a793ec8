"""Graph operators on node and edge tables; fixpoints run in rounds over durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import drop_materialized, materialize


#: Steps of a loop that one written table takes together; fewer jobs, the same result.
STEPS = 3


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(child, parent) -> all (node, ancestor, distance); distances double each round, shortest kept.

    The result has a row for every node and ancestor; to ask about some nodes only, see ``descendants``.
    """
    cur = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).where("node <> ancestor").distinct(), "closure")
    n = cur.count()
    for _ in range(max_rounds):
        b = cur.select(F.col("node").alias("_m"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
        longer = cur.join(b, F.col("ancestor") == F.col("_m")).select("node", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        new = materialize(cur.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "closure")
        drop_materialized(cur)
        m = new.count()
        cur = new
        if m == n:
            return cur
        n = m
    raise RuntimeError("the closure did not settle")


def peeled(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without parents and nodes without children are taken away until none is left of either.

    Nothing is left of an acyclic graph; else the cycles and the ways between them.
    """
    cur = materialize(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "peeled")
    n = cur.count()
    while n:
        # Each side is read once a round, so the plan stays small.
        d = cur.join(cur.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        d = d.join(cur.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")
        new = materialize(d, "peeled")
        drop_materialized(cur)
        cur, m = new, new.count()
        if m == n:
            break
        n = m
    return cur


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves; an acyclic graph gives none.

    Kahn's peeling leaves the cycles and the ways between them; only there the reach of nodes is followed.
    """
    left = peeled(edges)
    loops = edges.where("child = parent").select(F.col("child").alias("node"))
    back = left.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    cur, n = materialize(back, "reach"), -1
    while (m := cur.count()) != n:
        n = m
        b = cur.select(F.col("node").alias("_m"), F.col("ancestor").alias("_a"))
        new = materialize(cur.unionByName(cur.join(b, F.col("ancestor") == F.col("_m")).select("node", F.col("_a").alias("ancestor"))).distinct(), "reach")
        drop_materialized(cur)
        cur = new
    return cur.where("node = ancestor").select("node").unionByName(loops).distinct()


def descendants(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(node) everything that depends on the given nodes, searched from these only."""
    seen = materialize(of.select("node").distinct(), "seen")
    front = seen
    while True:
        new = materialize(edges.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if not new.limit(1).count():
            return seen.join(of.select("node"), "node", "left_anti")
        both = materialize(seen.unionByName(new), "seen")
        drop_materialized(seen)
        if front is not seen:
            drop_materialized(front)
        seen, front = both, new


def unknown_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is no node."""
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on which nothing depends."""
    return nodes.select("node").join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def effective_parents(edges: DataFrame, retained: DataFrame) -> DataFrame:
    """Nearest retained ancestors: (child, parent) with hidden nodes between them skipped.

    Pairs already followed are left out of later rounds, so hidden cycles end too.
    """
    keep = retained.select(F.col("node").alias("parent")).withColumn("_kept", F.lit(True))
    flagged = materialize(edges.select("child", "parent").distinct().join(keep, "parent", "left").select("child", "parent", F.coalesce("_kept", F.lit(False)).alias("_kept")), "edges")
    step = flagged.select(F.col("child").alias("_h"), F.col("parent").alias("_p"), F.col("_kept").alias("_k"))
    # Only retained children are asked for.
    seen = materialize(flagged.join(retained.select(F.col("node").alias("child")).distinct(), "child", "left_semi"), "parents")
    front = seen
    while True:
        further = front.where("not _kept").join(step, F.col("parent") == F.col("_h")).select("child", F.col("_p").alias("parent"), F.col("_k").alias("_kept")).distinct()
        new = materialize(further.join(seen, ["child", "parent"], "left_anti").select("child", "parent", "_kept"), "hidden")
        if not new.limit(1).count():
            return seen.where("_kept").select("child", "parent")
        both = materialize(seen.unionByName(new), "parents")
        drop_materialized(seen)
        if front is not seen:
            drop_materialized(front)
        seen, front = both, new


def prune_to_fixpoint(approved: DataFrame, edges: DataFrame, entity: list[str]) -> DataFrame:
    """Approved (entity, state, turn) rows whose every dependency is approved at the same turn or before.

    A removal can break others, so rounds of anti joins run until none breaks; every round but the last removes rows.
    """
    cur = materialize(approved.select(*entity, "state", "turn"), "approved")
    n = cur.count()
    dep = edges.select(F.col("child").alias("state"), "parent")
    while True:
        have = cur.select(*entity, F.col("state").alias("parent"), F.col("turn").alias("_pt"))
        need = cur.join(dep, "state").join(have, [*entity, "parent"], "left")
        broken = need.where(F.col("_pt").isNull() | (F.col("_pt") > F.col("turn"))).select(*entity, "state").distinct()
        nxt = materialize(cur.join(broken, [*entity, "state"], "left_anti"), "approved")
        m = nxt.count()
        drop_materialized(cur)
        if m == n:
            return nxt
        cur, n = nxt, m


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest way up; raises for a graph with a cycle.

    Levels are peeled from the roots: a step raises the children of the nodes that moved in the step before, and one
    written table takes STEPS of them.  An acyclic graph of n nodes settles in n steps, so one that still moves
    then has a cycle.
    """
    n = nodes.count()
    e = materialize(edges.select("child", "parent").distinct(), "edges")
    cur = materialize(nodes.select("node", F.lit(0).alias("level"), F.lit(True).alias("_c")), "levels")
    steps = 0
    while True:
        d = cur
        for _ in range(STEPS):
            up = e.join(d.where("_c").select(F.col("node").alias("parent"), F.col("level").alias("_l")), "parent").groupBy(F.col("child").alias("node")).agg((F.max("_l") + 1).alias("_n"))
            d = d.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("_n", F.lit(0))).alias("level"), (F.coalesce("_n", F.lit(0)) > F.col("level")).alias("_c"))
        new = materialize(d, "levels")
        drop_materialized(cur)
        cur, steps = new, steps + STEPS
        if not new.where("_c").limit(1).count():
            drop_materialized(e)
            return new.select("node", "level")
        if steps > n:
            raise ValueError("the graph has a cycle")


def verify_states(events: DataFrame, states: list[dict], entity: list[str]) -> DataFrame:
    """First turn at which each state of a small graph is complete, per entity.

    ``states`` is configuration: id, depends_on, pattern (a regular expression on tool names) and min_count.
    A state is complete at the first turn by which, from the turn of its last completed dependency on,
    ``min_count`` successful matching events have happened; all checks only grow with the turn, so one
    pass per depth level of the graph replaces a loop over turns.  Input: entity, turn, tool, ok.
    """
    from pyspark.sql import Window

    level: dict[str, int] = {}
    by_id = {s["id"]: s for s in states}

    def depth(i: str, seen=()) -> int:
        if i in seen:
            raise ValueError(f"cycle through {i}")
        if i not in level:
            level[i] = 1 + max([depth(p, (*seen, i)) for p in by_id[i].get("depends_on", [])], default=-1)
        return level[i]

    for s in states:
        depth(s["id"])
    ents = events.select(*entity).distinct()
    done = None
    for lv in sorted(set(level.values())):
        for s in (x for x in states if level[x["id"]] == lv):
            deps = s.get("depends_on", [])
            if deps:
                ready = done.where(F.col("state").isin(deps)).groupBy(*entity).agg(F.count("turn").alias("_n"), F.max("turn").alias("ready")).where(F.col("_n") == len(deps))
            else:
                ready = ents.withColumn("ready", F.lit(0).cast("long"))
            hits = events.where(F.col("ok") & F.col("tool").rlike(s["pattern"])).join(ready, entity).where(F.col("turn") >= F.col("ready"))
            kth = hits.withColumn("_k", F.row_number().over(Window.partitionBy(*entity).orderBy("turn", "tool"))).where(F.col("_k") == s.get("min_count", 1))
            part = kth.select(*entity, F.lit(s["id"]).alias("state"), F.col("turn").cast("long").alias("turn"))
            done = part if done is None else done.unionByName(part)
        done = materialize(done, "states")
    return done


def replay_states(events: DataFrame, states: list[dict], entity: list[str]) -> DataFrame:
    """Order-free replay: a state passes if its own check passes over all events and all its dependencies pass."""
    counts = events.where("ok").groupBy(*entity).agg(*[F.count_if(F.col("tool").rlike(s["pattern"])).alias(f"c_{s['id']}") for s in states])
    base = events.select(*entity).distinct().join(counts, entity, "left")
    passed: dict[str, object] = {}
    todo = list(states)
    while todo:
        ready = [s for s in todo if all(p in passed for p in s.get("depends_on", []))]
        if not ready:
            raise ValueError("cycle or unknown dependency")
        for s in ready:
            ok = F.coalesce(F.col(f"c_{s['id']}"), F.lit(0)) >= s.get("min_count", 1)
            for p in s.get("depends_on", []):
                ok = ok & passed[p]
            passed[s["id"]] = ok
            todo.remove(s)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("state"), p.alias("is_passed")) for i, p in passed.items()]))
    return base.select(*entity, rows.alias("r")).select(*entity, "r.state", "r.is_passed")


def fan_out(nodes: DataFrame, edges: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instantiate template nodes: one node per (node, resource), dependencies rewired to all instances."""
    n = nodes.join(instances, "node", "left").select("node", F.concat_ws("@", "node", "resource").alias("instance"))
    c, p = n.select(F.col("node").alias("child"), F.col("instance").alias("child_i")), n.select(F.col("node").alias("parent"), F.col("instance").alias("parent_i"))
    return n, edges.join(c, "child").join(p, "parent").select(F.col("child_i").alias("child"), F.col("parent_i").alias("parent")).distinct()


def insert_before(edges: DataFrame, target: str, new: str) -> DataFrame:
    """Put a node in front of ``target``: it takes over the target's dependencies, and the target depends on it."""
    moved = edges.withColumn("child", F.when(F.col("child") == target, F.lit(new)).otherwise(F.col("child")))
    return moved.unionByName(edges.sparkSession.createDataFrame([(target, new)], "child string, parent string")).distinct()


def without_descendants(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes left when the given nodes and everything that depends on them are removed."""
    down = descendants(edges, of)
    return nodes.select("node").join(down, "node", "left_anti").join(of.select("node"), "node", "left_anti")
