"""Operators on hand-computed fixtures, and conservation laws."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import aggregates as A
from tracelake.operators import chat as C
from tracelake.operators import graphs as G
from tracelake.operators import joins as J
from tracelake.operators import sampling as S
from tracelake.operators import selection as P
from tracelake.operators import sets as U
from tracelake.operators import windows as W
from tracelake.plans.advantage import advantages


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def turns(spark, data):
    return rows(spark, [("p", t, i, b, float(s)) for t, i, b, s in data], "prompt_id string, trajectory_id string, turn int, is_boundary int, score double")


def test_row_weighted_baseline(spark):
    t = turns(spark, [("long", 0, 0, 0), ("long", 1, 0, 0), ("long", 2, 0, 0), ("short", 0, 0, 1)])
    got = {(r.trajectory_id, r.turn): r.outcome_adv for r in advantages(t).collect()}
    assert got == {("long", 0): -0.25, ("long", 1): -0.25, ("long", 2): -0.25, ("short", 0): 0.75}


def test_local_advantage_and_zero_weight(spark):
    t = turns(spark, [("failed", 0, 0, 0), ("failed", 1, 0, 0), ("success", 0, 0, 0), ("success", 1, 1, 0)])
    got = {(r.trajectory_id, r.turn): r for r in advantages(t, weight=0.0).collect()}
    assert [got[k].local_adv for k in sorted(got)] == [0.0, 0.0, 0.0, 0.5]
    assert all(r.total_adv == r.outcome_adv for r in got.values())


def test_everyone_reaching_a_boundary_gets_nothing(spark):
    t = turns(spark, [("a", 0, 0, 0), ("a", 1, 1, 0), ("b", 0, 1, 1), ("b", 1, 0, 1)])
    got = advantages(t).collect()
    assert all(r.local_adv == 0 for r in got)
    assert sorted(r.outcome_adv for r in got) == [-0.5, -0.5, 0.5, 0.5]


def test_three_quantile_definitions(spark):
    d = rows(spark, [("g", x) for x in (4, 1, 3, 2)] + [("one", 7), ("one", None)], "g string, v int")
    up = {r.g: r.p50 for r in A.quantiles_upper(d, ["g"], "v").collect()}
    low = {r.g: r.p50 for r in A.quantiles_lower(d, ["g"], "v").collect()}
    lin = {r.g: (r.p50, r.p90) for r in A.quantiles_linear(d, ["g"], "v").collect()}
    assert (up["g"], low["g"]) == (3, 2) and lin["g"] == (2.5, pytest.approx(3.7)) and up["one"] == low["one"] == 7


def test_order_statistics_with_ties_match_sorting(spark):
    import random

    rng = random.Random(2)
    vals = [rng.randrange(9) for _ in range(501)]
    r = A.quantiles_lower(rows(spark, [("g", v) for v in vals], "g string, v int"), ["g"], "v").collect()[0]
    s = sorted(vals)
    assert [r.p50, r.p90, r.p99, r.total] == [s[500 * p // 100] for p in (50, 90, 99)] + [sum(vals)]


def test_mcnemar_and_holm(spark):
    d = rows(spark, [("a", 0, 0), ("b", 1, 5), ("c", 10, 10), ("d", 0, 6)], "k string, b int, c int")
    p = {r.k: r.p for r in d.select("k", A.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()}
    assert p["a"] == 1 and p["b"] == pytest.approx(2 * 7 / 64) and p["c"] == 1 and p["d"] == pytest.approx(2 / 64)
    h = A.holm(rows(spark, [("x", 0.01), ("y", 0.04), ("z", 0.03)], "k string, p double"), [], "p", "k")
    assert {r.k: round(r.p_holm, 6) for r in h.collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}


def test_consensus(spark):
    v = rows(spark, [("i", 1, "resolve", 2), ("i", 2, "resolve", 2), ("i", 3, "resolve", 3), ("i", 1, "answer", 4), ("i", 2, "answer", 5), ("i", 3, "noise", 1)], "item string, voter int, state string, turn int")
    got = {r.state: (r.n_votes, r.position) for r in A.vote_consensus(v, ["item"], "voter", "state", "turn").collect()}
    assert got == {"resolve": (3, 2), "answer": (2, 5)}  # upper median
    lab = rows(spark, [("i", "ok"), ("i", "error"), ("j", "ok"), ("j", "ok"), ("j", "error"), ("k", None)], "item string, label string")
    assert {r.item: r.consensus for r in A.label_consensus(lab, ["item"], "label", {"ok": 0, "error": 1}).collect()} == {"i": "error", "j": "ok"}


def test_precision_recall_empty_denominator(spark):
    d = rows(spark, [("a", False, False), ("b", True, False), ("b", True, True)], "f string, truth boolean, pred boolean")
    got = {r.f: (r.precision, r.recall) for r in A.precision_recall(d, [["f"]], "truth", "pred").collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.0, 0.5)}


def test_cofire(spark):
    d = rows(spark, [(1, "s1"), (1, "s2"), (1, "s2"), (1, "s3"), (2, "s1")], "u int, s string")
    e = rows(spark, [("s2", "s1")], "child string, parent string")
    assert {(r.state_a, r.state_b, r.n_units, r.is_dependent) for r in A.cofire(d, ["u"], "s", e).collect()} == {("s1", "s2", 1, True), ("s1", "s3", 1, False), ("s2", "s3", 1, False)}


def test_bins_partition_the_records(spark):
    d = spark.range(0, 60).select(A.binned(F.col("id"), [0, 5, 10, 20]).alias("b")).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in d} == {"0": 1, "1-5": 5, "6-10": 5, "11-20": 10, "21+": 39}


def test_runs_and_segments(spark):
    d = rows(spark, [("t", i, b) for i, b in enumerate([0, 1, 1, 0, 1])], "t string, i int, b int")
    r = W.runs(d.withColumn("f", F.col("b") == 1), ["t"], "i", "f").collect()
    assert sorted((x.run_start, x.run_end) for x in r) == [(1, 3), (4, 5)]
    s = {x.i: (x.segment_id, x.distance, round(x.decayed_reward, 3), x.role) for x in W.segments(rows(spark, [("t", i, b) for i, b in enumerate([0, 0, 1, 0])], "t string, i int, b int"), ["t"], "i", "b").collect()}
    assert s == {0: (0, 2, 9.025, "backfill"), 1: (0, 1, 9.5, "backfill"), 2: (0, 0, 10.0, "boundary"), 3: (1, None, 0.0, "none")}


def test_rolling_median(spark):
    d = rows(spark, [("t", i, float(v)) for i, v in enumerate([5, 1, 9, 3])], "t string, i int, v double")
    got = [r.rolling_median for r in W.rolling(d, ["t"], "i", "v", 3, 2).orderBy("i").collect()]
    assert got == [3.0, 5.0, 3.0, 6.0]


def test_resolve_owner(spark):
    chain = [(i, i - 1 if i else None, "root" if i == 0 else None) for i in range(32)]
    odd = [(100, 100, None), (101, 999, None), (102, 103, "self"), (103, None, "above")]
    got = {r.id: (r.owner, r.hops) for r in J.resolve_owner(rows(spark, chain + odd, "id int, parent int, owner string"), 30).collect()}
    assert got[30] == ("root", 30) and got[31] == (None, None) and got[100] == (None, None) and got[101] == (None, None) and got[102] == ("self", 0)


def test_running_total_over_partitions(spark):
    d = spark.range(1, 1001).select(F.col("id").alias("k"), F.col("id").alias("v")).repartition(8)
    got = {r.k: r.t for r in J.running_total(d, ["k"], "v", "t").collect()}
    assert all(got[k] == k * (k + 1) // 2 for k in got) and len(got) == 1000


def test_ordinal_join_and_asof(spark):
    a = rows(spark, [("r", "x", 1), ("r", "x", 2), ("r", "y", 3)], "r string, n string, i int")
    b = rows(spark, [("r", "x", 7)], "r string, n string, s int")
    assert {(x.i, x.s) for x in J.ordinal_join(a, b, ["r", "n"], ["i"], ["s"]).collect()} == {(1, 7), (2, None), (3, None)}
    e = rows(spark, [("r", "sub", 1, None), ("r", "sub", 2, 4), ("r", "sub", 3, None), ("r", "top", 4, None), ("r", "lone", 5, None)], "r string, s string, o int, t int")
    got = {x.o: x.anchor for x in J.anchor_asof(e, ["r"], "s", ["o"], "t", F.col("s") == "top").collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: None, 5: 4}


def test_last_wins_with_nulls_and_repeats(spark):
    d = rows(spark, [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n")], "k string, o int, v string")
    assert {r.k: (r.v, r.n_versions) for r in J.last_wins(d, "k", ["o"]).collect()} == {"a": ("y", 3), "b": ("z", 1), None: ("n", 1)}


def test_splits_are_stable_under_permutation(spark):
    d = rows(spark, [(f"s{i % 4}", f"k{i}") for i in range(61)] + [("single", "only")], "s string, k string")
    one = {tuple(r) for r in S.stable_split(d, "s", "k", "seed", 0.2).collect()}
    two = {tuple(r) for r in S.stable_split(d.orderBy(F.desc("k")).repartition(5), "s", "k", "seed", 0.2).collect()}
    assert one == two and ("single", "only", "proposal") in one
    three = S.stable_three_way(d, "s", "k", "seed", 0.1, 0.1).collect()
    assert {r.split for r in three if r.s == "s0"} == {"test", "dev", "proposal"} and len(three) == 62


def test_group_fill_keeps_groups_whole(spark):
    d = rows(spark, [(f"g{i % 20}",) for i in range(400)], "g string")
    # 50 rows are asked for, but never more than a tenth of all rows.
    for target, least in ((50, 40), (30, 30)):
        s = S.group_fill_split(d, "g", "x", target).collect()
        v = sum(r.n for r in s if r.split == "validation")
        assert len(s) == 20 and least <= v < least + 20


def test_round_robin_and_diverse(spark):
    d = rows(spark, [("a", "1", True), ("a", "2", False), ("a", "3", True), ("b", "4", False)], "g string, k string, ok boolean")
    assert [(r.g, r.k) for r in S.round_robin(d, "g", ["k"], 3).collect()] == [("a", "1"), ("b", "4"), ("a", "2")]
    assert {(r.g, r.k) for r in S.outcome_diverse(d, "g", "ok", [F.asc("k")], 2).collect()} == {("a", "1"), ("a", "2"), ("b", "4")}


def test_multiset_diff_conserves(spark):
    b, a = rows(spark, [(x,) for x in "aabbc"], "k string"), rows(spark, [(x,) for x in "abbd"], "k string")
    d = U.multiset_diff(b, a, "k").collect()
    assert {(r.k, r.removed, r.added) for r in d} == {("a", 1, 0), ("c", 1, 0), ("d", 0, 1)}
    assert 5 == 4 + sum(r.removed for r in d) - sum(r.added for r in d)


def test_graph_closure_cycle_and_effective(spark):
    e = rows(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("d", "x")], "child string, parent string")
    n = rows(spark, [(x,) for x in "abcd"], "node string")
    assert {(r.node, r.ancestor, r.distance) for r in G.closure(e).where("node = 'd'").collect()} == {("d", "c", 1), ("d", "x", 1), ("d", "b", 2), ("d", "a", 3)}
    assert {r.parent for r in G.unknown_dependencies(n, e).collect()} == {"x"}
    assert {r.node for r in G.sinks(n, e).collect()} == {"d"}
    cyc = e.unionByName(rows(spark, [("a", "c")], "child string, parent string"))
    assert {r.node for r in G.cyclic_nodes(cyc).collect()} == {"a", "b", "c"} and not G.cyclic_nodes(e).collect()
    kept = rows(spark, [("a",), ("d",)], "node string")
    assert {tuple(r) for r in G.effective_parents(e, kept).collect()} == {("d", "a")}
    assert {r.node for r in G.without_descendants(n, e, rows(spark, [("c",)], "node string")).collect()} == {"a", "b"}


def test_pruning_cascades(spark):
    ap = rows(spark, [("t", "s1", 5), ("t", "s2", 4), ("t", "s3", 6), ("u", "s1", 1), ("u", "s2", 1)], "q string, state string, turn int")
    e = rows(spark, [("s2", "s1"), ("s3", "s2")], "child string, parent string")
    assert {tuple(r) for r in G.prune_to_fixpoint(ap, e, ["q"]).collect()} == {("t", "s1", 5), ("u", "s1", 1), ("u", "s2", 1)}


def test_verify_states_against_a_turn_loop(spark):
    import random

    states = [{"id": "a", "pattern": "^x$"}, {"id": "b", "depends_on": ["a"], "pattern": "^y$", "min_count": 2}, {"id": "c", "depends_on": ["a", "b"], "pattern": "^[xz]$"}]
    rng = random.Random(4)
    data = [(f"r{r}", t, rng.choice("xyz"), rng.random() < 0.8) for r in range(25) for t in range(rng.randrange(1, 12))]
    want = set()
    for r in {d[0] for d in data}:
        done: dict = {}
        for t in range(12):
            for s in states:  # several states may close in one turn, in node order
                deps = s.get("depends_on", [])
                if s["id"] in done or any(p not in done for p in deps):
                    continue
                lo = max([done[p] for p in deps], default=0)
                import re

                if sum(ok and lo <= u <= t and bool(re.search(s["pattern"], n)) for q, u, n, ok in data if q == r) >= s.get("min_count", 1):
                    done[s["id"]] = t
        want |= {(r, k, v) for k, v in done.items()}
    ev = rows(spark, data, "r string, turn int, tool string, ok boolean")
    assert {tuple(x) for x in G.verify_states(ev, states, ["r"]).collect()} == want


def test_chat_operators(spark):
    roles = ["system", "user", "assistant", "tool_call", "tool_call", "tool_response", "tool_call", "tool_response", "assistant"]
    m = rows(spark, [("c", i, r, f"m{i}", None) for i, r in enumerate(roles)], "record_id string, msg_pos int, msg_role string, content string, loss boolean")
    b = C.bare_call_groups(m).collect()[0]
    n = C.normalised(m).orderBy("position").collect()
    assert (b.n_bare_groups, b.n_assistant) == (1, 2) and sum(r.role == "assistant" for r in n) == 3
    assert n[2].calls == ["m3", "m4"] and n[2].content == "m2" and n[4].calls == ["m6"] and n[4].content is None
    cl = C.claimed_responses(m).collect()
    assert sorted((r.call_pos, r.response_pos) for r in cl if r.response_pos is not None) == [(3, 5), (4, 7)]
    s = C.supervised(m)
    assert [r.msg_pos for r in s.where("is_supervised").orderBy("msg_pos").collect()] == [2, 8]
    f = C.longest_fitting_prefix(s, F.length("content"), 10).collect()[0]
    assert (f.n_kept, f.last_pos, f.n_dropped_turns) == (6, 2, 1)


def test_shifted_labels(spark):
    d = rows(spark, [([5, 6, 7], [0, 1, 1]), ([9], [1])], "t array<int>, m array<int>")
    lab, mask = C.shifted_labels(F.col("t"), F.col("m"))
    assert [(r.l, r.k) for r in d.select(lab.alias("l"), mask.alias("k")).collect()] == [([6, 7, 0], [1, 1, 0]), ([0], [0])]


def test_label_shift_takes_long_messages(spark, tmp_path):
    from tracelake.plans import chats as Q

    texts = ["one three fives", "a", "", None, "word to tokens " * 400, "x" * 201]
    data = [(i, "r", i, "user", t, None, None, None, None) for i, t in enumerate(texts)]
    rows(spark, data, "message_id long, record_id string, msg_pos int, msg_role string, content string, loss boolean, tool_call_id string, provider_id string, ingested_at timestamp").write.parquet(f"{tmp_path}/chat_messages.parquet")
    want = {}
    for i, t in enumerate(texts):
        if t is not None:
            tok = [len(x) for x in t.split(" ")]
            mask = [int(x > 3) for x in tok[1:]] + [0]
            labels = [n if m else 0 for n, m in zip(tok[1:] + [0], mask)]
            want[i] = tuple(",".join(map(str, x)) for x in (mask, labels, range(len(tok)), (tok + [0] * 8)[:8]))
    got = {r.message_id: (r["mask"], r["labels"], r["position_ids"], r["padded"]) for r in Q.Q["label_shift_and_padding"](spark, str(tmp_path)).collect()}
    assert got == want


def test_overlay_and_changes(spark):
    cur = rows(spark, [(1, "a", "x", "free"), (2, "b", "y", "shared"), (3, "c", "z", "kept")], "k int, name string, body string, m string")
    new = rows(spark, [(1, "A", "X"), (2, "B", "Y"), (3, "C", "Z"), (4, "D", "W")], "k int, name string, body string")
    got = {r.k: (r.name, r.body) for r in P.overlay(cur, new, "k", ["name"], "m").collect()}
    assert got == {1: ("A", "X"), 2: ("b", "Y"), 3: ("c", "z"), 4: ("D", "W")}
    assert {r.k: r.change for r in P.changed_rows(cur.drop("m"), new, "k").collect()} == {1: "changed", 2: "changed", 3: "changed", 4: "added"}


def test_greedy_cards(spark):
    d = rows(spark, [("f", "c1", "s", 1), ("f", "c1", "t", 2), ("f", "c2", "s", 3), ("f", "c3", "s", 4), ("f", "c4", "u", 5)], "fam string, c string, sig string, o int")
    got = [r.o for r in P.greedy_cards(d, "fam", "c", "sig", "o", 4).orderBy("slot").collect()]
    assert got == [1, 3, 5, 2]


def test_greedy_cards_brute_force(spark):
    import random

    rng, data, limit = random.Random(11), [], 4
    for f in range(150):
        n = rng.choice([3, 20, 60])
        data += [(f, "hot" if rng.random() < 0.35 else f"c{rng.randrange(12)}", f"s{rng.randrange(1, 5)}", o) for o in rng.sample(range(1000), n)]
    want = {}
    for f in range(150):
        d, taken, cs, ss = sorted((x for x in data if x[0] == f), key=lambda x: x[3]), [], set(), set()
        for x in d:
            if len(taken) < limit and x[1] not in cs and not (len(taken) * 2 >= limit and x[2] in ss):
                taken.append(x)
                cs.add(x[1])
                ss.add(x[2])
        want[f] = [x[3] for x in (taken + [x for x in d if x not in taken])[:limit]]
    got = {}
    for r in P.greedy_cards(rows(spark, data, "fam int, c string, sig string, o int"), "fam", "c", "sig", "o", limit).orderBy("fam", "slot").collect():
        got.setdefault(r.fam, []).append(r.o)
    assert got == want


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "g string, v int")
    assert A.quantiles_upper(e, ["g"], "v").count() == 0 and A.distribution(e, "g").count() == 0
    assert J.running_total(e, ["v"], "v", "t").count() == 0 and S.stable_split(e.withColumn("k", F.col("g")), "g", "k", "s", 0.5).count() == 0
