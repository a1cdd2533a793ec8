"""Gates on chat records, graphs of any depth, numbered lines and loaders: cases that must be turned down."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions.nested import reports_error
from tracelake.operators import chat as C
from tracelake.operators import graphs as G
from tracelake.operators import joins as J
from tracelake.sources import readers as R

MSG = "record_id string, msg_pos int, msg_role string, content string, loss boolean"


def messages(spark, records):
    rows = [(k, i, role, content, loss) for k, ms in records.items() for i, (role, content, loss) in enumerate(ms)]
    return spark.createDataFrame(rows, MSG)


CALL = '{"name": "find", "arguments": {"q": 1}}'
SOUND = [("system", "s", None), ("user", "u", None), ("assistant", "a", None), ("tool_call", CALL, None), ("tool_response", "r", None), ("assistant", "done", None)]


def test_rejections(spark):
    hand = '{"name": "transfer_to_agent", "arguments": {}}'
    m = messages(
        spark,
        {
            "sound": SOUND,
            "unreadable": [*SOUND[:3], ("tool_call", "{broken", None), ("tool_response", "r", None)],
            "mixed": [*SOUND[:2], ("assistant", "a", False), ("tool_call", CALL, None), ("tool_response", "r", None)],
            "excess": [*SOUND[:5], ("tool_response", "again", None)],
            "role": [*SOUND, ("developer", "x", None)],
            "unclaimed": SOUND[:4],
            "handover": [*SOUND, ("tool_call", hand, None)],
            "two": [*SOUND, ("tool_call", hand, None), ("tool_call", hand, None)],
            "first": [("tool_response", "r", None), ("developer", "x", None), ("tool_call", "{", None)],
            "empty call": [*SOUND[:3], ("tool_call", None, None), ("tool_response", None, None)],
        },
    )
    got = {r.record_id: r.reason for r in C.rejections(m).collect()}
    assert got == {
        "sound": None, "unreadable": "unreadable_call", "mixed": "mixed_loss", "excess": "excess_result", "role": "unknown_role", "unclaimed": "unclaimed_call", "handover": None, "two": "unclaimed_call",
        "first": "excess_result", "empty call": None,
    }
    assert {r.record_id for r in C.rejections(m, allow_open=True).where("reason = 'unclaimed_call'").collect()} == set()
    assert C.rejections(m.where("false")).count() == 0


def test_round_trip_turns_down_what_was_changed(spark):
    m = messages(spark, {"a": SOUND, "b": [*SOUND[:4], ("tool_call", CALL.replace("1", "2"), None), ("tool_response", "r1", None), ("tool_response", "r2", None)]})
    n = C.normalised(m)
    cols = ["same_calls", "same_results", "claims_in_order"]
    assert all(all(r[c] for c in cols) for r in C.round_trip(m, n).collect())
    swapped = n.withColumn("calls", F.reverse("calls"))
    assert {r.record_id: r.same_calls for r in C.round_trip(m, swapped).collect()} == {"a": True, "b": False}
    lost = n.where(~((F.col("role") == "tool") & (F.col("content") == "r1")))
    assert {r.record_id: r.same_results for r in C.round_trip(m, lost).collect()} == {"a": True, "b": False}
    early = n.withColumn("position", F.when(F.col("role") == "tool", -1).otherwise(F.col("position")))
    assert not any(r.claims_in_order for r in C.round_trip(m, early).collect())


def test_eos_mask_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        ids, sup = [], []
        for _ in range(int(rng.integers(0, 6))):
            ids += [1, *rng.integers(10, 20, int(rng.integers(0, 9))).tolist(), *([2, *rng.integers(10, 20, int(rng.integers(0, 9))).tolist()] if rng.random() < 0.8 else []), 0]
            sup.append(bool(rng.random() < 0.6))
        ids += rng.integers(10, 20, int(rng.integers(0, 4))).tolist()
        rows.append((k, ids, sup if k % 7 else [*sup, True]))
    d = spark.createDataFrame(rows, "k int, ids array<int>, sup array<boolean>")
    got = {r.k: (r.m, r.f) for r in d.withColumn("m", C.eos_mask(F.col("ids"), 0, F.col("sup"), 2)).select("k", "m", C.mask_fault(F.col("ids"), F.col("m"), 0, F.try_element_at("sup", F.lit(-1))).alias("f")).collect()}
    for k, ids, sup in rows:
        ends = [i for i, t in enumerate(ids) if t == 0]
        if len(ends) != len(sup):
            assert got[k] == (None, "count")
            continue
        mask, before = [0] * len(ids), -1
        for e, s in zip(ends, sup):
            marks = [i for i in range(before + 1, e) if ids[i] == 2]
            for i in range((marks[-1] if marks else before) + 1, e + 1):
                mask[i] = int(s)
            before = e
        runs = any(ids[i] == 0 and mask[i] and i + 1 < len(ids) and mask[i + 1] for i in range(len(ids)))
        fault = "nothing" if not any(mask) else "last" if not sup[-1] else "back_to_back" if runs else None
        assert got[k] == (mask, fault)


def test_eos_mask_of_a_long_sample(spark):
    d = spark.range(1).select(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.array_repeat(F.lit(7), 500), F.array(F.lit(0))))).alias("ids"), F.array_repeat(F.lit(True), 200).alias("sup"))
    assert d.select(F.size(C.eos_mask(F.col("ids"), 0, F.col("sup"))).alias("n")).collect()[0].n == 100_200


def test_render_equivalence_notices_a_prefix_that_changes(spark):
    m = C.supervised(messages(spark, {"a": [("user", "u", None), ("assistant", "one", None), ("tool_response", "r", None), ("assistant", "two", None)]}))
    text = F.concat_ws(":", "msg_role", "content")
    r = C.render_equivalence(m, text, text).collect()[0]
    assert (r.n_samples, r.n_same_prefix, r.n_same_place) == (2, 2, 2) and r.slots_exploded > r.slots_whole
    last_only = F.when(F.col("msg_pos") == F.col("_last"), text).otherwise(F.col("msg_role"))
    r = C.render_equivalence(m, text, last_only).collect()[0]
    assert r.n_same_prefix == 0 and r.n_same_place == 0


def test_positions_restart(spark):
    d = spark.createDataFrame([([3, 0, 2],), ([],)], "n array<int>")
    assert [r.p for r in d.select(C.segment_positions(F.col("n")).alias("p")).collect()] == [[0, 1, 2, 0, 1], []]


def test_history_takes_summaries(spark):
    d = spark.createDataFrame([("user", "x" * 9, "s"), ("tool_response", "x" * 9, "s"), ("tool_response", "x" * 9, " ")], "r string, c string, s string")
    assert [r.x for r in d.select(C.compressed_history(F.col("r"), F.col("c"), ["user"], 4, F.col("s")).alias("x")).collect()] == ["x" * 9, "s", "xxxx"]


def chain(spark, n, extra=()):
    return spark.createDataFrame([(i + 1, i) for i in range(n)] + list(extra), "child int, parent int")


def test_deep_graphs(spark):
    e = chain(spark, 40)
    nodes = spark.createDataFrame([(i,) for i in range(41)], "node int")
    assert {tuple(r) for r in G.levels(nodes, e).collect()} == {(i, i) for i in range(41)}
    kept = spark.createDataFrame([(0,), (33,), (40,)], "node int")
    assert {tuple(r) for r in G.effective_parents(e, kept).collect()} == {(33, 0), (40, 33)}
    assert {r.node for r in G.descendants(e, spark.createDataFrame([(37,)], "node int")).collect()} == {38, 39, 40}


def test_cycles(spark):
    e = chain(spark, 6, [(2, 5), (9, 9), (11, 10)])
    assert {r.node for r in G.cyclic_nodes(e).collect()} == {2, 3, 4, 5, 9}
    assert G.cyclic_nodes(chain(spark, 6)).count() == 0 and G.cyclic_nodes(e.where("false")).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        G.levels(spark.createDataFrame([(i,) for i in range(7)], "node int"), e)
    hidden = G.effective_parents(spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "x"), ("y", "b")], "child string, parent string"), spark.createDataFrame([("a",), ("b",)], "node string"))
    assert {tuple(r) for r in hidden.collect()} == {("a", "b")}


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = ["" if i % 5 == 2 else '{"k": %d}' % i for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[:7]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = R.read_jsonl(spark, str(tmp_path), "k long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert {(r.source_file[-2:], r.source_row, r.k) for r in got} == {(n, i + 1, i) for n, k in (("nl", 400), ("gz", 7)) for i in range(k) if i % 5 != 2}


def test_loaders(spark, tmp_path):
    schema = "case_id string, case_input struct<id: string, question: string, multi_turn: boolean>, metadata struct<skill_domain: string>"
    d = spark.createDataFrame([("c1", ("1", "q", False), ("docs",)), ("c2", ("2", "q", None), None), ("c3", ("3", "q", True), None), (None, None, None)], schema)
    assert {(r.case_id, r.domain) for r in R.load_cases(d).collect()} == {("c1", "docs"), ("c2", "general")}
    assert [r.case_id for r in R.load_cases(d, "docs").collect()] == ["c1"]
    with pytest.raises(Exception, match="comes twice"):
        R.load_cases(d.unionByName(d)).collect()
    (tmp_path / "a.json").write_text('[{"iid": "i1", "v": 1}]')
    (tmp_path / "b.json").write_text('[{"iid": "i2", "v": 2}]')
    i = R.load_instances(spark, str(tmp_path / "*.json"))
    assert {(r.iid, r.v) for r in i.collect()} == {("i1", 1), ("i2", 2)}
    (tmp_path / "c.json").write_text('[{"iid": "i2", "v": 3}]')
    with pytest.raises(Exception, match="comes twice"):
        R.load_instances(spark, str(tmp_path / "*.json")).collect()
    rows = spark.createDataFrame([(1, "i1"), (2, "zz"), (3, None)], "k int, iid string")
    one = spark.createDataFrame([("i1", 1)], "iid string, v int")
    assert {(r.k, r.v, r.error) for r in J.with_instance(rows, one, "iid").collect()} == {(1, 1, None), (2, None, "no_instance"), (3, None, "no_key")}
    with pytest.raises(Exception, match="no instance for"):
        J.with_instance(rows, one, "iid", strict=True).collect()


@pytest.mark.parametrize(
    "value,want",
    [
        ({"success": False}, True), ({"ok": "false"}, True), ({"success": True}, False), ({"exit_code": 1}, True), ({"exit_code": "0"}, False), ({"returncode": -9}, True), ({"status": "Failed"}, True), ({"status": "done"}, False),
        ({"a": [{"b": '{"result": {"outcome": "failure"}}'}]}, True), ({"properties": {"success": False}}, False), ("Traceback (most recent", True), (None, False), ({"ok": None}, False),
    ],
)
def test_reports_error(value, want):
    assert reports_error(value) is want
