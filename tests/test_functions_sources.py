"""Scalar functions, readers, writers and streams."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import hashing as H
from tracelake.functions import text as X
from tracelake.plans.cases import parse_checkpoints
from tracelake.sources import readers as R
from tracelake.streaming import events as E


def one(spark, col, **values):
    d = spark.createDataFrame([tuple(values.values())], list(values))
    return d.select(col.alias("x")).collect()[0].x


@pytest.mark.parametrize("glob,name,hit", [("a*c", "abbc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[!x]y", "zy", True), ("a.c", "abc", False), ("exact", "exact", True), ("pre*", "prefix", True)])
def test_globs(spark, glob, name, hit):
    assert one(spark, X.matches_any(F.col("n"), [glob]), n=name) is hit


def test_text_functions(spark):
    assert one(spark, X.tool_name(F.col("n")), n=" proxy.Sheet-Fill ") == "sheet_fill"
    assert one(spark, X.head_tail(F.col("n"), 9, "~"), n="abcdefghijkl") == "abcdef~jkl"
    assert one(spark, X.labelled_ids(F.col("n"), r"id-\d+", "ref"), n="id-7 id-8 id-7") == "<ref_1> <ref_2> <ref_1>"
    assert one(spark, X.ordered_operations(F.col("n"), {"share": "share", "find": "find"}), n="find then share") == ["find", "share"]
    assert one(spark, X.resource_key(F.col("n")), n="Plan_v2 (x).DOCX") == "planv2x"
    assert one(spark, X.zh_count(F.col("n")), n="两") == 2
    assert one(spark, X.verdict(F.col("n")), n=" pass ") == "PASS"
    assert one(spark, X.without_tags(F.col("n"), ["think"]), n="a <think>x\ny</think>b") == "a b"
    assert one(spark, X.looks_like_error(F.col("n")), n='{"error": "x"}') is True
    assert one(spark, X.count_literal(F.col("n"), "a.a"), n="a.aa.a") == 2


def test_fitted_halves_until_it_fits(spark):
    assert len(one(spark, X.fitted(F.col("n"), F.lit(10), 61, 100, 20, "-"), n="x" * 500)) == 51


def test_canonical_hashes(spark):
    doc = {"b": [1, {"z": "é", "a": None}], "a": True}
    want = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    text = json.dumps(doc, indent=2, ensure_ascii=True)
    assert one(spark, H.canonical_json_sha(F.col("n")), n=text) == want == one(spark, H.canonical_json_sha_exact(F.col("n")), n=text)
    assert one(spark, H.texts_md5(F.col("n")), n=["a", "b"]) == hashlib.md5(b"ab").hexdigest()
    assert one(spark, H.set_fingerprint(F.col("n")), n=["b", "a", "b"]) == one(spark, H.set_fingerprint(F.col("n")), n=["a", "b"])


def test_jsonl_plain_and_gzip_by_content(spark, tmp_path):
    lines = '{"k": 1}\n\n{"k": 2}\nnot json\n'
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "b.txt").write_bytes(gzip.compress(lines.encode()))
    got = R.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").orderBy("source_row").collect()
    assert [(r.source_row, r.k) for r in got[:2]] == [(1, 1), (3, 2)] and got[2]._not_object == "not json"
    both = R.read_jsonl_sniffed(spark, str(tmp_path)).collect()
    assert len(both) == 6 and {r.source_row for r in both} == {1, 3, 4}


def test_training_log_and_verdicts(spark, tmp_path):
    line = " iteration        5/     20 | consumed samples:   40 | lm loss: 4.5E-01 | grad norm: 12.5 | skipped iterations:   0 | nan iterations:   0 |"
    d = spark.createDataFrame([(line,), ("noise",)], "value string")
    r = R.parse_training_log(d).collect()
    assert len(r) == 1 and (r[0].step, r[0].planned_steps, r[0].consumed, r[0].loss, r[0].grad_norm, r[0].learning_rate) == (5, 20, 40, 0.45, 12.5, None)
    (tmp_path / "run.json").write_text(json.dumps({"cases": [{"item_id": "a", "scores": [{"name": "v", "stringValue": "pass"}]}, {"item_id": "b", "scores": [], "eval_result": "FAIL"}, {"item_id": "c", "scores": None}]}))
    assert {x.item_id: x.verdict for x in R.read_verdicts(spark, str(tmp_path / "run.json")).collect()} == {"a": "PASS", "b": "FAIL", "c": None}


def test_provenance_and_writers(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    p = R.file_provenance(spark, str(tmp_path / "f.bin"))
    assert p.collect()[0].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert R.known_sources(p, p.select("sha256")).count() == 0
    R.write_jsonl(spark.createDataFrame([(2, None)], "b int, a string"), str(tmp_path / "o"))
    text = "".join(x.read_text() for x in (tmp_path / "o").glob("part-*"))
    assert text.strip() == '{"a":null,"b":2}'
    s = spark.createDataFrame([(1, [1, 2], [0, 1]), (2, [3], [1])], "sample_id int, tokens array<int>, mask array<int>")
    R.write_token_table(s, str(tmp_path / "tok"))
    assert {(r.sample_id, r.offset) for r in spark.read.parquet(str(tmp_path / "tok")).collect()} == {(1, 0), (2, 2)}
    R.write_csv(s.select("sample_id"), str(tmp_path / "csv"), ["sample_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_checkpoint_expressions():
    assert parse_checkpoints("all", [3, 1]) == [1, 3] and parse_checkpoints("1,10-30", [1, 10, 20, 40]) == [1, 10, 20]
    with pytest.raises(ValueError):
        parse_checkpoints("7", [1])


def test_stream_dedupe_and_attempts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select cast(id % 3 as string) request_id, id = 4 as ok, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts from range(6)").coalesce(1).write.parquet(src)
    s = E.deduplicated(E.read_events(spark, src), "request_id", "ts", "1 hour")
    assert E.run_available(s, "dedupe").count() == 3
    st = E.attempt_states(E.read_events(spark, src).select("request_id", "ok"))
    seen = []
    st.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.request_id: (r.attempts, r.state) for r in seen} == {"0": (2, "queued_retry"), "1": (2, "completed"), "2": (2, "queued_retry")}


def test_nested_walks(spark):
    from tracelake.functions.nested import is_error_json, reports_error, sanitize, sanitized_json

    v = sanitize({"a": "fl-12ab34cd and fl-12ab34cd, x@y.org", "token": "s", "l": ["fl-99ab34cd"], "n": None})
    assert v == {"a": "<id_1> and <id_1>, <email_1>", "token": "<masked>", "l": ["<id_2>"], "n": None}
    assert reports_error({"x": '{"error": "no"}'}) and not reports_error({"schema": {"error": "text"}}) and not reports_error({"error": None})
    assert one(spark, sanitized_json(F.col("n")), n='{"b": 1, "a": "q@r.de"}') == '{"a": "<email_1>", "b": 1}'
    assert one(spark, is_error_json(F.col("n")), n="HTTP 503 upstream busy") is True


def test_chat_scalars(spark):
    from tracelake.operators import chat as C

    d = spark.createDataFrame([([1, 2, 0, 3, 0, 4], [False, True]), ([1, 0], [True, True])], "ids array<int>, sup array<boolean>")
    assert [r.m for r in d.select(C.eos_mask(F.col("ids"), 0, F.col("sup")).alias("m")).collect()] == [[0, 0, 0, 1, 1, 0], None]
    j = spark.createDataFrame([({"a": "ok"},), ({"a": "ok", "b": "bad"},), ({},), (None,)], "j map<string,string>")
    assert [r.x for r in j.select(C.judged_ok(F.col("j")).alias("x")).collect()] == [True, False, False, False]
    assert one(spark, C.effort(F.col("a"), F.col("b")), a=" ", b="High") == "high" and one(spark, C.effort(F.col("a")), a="extreme") is None
    m = spark.createDataFrame([([("user", "x"), ("assistant", "done")],), ([("tool_call", '{"name": "transfer_to_human"}')],), ([("user", "x")],), ([],)], "m array<struct<role: string, content: string>>")
    assert [r.x for r in m.select(C.proper_ending(F.col("m")).alias("x")).collect()] == [True, True, False, False]
