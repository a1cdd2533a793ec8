"""Small fixtures, brute force and edge cases of the training-data operators."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest

from tracelake.llm import chunking, endings, leaks, packing, pairs, pii, repeats, splits, truncation

T0 = dt.datetime(2026, 1, 1)
EVENT = "event_id long, request_id string, event_index int, tool_name string, args string, started_at timestamp, ended_at timestamp, ingested_at timestamp, ptr string, same string"


def ev(spark, rows):
    return spark.createDataFrame([(i, r, x, t, a, None if s is None else T0 + dt.timedelta(seconds=s), None if e is None else T0 + dt.timedelta(seconds=e), T0, "clash", "clash") for i, r, x, t, a, s, e in rows], EVENT)


# --- repeated events -------------------------------------------------------------------------


def test_repeats_notation_typos_and_targets(spark):
    rows = [
        (1, "r", 1, "proxy.file_find", '{"query": "late  invoices", "page": 1}', 1, 2),
        (2, "r", 2, "FILE-FIND ", '{"page": "1", "query": "Late Invoices!", "call_id": "x"}', 3, 4),
        (3, "r", 3, "file_find", '{"page": 1.0, "query": "late invocies", "ts": 5, "cursor": null}', 5, 9),
        (4, "r", 4, "file_find", '{"page": 2, "query": "late invoices"}', 10, 11),
        (5, "r", 5, "file_find", None, 12, 13),
        (6, "r", 6, "file_find", None, 14, 15),
        (7, "r", 7, "doc_patch", '{"put": "plan"}', 16, None),
        (7, "r", 7, "doc_patch", '{"put": "plan"}', 16, None),
        (8, "r", 8, "doc_patch", '{"put": "plan (new)"}', 18, 19),
        (9, "q", None, "x", "not json", None, None),
        (10, None, 1, "x", "{}", 1, 2),
        (11, None, 2, "x", "{}", 3, 4),
    ]
    got = {tuple(r) for r in repeats.found(ev(spark, rows)).collect()}
    assert got == {("r", 1, 3)}
    full = repeats.collapse_repeats(ev(spark, rows)).collect()
    run = next(r for r in full if r.first_index == 1 and r.request_id == "r")
    assert (run.n_events, run.duration_ms) == (3, 8000)
    assert sum(r.n_events for r in full) == 11  # second delivery dropped


def test_repeats_brute_force_and_long_run(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for r in range(12):
        for k in range(rng.choice([1, 5, 70])):
            i += 1
            rows.append((i, f"r{r}", k, rng.choice(["a", "b"]), '{"p": %d}' % rng.choice([1, 1, 1, 2]), i, i))
    rows += [(10_000 + k, "hot", k, "a", '{"p": 1}', k, k) for k in range(700)]
    want = set()
    for r, g in itertools.groupby(sorted(rows, key=lambda x: (x[1], x[5])), key=lambda x: x[1]):
        for _, run in itertools.groupby(g, key=lambda x: (x[3], x[4])):
            run = list(run)
            if len(run) > 1:
                want.add((r, run[0][2], run[-1][2]))
    assert {tuple(x) for x in repeats.found(ev(spark, rows).repartition(5)).collect()} == want


def test_repeats_empty(spark):
    assert repeats.found(ev(spark, [])).count() == 0


def test_typo_distance():
    assert repeats.typo_distance("harbor", "habror", 2) == 1
    assert not repeats.same_free_text("row 12 of the plan", "row 13 of the plan")
    assert not repeats.same_free_text("report", None)


# --- pairs -----------------------------------------------------------------------------------


def test_pair_defects(spark):
    full = [(f"f{i}", f"Move item {i}.", f"Item {i} now lives in the archive and everybody can see it there.") for i in range(5)]
    rows = full + [
        ("empty", "Move item 9.", "```\n​```"),
        ("none", "Move item 9.", None),
        ("short", "How many?", "3"),
        ("copy", "Move the plan to the archive.", "MOVE THE PLAN TO THE ARCHIVE"),
        ("quoted", "Move the plan.", "You asked: “Move the plan”. Item 2 now lives in the archive."),
        ("refuse", "Move the plan.", "I'm sorry, but I can't help with that. Have a nice day."),
        ("setback", "Move the plan.", "The plan now lives in the archive. I was not able to rename it, but everything else went through."),
        ("cut", "Move item 9.", "Item 9 now lives in the archive and every"),
        ("json", "Move item 9.", '{"content": "Item 9 now lives in the arch'),
        ("lang", "Move the plan to the archive please.", "Saya menemukan berkas dan sudah memindahkan semua itu ke folder arsip."),
        ("asked", "Move the plan. Please answer in Indonesian.", "Saya menemukan berkas dan sudah memindahkan semua itu ke folder arsip."),
        ("noq", None, "Saya menemukan berkas dan sudah memindahkan semua itu ke folder arsip."),
        ("long", "Move item 9.", "Item 1 now lives in the archive. " * 4000),
    ]
    d = spark.createDataFrame([(a, b, c, T0, "clash") for a, b, c in rows] * 2, "request_id string, question string, answer string, ingested_at timestamp, text string")
    got = {r.request_id: r.defect for r in pairs.found(d).collect()}
    assert got == {"empty": "empty", "none": "empty", "copy": "copy", "refuse": "refusal", "cut": "truncated", "json": "truncated", "lang": "language"}
    assert pairs.found(d.where("false")).count() == 0


def test_length_spikes(spark):
    flat = [(n, 30) for n in range(100, 200)]
    at = [*flat[:45], (145, 300), *flat[46:], (2000, 30), (2004, 1), (40, 3)]
    got = {r.n_chars for r in pairs.length_spikes(spark.createDataFrame(at, "n_chars int, n_at long")).collect()}
    assert got == {145, 2000}
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = [(f"r{i}", "What happened to every item of the plan?", " ".join(word() for _ in range(260))[:2000], T0) for i in range(25)]
    d = spark.createDataFrame(rows, "request_id string, question string, answer string, ingested_at timestamp")
    assert {r.defect for r in pairs.found(d).collect()} == {"truncated"} and pairs.found(d).count() == 25


def test_shortened_texts_across_partitions(spark):
    texts = [(f"w{i:03d} some longer text", False) for i in range(300)] + [(f"w{i:03d} some", True) for i in range(0, 300, 7)] + [("zzz", True)]
    d = spark.createDataFrame(texts, "text string, asked boolean").repartition(7)
    got = {r.text for r in pairs.shortened_texts(d).collect()}
    assert got == {f"w{i:03d} some" for i in range(0, 300, 7)}


# --- chunks ----------------------------------------------------------------------------------


@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 10), (7, 6), (1, 0), (200, 48)])
def test_split_text_properties(limit, overlap):
    rng = random.Random(limit)
    for text in ["", "x" * 500, "A sentence here. " * 60, "短句。" * 200, "".join(rng.choice("ab \n.，。👍🏽") for _ in range(900))]:
        p = chunking.split_text(text, limit, overlap)
        if len(text) <= limit:
            assert p == ([(0, 0, len(text), "end")] if text else [])
            continue
        assert p[0][0] == 0 and p[-1][2] == len(text)
        for (s, c, e, _), (s2, c2, e2, _) in zip(p, p[1:]):
            assert e == c2 and e - s2 == min(overlap, e - s) and e - s <= limit and e2 - s2 <= limit and c < e


def test_split_prefers_strong_boundaries():
    text = ("word " * 18).strip() + ".\n\n" + ("next " * 18).strip() + "."
    assert [x[3] for x in chunking.split_text(text, 120, 0)] == ["paragraph", "end"]


def provs(spark, rows=(("p", 10, 2, False), ("d", 20, 4, True))):
    return spark.createDataFrame(list(rows), "provider_id string, seq_length int, overlap_tokens int, is_default boolean")


def test_chunks_limits_and_nulls(spark):
    rows = [(1, "x" * 15, "p"), (2, "x" * 15, None), (3, "x" * 21, "unknown"), (4, None, "p"), (5, "", "p"), (1, "x" * 15, "p")]
    m = spark.createDataFrame([(a, b, c, T0, 5) for a, b, c in rows], "message_id long, content string, provider_id string, ingested_at timestamp, seq_length int")
    assert sorted(r.message_id for r in chunking.found(m, provs(spark)).collect()) == [1, 3]
    assert chunking.split_oversized(m, provs(spark)).where("message_id = 1").count() == 2
    assert chunking.found(m.where("false"), provs(spark)).count() == 0


# --- splits ----------------------------------------------------------------------------------


def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, author_id string, origin_trace_id string, seed_files array<string>")


def test_ties_and_components(spark):
    rows = [
        ("c1", "acct-0000118", None, None), ("c2", " ACCT_118 ", "00AB-cd", ["f1"]), ("c3", None, "00abCD", []), ("c4", "unknown", "0000", ["f1", None]), ("c5", "unknown", "0000", ["tmpl-blank-doc"]),
        ("c6", "acct-0000000", "", ["tmpl-blank-doc"]), ("c7", "ACCT-0", None, None), (None, "acct-118", None, None),
    ]
    got = {tuple(r) for r in splits.tied_pairs(cases(spark, rows)).collect()}
    assert got == set(itertools.combinations(["c1", "c2", "c3", "c4"], 2))
    assert splits.tied_pairs(cases(spark, [])).count() == 0


def test_hash_to_min_path_and_star(spark, monkeypatch):
    monkeypatch.setattr(splits, "SALT_ABOVE", 5)
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("s", f"t{i}") for i in range(40)] + [("x", "x"), (None, "y")]
    got = {r.node: r.component for r in splits.hash_to_min(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and {got[f"t{i}"] for i in range(40)} == {"s"}


def test_split_proportions_and_groups(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", f"docs-{rng.randrange(250)}" if i % 9 else "docs-hot", None, rng.choice(["docs", " Docs", None]), T0) for i in range(3000)] + [("r0", "docs-hot", None, "docs", T0)]
    r = spark.createDataFrame(rows, "request_id string, case_id string, iid string, domain string, ingested_at timestamp")
    a = splits.assign_splits(r, cases(spark, [("docs-1", "acct-1", None, None), ("docs-2", "acct-1", None, None)])).collect()
    assert len(a) == 3000 and len({x.request_id for x in a}) == 3000
    by: dict = {}
    for x in a:
        by.setdefault(x.component, set()).add(x.split)
    assert all(len(v) == 1 for v in by.values())
    assert len({x.split for x in a if x.case_id in ("docs-1", "docs-2")}) == 1
    share = {s: sum(x.split == s for x in a) / 3000 for s in splits.SPLITS}
    assert abs(share["train"] - 0.8) < 0.04 and abs(share["test"] - 0.1) < 0.03
    assert splits.assign_splits(r.where("false"), cases(spark, [])).count() == 0


# --- personal information --------------------------------------------------------------------


def spans(text):
    return {(k, text[s:e]) for k, s, e, *_ in pii.propose(text)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to ana.wynbrook@corp.example now", ("email", "ana.wynbrook@corp.example")),
        ("mail: ana(at)corp.example", ("email", "ana(at)corp.example")),
        ("所有者邮箱：ana [at] post [dot] test", ("email", "ana [at] post [dot] test")),
        ("Call +1 (808) 555-0165 ext. 4", ("phone", "+1 (808) 555-0165")),
        ("手机号：１２０-5142-4200", ("phone", "１２０-5142-4200")),
        ("NIK 9984002306807937 ada", ("id_number", "9984002306807937")),
        ("El DNI 99.746.344-J figura", ("id_number", "99.746.344-J")),
        ("Address: Flat 22, 1300 Harrowgate Road, Grayhollow", ("address", "Flat 22, 1300 Harrowgate Road, Grayhollow")),
        ("纸质版请寄到望川省北屿市望湖区听潮大道82号。", ("address", "望川省北屿市望湖区听潮大道82号")),
        ("Signed, Ana C. Wynbrook-Moor", ("person_name", "Ana C. Wynbrook-Moor")),
        ("请联系顾澈知确认。", ("person_name", "顾澈知")),
    ],
)
def test_pii_proposals(text, want):
    assert want in spans(text)


def test_name_inside_email_is_none():
    assert {k for k, _ in spans("cc Anna.Wynbrook@corp.example")} == {"email"}


def pii_tables(spark, extra=()):
    texts = [f"Write to ana{i}.wynbrook@corp.example if the link fails. Call (212) 555-01{i:02d} after the review." for i in range(60)]
    texts += [f"Batch 123-4567-{i:02d} ran. Contact person: Anna Wynbrook. Build 1.2 ran on 2026-01-{i % 28 + 1:02d}." for i in range(60)]
    texts += [None, "", "nothing here " * 5000, *extra]
    c = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "message_id long, content string, kind string")
    return c, spark.createDataFrame([(1, None, "x")], "event_id long, response string, feats string")


def test_pii_found_and_redacted(spark):
    c, e = pii_tables(spark)
    got = pii.found(c, e).collect()
    kinds = {k: sum(r.pii_type == k for r in got) for k in pii.KINDS}
    assert kinds["email"] == 60 and kinds["phone"] == 60 and kinds["person_name"] == 60 and kinds["id_number"] == 0
    red = {r.row_id: r.redacted for r in pii.redacted(c, e).collect()}
    assert red[0] == "Write to [EMAIL] if the link fails. Call [PHONE] after the review."
    assert pii.found(c.where("false"), e.where("false")).count() == 0


def test_vote_model_orders_labelers():
    post = pii.vote_model([(0, 2 * 27 + 2 * 9 + 2 * 3 + 1, 500), (0, 1 * 27 + 0 + 0 + 1, 500), (0, 2 * 27 + 0 + 2 * 3 + 0, 100)])
    assert post[0, 2 * 27 + 2 * 9 + 2 * 3 + 1] > 0.9 > 0.1 > post[0, 27 + 1]


# --- packing ---------------------------------------------------------------------------------


def test_pack_random():
    rng = random.Random(5)
    for cap in (10, 512):
        sizes = [rng.randint(0, cap) for _ in range(700)] + [cap, 0, 1]
        w = packing.pack(sizes, cap)
        fill: dict = {}
        for s, x in zip(sizes, w):
            fill[x] = fill.get(x, 0) + s
        assert max(fill.values()) <= cap and min(w) >= 0
        assert len(fill) <= 1.06 * sum(sizes) / cap + 2 or max(sizes) * 3 > cap


def test_fill_windows(spark):
    d = spark.createDataFrame([(1, "word " * 100, "p", 1), (2, None, None, 1), (3, "", "d", 1), (4, "a b", "zz", 1), (4, "a b", "zz", 1)], "doc_id long, text string, provider_id string, window int")
    rows = packing.fill_windows(d, provs(spark), shard_items=2).collect()
    per: dict = {}
    for r in rows:
        k = (r.provider_id, r.shard, r.window)
        per[k] = per.get(k, 0) + r.n_tokens
        assert per[k] <= r.seq_length
    assert {r.doc_id for r in rows} == {1, 2, 3, 4}
    one = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == 1)
    assert [s for s, _ in one] == list(range(0, 10 * len(one), 10)) and all(n == 10 for _, n in one[:-1])
    assert packing.fill_windows(d.where("false"), provs(spark)).count() == 0


# --- leaks -----------------------------------------------------------------------------------

ITEM = "Under the label Zorquil, 809 chalk boxes still lack a wear index unless Miptur arrives late. Whenever Drifen reopens, every scanned map past 565 days was moved by Ricfen."


def items(spark):
    rows = [("e1", ITEM)] + [(f"x{i}", f"Under the label Name{chr(97 + i)}q, {i}7 chalk boxes still lack a wear index unless Oth{chr(97 + i)} arrives late. Whenever Ser{chr(97 + i)} reopens, every scanned map past {i}3 days was moved by Bel{chr(97 + i)}.") for i in range(8)]
    return spark.createDataFrame(rows, "item_id string, item_text string")


def test_leaks(spark):
    wrapped = "> " + ITEM[:80] + "\n> " + ITEM[80:]
    docs = [
        (1, "Intro. " + ITEM + " End."), (2, "Log. " + wrapped.upper()), (3, "A few words: the label Zorquil, 809 chalk"), (4, ITEM.replace("Zorquil", "Other").replace("809", "12").replace("565", "9").replace("Miptur", "A").replace("Drifen", "B").replace("Ricfen", "C")),
        (5, None), (6, ""), (7, "plain text " * 3000), (8, "Half: " + ITEM[: len(ITEM) // 2]), (1, "Intro. " + ITEM + " End."),
    ]
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in docs], "doc_id long, text string, tokens string, item_id string")
    assert {tuple(r) for r in leaks.found(d, items(spark)).collect()} == {(1, "e1"), (2, "e1"), (8, "e1")}
    assert leaks.found(d, items(spark).where("false")).count() == 0
    assert leaks.found(d.where("false"), items(spark)).count() == 0


def test_leaks_with_other_parameters(spark):
    new = ITEM
    for a, b in (("Zorquil", "Quam"), ("809", "12"), ("565", "9"), ("Miptur", "Velt"), ("Drifen", "Borun"), ("Ricfen", "Sollit")):
        new = new.replace(a, b)
    d = spark.createDataFrame([(1, "Intro. " + ITEM), (2, "Intro. " + new + " End."), (3, "plain text " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in leaks.leaks(d, items(spark)).where("item_id = 'e1'").collect()}
    assert sorted(got) == [1, 2] and got[1].share >= leaks.SHARE and not got[1].is_renamed and got[1].n_renamed == 0
    assert got[2].is_renamed and got[2].n_renamed > 0 and got[2].n_other == 0 and got[2].share < leaks.SHARE
    r = leaks.leak_report(d, items(spark)).where("item_id = 'e1'").collect()[0]
    assert (r.n_docs, r.n_renamed) == (1, 1)


def test_slot_agreement():
    item = "if x is y then x of y".split()
    common, hits = {"if", "is", "then", "of"}, [(i, i) for i in range(4)]
    assert leaks.slot_agreement(item, "if p is q then p of q".split(), hits, common) == (4, 0, 4, 0)
    assert leaks.slot_agreement(item, "if p is q then r of q".split(), hits, common) == (4, 0, 3, 1)
    assert leaks.slot_agreement(item, "if p is p then p of p".split(), hits, common)[3] == 2


def test_notation():
    assert leaks.tokens("Ｃａｆ\\u00e9 &amp; “x”") == ["café", "x"]


# --- truncation ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,state",
    [
        ("A whole sentence.", "closed"), ("句子。", "closed"), ("It stops in the mid", "open"), ("It stops…", "open"), ("x [truncated]", "open"), ('{"a": [1, 2]}', "closed"), ('{"a": [1, "b', "open"), ("```\ncode", "open"),
        ("Text.\n\nhttps://example.org/ab12", "closed"), ("Text.\n\n-- the desk", "closed"), ("Text.\n\n(before lunch)", "closed"), ("| a | b |\n| c | d |", "closed"), ("| a | b |\n| c", "open"), ("", "empty"), (None, "empty"), ("Mean x_y, run 1a2b3c", "closed"),
    ],
)
def test_endings(text, state):
    assert endings.ending(text)[0] == state


def test_truncation(spark):
    whole = [(i, f"The checkpoint planner restored report {i} after the review.", "s") for i in range(40)]
    rows = whole + [(100, "The checkpoint planner restored the repo", "s"), (101, None, "s"), (102, "", None), *[(103 + 10 * k, f"Text {k}.\n\n-- review plan", "t") for k in range(3)], (104, "Fine here.\n\n-- revie", "t"), (0, whole[0][1], "s")]
    d = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "doc_id long, text string, source string, n int, word string")
    got = {r.doc_id: r for r in truncation.judge_endings(d).collect()}
    assert sorted(k for k, r in got.items() if r.is_cut) == [100, 104] and got[100].evidence.startswith("sentence+word")
    rates = {r.source: r.share_cut for r in truncation.rates(d).collect()}
    assert rates["t"] == 0.25 and rates[None] == 0
    assert truncation.found(d.where("false")).count() == 0


def test_truncation_evidence_decides(spark):
    whole = [(i, f"The checkpoint planner restored report {i} after the review. The judge read the report.", "s") for i in range(310)]
    titles = [(1000, "Total rows: 42", "s"), (1001, "Quarterly review", "s")]
    cuts = [(1010, "The judge read the repo", "s"), (1011, "After the review the", "s"), (1012, "After the review,", "s")]
    at = [(1020 + k, ("judge " * k + "review report " * 9)[:60].rstrip() + "report" * 9, "t") for k in range(6)]
    at = [(i, x[:58] + "ew", "t") for i, x, _ in at] + [(1030, "Fine.\n\nhttps://example.org/" + "a" * 33, "t"), (1031, "Fine.\n\nhttps://example.org/" + "a" * 20, "t")]
    d = spark.createDataFrame(whole + titles + cuts + at, "doc_id long, text string, source string")
    got = {r.doc_id: r.evidence for r in truncation.judge_endings(d).where("is_cut").collect()}
    assert sorted(got) == [1010, 1011, 1012, *range(1020, 1026), 1030] and got[1011] == "sentence+inside" and got[1030] == "link+limit"


def test_trie_nodes(spark):
    w = spark.createDataFrame([("report", 5), ("repose", 3), ("rare", 1)], "word string, n long")
    assert {(r.prefix, r.n_below) for r in truncation.trie_nodes(w).where("length(prefix) >= 4").collect()} == {("repo", 8), ("repor", 5), ("repos", 3)}


def test_numpy_is_deterministic():
    a = leaks.Canon({"a", "b", "c"}).windows(["a", "b", "x1", "7", "c", "a"])
    b = leaks.Canon({"a", "b", "c"}).windows(["a", "b", "x1", "7", "c", "a"])
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
