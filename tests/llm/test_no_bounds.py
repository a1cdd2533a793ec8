"""Results at and beyond lengths and sizes that once were bounds, and texts unlike the test tables'."""

import random

import pytest

from tracelake.llm import endings, leaks, pairs, splits, truncation

WHOLE = [(i, f"The checkpoint planner restored report {i} after the review. The judge read the report.", "s") for i in range(40)]


@pytest.mark.parametrize("n", [10, 1990, 2010, 70_000])
def test_final_unit_of_any_length(n):
    assert endings.final_unit("One sentence. " + "x" * n) == "x" * n
    assert endings.final_unit("x" * n) == "x" * n
    assert endings.ending("One. (" + "x" * n + ")")[:2] == ("closed", "bracket")


@pytest.mark.parametrize("n", [10, 390, 410, 5000])
def test_json_key_of_any_length(n):
    assert endings.ending('{"' + "k" * n + '": 1}')[:2] == ("closed", "json")
    assert endings.ending('{"' + "k" * n + '": [1, "b')[:2] == ("open", "structure")


@pytest.mark.parametrize("n", [63, 64, 65, 300])
def test_broken_words_of_any_length(spark, n):
    word = ("abcdefghij" * 40)[: n + 5]
    rows = [*WHOLE, *[(50 + i, f"The planner {i} moved {word} away.", "s") for i in range(3)], (100, f"The planner moved {word[:n]}", "s"), (101, f"The planner moved {word}", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.evidence for r in truncation.judge_endings(d).where("is_cut").collect()} == {100: "sentence+word"}


def test_sound_texts_without_a_final_mark(spark):
    texts = [
        "Buy milk", "Meeting notes for Tuesday", "TODO refactor the parser", "def add(a, b):\n    total = a + b\n    return total", "The plan went well.\n\nBest regards\nAnna", "Results\n\n- first item\n- second item",
        "Chapter 3: Restoring a checkpoint", "select name from users where id = 4", "¿Quién viene mañana?\nTodos", "# Heading\n\nAgenda\n1. Budget\n2. Hiring",
    ]
    rows = WHOLE + [(100 + i, t, "s") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert truncation.found(d).collect() == []


# --- leaks -----------------------------------------------------------------------------------

TRAIN = "A train leaves Berlin at 9 and travels to Munich at 120 km/h. Another train leaves Munich at 10 and travels to Berlin at 80 km/h. When do the trains meet, and how far from Berlin is that?"


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {tuple(r) for r in leaks.found(d, spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(items)], "item_id string, item_text string")).collect()}


@pytest.mark.parametrize("n_items", [1, 3, 39, 40, 41])
def test_leaks_whatever_the_number_of_items(spark, n_items):
    items = [TRAIN] + [f"Count the {w}{k} of shelf {k}, then multiply what you counted by {k + 3} and write down the last digit of that for every {w}{k + 1}." for k, w in zip(range(n_items - 1), ["spoon", "lamp", "coin"] * 20)]
    got = found(spark, ["Intro. " + TRAIN.upper() + " End.", "A train leaves Berlin late.", "Nothing here at all of that kind, only prose about a garden."], items)
    assert got == {(0, "e0")}


def test_leaks_of_unusual_and_short_items(spark):
    unusual = "Zorquil brimvas kamnov turlux othfen miptor ricquil drihal wadbel polsert gorvas lenjor"
    items = [unusual, "Sort the list", "Why?", "the the the the the the the the the the the the", "", None]
    docs = ["x " + unusual + " y", "please sort the list now", "and why? because", "sort a list", "Zorquil brimvas kamnov once", "", None]
    assert found(spark, docs, items) == {(0, "e0"), (1, "e1"), (2, "e2")}


def test_items_with_the_same_text(spark):
    assert found(spark, ["Intro. " + TRAIN], [TRAIN] * 5) == {(0, f"e{i}") for i in range(5)}


def test_reparameterised_questions(spark):
    new = TRAIN
    for a, b in (("Berlin", "Lyon"), ("Munich", "Paris"), ("120", "95"), ("80", "70"), ("at 9 ", "at 7 "), ("at 10 ", "at 8 ")):
        new = new.replace(a, b)
    mixed = new.replace("travels to Lyon", "travels to Rome").replace("from Lyon", "from Oslo")
    d = spark.createDataFrame([(1, "Q: " + new + " A: noon."), (2, "Q: " + TRAIN), (3, "A train is late. " * 50), (4, mixed)], "doc_id long, text string")
    i = spark.createDataFrame([("e", TRAIN), ("f", "Name the five longest rivers of the continent, from the longest to the shortest, and their sources.")], "item_id string, item_text string")
    got = {r.doc_id: r for r in leaks.leaks(d, i).collect()}
    assert got[1].is_renamed and got[1].n_other == 0 and not got[2].is_renamed and got[4].n_other > 0 and 3 not in got
    assert {tuple(r)[:2] for r in leaks.reparameterised(d, i).where("n_other = 0").collect()} == {(1, "e")}
    # More than a third of the words stands there literally, whatever the parameters.
    assert {tuple(r) for r in leaks.found(d, i).collect()} == {(1, "e"), (2, "e"), (4, "e")}


def test_typed_placeholders():
    c = leaks.Canon({"run", "for", "days", "the"})
    kinds = lambda t: [("NUX"[{1: 0, 2: 1, 0: 2}[int(v) >> 60 & 3]] if int(v) & leaks._SLOT else "-") for v in c.ids_of(t.split())]
    assert kinds("run for 12 days") == ["-", "-", "N", "U"] and kinds("for three hours the days") == ["-", "N", "U", "-", "-"] and kinds("the zorquil") == ["-", "X"]


def test_scan_and_join_agree(spark, monkeypatch):
    docs = ["Intro. " + TRAIN, "other prose " * 30, TRAIN[:90]]
    want = found(spark, docs, [TRAIN])
    monkeypatch.setattr(leaks, "MAX_WINDOWS", 1)
    assert found(spark, docs, [TRAIN]) == want and (0, "e0") in want


# --- splits ----------------------------------------------------------------------------------


def test_pairs_of_large_components_are_spread(spark, monkeypatch):
    rows = [(f"c{i:02d}", "acct-7", None, None) for i in range(30)] + [(f"d{i}", "acct-9", None, None) for i in range(3)]
    c = spark.createDataFrame(rows, "case_id string, author_id string, origin_trace_id string, seed_files array<string>")
    want = {tuple(r) for r in splits.tied_pairs(c).collect()}
    monkeypatch.setattr(splits, "PAIRS_ABOVE", 7)
    assert {tuple(r) for r in splits.tied_pairs(c).collect()} == want and len(want) == 30 * 29 // 2 + 3
    assert sorted((r.component, r.n_cases) for r in splits.component_members(c).select("component", "n_cases").distinct().collect()) == [("c00", 30), ("d0", 3)]


def test_rendezvous_keeps_old_components(spark):
    old = [(f"k{i}", f"d{i % 3}", 1 + i % 7) for i in range(400)]
    sizes = spark.createDataFrame(old, "component string, domain string, n long")
    fit = splits.fit_rendezvous(sizes)
    first = {r.component: r.split for r in splits.choose(sizes, fit).collect()}
    more = spark.createDataFrame(old + [(f"new{i}", f"d{i % 5}", 900) for i in range(300)], "component string, domain string, n long")
    second = {r.component: r.split for r in splits.choose(more, fit).collect()}
    assert all(second[k] == v for k, v in first.items()) and len(second) == 700
    assert splits.fit_rendezvous(sizes) == fit and set(first.values()) == set(splits.SPLITS)


# --- pairs -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 15, 20, 2000])
def test_refusals_of_any_length(n):
    assert pairs.is_refusal("I can't help with that. " * n)
    assert not pairs.is_refusal("I can't help with that. " * n + "The plan now lives in the archive and everybody can see it.")


@pytest.mark.parametrize("text", ["I have to pass on this one.", "I'd rather not do that.", "I'm not willing to do that. Have a nice day.", "Lo siento, no puedo ayudar con eso.", "Das kann ich leider nicht tun."])
def test_more_ways_to_decline(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize(
    "answer",
    [
        "Ho spostato il piano nella cartella e tutti possono vederlo ora.", "Je l'ai fait pour vous et le plan est dans le dossier avec les autres.", "Movi o plano para a pasta e agora todos eles estão lá também.",
        "Я переместил план в архив, теперь его видят все.", "計画をアーカイブに移動しました。", "계획을 보관함으로 옮겼습니다.", "نقلت الخطة إلى الأرشيف ويمكن للجميع رؤيتها الآن", "Ik heb het plan naar de map verplaatst en nu kan iedereen het zien.",
    ],
)
def test_other_languages(answer):
    q = "Move the plan to the archive and tell me who can see it now."
    assert pairs.profile(q, answer)[0] == "language"
    assert pairs.profile(q, "The plan is now in the archive and everybody can see it.")[0] is None
    assert pairs.profile(answer + " " + q, answer + " x")[0] != "language"


def test_neighbours_across_borders(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    full = [" ".join(word() for _ in range(8)) for _ in range(300)]
    # Shortened and then worded a little otherwise at the end: evidence comes from the neighbour on either side.
    cut = [x[:30] + "zz" for x in full[::3]] + [x[:30] + "  " for x in full[1::3]]
    rows = [(x, False) for x in full] + [(x, True) for x in cut]
    d = spark.createDataFrame(rows, "text string, asked boolean")
    got = []
    for k in (1, 5, 40):
        spark.conf.set("spark.sql.shuffle.partitions", k)
        got.append({r.text for r in pairs.shortened_texts(d).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got[0] == got[1] == got[2] and got[0]
