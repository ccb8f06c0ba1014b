import random
import re

import pytest

from kairoframe.llm import decontamination as D


def find(spark, documents, docs, items, **options):
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, at int")
    return {(r.doc_id, r.item_id): (r.n_found, r.n_windows, r.reparameterised) for r in D.contamination(documents(docs), bench, **options).collect()}


QUESTION = "If Mary has 12 apples and gives 5 kg of pears to Bob then how many apples does Mary still have today"


def test_reparameterised_questions_have_to_be_consistent(spark, documents):
    docs = [
        (1, "before. " + QUESTION + " after"),
        (2, "x. If Anna has 31 apples and gives 7 miles of pears to Karl then how many apples does Anna still have today"),
        (3, "x. If Anna has 31 apples and gives 7 kg of pears to Karl then how many apples does Dora still have today"),
        (4, "If Mary has twelve oranges and sells five of them to Bob then how many oranges will Mary own tomorrow"),
        (5, QUESTION.upper()),
    ]
    got = find(spark, documents, docs, [(7, QUESTION)])
    assert set(got) == {(1, 7), (2, 7)} or set(got) == {(1, 7), (2, 7), (5, 7)}
    assert got[1, 7][2] is False and got[2, 7][2] is True
    assert got[1, 7][:2] == (got[1, 7][1],) * 2


def test_planted_passages_against_plain_search(spark, documents, prose):
    r = random.Random(2)
    items = [(i, prose(i, r.choice([9, 15, 40]))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        text = prose(1000 + d, 60)
        if d % 3 == 0:
            i, item = r.choice(items)
            w = item.split()
            part = w if len(w) < 20 or d % 2 else w[5:20]
            text = f"{text} {' '.join(part)} {prose(5000 + d, 20)}"
        docs.append((d, text))
    for d, t in docs:
        w = re.findall(r"\w+", t.lower())
        held = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        for i, item in items:
            v = re.findall(r"\w+", item.lower())
            n = {k for k in range(len(v) - 7) if tuple(v[k : k + 8]) in held}
            if len(n) >= min(4, len(v) - 7):
                want.add((d, i))
    assert want and set(find(spark, documents, docs, items)) == want
    assert set(find(spark, documents, docs, items, most_broadcast=0)) == want


def test_nulls_short_items_repeats_and_long_texts(spark, documents, prose):
    item = prose(1, 20)
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (None, prose(9, 20)), (5, "one two three four five six")]
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "too short"), (5, "a. one two three four five six b"), (6, prose(7, 30_000) + " " + item)]
    got = find(spark, documents, docs, items)
    assert set(got) == {(3, 1), (5, 5), (6, 1)}
    assert got[3, 1][0] == got[3, 1][1]


@pytest.mark.parametrize("docs,items", [([], [(1, QUESTION)]), ([(1, QUESTION)], []), ([], [])])
def test_empty_tables(spark, documents, docs, items):
    assert find(spark, documents, docs, items) == {}


def test_clean_documents_stay_with_all_columns(spark, documents, prose):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    df = documents([(1, QUESTION), (2, prose(1, 50)), (3, None), (None, QUESTION)])
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3]


@pytest.mark.parametrize(
    "copy",
    [
        "Question: What is the tallest mountain of the northern island chain? Yes",
        "they answer What is the tallest mountain of the northern island chain",
        "so it says what is the tallest mountain of the northern island chain and more",
        "WHAT IS THE TALLEST MOUNTAIN OF THE NORTHERN ISLAND CHAIN",
    ],
)
def test_what_stands_before_a_copy_and_its_capitals_do_not_matter(spark, documents, copy):
    item = "What is the tallest mountain of the northern island chain?"
    assert set(find(spark, documents, [(1, copy), (2, "What is the tallest building of the northern island chain?")], [(7, item)])) == {(1, 7)}


def test_capitals_of_names_and_units_and_lost_full_stops(spark, documents):
    sentences = "Trains leave at noon. Buses leave an hour later. Ships wait for both. Planes never wait for them"
    docs = [(1, QUESTION.upper()), (2, QUESTION.lower()), (3, "so " + sentences.replace(".", "")), (4, "so. " + sentences.replace(". ", ", "))]
    bench = spark.createDataFrame([(7, QUESTION), (8, sentences)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contamination(documents(docs), bench).collect()}
    assert {k: r.reparameterised for k, r in got.items()} == {(1, 7): False, (2, 7): False, (3, 8): False, (4, 8): False}
    assert all(r.n_found == r.n_windows for r in got.values())


def test_items_of_few_literals_are_found_as_they_are(spark, documents):
    items = [(1, "What is 17 times 23 plus 4?"), (2, "name the largest ocean"), (3, "1 4 9 16 25 36 49 64 81 100 121"), (4, "the cast was Anna Berg, Karl Ode, Ines Roy, Paul Tan, Mia Fox, Leo Kern")]
    docs = [(i, f"So. The text: {t} And more.") for i, t in items] + [(5, "What is 17 times 24 plus 4?"), (6, "1 4 9 16 25 35 49 64 81"), (7, "name the largest river")]
    assert set(find(spark, documents, docs, items)) == {(i, i) for i, _ in items}
    assert set(find(spark, documents, docs, items, most_broadcast=0)) == {(i, i) for i, _ in items}


def test_numbers_beside_few_wordy_windows_may_still_be_exchanged(spark, documents):
    item = "add 3 and 5 and 7 and 9 then 2 and 8 and tell the sum of them all"
    docs = [(1, item), (2, "add 4 and 6 and 1 and 8 then 9 and 5 and tell the sum of them all"), (3, "tell 4 and 6 the sum")]
    assert set(find(spark, documents, docs, [(7, item)])) == {(1, 7), (2, 7)}


def test_one_inconsistent_value_does_not_lose_the_windows_without_it(spark, documents, prose):
    long = f"it weighs 5 kg {prose(1, 40)} and the other 5 kg belong to us where Mary met {prose(2, 10)} with Mary today"
    fruits = "Tom put 3 apples and 3 pears into the basket then walked home and told everyone about the fruits inside it"
    docs = [
        (1, long.replace("other 5", "other 6")),
        (2, long.replace("other 5 kg", "other 5 lbs")),
        (3, long.replace("with Mary", "with Anna")),
        (4, fruits.replace("3 apples", "4 apples").replace("3 pears", "7 pears")),
    ]
    assert set(find(spark, documents, docs, [(7, long), (8, fruits)])) == {(1, 7), (2, 7), (3, 7), (4, 8)}


def test_values_have_to_stand_for_each_other_one_to_one(spark, documents):
    docs = [(1, QUESTION.replace("Mary", "Anna").replace("Bob", "Anna")), (2, QUESTION.replace("Mary", "Anna").replace("Bob", "Karl"))]
    assert set(find(spark, documents, docs, [(7, QUESTION)])) == {(2, 7)}


def test_the_windows_meet_by_their_hashes(spark, documents, prose):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    plan = D.contamination(documents([(1, prose(1, 30))]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [hash" in plan and "Python" not in plan


def test_ids_of_another_type_and_several_texts_of_one_id(spark, prose):
    df = spark.createDataFrame([("a", "clean text of few words", 1), ("a", "so " + prose(3, 20), 2), (None, prose(3, 20), 3)], "doc_id string, text string, hash int")
    bench = spark.createDataFrame([("x", prose(3, 20))], "item_id string, text string")
    for options in ({}, {"most_broadcast": 0}):
        assert [tuple(r)[:2] for r in D.contamination(df, bench, **options).collect()] == [("a", "x")]
