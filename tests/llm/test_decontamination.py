import random

import pytest

from tempograph.llm import decontamination as d


@pytest.fixture(scope="module")
def bench(spark):
    items = [
        (1, "A train leaves Boston with 25 passengers and travels 300 km in 4 hours, how fast does it go when it meets Alice near the river?"),
        (2, "Plain words stand here one after another without any number or name inside of this long question about nothing"),
        (3, "What is up"),
        (4, None),
        (5, "12 13 14 15 16 17 18 19 20 21 22 23"),
    ]
    return spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, width int")


def test_found_and_left_alone(spark, bench):
    r = random.Random(0)
    filler = lambda n: " ".join(r.choice(["wood", "lake", "sun", "moon", "grass"]) for _ in range(n))
    question = bench.where("item_id = 1").first().text
    plain = bench.where("item_id = 2").first().text
    docs = {
        1: filler(50) + ". " + question + " " + filler(9),
        2: filler(9) + ".\n" + question.replace("25", "31").replace("300", "520").replace("Alice", "Bob").replace("Boston", "Denver"),
        3: question.upper(),
        4: plain.replace(" ", "\n ", 3) + " " + question,
        5: filler(500),
        6: None,
        7: "",
        8: " ".join(question.split()[:6]) + " " + filler(30),
        9: "12 13 14 15 16 17 18 19 20 21 22 23",
        10: "So. What is up",
        11: "30 31 32 33 34 35 36 37 38 39 40",
        12: " ".join(plain.split()[3:16]),
    }
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs.items()], "doc_id long, text string, windows int, of string").repartition(3)
    got = {x.doc_id: (x.item_ids, x.reparameterised) for x in d.contaminated_documents(df, bench).collect()}
    assert got == {1: ([1], False), 2: ([1], True), 3: ([1], False), 4: ([1, 2], False), 9: ([5], False), 12: ([2], False), 10: ([3], False)}
    kept = d.decontaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(docs) - set(got)
    assert d.contaminated_documents(df.limit(0), bench).collect() == [] == d.contaminated_documents(df, bench.limit(0)).collect()


def test_changed_names_and_numbers_wherever_they_stand(spark):
    items = [
        (1, "Anna has 12 red pens. Tom has 5 blue pens. Ben buys 3 more pens. How many pens do they have now?"),
        (2, "What is the largest planet known today"),
        (3, "The road from Paris to Rome takes twenty hours by car, and 3 days on foot if one walks at night."),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = {
        1: "Some words before. Eva has 7 red pens. Karl has 25 blue pens. Mia buys 4 more pens. How many pens do they have now? And words after.",
        2: "Question: What is the largest planet known today? Nobody said.",
        3: "question: what is the largest planet known today? nobody said.",
        4: "He wrote: The road from New York to San Jose takes twenty-six hours by car, and 12 days on foot if one walks at night.",
        5: "Eva has a pen. Karl has a pen. The road is long and takes days on foot if it is night, and today she walks on.",
        6: "Eva has 7 red pens. Karl has 7 blue pens. " * 2000,
    }
    df = spark.createDataFrame([*docs.items(), (1, docs[1]), (None, docs[2])], "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.item_ids, x.reparameterised) for x in d.contaminated_documents(df, bench).collect()}
    assert got == {1: ([1], True), 2: ([2], False), 3: ([2], False), 4: ([3], True), None: ([2], False)}


def test_inconsistent_slots_are_no_match(spark):
    bench = spark.createDataFrame([(1, "take 5 red and 5 blue and 5 green and 5 black balls from the box")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "take 7 red and 7 blue and 7 green and 7 black balls from the box"), (2, "take 7 red and 8 blue and 9 green and 4 black balls from the box")], "doc_id long, text string")
    assert [(x.doc_id, x.reparameterised) for x in d.contaminated_documents(docs, bench).collect()] == [(1, True)]


def test_units_and_names(spark):
    df = spark.createDataFrame([("We saw Carl. He ran 5 km and three miles, m of it.",)], "text string")
    t = [p.t for p in d.template(df).first().pairs]
    assert t == [d.NAME, "saw", d.NAME, "ran", d.NUMBER, d.UNIT, "and", d.NUMBER, d.UNIT, "m", "of", "it"]


def brute(texts, items):
    """Documents with a benchmark item as a run of lower-cased words (these tables have no numbers or inner names)."""
    import re

    norm = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+|\d+", t.lower())) + " "
    return {i: sorted(k for k, q in items if norm(q) in norm(t)) for i, t in texts}


def test_tables(spark):
    path = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    want = brute([(x.doc_id, x.text or "") for x in docs.collect()], [(x.item_id, x.text) for x in bench.collect()])
    got = {x.doc_id: x.item_ids for x in d.contaminated_documents(docs, bench).collect()}
    assert got == {i: v for i, v in want.items() if v} and got


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x.item_ids for x in d.contaminated_documents(docs, bench).collect()}


def test_copies_dense_in_numbers_and_names(spark):
    items = ["Compute 12 + 45 * 7 - 3 / 9 modulo 11", "Who wrote this novel: Jane Austen, Emily Bronte, Mark Twain, Charles Dickens or Leo Tolstoy?", "12 13 14 15 16 17 18 19 20 21 22 23"]
    around = "wood and lake. {} Moon and grass."
    assert found(spark, items, [around.format(x) for x in items] + [around.format("30 31 32 33 34 35 36 37 38 39 40")]) == {0: [0], 1: [1], 2: [2]}
    others = "Who wrote this novel: Ann Brown, Carl Dean, Ed Fox, Gus Hill or Ian Jones?"
    assert found(spark, items, [others]) == {0: [1]}
