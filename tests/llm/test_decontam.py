import random

from siftwork.llm import decontam
from siftwork.llm.decontam import decontaminated, leaks


def test_leaks(spark, monkeypatch):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta kappa sigma omega".split()) for _ in range(n))
    items = [
        (1, "A train leaves the city of Paris at 10 and drives 300 km to the town of Lyon, then back 300 km. How long is the way of the train from Paris?"),
        (2, "what is the colour of the sky today"),
        (3, "12 13 14 15 16 17 18 19 20"),
        (4, "too short"),
        (5, None),
        (6, "".join(f"word{i}x " for i in range(40))),
        (7, " ".join(c * 80 for c in "pqr")),
    ]
    docs = [
        (0, filler(50) + ". " + items[0][1] + " " + filler(30)),
        (1, "Some text. A train leaves the city of Berlin at 7 and drives 90 mi to the town of Bonn, then back 90 mi. How long is the way of the train from Berlin? Yes."),
        (2, "A train leaves the city of Berlin at 7 and drives 90 mi to the town of Bonn, then back 80 mi. How long is the way of the train from Hamburg?"),
        (3, "x. What is the\ncolour of the sky, today y"),
        (4, "what is the colour of the sea today"),
        (5, "12 13 14 15 16 17 18 19 20"),
        (6, None),
        (7, ""),
        (8, "so " + "".join(f"word{i}x " for i in range(8, 32))),
        (9, "so " + "".join(f"word{i}x " for i in range(10, 22))),
        (10, filler(20000)),
        (11, "Too SHORT!"),
        (0, filler(50) + ". " + items[0][1] + " " + filler(30)),
        (None, items[5][1]),
        (12, f"  {'P' * 80},\n{'q' * 80}... {'r' * 80}!" + " " * 300),
        (13, f"{'p' * 80} {'q' * 80} {'r' * 80} s"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    want = {(0, 1), (1, 1), (3, 2), (8, 6), (None, 6), (11, 4), (12, 7)}
    got = leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert got.count() == len(want)
    monkeypatch.setattr(decontam, "BLOCK", 7)
    assert {(r.doc_id, r.item_id) for r in leaks(d, b).collect()} == want
    assert {r.doc_id for r in decontaminated(d, b).collect()} == {2, 4, 5, 6, 7, 9, 10, 13}
    assert leaks(d, b.limit(0)).count() == 0 and leaks(d.limit(0), b).count() == 0


def test_verbatim_text_and_slots_at_odds(spark):
    prose = lambda a, n: " ".join(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    items = [
        (1, "What is the colour of the sky today"),
        (2, "rate 12 of 13 14 15 16 and 17 18 19 20 more 21 22 23"),
        (3, f"take 3 of {prose('u', 30)} then 3 of {prose('v', 30)} end"),
        (4, prose("z", 120)),
        (5, "Paris lies far from Lyon and very near the sea"),
        (6, "a train to the city of\nParis goes past the town of\nLyon each day"),
    ]
    z = items[3][1].split()
    docs = [
        (1, "Question: What is the colour of the sky today"),
        (2, "we know Zed is the colour of the sky today"),
        (3, "so " + items[1][1]),
        (4, "rate 12 of 13 14 15 16 and 17 18 19 20 less 21 22 24"),
        (5, items[2][1].replace("then 3", "then 5")),
        (6, "x " + " ".join(z[40:60]) + " y"),
        (7, "x " + " ".join(z[40:59]) + " y"),
        (8, "he says Berlin lies far from Bonn and very near the sea"),
        (9, items[5][1].replace("\n", " ")),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (4, 2), (5, 3), (6, 4), (8, 5), (9, 6)}
    assert all(r.coverage == r.n_windows / r.item_windows for r in got)


def test_a_phrase_that_all_items_share(spark):
    """A frame common to many items brings no document and item together, unless the item has nothing rarer."""
    frame = "answer the following question about the text with one of the letters below and say why"
    word = lambda i: "".join(chr(97 + i // 10**k % 10) for k in range(3))
    items = [(i, f"{frame} " + " ".join(f"{word(i)}{chr(107 + k)}q" for k in range(12))) for i in range(60)] + [(99, frame)] + [(100 + i, "one and the same item for all of these rows here") for i in range(30)]
    docs = [(i, "so " + t + " end") for i, t in items[:5]] + [(50, "about " + frame + " nothing else"), (60, "x one and the same item for all of these rows here y")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == {(i, i) for i in range(5)} | {(i, 99) for i in (0, 1, 2, 3, 4, 50)} | {(60, 100 + i) for i in range(30)}


def test_recall_on_questions_asked_again(spark):
    """Every item asked again with other numbers, names and units is found, in long texts too."""
    rng = random.Random(9)
    lower = "walks drives buys holds sends keeps counts finds reads draws".split()
    nouns = "apples boxes roads letters stones lamps books cups ropes birds".split()
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta kappa sigma omega".split()) for _ in range(n))

    def ask(seed, names, numbers, unit):
        r = random.Random(seed)
        said = f"a friend of {names[0]} {r.choice(lower)} {numbers[0]} {r.choice(nouns)} and {r.choice(lower)} them {numbers[1]} {unit} to the house of {names[1]}"
        return f"{said} where {r.choice(nouns)} and {r.choice(nouns)} {r.choice(lower)} by the {r.choice(nouns)}, how many {r.choice(nouns)} does the friend of {names[0]} have"

    items = [(i, ask(i, ("Anna", "Bert"), (12, 30), "km")) for i in range(40)]
    docs = [(i, f"{filler(rng.randrange(3000))} {ask(i, ('Zoe', 'Max'), (7, 95), 'mi')} {filler(20)}") for i in range(40)]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(i, i) for i in range(40)} <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_phrases_of_many_items_that_are_most_of_an_item_or_long(spark):
    """No leak is lost where all that a document holds of an item stands in many items."""
    word = lambda a, i: f"{a}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}"
    most = " ".join(word("m", k) for k in range(14))  # 7 of 13 windows
    long = " ".join(word("l", k) for k in range(20))  # 20 words in a row, 13 of 93 windows
    items = [(i, most + " " + " ".join(word("n" + chr(97 + i), k) for k in range(6))) for i in range(20)]
    items += [(100 + i, " ".join(word("p" + chr(97 + i), k) for k in range(3 * i)) + " " + long + " " + " ".join(word("q" + chr(97 + i), k) for k in range(80 - 3 * i))) for i in range(20)]
    docs = [(1, "so " + most + " it was"), (2, "so " + long + " it was"), (3, "so " + most[: most.rindex(" ")] + " it was"), (4, long[: long.rindex(" ")])]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, i) for i in range(20)} | {(2, 100 + i) for i in range(20)}
