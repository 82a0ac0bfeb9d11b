import random
import re

from hotloom.llm.leakage import leaked_spans

WORDS = [f"w{i}" for i in range(30)]


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[a-z0-9]+", fold)


def brute(items, docs, run):
    found = set()
    for i, a in items:
        grams = {tuple(w[k : k + run]) for w in [words(a or "")] for k in range(len(w) - run + 1)}
        for d, b in docs:
            w = words(b or "")
            if any(tuple(w[k : k + run]) in grams for k in range(len(w) - run + 1)):
                found.add((i, d))
    return found


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25)))) for i in range(40)] + [(100, None), (101, ""), (102, "one two"), (103, "Kelvin K sign " + " ".join(WORDS[:6]))]
    docs = [(900, None), (901, ""), (902, "...")]
    for d in range(200):
        noise = [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            w = words(rng.choice(items)[1] or "")
            a = rng.randrange(len(w) + 1)
            noise[5:5] = w[a : a + rng.randrange(1, 20)]
        docs.append((d, "".join(x.upper() + rng.choice([" ", "\n", ", ", " – ", "é", "-"]) if rng.random() < 0.3 else x + " " for x in noise)))
    docs.append((903, "Kelvin k sign " + " ".join(WORDS[:6])))
    left, right = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for run in (3, 6):
        for most in (10**6, 200):
            got = {(r.item_id, r.doc_id) for r in leaked_spans(right, "doc_id", "text", left, "item_id", "text", run, most).collect()}
            assert got == brute(items, docs, run) and got


def test_spans_map_to_the_original(spark):
    item = "alpha beta gamma delta epsilon"
    text = "«é» Alpha,\n\tBETA -- gamma délta; alpha beta gamma delta epsilon zeta. 😀 beta gamma delta"
    got = leaked_spans(spark.createDataFrame([(7, text)], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(1, item)], "item_id long, text string"), "item_id", "text", 3).collect()
    assert sorted((text[r.start : r.stop], r.words) for r in got) == sorted([("Alpha,\n\tBETA -- gamma", 3), ("alpha beta gamma delta epsilon", 5), ("beta gamma delta", 3)])


def test_no_items_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaked_spans(docs, "doc_id", "text", items.limit(0), "item_id", "text", 2).count() == 0
    assert leaked_spans(docs.limit(0), "doc_id", "text", items, "item_id", "text", 2).count() == 0
