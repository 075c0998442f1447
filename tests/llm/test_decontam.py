import random
import re
from collections import Counter

import pytest

from docscore.llm import decontam as op

QUESTION = "A train leaves Boston at 9:30 and travels 120 km in 2 hours before it stops, so what speed did the train from Boston keep over 120 km?"
SWAPPED = QUESTION.replace("Boston", "Lisbon").replace("120", "77").replace("9:30", "4:15").replace("2 hours", "5 hours")
BROKEN = QUESTION.replace("from Boston", "from Madrid").replace("leaves Boston", "leaves Oslo").replace("over 120", "over 9").replace("travels 120", "travels 8")
PLAIN = "the quick brown fox jumps over the lazy dog while nobody in the village is looking at it"


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    items = spark.createDataFrame(items, "item_id long, text string, extra string")
    return {(r["doc_id"], r["item_id"]): r for r in op.contaminated(docs, items, **options).collect()}


def read(text):
    """For each way, the words as ``(kind or literal word, content, is slot)``; made from the docstrings alone."""
    words = []
    for raw in (text or "").split():
        inner = re.sub(r"^[^\w$€£+\-−]+", "", raw)
        inner = re.sub(r"[^\w%°€£$²³]+$", "", inner)
        ends = raw.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
        if inner:
            words.append([inner, ends])
        elif ends and words:
            words[-1][1] = True
    out = ([], [], [])
    begins, after_number = True, False
    for inner, ends in words:
        low = inner.lower()
        number = bool(re.fullmatch(r"[+\-−]?[$€£]?[0-9][0-9.,:/]*([%°]|[A-Za-zµ²³]{1,4})?[€£$]?", inner)) or low in op.NUMBER_WORDS
        unit = not number and after_number and low in op.UNITS
        capital = inner[0].isupper() and not inner.isupper() and not number and not unit
        for way, name in ((0, capital and not begins), (1, capital and (not begins or low not in op.ORDINARY)), (2, False)):
            kind = "#number" if number else "#unit" if unit else "#name" if name else None
            out[way].append((low if way == 2 or not kind else kind, low, way != 2 and kind is not None))
        begins, after_number = ends, number
    return out


def brute(docs, items, width=5, least=0.8):
    out = set()
    said = [(d, read(t)) for d, t in docs]
    for i, question in items:
        asked = read(question)
        size = min(width, len(asked[0]))
        for d, doc in said:
            for way in range(3):
                if size and contains(doc, asked[way], way, size, len(asked[0]), least):
                    out.add((d, i))
    return out


def contains(doc, asked, way, size, length, least):
    if way == 2 and size == 1 and (length != 1 or len(doc[0]) != 1):
        return False
    wins = lambda row: [row[k : k + size] for k in range(len(row) - size + 1)]
    good = lambda w: way == 2 or sum(not s for _, _, s in w) >= 2
    name = lambda w: tuple(k for k, _, _ in w)
    of_item = [(q, w) for q, w in enumerate(wins(asked)) if good(w)]
    needed = {name(w) for _, w in of_item}
    found, aligned = set(), {}
    for row in [doc[2]] if way == 2 else {tuple(r) for r in doc[:2]}:
        for p, w in enumerate(wins(row)):
            for q, v in of_item if good(w) and name(w) in needed else []:
                if name(v) == name(w):
                    aligned.setdefault(p - q, set()).add((p, name(w), tuple((a, b) for (_, a, s), (_, b, _) in zip(v, w) if s)))
    for some in aligned.values():
        votes = Counter(pair for _, _, pairs in some for pair in pairs)
        rule, back = {}, {}
        for (a, b), n in votes.items():
            rule[a] = max(rule.get(a, (0, "")), (n, b))
            back[b] = max(back.get(b, (0, "")), (n, a))
        found |= {name for _, name, pairs in some if all(rule[a][1] == b and back[b][1] == a for a, b in pairs)}
    return bool(needed) and len(found) / len(needed) >= least


def test_template_slots():
    words, hashes, slots = op.template("Then Anna paid $5.50 for 3 kg - of Rice. Rice is 20% off, 10km away")
    assert [w for w, s in zip(words, slots, strict=True) if s] == ["Anna", "$5.50", "3", "kg", "Rice.", "20%", "10km"]
    assert op.template(None)[0] == op.template(" - ")[0] == []


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 0}])
def test_reparameterised_and_clean(spark, options):
    docs = [
        (1, f"Some intro. {QUESTION} And more.", 0), (2, f"x\n{SWAPPED}\ny", 0), (3, BROKEN, 0), (4, PLAIN.upper(), 0), (5, "nothing here at all, really", 0),
        (6, None, 0), (7, "", 0), (None, PLAIN, 0), (8, PLAIN, 0), (8, PLAIN, 0), (9, "word " * 50_000 + PLAIN, 0), (10, " ".join(QUESTION.split()[:14]), 0),
    ]
    items = [(100, QUESTION, "a"), (101, PLAIN, "b"), (102, None, None), (103, "too short", "c"), (None, PLAIN + " again", "d")]
    got = found(spark, docs, items, **options)
    assert set(got) == {(1, 100), (2, 100), (None, 101), (8, 101), (9, 101), (4, 101)} | {(d, None) for d in (4, None, 8, 9)}
    assert not got[(1, 100)]["reparameterised"] and got[(2, 100)]["reparameterised"] and got[(2, 100)]["n_changed"] >= 3


def test_fixture_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = set(found(spark, [(d, t, 0) for d, t in docs], [(i, t, "") for i, t in items]))
    assert got == brute(docs, items)
    assert {(d, i) for d, t in docs for i, q in items if q in t} <= got


def test_made_questions_match_brute_force(spark):
    rnd = random.Random(11)
    names, verbs, things = ["Tom", "Anna", "Sara", "Oscar", "Mia"], ["buys", "sells", "finds", "gives away"], ["apples", "km", "books", "kg"]
    number = lambda: rnd.choice([str(rnd.randrange(2, 30)), "seven", "$4.50", "12%", "three"])
    line = lambda: rnd.choice(["{0} {v} {n} {t} and {1} {v} {m} more.", "Then {0} has {n} {t} but {1} has {m}.", "How many {t} does {0} have, if {1} {v} {n}?", "Solve it. Show your work."])
    shapes = [" ".join(line() for _ in range(rnd.randint(1, 4))) for _ in range(25)]

    def ask(shape):
        return " ".join(s.format(*rnd.sample(names, 2), v=verbs[k % 4], n=number(), m=number(), t=things[k % 4]) for k, s in enumerate(re.split(r"(?<=[.?]) ", shape)))

    items = [(k, ask(s)) for k, s in enumerate(shapes)] + [(100, "Is it?"), (101, "yes"), (102, "Tom Anna 5 kg 7 Sara")]
    docs = [(k, f"Intro words. {ask(rnd.choice(shapes))} {rnd.choice(['', 'And then some.', ask(rnd.choice(shapes))])}") for k in range(150)]
    docs += [(200 + k, q.upper() if k % 2 else f'"{q}"') for k, q in items] + [(300, "so: is it? maybe"), (301, "Yes!"), (302, "yes yes")]
    got = set(found(spark, [(d, t, 0) for d, t in docs], [(i, t, "") for i, t in items]))
    assert got == brute(docs, items) and len(got) > 60


def test_two_values_must_not_become_one(spark):
    asked = "first add 3 to the sum, later take 5 from the sum, then put 3 on top, now drop 5 of these again"
    docs = [(1, asked.replace("3", "8").replace("5", "9"), 0), (2, asked.replace("3", "7").replace("5", "7"), 0)]
    assert set(found(spark, docs, [(1, asked, "")])) == {(1, 1)}


def test_drop_and_empty(spark):
    docs = spark.createDataFrame([(1, PLAIN, "k"), (2, "clean text", "k"), (3, None, None)], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(5, PLAIN)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in op.drop_contaminated(docs, items).collect()) == [2, 3]
    assert op.drop_contaminated(docs, items).columns == docs.columns
    assert op.contaminated(docs, items.limit(0)).count() == op.contaminated(docs.limit(0), items).count() == 0


TOM = "Tom has 12 apples. Tom buys 5 more at the market. Tom gives 3 apples to Anna. How many apples does Tom have left?"
TOM_AGAIN = "Sara has 31 apples. Sara buys 9 more at the market. Sara gives 8 apples to Mia. How many apples does Sara have left?"
NATALIA = "Natalia sold 48 clips in April. Natalia then sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
OSCAR = NATALIA.replace("Natalia", "Oscar").replace("48", "62").replace("April", "June").replace("May", "July")


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 0}])
def test_names_that_begin_sentences_case_and_short_items(spark, options):
    docs = [
        (1, f"Intro. {TOM_AGAIN} End.", 0), (2, OSCAR, 0), (3, NATALIA.lower(), 0), (4, TOM.upper(), 0), (5, TOM, 0), (6, "he said: WHAT IS entropy? twice", 0),
        (7, "Entropy!", 0), (8, "what is energy", 0), (9, TOM_AGAIN.replace("Sara gives", "Peter gives").replace("does Sara", "does Kim").replace("Sara buys", "Lea buys"), 0),
    ]
    items = [(1, TOM, ""), (2, NATALIA, ""), (3, "What is entropy?", ""), (4, "entropy", ""), (5, "", "")]
    got = found(spark, docs, items, **options)
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 1), (6, 3), (7, 4)}
    assert got[(1, 1)]["reparameterised"] and got[(2, 2)]["reparameterised"]
    assert not any(got[k]["reparameterised"] for k in ((3, 2), (4, 1), (5, 1), (6, 3), (7, 4)))


def test_rows_with_a_null_or_shared_id_are_judged_by_their_text(spark):
    rows = [(None, PLAIN, 1), (None, "clean text", 2), (5, "clean", 3), (5, PLAIN, 4), (6, None, 5), (6, "", 6), (7, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text long")
    out = op.drop_contaminated(docs, spark.createDataFrame([(5, PLAIN)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(r["__text"] for r in out.collect()) == [2, 3, 5, 6, 7]


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("a", PLAIN), ("b", "clean"), (None, PLAIN)], "doc_id string, text string")
    items = spark.createDataFrame([("x", PLAIN)], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op.contaminated(docs, items).collect()} == {("a", "x"), (None, "x")}
    assert [r["doc_id"] for r in op.drop_contaminated(docs, items).collect()] == ["b"]


def test_a_phrase_that_all_items_and_documents_have_meets_nothing(spark):
    stock = "please read the text and choose the best answer of those below"
    items = spark.createDataFrame([(k, f"{stock} {' '.join(f'q{k}w{j}' for j in range(12))}") for k in range(60)], "item_id long, text string")
    asked = op.sized(op.window_rows(items, "item_id", "text", [5], items=True).withColumnsRenamed({"row": "item", "id": "item_id"}), 0.8)
    assert {r["window"] for r in asked.where("key").collect()}.isdisjoint({r["window"] for r in asked.groupBy("window").count().where("count > 10").collect()})
    docs = spark.createDataFrame([(k, f"{stock} and nothing else") for k in range(50)], "doc_id long, text string")
    assert op.contaminated(docs, items).count() == 0
