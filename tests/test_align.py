import random
import time

import numpy as np
import pytest

from docscore.operators import align


def brute_table(a, b):
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table


def brute_confusion(a, b):
    table, i, j = brute_table(a, b), len(a), len(b)
    out = np.zeros((11, 11), int)
    while i or j:
        if i and j and table[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == table[i][j]:
            i, j = i - 1, j - 1
            out[int(a[i]), int(b[j])] += 1
        elif i and table[i - 1][j] + 1 == table[i][j]:
            i -= 1
            out[int(a[i]), 10] += 1
        else:
            j -= 1
            out[10, int(b[j])] += 1
    return out


def edited(rnd, text, alphabet, edits):
    out = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(out) + 1)
        kind = rnd.choice("sdi")
        if kind == "i" or at == len(out):
            out.insert(at, rnd.choice(alphabet))
        elif kind == "s":
            out[at] = rnd.choice(alphabet)
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["01", "0123456789"])
def test_confusion_of_short_strings_is_the_walk_back(alphabet):
    rnd = random.Random(3)
    pairs, want = [("", ""), ("", "7"), ("55", "")], np.zeros((11, 11), int)
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(15)))
        pairs.append((text, edited(rnd, text, alphabet, rnd.randrange(5))))
    for a, b in pairs:
        want += brute_confusion(a, b)
    assert (align.confusion(pairs) == want).all()


def test_confusion_of_long_strings_has_the_fewest_edits():
    rnd = random.Random(4)
    for size in (49, 200, 700):
        text = "".join(rnd.choice("0123456789") for _ in range(size))
        other = edited(rnd, text, "0123456789", size // 10)
        found = align.confusion([(text, other)])
        assert found.sum() - np.trace(found[:10, :10]) == brute_table(text, other)[-1][-1]
        assert found[:10].sum() == len(text) and found[:, :10].sum() == len(other)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_parts_add_up_to_the_distance(alphabet):
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30)))
        other = edited(rnd, text, alphabet, rnd.randrange(12)) if rnd.random() < 0.8 else "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30)))
        parts = align.edit_parts(*align.tokens(text, other, "character"))
        assert sum(parts) == brute_table(text, other)[-1][-1], (text, other)
        assert min(parts) >= 0 and parts[2] - parts[1] == len(other) - len(text)


def test_known_edits_have_known_parts():
    words = [f"w{i}" for i in range(5000)]
    put = ["S" if i % 40 == 7 else w for i, w in enumerate(words)] + ["I"] * 3
    cut = [w for i, w in enumerate(words) if i % 50]
    assert align.edit_parts(*align.tokens(" ".join(words), " ".join(put), "word")) == (125, 0, 3)
    assert align.edit_parts(*align.tokens(" ".join(words), " ".join(cut), "word")) == (0, 100, 0)


def test_near_equal_texts_are_near_linear():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    other = edited(rnd, text[:500_000], "xyz", 20) + text[500_000:]
    began = time.perf_counter()
    assert sum(align.edit_parts(*align.tokens(text, other, "character"))) <= 20
    assert time.perf_counter() - began < 5


def test_tables(spark):
    rows = [("g", "one two three", "one 2 three x"), ("g", None, "a b"), ("g", "a", None), ("g", "same", "same"), (None, "", None), ("h", "é ü w", "é ü w w")]
    pairs = spark.createDataFrame(rows, "k string, expected string, predicted string")
    found = {r["k"]: (r["substitutions"], r["deletions"], r["insertions"], r["edits"], r["reference"], r["rate"]) for r in align.error_rates(pairs, ["k"]).collect()}
    assert found == {"g": (1, 1, 3, 5, 5, 1.0), None: (0, 0, 0, 0, 0, None), "h": (0, 0, 1, 1, 2, 0.5)}
    assert align.error_rates(pairs.limit(0), ["k"], "character").count() == 0
    digits = spark.createDataFrame([("123", "12"), ("123", "123"), (None, "7"), ("5", None), (None, None), ("44", "4"), ("19", "79")], "expected string, predicted string")
    got = {tuple(r) for r in align.digit_confusion(digits).collect()}
    assert got == {("1", "1", 2), ("2", "2", 2), ("3", "3", 1), ("3", "", 1), ("", "7", 1), ("5", "", 1), ("4", "4", 1), ("4", "", 1), ("1", "7", 1), ("9", "9", 1)}
    assert align.digit_confusion(digits.limit(0)).count() == 0


def test_word_errors_match_the_full_table(spark):
    rnd = random.Random(3)
    rows = [(str(k), " ".join(rnd.choices("abcd", k=rnd.randrange(12))), " ".join(rnd.choices("abcd", k=rnd.randrange(12)))) for k in range(80)]
    got = {r["k"]: r["edits"] for r in align.error_rates(spark.createDataFrame(rows, "k string, predicted string, expected string"), ["k"]).collect()}
    assert got == {k: brute_table(e.split(), p.split())[-1][-1] for k, p, e in rows}
