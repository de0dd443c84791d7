from __future__ import annotations

import random

from anchorlake.llm.near_duplicates import all_pairs, near_duplicates, shingles_of, words_of

ROW = "id string, kind string, text string, class string"


def pairs(spark, rows, parts=(7, 10), within="kind", cut=words_of):
    m, links = near_duplicates(spark.createDataFrame(rows, ROW), "id", "text", within, parts, cut)
    return sorted((r["a"], r["b"]) for r in all_pairs(m, links).collect())


def brute(rows, parts=(7, 10), cut=words_of):
    s = {i: (k, set(cut(t))) for i, k, t, _ in rows if i is not None and k is not None and t and cut(t)}
    ids = sorted(s)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a][0] == s[b][0] and len(s[a][1] & s[b][1]) * parts[1] >= len(s[a][1] | s[b][1]) * parts[0]]


def test_words():
    assert words_of("Foo-bar2 FOO 天地 _ü") == sorted(["foo", "bar2", "天", "地"])
    assert shingles_of(3)("a b c d") == ["a b c", "b c d"] and shingles_of(5)("a b") == ["a b"] and shingles_of(5)("!") == []


def test_brute_force(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(60):
        base = random.sample(vocabulary, random.randint(3, 50))
        for c in range(random.randint(1, 5)):
            t = list(base)
            for _ in range(random.randint(0, max(1, len(t) // 4))):
                t[random.randrange(len(t))] = random.choice(vocabulary)
            random.shuffle(t)
            rows.append((f"e{g}_{c}", random.choice("ab"), " ".join(t), ""))
    assert pairs(spark, rows) == brute(rows)


def test_threshold_is_exact_and_odd_rows(spark):
    rows = [("a", "k", "1 2 3 4 5 6 7", "x"), ("b", "k", "1 2 3 4 5 6 7 8 9 10", "x"), ("c", "k", "1 2 3 4 5 6 7 8 9 10 11", "x"), ("d", "other", "1 2 3 4 5 6 7", "x"), ("e", "k", "", "x"), ("f", "k", None, "x"), ("g", None, "1 2 3", "x"), (None, "k", "1 2 3", "x"), ("h", "k", "!!", "x"), ("a", "k", "1 2 3 4 5 6 7", "y"), ("z", "k", "7 6 5 4 3 2 1", "x")]
    assert pairs(spark, rows) == [("a", "b"), ("a", "z"), ("b", "c"), ("b", "z")]
    assert pairs(spark, []) == []


def test_many_copies_and_long_texts_by_shingles(spark):
    long = " ".join(f"t{i}" for i in range(6000))
    rows = [(f"c{i:03}", "k", "the same text of many words here and there", "") for i in range(60)] + [("l1", "k", long, ""), ("l2", "k", long + " end", ""), ("l3", "k", long[: len(long) // 2], "")]
    m, links = near_duplicates(spark.createDataFrame(rows, ROW), "id", "text")
    assert m.select("class").distinct().count() == 4 and [r["similarity"] > 0.99 for r in links.collect()] == [True]
    assert len(pairs(spark, rows, (8, 10), None, shingles_of(5))) == 60 * 59 // 2 + 1
