from __future__ import annotations

import random

from anchorlake.llm.mixing import mixture

DOC = "doc_id long, source string, tokens long, weight string"
TGT = "source string, weight double, max_repeats int"


def mixed(spark, docs, targets, **kw):
    out, report = mixture(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TGT), **kw)
    return {r["doc_id"]: r for r in out.collect()}, {r["source"]: r for r in report.collect()}


def test_shares_repeats_and_missing_sources(spark):
    random.seed(1)
    docs = [(i, "big", random.randint(1, 400), "") for i in range(3000)] + [(10_000 + i, "small", random.randint(1, 400), "") for i in range(150)] + [(20_000 + i, "mid", random.randint(1, 5000), "") for i in range(300)]
    docs += [(90_000, None, 10**7, ""), (90_001, "other", 10**7, ""), (90_002, "big", 0, "")]
    targets = [("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.2, 2), ("absent", 0.1, 5)]
    got, report = mixed(spark, docs, targets)
    caps = {"big": 1, "small": 4, "mid": 2}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in got.values())
    assert not {90_000, 90_001, 90_002} & set(got)
    assert report["absent"]["share"] == 0 and report["absent"]["tokens"] == 0
    for s, w in (("big", 0.5), ("small", 0.2), ("mid", 0.2)):
        assert abs(report[s]["share"] - w / 0.9) < 0.002, (s, report[s])
        assert report[s]["tokens"] == sum(r["tokens"] * r["copies"] for r in got.values() if r["source"] == s) <= report[s]["goal"] + 1e-6
    again, _ = mixed(spark, docs[::-1], targets)
    assert {k: r["copies"] for k, r in again.items()} == {k: r["copies"] for k, r in got.items()}
    other, _ = mixed(spark, docs, targets, seed=2)
    assert set(other) != set(got)


def test_given_total_and_shortfall(spark):
    docs = [(i, "a", 10, "") for i in range(100)] + [(1000 + i, "b", 10, "") for i in range(10)]
    got, report = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)], total=1000)
    assert report["b"]["tokens"] == 300 and report["a"]["tokens"] == 500
    assert all(r["copies"] == 3 for r in got.values() if r["source"] == "b")


def test_chances_follow_sizes(spark):
    """200 sources of the same sizes are as many draws: how often a size is drawn is its chance, and each draw has its size in tokens."""
    sizes = [10] * 120 + [20] * 80 + [40] * 40 + [700]
    draws, goal = 200, 2000
    docs = [(d * 1000 + i, f"s{d}", t, "") for d in range(draws) for i, t in enumerate(sizes)]
    got, report = mixed(spark, docs, [(f"s{d}", 1 / draws, 1) for d in range(draws)], total=draws * goal, power=1.0)
    # 700 is certain; what is missing, 1300, is shared out in proportion to size: factor = 1300 / sum of squares.
    factor = 1300 / sum(t * t for t in sizes if t < 700)
    assert abs(sum(min(1, factor * t) * t for t in sizes[:-1]) - 1300) < 1e-9
    n = {t: 0 for t in (10, 20, 40, 700)}
    for r in got.values():
        n[r["tokens"]] += 1
    assert n[700] == draws
    for t in (10, 20, 40):
        chance = n[t] / draws / sizes.count(t)
        assert abs(chance - factor * t) < 0.08 * factor * t, (t, chance, factor * t)
    assert all(1990 <= r["tokens"] <= 2000 for r in report.values())
    # By default the chance falls with the root of the size, and none is certain here.
    got, report = mixed(spark, docs, [(f"s{d}", 1 / draws, 1) for d in range(draws)], total=draws * goal)
    n = {t: sum(r["tokens"] == t for r in got.values()) for t in (10, 20, 40)}
    factor = goal / sum(t**0.5 for t in sizes)
    for t in (10, 20, 40):
        chance = n[t] / draws / sizes.count(t)
        assert abs(chance - factor * t**-0.5) < 0.12 * factor * t**-0.5, (t, chance, factor * t**-0.5)


def test_empty(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == {}
    got, report = mixed(spark, [(1, "a", 5, "")], [])
    assert got == {} and report == {}
