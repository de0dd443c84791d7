"""Similarity joins on texts that share their rarest words with many others: right pairs, and no row written per pair of these."""

from __future__ import annotations

import glob
import os
import random

import pytest

from anchorlake.operators import similarity
from anchorlake.plans import registry


def texts(n):
    """Half are random words out of few, half are earlier texts with up to two words gone or new."""
    r, words, out = random.Random(7), [f"w{i}" for i in range(60)], []
    for i in range(n):
        t = r.sample(words, r.randint(5, 30))
        if i % 2:
            t = list(out[r.randrange(len(out))])
            for _ in range(r.randint(0, 2)):
                t.pop(r.randrange(len(t))) if len(t) > 4 and r.random() < 0.5 else t.append(r.choice(words))
        out.append(t)
    return [(f"k{i:04}", f"n{i % 3}", " ".join(t)) for i, t in enumerate(out)]


def alike(a, b):
    a, b = set(a.split()), set(b.split())
    return 9 * len(a & b) > 4 * (len(a) + len(b))


def written(spark, run):
    """What ``run`` gives, and the most rows that one stage of it wrote for others."""
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: (x.apply(i) for i in range(x.size())))(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    old = set(stages())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return got, max(n for s, n in stages().items() if s not in old)


@pytest.mark.parametrize("within", [[], ["n"]])
def test_links_of_texts_with_common_words(spark, within):
    rows = texts(1000)
    df = spark.createDataFrame(rows, "k string, n string, text string")
    (members, links), most = written(spark, lambda: [x.collect() for x in similarity.classes(df, "k", within)])
    first = {}
    for k, n, t in rows:
        first.setdefault((n if within else "", frozenset(t.split())), k)
    assert {r["k"]: r["class"] for r in members} == {k: first[n if within else "", frozenset(t.split())] for k, n, t in rows}
    one = {k: (n, t) for k, n, t in rows if k in first.values()}
    want = {(a, b) for a in one for b in one if a < b and (not within or one[a][0] == one[b][0]) and alike(one[a][1], one[b][1])}
    assert len(want) > 100 and sorted((r["class_a"], r["class_b"]) for r in links) == sorted(want)
    assert most < 5 * len(rows)

def test_collisions_of_texts_with_common_words(spark):
    rows = texts(1000)
    left, right = spark.createDataFrame([(k, t) for k, _, t in rows], "key string, text string"), spark.createDataFrame([("r" + k[-2:], t) for k, _, t in rows[::2]], "id string, option string")
    got, most = written(spark, lambda: similarity.collides(left, "key", right).collect())
    want = {}
    for k, _, t in rows:
        for j, _, o in rows[::2]:
            if alike(t, o):
                want[k, "r" + j[-2:]] = min(o, want.get((k, "r" + j[-2:]), o))
    assert {(r["key"], r["id"]): r["option"] for r in got} == want
    assert most < 5 * len(rows)


NAMES = ["dup_cross_links", "dup_cross_first", "debts_all", "debt_counts", "debt_next", "maintenance_plan"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, with eight times as many entries of texts as above."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("tables")
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        if "remember_entries" not in p:
            os.symlink(p, at / os.path.basename(p))
    t = pq.read_table("/root/testdata/sf0.001/remember_entries.parquet")
    ids, i = t.column("entry_id").to_pylist(), t.schema.get_field_index("entry_id")
    t = pa.concat_tables([t.set_column(i, t.schema.field(i), pa.array([x and f"{x}{k}" for x in ids], t.schema.field(i).type)) for k in range(8)])
    j = t.schema.get_field_index("text")
    pq.write_table(t.set_column(j, t.schema.field(j), pa.array([x for _, _, x in texts(t.num_rows)], t.schema.field(j).type)), at / "remember_entries.parquet")
    return str(at), t.num_rows


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_queries_write_no_row_per_pair(spark, tables, name):
    rows, most = written(spark, lambda: registry.QUERIES[name](spark, tables[0]).collect())
    assert rows and most < 5 * tables[1]
