import random

import numpy as np

from docrecon.llm import components as module


def least_reachable(links):
    at = {}

    def root(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        at[max(p, q)] = min(p, q)
    return {x: root(x) for x in at}


def links_of(seed, nodes=400, n=330):
    draw = random.Random(seed)
    some = [(draw.randrange(nodes) - 50, draw.randrange(nodes) - 50) for _ in range(n)]
    some = [(a, b) for a, b in some if a != b]
    chain = [(1000 + k, 1001 + k) for k in range(300)]
    star = [(2000, 2001 + k) for k in range(200)]
    out = some + chain + star + some[:20]
    draw.shuffle(out)
    return out


def tables(spark, monkeypatch):
    """Names of the tables that ``components`` writes from now on."""
    real, names = module.settled, []

    def settled(df, name):
        names.append(name)
        return real(df, name)

    monkeypatch.setattr(module, "settled", settled)
    return names


def test_forest_joins_all_to_the_least():
    links = links_of(1)
    high, low = module.forest(*[np.array(x, np.int64) for x in zip(*links)])
    want = least_reachable(links)
    assert dict(zip(high.tolist(), low.tolist())) == {k: v for k, v in want.items() if k != v}
    assert len(high) == len(set(high.tolist()))


def test_links_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(module, "FILE_ROWS", 50)
    links = links_of(2)
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    names = tables(spark, monkeypatch)
    got = [tuple(r) for r in module.components(df).collect()]
    assert sorted(got) == sorted(least_reachable(links).items())
    assert "star" in names


def test_few_links_need_no_round(spark, monkeypatch):
    """Each round writes four tables and passes over all of them, however few the links."""
    names = tables(spark, monkeypatch)
    links = links_of(3)
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    assert sorted(tuple(r) for r in module.components(df).collect()) == sorted(least_reachable(links).items())
    assert names == ["links", "components"]


def test_further_links_join_components(spark, monkeypatch):
    monkeypatch.setattr(module, "FILE_ROWS", 50)
    links = links_of(4)
    first, more = links[::2], [*links[1::2], (-900, -901), (7000, 1005)]
    schema = "a long, b long"
    label = module.components(spark.createDataFrame(first, schema))
    got = module.extended(label, spark.createDataFrame(more, schema))
    assert sorted(tuple(r) for r in got.collect()) == sorted(least_reachable(first + more).items())


def test_no_links(spark):
    assert module.components(spark.createDataFrame([], "a long, b long")).count() == 0
