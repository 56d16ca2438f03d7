import random

from conftest import rows

from wardline.llm.frames import IdFilter
from wardline.llm.graph import components


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    # A long path, and a star with many leaves.
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(300)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert rows(found) == sorted(((x, top(x)) for x in linked), key=repr)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_id_filter_lets_all_its_ids_through(spark):
    from pyspark.sql import functions as F

    near = IdFilter(spark.range(0, 3000, 3), "id")
    passed = {r[0] for r in spark.range(0, 6000).filter(near.maybe(F.col("id"))).collect()}
    assert set(range(0, 3000, 3)) <= passed and len(passed) < 1700
