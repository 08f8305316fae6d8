import random

from brute import classes

from quoteflow.llm.components import components


def test_chains_stars_rings_and_repeats(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(50, 51), (51, 52), (52, 50)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3), (2, None)]
    edges += edges[:20]
    rng.shuffle(edges)
    proper = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {x for e in proper for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(nodes) and dict(map(tuple, got)) == classes(nodes, proper)


def test_text_nodes_and_no_edges(spark):
    got = components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")).collect()
    assert dict(map(tuple, got)) == {"a": "a", "b": "a", "c": "a"}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
