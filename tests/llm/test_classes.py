import random

from landloom.llm.classes import components, contracted


def least_connected(links):
    """Plain union: the least vertex of every vertex's component."""
    above = {}

    def root_of(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = root_of(a), root_of(b)
        above[max(a, b)] = min(a, b)
    return {x: root_of(x) for x in list(above)}


def test_contracted_links_join_the_same(spark):
    """A crowd whose members all meet many others, chains, pairs, repeated and turned links, links to oneself; over few and many partitions."""
    rng = random.Random(1)
    crowd = rng.sample(range(10_000), 300)
    links = [tuple(rng.sample(crowd, 2)) for _ in range(8000)] + [(20_000 + i, 20_001 + i) for i in range(50)] + [(30_000 + 2 * i, 30_001 + 2 * i) for i in range(40)]
    links += [(b, a) for a, b in links[:500]] + links[:200] + [(5, 5)]
    want = {x: r for x, r in least_connected(links).items() if x != 5 or r != 5}
    for partitions in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            fewer = contracted(spark.createDataFrame(links, "x long, y long").repartition(7), ("x", "y"))
            assert {r.id: r.root for r in components(fewer).collect()} == want
            assert fewer.count() < len(want) * 2
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_links(spark):
    none = contracted(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0 and components(none).count() == 0
