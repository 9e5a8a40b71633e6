import random

from tidemill.llm.components import connected_components

PAIRS = "a long, b long, low long, m long"


def brute(pairs):
    """The smallest node reachable from every node of the pairs, by plain loops."""
    pairs = [p for p in pairs if None not in p and p[0] != p[1]]
    of = {x: x for p in pairs for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(of[a], of[b])
            moved |= of[a] != low or of[b] != low
            of[a] = of[b] = low
    return of


def components(spark, pairs):
    rows = connected_components(spark.createDataFrame([(a, b, 7, None) for a, b in pairs], PAIRS)).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_matches_plain_loops(spark):
    rng = random.Random(3)
    chain = [(k + 1, k) for k in range(1000, 1040)]
    star = [(2000, k) for k in range(2001, 2060)]
    rest = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)]
    pairs = chain + star + rest + [(None, 1), (1, None), (None, None), (5000, 5000)] + rest
    assert components(spark, pairs) == brute(pairs)


def test_no_pairs(spark):
    assert components(spark, []) == {}
    assert components(spark, [(4, 4), (None, 4)]) == {}
