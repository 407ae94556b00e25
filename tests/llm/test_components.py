"""Connected components on chains, stars and repeated links."""

import random

from airsignal.llm.components import connected_components
from tests.llm.test_simhash import classes


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (201, 202), (202, 201)]
    pairs += [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(120)]
    group = classes(500, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = {x: min(y for y in nodes if group[y] == group[x]) for x in nodes}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
