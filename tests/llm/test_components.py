"""Components of links: against a plain search, and the rows that joins make of the links."""

import random

import pytest

from colform.llm.components import components
from colform.llm.shared import Workspace


def joined_rows(spark, run) -> int:
    """Rows that the joins of all executions inside ``run`` gave."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    seen = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    total, all_ = 0, store.executionsList(int(seen), 1 << 20)
    for i in range(all_.size()):
        run_id = all_.apply(i).executionId()
        metrics, nodes = store.executionMetrics(run_id), store.planGraph(run_id).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" not in node.name():
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                    total += int(metrics.apply(metric.accumulatorId()).replace(",", ""))
    return total


def plain(links) -> dict[int, int]:
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def graphs():
    rng = random.Random(3)
    yield "path", [(i, i + 1) for i in range(200)]
    yield "star of the largest", [(500, i) for i in range(300)]
    yield "sparse", [(rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(300)]
    yield "zigzag", [(i, 1000 - i) for i in range(100)] + [(i + 1, 1000 - i) for i in range(99)]


@pytest.mark.parametrize("links", [pytest.param(links, id=name) for name, links in graphs()])
@pytest.mark.parametrize("parts", [1, 3])
def test_components_against_a_plain_search(spark, links, parts):
    work, labels, cut = Workspace(spark, "components"), None, -(-len(links) // parts)
    for k in range(parts):
        some = spark.createDataFrame(links[k * cut : (k + 1) * cut], "a long, b long")
        labels = components(some, work, f"c{k}", *([] if labels is None else [labels]))
    want = plain([x for x in links if x[0] != x[1]])
    assert sorted(map(tuple, labels.select("node", "label").collect())) == sorted(want.items())


def test_no_links(spark):
    work = Workspace(spark, "components")
    labels = components(spark.createDataFrame([], "a long, b long"), work, "c0")
    assert labels.columns == ["node", "label"] and not labels.count()


def test_links_are_not_joined_again_in_every_round(spark):
    hubs, leaves = 20, 400
    links = spark.createDataFrame([(h * 1009 % 997, 1000 + i) for h in range(hubs) for i in range(leaves)], "a long, b long")
    work = Workspace(spark, "components")
    assert joined_rows(spark, lambda: components(links, work, "c")) < 3 * hubs * leaves
