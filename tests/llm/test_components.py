"""Connected components against a plain union of sets."""

import random

from palaver.llm import simhash


def plain(pairs):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_roots_are_the_smallest_nodes(spark):
    rng = random.Random(5)
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += list(zip(chain, chain[1:], strict=False))  # a path of nodes in no order
    pairs += [(5000, i) for i in range(4000, 4100)] + [(-7, i) for i in range(6000, 6100)]  # led by the largest and by the smallest node
    pairs += [(a, b) for a in range(7000, 7020) for b in range(7000, 7020)] + [(b, a) for a, b in pairs[:50]] + pairs[:50]  # a clique, links in both directions and repeated ones
    found = simhash.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)).collect()
    assert len(found) == len({r.node for r in found})
    expected = plain((a, b) for a, b in pairs if a != b)
    assert {r.node: r.root for r in found} == expected
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_small_tables_take_few_tasks(spark):
    """A round over few links costs about two shuffles, not a dozen, also where partitions are not put together after a shuffle."""
    parts, names = 40, ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300, 2)], "a bigint, b bigint").repartition(parts)
    context = spark.sparkContext
    try:
        for name, value in zip(names, [str(parts), "false"], strict=True):
            spark.conf.set(name, value)
        context.setJobGroup("components", "tasks of components")
        assert simhash.components(links).count() == 300
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
    assert 0 < tasks < 2 * 4 * parts + 2 * parts + 60
