from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from wayfare.llm import blocks


def joined_by_node(df):
    """Rows that the joins by node of a frame that has run gave."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") and "node" in plan.leftKeys().toString() else 0
        return own + sum(walk(plan.children().apply(k)) for k in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("block", [4, 512])
def test_meetings(spark, block):
    """All pairs of different labels under a key that pass, by blocks of either kind; a member's traits are joined once, not once for each of its keys."""
    rng = random.Random(block)
    members = {k: (rng.randint(0, 9), rng.randint(0, 30)) for k in range(120)}
    held = {key: rng.sample(range(120), 30) for key in range(25)} | {99: [5], 98: [k for k, m in members.items() if m[0] == 3]}
    entries = spark.createDataFrame([(key, k, members[k][0], key) for key, ks in held.items() for k in ks], "key long, node long, label long, extra long")
    traits = spark.createDataFrame([(k, size) for k, (_, size) in members.items()], "node long, size long")

    def judge(cols):
        size, extra = cols["size"].to_numpy(), cols["extra"].to_numpy()
        return lambda i, j: (np.abs(size[i] - size[j]) <= 3) & (extra[i] == extra[j])

    made = blocks.meetings(entries, traits, judge, False, block)
    pairs = {tuple(sorted(p)) for ks in held.values() for p in itertools.combinations(ks, 2) if members[p[0]][0] != members[p[1]][0] and abs(members[p[0]][1] - members[p[1]][1]) <= 3}
    assert set(map(tuple, made.collect())) == pairs
    assert joined_by_node(made) <= len(members)
    # of a forest the pairs connect the same labels
    some = set(map(tuple, blocks.meetings(entries, traits, judge, True, block).collect()))
    assert some <= pairs and len(some) < len(pairs)

    def groups(of):
        up = {k: k for k in range(10)}
        for a, b in of:
            a, b = members[a][0], members[b][0]
            up = {k: min(up[a], up[b]) if v in (up[a], up[b]) else v for k, v in up.items()}
        return up

    assert groups(some) == groups(pairs)
