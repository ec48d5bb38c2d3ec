"""Soundness of bound artifacts against plain recursion, with broken links and cycles."""

import random

from grovespan.operators import closure


def plain(ids, links):
    hashes = dict(ids)
    own = {i: [] for i in hashes}
    problems = {i: set() for i in hashes}
    for child, parent, bound in links:
        if child in own:
            if parent not in hashes:
                problems[child].add("missing_parent")
            elif bound is None or bound != hashes[parent]:
                problems[child].add("hash_differs")
            else:
                own[child].append(parent)
    sound = {}
    while True:
        new = {i: max([sound[p] + 1 for p in own[i]], default=0) for i in hashes if i not in sound and not problems[i] and all(p in sound for p in own[i])}
        if not new:
            break
        sound |= new
    behind = {i for i in hashes if problems[i]}
    while more := {i for i in hashes if i not in behind and any(p in behind for p in own[i])}:
        behind |= more
    return {i: ("sound", None, sound[i]) if i in sound else ("broken", ",".join(sorted(problems[i])), None) if problems[i] else ("depends" if i in behind else "cycle", None, None) for i in hashes}


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, forward in ((30, True), (40, False)):
        ids = [(i, f"h{i}") for i in range(n)]
        links = []
        for i in range(n):
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(i) if i and (forward or rng.random() < 0.9) else rng.randrange(n)
                links.append((i, p if rng.random() < 0.95 else 999, f"h{p}" if rng.random() < 0.93 else rng.choice([None, "x"])))
        links += links[:3] + [(500, 1, "h1")]
        got = closure.soundness(spark.createDataFrame(ids, "id bigint, hash string"), spark.createDataFrame(links, "child bigint, parent bigint, bound string")).collect()
        assert {r["id"]: (r["status"], r["problem"], r["level"]) for r in got} == plain(ids, links)


def test_cycles_and_nothing(spark):
    ids = spark.createDataFrame([(i, "h") for i in range(5)], "id bigint, hash string")
    links = spark.createDataFrame([(1, 2, "h"), (2, 1, "h"), (3, 2, "h"), (4, 4, "h")], "child bigint, parent bigint, bound string")
    got = {r["id"]: r["status"] for r in closure.soundness(ids, links).collect()}
    assert got == {0: "sound", 1: "cycle", 2: "cycle", 3: "cycle", 4: "cycle"}
    assert {r["status"] for r in closure.soundness(ids, links.limit(0)).collect()} == {"sound"}
    assert closure.soundness(ids.limit(0), links.limit(0)).collect() == []
