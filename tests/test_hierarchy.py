import random

import pytest

from quillon.operators.hierarchy import Hierarchy

DDL = "node_key long, id string, parent_id string"


def brute(rows):
    last = {}
    for key, node, parent in rows:
        if node is not None and (node not in last or key > last[node][0]):
            last[node] = (key, parent)
    parents = {i: (p if p and p in last else None) for i, (_, p) in last.items()}
    out = {}
    for node in parents:
        seen, path, at = {}, [], node
        while at is not None and at not in seen:
            seen[at] = len(path)
            path.append(at)
            at = parents[at]
        if at is None:
            out[node] = (path[-1], len(path) - 1)
        else:
            ring = path[seen[at] :]
            out[node] = (min(ring), -1 if node in ring else -2)
    return out, parents


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    return {r.node_id: (r.root_id, r.depth) for r in Hierarchy(df, **how).found().collect()}


def forest(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        node = f"n{rng.randrange(n)}" if rng.random() < 0.1 else f"n{k}"
        r = rng.random()
        parent = None if r < 0.02 else "" if r < 0.03 else "nobody" if r < 0.04 else f"n{rng.randrange(n)}" if r < 0.3 else f"n{max(0, k - rng.randrange(5))}"
        if n // 3 < k < n // 3 * 2:
            parent = "n7"  # a hot parent
        rows.append((k, node if rng.random() > 0.01 else None, parent))
    return rows


@pytest.mark.parametrize("limit", [1 << 18, 60])
def test_random_forest_with_cycles(spark, limit):
    rows = forest(3, 1500)
    assert found(spark, rows, core_limit=limit) == brute(rows)[0]


def test_deep_chain_and_long_cycle(spark):
    rows = [(k, f"c{k}", f"c{k + 1}" if k < 3000 else None) for k in range(3001)]
    rows += [(5000 + k, f"r{k}", f"r{(k + 1) % 700}") for k in range(700)] + [(9000, "tail", "r5"), (9001, "self", "self")]
    expected, _ = brute(rows)
    assert found(spark, rows, core_limit=200) == expected
    assert expected["self"] == ("self", -1) and expected["tail"][1] == -2


def test_paths_and_intervals(spark):
    rows = [(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "a"), (5, "e", None), (6, "a", None)]
    h = Hierarchy(spark.createDataFrame(rows, DDL))
    assert {r.node_id: r.path for r in h.paths().collect()} == {"a": "a", "b": "a > b", "c": "a > b > c", "d": "a > d", "e": "e"}
    assert {r.node_id: r.n_descendants for r in h.spans().collect()} == {"a": 3, "b": 1, "c": 0, "d": 0, "e": 0}
    asked = spark.createDataFrame([("a",), ("b",)], "x string")
    assert {(r.node_id, r.descendant_id) for r in h.descendants(asked).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")}
    asked = spark.createDataFrame([("c",), ("e",)], "x string")
    assert {(r.node_id, r.ancestor_id) for r in h.ancestors(asked).collect()} == {("c", "a"), ("c", "b")}


def test_empty_null_and_extra_columns(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None, "x"), (2, None, None)]) == {}
    df = spark.createDataFrame([(1, "a", "b", "k", 5), (2, "b", None, "pk", 6)], DDL + ", k string, root int")
    assert {(r.node_id, r.depth) for r in Hierarchy(df).found().collect()} == {("a", 1), ("b", 0)}


@pytest.mark.parametrize("spread", [False, True])
def test_tails_into_cycles_across_partitions(spread):
    """Chains that lead over several partitions into a cycle inside one: only the cycle is marked."""
    import pyarrow as pa

    from quillon.operators import pointers

    names = ["key", "ptr", "steps", "gain", "done"]

    def jump(rows):
        out = pointers._jump_local_cut(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)]))
        return [tuple(r.values()) for b in out for r in b.to_pylist()]

    # partition = key // 1000; the cycle 1 -> 2 -> 3 -> 1 and tails over partitions 5 to 1 into it
    edges = {1: 2, 2: 3, 3: 1} | {p * 1000 + t: (p - 1) * 1000 + t if p > 1 else 1 + t % 3 for p in range(1, 6) for t in range(10, 19)}
    if spread:  # a cycle over five partitions
        edges |= {p * 1000 + 50: p % 5 * 1000 + 1050 for p in range(1, 6)}
    parts = [[(k, p, 1, 0, False) for k, p in edges.items() if k // 1000 == n] for n in range(6)]
    first = [r for part in parts for r in jump(part)]
    needed = {r[1] for r in first if not r[4]}
    core = jump([r for r in first if r[0] in needed])
    assert {r[0] for r in first + core if r[3] == -1} == ({1, 1050} if spread else {1})
    assert all(r[4] for r in core)


def test_registered_descendants(spark, sf):
    from quillon.plans import training

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/document_node.parquet").select(*[c.split()[0] for c in DDL.split(", ")]).collect()]
    outcome, parents = brute(rows)
    asked = {i for k, i, _ in rows if k % 20 == 0 and i is not None and outcome[i][1] >= 0}
    below = lambda n: parents[n] and {parents[n]} | below(parents[n]) or set()
    truth = {(a, n) for n, (_, depth) in outcome.items() if depth >= 0 for a in below(n) & asked}
    plain = lambda r: outcome[r.node_id][1] >= 0
    assert truth and {tuple(r) for r in training.p3_descendants(spark, sf).collect() if plain(r)} == truth
    spans = [r for r in training.p3_spans(spark, sf).collect() if plain(r)]
    read = {(a.node_id, n.node_id) for a in spans if a.node_id in asked for n in spans if n.root == a.root and a.exit < n.entry < a.entry}
    assert read == truth
