"""k-means of many nodes in one job a round against the loop of one node."""

import numpy as np

from stratalens.operators import clusters
from stratalens.operators.segments import kmeans_nodes


def groups(seed, nodes=4, rows=90):
    """Well-parted groups: no center lies where two sums could tell differently."""
    rng = np.random.default_rng(seed)
    out = []
    for node in range(nodes):
        base = rng.standard_normal((node + 2, 10))
        for i in range(rows + 11 * node):
            v = base[i % len(base)] + 0.05 * rng.standard_normal(10)
            out.append((f"0/{node}", f"f{node}/{i:03}", [float(x) for x in v]))
    return out


def test_nodes_at_once_equal_each_node_alone(spark):
    items = spark.createDataFrame(groups(2), "node string, path string, vector array<double>")
    want = sorted(map(tuple, clusters.cluster_group(items, ["node"], 20, "path").collect()))
    got = sorted(map(tuple, kmeans_nodes(items, 20, 20, rows_of=25).select("node", "path", "cluster").collect()))
    assert got == want and len({c for _, _, c in got}) > 2


def test_jobs_do_not_grow_with_nodes(spark):
    status = spark.sparkContext.statusTracker()
    jobs = []
    for nodes in (2, 8):
        alike = [(f"{n}/{k}", p, v) for k in range(nodes // 2) for n, p, v in groups(3, 2, 50)]
        items = spark.createDataFrame(alike, "node string, path string, vector array<double>")
        spark.sparkContext.setJobGroup(f"nodes{nodes}", "nodes")
        kmeans_nodes(items, 6, 3).count()
        jobs.append(len(status.getJobIdsForGroup(f"nodes{nodes}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 5


def test_hierarchy_with_large_nodes(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 12))
    rows = [(f"src/m{i % 5}/f{i:03}.ts", [float(x) for x in base[i % 3] + 0.3 * base[(i // 3) % 3] + 0.02 * rng.standard_normal(12)]) for i in range(160)]
    items = spark.createDataFrame(rows, "path string, vector array<double>")
    told = lambda n: sorted(map(tuple, clusters.hierarchy(items, 3, 10, 2, n).collect()))
    assert told(30) == told(1_000_000)
