"""Tasks that the driver keeps count of, however few the rows."""

from stratalens.llm import components

PARTS = 37


def test_a_round_of_components_deals_its_edges_four_times(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    rounds = []
    monkeypatch.setattr(components, "materialise", lambda df, name, f=components.materialise: rounds.append(name) or f(df, name))
    edges = [(i, i + 1) for i in range(8)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("components", "")
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(9)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("components") for s in seen.getJobInfo(j).stageIds}
    dealt = [s for s in map(seen.getStageInfo, stages) if s and s.numCompletedTasks == PARTS]
    assert len(dealt) <= 4 * (len(rounds) - 1) + 2, (len(dealt), len(rounds))  # and the first and the last distinct ones
