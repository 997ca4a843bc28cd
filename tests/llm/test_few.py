"""Rounds over small tables take few tasks, also where the session deals everything over many."""

from barley.llm.components import components


def tasks_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    result = work()
    tracker, total = spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            total += info.numCompletedTasks if info else 0
    spark.sparkContext.setJobGroup("", "")
    return result, total


def test_rounds_of_few_links(spark):
    settings = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 9), (8, 9)], "a bigint, b bigint")
        got, tasks = tasks_of(spark, "few links", lambda: {r["id"]: r["component"] for r in components(links).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 8: 7, 9: 7}
    # every exchange of every round took 100 tasks before
    assert tasks < 1000
