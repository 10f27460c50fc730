import numpy as np

from tremorframe.operators import learning


def test_blocks_do_not_change_the_rows(spark):
    r = np.random.default_rng(6)
    data = [(i, int(i % 4 == 0), *(float(v) for v in r.normal(size=3))) for i in range(240)]
    df = spark.createDataFrame(data, "id long, label int, a double, b double, c double")
    whole, dealt = (sorted(map(tuple, learning.smote(df, "id", "label", ["a", "b", "c"], 5, block=n).where("id < 0").collect())) for n in (5000, 10))
    assert whole == dealt and len(whole) == 120
    x = {row[0]: np.array(row[2:]) for row in data if row[1] == 1}
    for key, label, *v in whole:
        own = (-1 - key) // 1000
        near = sorted((j for j in x if j != own), key=lambda j: ((x[j] - x[own]) ** 2).sum())[:5]
        # The new row lies between its own and one of the five nearest of the class.
        gaps = [abs(np.linalg.norm(v - x[own]) + np.linalg.norm(v - x[j]) - np.linalg.norm(x[j] - x[own])) for j in near]
        assert label == 1 and min(gaps) < 1e-9


def below(plan):
    """A plan's nodes, through adaptive plans and their stages."""
    yield plan
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
    children = plan.children()
    for p in inner + [children.apply(i) for i in range(children.size())]:
        yield from below(p)


def test_only_rows_with_copies_ask(spark):
    """A class that lacks ten rows has ten that ask for neighbours, however large it is."""
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(i < 290), *(float(v) for v in r.normal(size=2))) for i in range(590)], "id long, label int, a double, b double")
    rows = learning.smote(df, "id", "label", ["a", "b"], 3)
    assert rows.where("id < 0").count() == 10
    rows.collect()
    got = [n.metrics().apply("pythonNumRowsReceived").value() for n in below(rows._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("FlatMapGroupsInPandas")]
    assert got and max(got) <= 10 * 3
