from laminae.operators import series


def test_draws_meet_items_by_an_equal_key_and_without_one_task_for_all(spark):
    weights = spark.createDataFrame([(k, 500 if k == 7 else k % 3) for k in range(60)], "id long, w long")
    draws = spark.createDataFrame([(k, k / 400) for k in range(400)], "draw long, u double")
    out = series.cumulative_sampler(weights, draws)
    total, upto, want = 0, [], {}
    for k in range(60):
        total += 500 if k == 7 else k % 3
        upto.append(total)
    for k in range(400):
        want[k] = next(i for i, c in enumerate(upto) if k / 400 < c / total)
    assert {r.draw: r.id for r in out.collect()} == want and out.count() == 400
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan
