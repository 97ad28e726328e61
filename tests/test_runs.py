from notelens.operators import runs


def test_running_mean_keeps_null_keys(spark):
    rows = [(1, "a", 1, 0, 2.0), (2, "a", 1, runs.STEPS, 4.0), (3, None, 1, 0, 1.0), (4, None, 1, 1, 3.0), (5, "a", None, 0, 5.0),
            (6, "b", 1, None, 7.0), (7, None, None, None, 8.0)]
    losses = spark.createDataFrame(rows, "id long, experiment string, epoch int, step long, loss double")
    got = runs.running_mean(losses)
    assert {r.id: r.mean_loss for r in got.collect()} == {1: 2.0, 2: 3.0, 3: 1.0, 4: 2.0, 5: 5.0, 6: 7.0, 7: 8.0}
