"""A tick of the settlement worker over any number of payments."""


def test_a_tick_of_any_size_counts_ranges(spark, monkeypatch):
    """The n-th number by counts, with numbers that come twice, far apart and negative; and no more rows at the driver than ranges."""
    import random

    from parley.streaming import worker

    rnd = random.Random(3)
    numbers = [rnd.randrange(-50, 50) for _ in range(40)] + [rnd.randrange(10**15) for _ in range(160)]
    monkeypatch.setattr(worker, "RANGES", 16)
    frame = spark.createDataFrame([(i,) for i in numbers], "payment_id long")
    for n in (1, 2, 40, 41, 150, 200):
        assert worker.reach(frame, n) == (min(numbers), sorted(numbers)[n - 1], n)
    assert worker.reach(frame, 201) == (min(numbers), max(numbers), 200) and worker.reach(frame.limit(0), 5) == (0, -1, 0)
