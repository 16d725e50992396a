"""Concentration steps go on until no start moves."""

import logging

import numpy as np

from quirefold.llm import quality


def test_steps_have_no_cap(spark, caplog):
    r = np.random.default_rng(0)
    x = r.normal(size=(20_000, 5)) * 1000
    x[:10_000] = r.normal(size=(10_000, 5)) * 1400 + 2500  # two clouds that the nearest three quarters shift between
    fit = spark.createDataFrame([("p", *map(int, v)) for v in x], "pool string, " + ", ".join(f"{s} bigint" for s in quality.STATS))
    with caplog.at_level(logging.INFO, logger=quality.__name__):
        found = quality.estimates(fit, True, 0.75, (0.0,) * 5, 12).collect()
    told = [rec.args for rec in caplog.records]
    assert [k for k, _ in told] == list(range(1, len(told) + 1)) and len(told) > 12
    assert told[-1][1] == 0 and all(n > 0 for _, n in told[:-1])
    assert len(found) == 1
