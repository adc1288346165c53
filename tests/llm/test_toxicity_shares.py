"""Class shares and whole texts in the calibration, where the sample's bounds bind."""

import random
import zlib

import numpy as np
import pytest

from revoicer.llm import toxicity
from tests.llm.conftest import prose


def test_prior_and_calibration_do_not_depend_on_the_bounds(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        words = prose(rng, rng.choice([60, 900])).split()
        toxic = int(i % 7 == 0)
        if toxic or i % 70 == 1:  # some clean documents hold the word too
            words[rng.randrange(len(words))] = "vermin"
        rows.append((i, " ".join(words), toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = d.select("doc_id", "toxic")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    share = np.mean([r[2] for r in train])
    sample = toxicity.Sample(positives=50, negatives=100, steps=90)
    model = toxicity.fit(d.select("doc_id", "text"), labels, sample)
    assert model["prior"] == pytest.approx(share)
    # The scale is the one of all windows of all training texts, up to the sampled rows.
    z = toxicity.highest(model["p"], [t for _, t, _ in train])
    a, b = model["scale"]
    mean = toxicity.sigmoid(a * z + b).mean()
    assert abs(mean - share) < 0.05
