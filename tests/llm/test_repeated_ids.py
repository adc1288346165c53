"""Near-duplicate classes of tables that repeat an id."""

import random

from revoicer.llm import neardup
from tests.llm.conftest import prose


def test_no_class_is_lost_where_ids_repeat(spark):
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    near = d + " one more"
    rows = [(3, a), (9, a), (9, b), (20, c), (20, a + " " + b), (30, d), (30, near), (30, near), (31, d)]
    kept = neardup.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r.doc_id, r.text) for r in kept)
    assert [i for i, _ in texts] == [3, 9, 20, 20, 30]
    assert texts[:2] == [(3, a), (9, b)] and {t for i, t in texts if i == 20} == {c, a + " " + b}
