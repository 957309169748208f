"""Places of words go to Python as whole numbers, not as objects."""

import numpy as np
import pytest

from annalist.operators import retrieval


@pytest.mark.parametrize("places, n, score", [([(0, 0), (1, 1)], 2, 1.0), ([(0, 0), (2, 1), (3, 0)], 2, 1.5), ([(4, 0), (7, 0)], 1, 2.0), ([(0, 0), (1, 0)], 2, 0.0), ([], 3, 0.0), ([(0, 2), (1, 1), (5, 0)], 3, 0.25)])
def test_density_of_packed_places(places, n, score):
    assert retrieval._cover(np.array([p * n + t for p, t in places], np.int64), n) == score


def test_scores_of_batches_that_are_slices(spark):
    rows = spark.createDataFrame([(q, d, 2, [(d, 0), (d + 1 + q, 1)]) for q in range(3) for d in range(40)], "item_id long, doc_id long, n int, places array<struct<place:int,term:int>>")
    got = retrieval._scored(rows.where("doc_id % 3 = 1"), "item_id", "doc_id").collect()
    assert len(got) == 39 and all(r.score == 1 / (r.item_id + 1) for r in got)
