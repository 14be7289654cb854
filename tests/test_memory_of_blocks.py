"""What a block of distances holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from memspark.operators import vectors


def test_distances_are_found_for_few_queries_at_a_time():
    rnd = np.random.default_rng(1)
    q, v = rnd.normal(size=(256, 4)), rnd.normal(size=(20_000, 4))
    ids, rows = pa.array(np.arange(len(v))), np.arange(len(v))
    tracemalloc.start()
    found = list(vectors._best({4: (np.arange(len(q)), q)}, {4: (rows, v)}, ids, 10, True))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    print("peak MB", round(peak, 1))
    assert len(found) == len(q) and peak < 60
    for (_, near, scores), x in zip(found[:20], q, strict=False):
        exact = np.round(1 / (1 + np.sqrt(((v - x) ** 2).sum(axis=1))), 6)
        assert list(near) == list(np.lexsort((rows, -exact))[:10]) and list(np.round(scores, 6)) == list(exact[near])
