"""Memory of the best candidates."""

import numpy as np

from quillon.operators import ranking


def test_candidates_of_many_documents_are_bounded():
    """Arrays of a few candidates each count by what they hold."""
    top = ranking.Top(np.arange(4), 2, room=1_000)
    for k in range(5_000):
        top.add(k, np.full(4, float(k)), np.arange(4) == k % 4)
        assert len(top.held) <= 1 + 1_000 / ranking.ARRAYS
    query, ids, _ = top.columns()
    assert sorted(zip(query.tolist(), ids.tolist())) == sorted((k % 4, k) for k in range(4_992, 5_000))
