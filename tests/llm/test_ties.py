import numpy as np

from leafmill.llm import ann


def test_many_ties_go_to_the_smallest_ids():
    rng = np.random.default_rng(3)
    vectors = np.column_stack([np.ones(600), rng.permutation(600) / 600])
    ids = rng.permutation(600).tolist()
    cell = ann.Cell(vectors, [[i] for i in ids], float(np.sqrt((vectors**2).sum(axis=1).max())))
    query = np.array([1.0, 0.0])
    near = cell.tree.distances(ann.project(query[None, :], None)[0])
    found, seen = cell.search(query, near, np.inf, 1e9, 21)
    assert found == [(i, 1.0) for i in range(21)] and seen == 600
