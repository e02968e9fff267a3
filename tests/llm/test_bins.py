"""Counts of tokens by their high bits: packed small, and never below the true overlap."""

import numpy as np
import pytest

from launchlens.llm import jaccard


@pytest.mark.parametrize("top, width", [(15, 0.5), (16, 1), (255, 1), (256, 2), (65535, 2)])
def test_counts_take_the_bits_they_need(top, width):
    counts = np.random.default_rng(top).integers(0, top + 1, 64)
    counts[5] = top
    packed = jaccard._packed(counts)
    assert len(packed) == 1 + 64 * width and jaccard._counts(packed).tolist() == counts.tolist()


def test_bins_bound_the_overlap_of_sets_of_any_size():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 2**64, 5000, dtype=np.uint64)
    sets = [np.unique(draw.choice(pool, n)) for n in (1, 30, 700, 4000)]
    first = np.cumsum([0, *map(len, sets)])
    bins = jaccard._bins(np.concatenate(sets), first)
    for a, one in zip(sets, bins):
        assert len(one) <= 9 + len(a) // 2  # half a byte a bin
        for b, other in zip(sets, bins):
            assert len(np.intersect1d(a, b)) <= jaccard._most_common(one, [other]) <= len(a)
