"""Recall of the chosen paths inside one large family, and exact verification; no session needed."""

import time

import numpy as np
from pulsegrid.llm import near_dedup, textblocks


def sketch_of(sets):
    """64 minwise values of each set, as the operator takes them."""
    out = np.zeros((len(sets), near_dedup.FUNCTIONS), np.uint64)
    for i, values in enumerate(sets):
        for k in range(near_dedup.FUNCTIONS):
            out[i, k] = ((values ^ near_dedup._KEYS[k]) * (near_dedup._KEYS[near_dedup.FUNCTIONS + k] | np.uint64(1))).min()
    return textblocks.mix(out)


def family(pairs, shared, own, common, seed):
    """``pairs`` pairs of documents: all share ``shared`` shingles, a pair ``common`` of its ``own`` others."""
    rng = np.random.default_rng(seed)
    boilerplate, sets = rng.integers(1, 2**63, shared).astype(np.uint64), []
    for _ in range(pairs):
        both = rng.integers(1, 2**63, common).astype(np.uint64)
        for _ in range(2):
            sets.append(np.unique(np.r_[boilerplate, both, rng.integers(1, 2**63, own - common).astype(np.uint64)]))
    return sets


def similarity(a, b):
    common = len(np.intersect1d(a, b))
    return common / (len(a) + len(b) - common)


def found_pairs(sets, settings):
    """Groups of all trees over the family: pairs of one group."""
    least, sizes = sketch_of(sets), np.array([len(s) for s in sets])
    sketch = (least >> np.uint64(40)).astype(np.uint8)
    together = np.zeros((len(sets), len(sets)), bool)
    for tree in range(settings.trees):
        for token in np.unique(least[:, tree]):
            rows = np.flatnonzero(least[:, tree] == token)
            if len(rows) > 1:
                paths = near_dedup._Paths(int(token >> np.uint64(1)) + tree, sizes[rows], sketch[rows], rows, settings)
                paths.explore(np.arange(len(rows)))
                for group in paths.groups:
                    together[np.ix_(rows[group], rows[group])] = True
    return together


def test_recall_of_pairs_in_a_deep_family():
    """Strangers at 0.70, pairs at 0.79, nodes compared only below 48 open documents: branching goes deep and still finds them."""
    sets = family(700, 165, 35, 12, 1)
    assert 0.69 < similarity(sets[0], sets[2]) < 0.72 and 0.75 < similarity(sets[0], sets[1]) < 0.80
    together = found_pairs(sets, near_dedup.Settings(node=48))
    assert np.mean([together[2 * k, 2 * k + 1] for k in range(700)]) >= 0.9


def test_family_of_the_given_size_is_quick_and_whole():
    """The same family with the operator's own settings: all pairs, and exact components, in seconds."""
    sets, settings = family(700, 165, 35, 12, 2), near_dedup.Settings()
    started = time.perf_counter()
    together = found_pairs(sets, settings)
    assert all(together[2 * k, 2 * k + 1] for k in range(700))
    label = near_dedup.linked(sets, np.arange(1_400), 75)
    assert time.perf_counter() - started < 30
    assert all(label[2 * k] == label[2 * k + 1] for k in range(700)) and len(np.unique(label)) == 700


def test_groups_stay_bounded():
    """Whatever the sizes, a group's shingles stay near the bound, and every alike pair shares a group."""
    sets = family(150, 60, 8, 6, 3)
    settings = near_dedup.Settings(group=2_000)
    least = sketch_of(sets)
    paths = near_dedup._Paths(5, np.array([len(s) for s in sets]), (least >> np.uint64(40)).astype(np.uint8), np.arange(len(sets)), settings)
    paths.explore(np.arange(len(sets)))
    held = {frozenset((int(a), int(b))) for g in paths.groups for a in g for b in g if a < b}
    assert max(sum(len(sets[i]) for i in g) for g in paths.groups) <= 2 * (2_000 + 70)
    assert all(frozenset((2 * k, 2 * k + 1)) in held for k in range(150))
