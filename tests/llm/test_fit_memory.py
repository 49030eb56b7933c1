import tracemalloc

import numpy as np

from leadflow.llm import toxicity


def test_a_fit_does_not_copy_its_sentences():
    """The driver holds the sentences of the sample once, not several times."""
    x = np.random.default_rng(5).random((120_000, 24))
    y = x[:, 0] + 0.3 * x[:, 1] > 0.9
    tracemalloc.start()
    w, b = toxicity._fit_machine(x, y, rounds=5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 2
    assert ((x @ w + b > 0) == y).mean() > 0.95
