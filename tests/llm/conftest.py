import random

import pytest


@pytest.fixture
def prose():
    """Random pseudo-word texts from a small vocabulary."""

    def make(n, seed=0, words=(0, 60), vocabulary=300):
        rng = random.Random(seed)
        vocab = ["".join(rng.choice("abcdeéÄß") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
        return [" ".join(rng.choice(vocab) for _ in range(rng.randint(*words))) for _ in range(n)]

    return make
