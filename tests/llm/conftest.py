import random

import pytest

WORDS = "bank loan rate deposit fee credit card loss income asset risk capital market growth quarter year branch client fund note bond yield cash equity debt swap trust audit board claim".split()


@pytest.fixture
def words_of():
    """A function that makes n random words from a seed."""
    return _words


def _words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
