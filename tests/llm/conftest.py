"""Small tables with all the awkward rows."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    """n words in an order that hangs on the seed, without repeated runs."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


AWKWARD = [
    (1, prose(1, 60), "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, "   \n \n", "en", None, 5),
    (None, prose(5, 40), "en", "b", 3),
    (6, prose(6, 40), None, None, None),
    (6, prose(6, 40), None, None, None),
    (7, prose(1, 60), "de", "b", 9),
    (8, "x", "en", "b", 1),
    (9, "été 漢字 \U0001f600 " * 3, "fr", "c", 1),
    (10, prose(10, 30000), "en", "c", 1),
    (11, "&&& %%% ***", "en", "c", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, COLUMNS)


@pytest.fixture(scope="session")
def crowded(awkward):
    """The same with columns whose names the operators use inside, one of them twice, one differing in case."""
    from pyspark.sql import functions as F

    names = "i t n l r u v k id p key weight copies epochs host html page_id keep fp_hi fp_lo size digest payload shard".split()
    wide = awkward.select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    return wide.toDF(*[*wide.columns[:-2], "TEXT", "key"])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
