import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, sig string, size int, rank int"


def rows(texts, **more):
    return [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or ""), i, "x", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns with names that the operators use themselves."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    long = prose(6000)
    base = prose(120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", " \n\t ", "...", "word", "Two words", base, near, base, long, prose(40) + "\n" + prose(30), "éß 字 " + prose(20), "a a a a a a a a a a a a", base.upper()]
    out = rows(texts)
    out += [out[6], out[6], (3, "another text under a known id", None, None, None, None, None, None, None), (None, "no id at all here", "en", "s1", 5, 1, "y", 1, 1), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(out, COLUMNS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
