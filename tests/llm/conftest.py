import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `Doc_Id2` string, `_id` string, `path` string, `token.s` string"


def rows(seed: int = 1, n: int = 120):
    """Documents with copies, near copies, nulls, blanks, one very long text, repeated rows, and extra columns with names used inside."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeghilmnorstuvé") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    out = []
    for i in range(n):
        kind = rnd.randrange(8)
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 120))).capitalize() + "."
        if out and kind == 0:
            text = rnd.choice(out)[1] or ""
        elif out and kind == 1:
            near = (rnd.choice(out)[1] or "").split(" ")
            near[rnd.randrange(len(near))] = rnd.choice(words)
            text = " ".join(near)
        elif out and kind == 2:
            text = (rnd.choice(out)[1] or "").replace(" ", "\n  ", 2) + " "
        out.append((i, text, rnd.choice(["en", "fr", "xx", None]), rnd.choice(["src0", "src1"])))
    out += [(n, None, None, None), (n + 1, "", "en", "s"), (n + 2, " \n\t ", "en", "s"), (n + 3, "one two", "en", "s"), (n + 4, "one two", "en", "s"), (n + 5, " ".join(rnd.choice(words) for _ in range(30_000)), "en", "s")]
    out += [(n + 6, "x" * 20_000, "en", "s"), out[3], (None, "a text without a key, long enough to be one of the others here", "en", "s")]
    return [(*r, len(r[1] or ""), "e", "f", "g", "h") for r in out]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
