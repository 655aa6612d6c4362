import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept string, size long, cell int, h long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]), with further columns whose names operators use inside."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], (r + (None,) * 4)[2], (r + (None,) * 4)[3], None, "x", "y", 1, 2, 3) for r in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def sample():
    """Nulls, empty texts, ties, copies, near copies, a long text and unusual characters."""
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcdefgéß") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, near = prose(60), prose(150)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, "Ünï ☃ <|endoftext|> 12,3 don't"), (7, passage), (8, passage), (8, passage), (None, passage), (None, None)]
    rows += [(10 + k, prose(30) + " " + passage + " " + prose(20)) for k in range(6)]
    rows += [(30 + k, near.replace(near.split()[k], "changed", 1)) for k in range(8)]
    rows += [(50 + k, prose(r.randrange(1, 120)) + "\nA line that all of these share\n" + prose(9)) for k in range(30)]
    rows += [(90, prose(20_000)), (91, "x" * 5000), (92, "x" * 4000 + prose(50)), (93, "spam " * 3000)]
    return rows
