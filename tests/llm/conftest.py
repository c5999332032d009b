from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Extra columns have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size int, name string, block binary, `set` int, `__mw` int"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x", "y", 1, "z", b"b", 2, 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, ties and repeated rows."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "x1", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(10)]
    rows += [(300, None), (301, ""), (302, "   \n\t "), (303, "."), (304, "one"), (305, "one two three"), (306, "ONE two three")]
    rows += [(307, " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(20_000)))]
    rows += [(308, "same row"), (308, "same row")]
    return rows
