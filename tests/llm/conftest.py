import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with an extra column whose name clashes with outputs."""
    def make(rows, source=None):
        return spark.createDataFrame(
            [(i, t, "en", source(i) if source else "s", len(t or ""), "x") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    return make


@pytest.fixture(scope="session")
def learns():
    return lambda i, parts: zlib.crc32(str(i).encode()) % parts != 0
