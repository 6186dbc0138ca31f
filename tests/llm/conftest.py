import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long, label int, score double, n_tokens string, node long, hub long, raw binary, h long, key string, salt int"


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang), with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, None, -1, 7, 0.5, "x", -2, -3, b"r", 5, "k", 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


