from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, n long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with extra columns whose names clash with helper columns: (doc_id, text[, source])."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", None, 1) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
