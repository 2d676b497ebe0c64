"""Small tables of the shape the corpus operators read."""

from __future__ import annotations

import pyarrow as pa
import pytest

TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("key", pa.string())])


@pytest.fixture
def documents(spark):
    """``documents((doc_id, text[, lang]), ...)`` with an extra column whose name clashes with inner ones."""

    def build(*rows):
        data = [{"doc_id": r[0], "text": r[1], "lang": r[2] if len(r) > 2 else None, "source": "s", "n_chars": 0, "key": "k"} for r in rows]
        return spark.createDataFrame(pa.Table.from_pylist(data, schema=TEXT))

    return build
