from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline
from quakeloom.llm import registry


def test_every_operator_has_a_query_and_sql_is_text():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert all(isinstance(text, str) for text in entry.oracle_sql().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
