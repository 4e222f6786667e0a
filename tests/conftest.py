import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codesift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def scan_text(spark):
    """Findings of inline texts as {path: [(rule_id, line, snippet), ...]} in order."""
    from codesift import audit

    def run(texts, **options):
        if isinstance(texts, str):
            texts = {"a.sol": texts}
        sources = spark.createDataFrame(list(texts.items()), "path string, content string")
        rows = audit(sources, **options).findings().orderBy("path", "position").collect()
        found = {path: [] for path in texts}
        for row in rows:
            found[row.path].append((row.rule_id, row.line, row.code_snippet))
        return found

    return run
