import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from faultlens.session import local_session

    session = local_session("faultlens-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def files_of(spark, rows):
    """(language, content) rows as a files table with an ``id``."""
    return spark.createDataFrame(
        [(i, "r", f"f{i:04d}", language, content) for i, (language, content) in enumerate(rows)],
        "id int, repo_url string, path string, language string, content string")
