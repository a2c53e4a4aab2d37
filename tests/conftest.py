import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from workload.local import local_session

    session = local_session("tests", "8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files of one repository out of a path -> content dictionary."""
    from addonscope.sources.corpus import classify

    def make(contents, repo="r"):
        rows = [(repo, path, text) for path, text in contents.items()]
        return classify(
            spark.createDataFrame(rows, "repo STRING, path STRING, content STRING")
        )

    return make
