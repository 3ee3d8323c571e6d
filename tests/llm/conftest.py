import shutil
import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def scratch(spark):
    """A shared folder of its own for staged tables, where the session names none."""
    if spark.conf.get("spark.checkpoint.dir", None):
        yield
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("tapeloom.scratch.dir", folder)
    yield
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (or (doc_id, text) pairs), with columns whose names clash."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, "en", None, None if t is None else len(t), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, piece long, kept string")

    return make
