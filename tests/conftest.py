import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from feedloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def feedback(spark):
    from catalog.fixture import feedback as view

    return view(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def analyzed(spark, feedback):
    from feedloom.operators.signals import enrich
    from feedloom.session import materialize

    return materialize(enrich(feedback, normalise=False))
