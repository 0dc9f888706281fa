import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
# the workers import the package too, from wherever pytest was started
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ.setdefault("MARLSTONE_DRIVER_MEMORY", "4g")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import local_session

    session = local_session("tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF
