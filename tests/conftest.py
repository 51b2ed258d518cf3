import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terradelta.session import local  # noqa: E402


@pytest.fixture(scope="session")
def shared_dir(tmp_path_factory):
    """Stands for the folder that a cluster names in spark.checkpoint.dir."""
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_dir):
    session = local(8, "6g", spark__checkpoint__dir=shared_dir)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
