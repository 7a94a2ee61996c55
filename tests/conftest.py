import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle  # noqa: E402

import pixelkin  # noqa: E402
from pixelkin.session import local_session  # noqa: E402

# The package is not installed on the workers here, so its functions travel with the tasks.
cloudpickle.register_pickle_by_value(pixelkin)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", shuffle_partitions=4)
    yield session
    session.stop()
