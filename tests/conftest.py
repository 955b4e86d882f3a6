import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.session import ROCKSDB_PROVIDER, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
