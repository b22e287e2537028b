import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scopeline.session import local_session

    session = local_session(
        4,
        "3g",
        **{
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoints')}",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    yield session
    session.stop()
