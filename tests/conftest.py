import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bytestrata.session import local_session

    return local_session(
        "tests", "4", spark__driver__memory="4g", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__default__parallelism="4",
    )
