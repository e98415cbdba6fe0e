import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import get_spark, shared_dir

    session = get_spark("tests", 8)
    shared_dir(session)
    return session
