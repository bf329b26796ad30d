import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clinspan.session import remove_shared_dirs
    from compare import session

    session = session()
    yield session
    remove_shared_dirs()
    session.stop()
