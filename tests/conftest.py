import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from vacantia.session import checkpoint_dir, local_session

    session = local_session(8, "tests")
    checkpoint_dir(session)
    return session
