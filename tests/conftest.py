import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from spanweave.session import session

    return session("local[4]", 4, spark__driver__memory="3g", spark__sql__execution__arrow__maxRecordsPerBatch="100")
