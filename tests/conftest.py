import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import local_session

    session = local_session(cores=4, memory="4g", partitions=4)
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling costs more than it saves
    return session
