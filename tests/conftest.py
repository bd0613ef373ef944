import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# stub models defined in the tests are imported by the Python workers
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE), os.environ.get("PYTHONPATH", "")])
from kgweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("kgweave-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                      spark__ui__showConsoleProgress="false", spark__default__parallelism="4")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples."""
    d = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in d.collect()), key=str)
