import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

from tidemark.session import local_session  # noqa: E402

LIMITS = {"hotGroupRows": 5, "modelGroupRows": 20, "matchValuesPerTask": 3}


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidemark-tests")
    yield session
    session.stop()


@pytest.fixture
def small_limits(spark):
    """Every size limit lowered to a few rows, so the large-group ways run."""
    for name, value in LIMITS.items():
        spark.conf.set(f"spark.tidemark.{name}", str(value))
    yield
    for name in LIMITS:
        spark.conf.unset(f"spark.tidemark.{name}")
