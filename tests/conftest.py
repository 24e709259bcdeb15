from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from runloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="runloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def runs(spark):
    """Twenty runs of three workflows with mixed states."""
    rows = []
    for i in range(20):
        status = "success" if i < 15 else "failed" if i < 18 else "timeout" if i == 18 else "error"
        outputs = {"answer": "x" * 50} if status == "success" else {}
        rows.append(
            (f"wf_{i % 3}", f"exec_{i:03d}", i, status, 0.5 + 0.2 * i, 100 + 20 * i, 0.01 + 0.002 * i, outputs,
             "variant_0" if i % 2 == 0 else None, "dataset_0" if i % 3 == 0 else None)
        )
    return spark.createDataFrame(
        rows,
        "workflow_id string, execution_id string, seq long, status string, execution_time double, tokens_used long, "
        "cost double, outputs map<string,string>, prompt_variant string, dataset string",
    )
