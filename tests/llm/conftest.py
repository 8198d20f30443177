import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
