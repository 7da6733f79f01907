import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weirflow.session import Settings, session  # noqa: E402



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    settings = Settings(
        job_name="tests",
        master="local[4]",
        parallelism=4,
        checkpoint_dir=f"file://{shared}",
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    spark = session(settings)
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"
