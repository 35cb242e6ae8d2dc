"""One session and the small annotation fixture used across tests."""

import os
import sys

import numpy as np
import pandas as pd
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]
# Workers import the helpers of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from track_help import FRAMES  # noqa: E402
from trackscore.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def annotations(spark):
    """One track that drifts down the picture while its action changes; some frames are skipped."""
    rows = []
    for at, frame in enumerate(FRAMES):
        top = 0.2 + 0.03 * at
        rows.append(("cam7", frame * 0.04, 0.35, top, 0.6 + 0.01 * (at % 2), top + 0.25, at % 3, 2, at))
    return spark.createDataFrame(
        rows, "video_id string, timestamp double, x1 double, y1 double, x2 double, y2 double, "
              "action_id int, target_id int, row_ord long")


@pytest.fixture(scope="session")
def skewed(spark):
    """Tracks of very different sizes with ties in time; one holds most rows."""
    rng = np.random.default_rng(7)
    rows, at = [], 0
    for video, n in (("hot", 400), ("a", 37), ("b", 5), ("c", 60)):
        for _ in range(n):
            rows.append((video, int(rng.integers(0, 40)) * 1.0, at, int(rng.integers(0, 3)),
                         bool(rng.random() > 0.3), float(np.round(rng.random(), 2))))
            at += 1
    frame = pd.DataFrame(rows, columns=["video_id", "timestamp", "row_ord", "action_id", "valid", "score"])
    frame["target_id"] = 0
    return spark.createDataFrame(frame).repartition(7).persist(), frame
