from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from aerolens.session import checkpoint_dir, get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="aerolens-tests", shuffle_partitions=4,
                    conf={"spark.driver.memory": "4g"})
    checkpoint_dir(s, tempfile.mkdtemp(prefix="aerolens-tests-"))
    yield s


T0 = dt.datetime(2024, 9, 15, 20, 0, 0, tzinfo=dt.timezone.utc)


def make_rows(spark, rows, extra_schema=""):
    """Telemetry frame from dicts; missing channels default to a moving flight."""
    base = []
    for i, r in enumerate(rows):
        ri = r.get("row_idx", i + 1)
        d = {
            "replicate": r.get("replicate", 3),
            "case_id": r.get("case_id", 1),
            "row_idx": ri,
            "_ord": r.get("_ord", i),
            "timestamp": r.get("timestamp", T0 + dt.timedelta(seconds=0.1 * ri)),
            "altitude": r.get("altitude", 50.0 + ri),
            "speed": r.get("speed", 10.0 + 0.1 * ri),
            "heading": r.get("heading", 90.0),
            "latitude": r.get("latitude", 52.0 + 0.0001 * ri),
            "longitude": r.get("longitude", 21.0),
            "label": r.get("label", 0),
            "tamper_type": r.get("tamper_type", "normal"),
            "profile": r.get("profile", "subtle"),
        }
        base.append(d)
    schema = ("replicate int, case_id bigint, row_idx bigint, _ord bigint, timestamp timestamp, "
              "altitude double, speed double, heading double, latitude double, longitude double, "
              "label int, tamper_type string, profile string")
    return spark.createDataFrame(base, schema)
