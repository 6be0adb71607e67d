import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, app="tests")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def frame(spark):
    """Rows whose timestamps are ISO text in UTC, typed by a DDL schema."""

    def make(rows, schema):
        import re

        from pyspark.sql import functions as F

        times = re.findall(r"(\w+) timestamp", schema)
        df = spark.createDataFrame(rows, re.sub(r"\btimestamp\b", "string", schema))
        return df.withColumns({c: F.to_timestamp(c) for c in times}) if times else df

    return make
