import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threatlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = (session.builder("tests").master("local[8]").config("spark.sql.shuffle.partitions", "8")
           .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
           .config("spark.driver.memory", "8g")
           .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    out.sparkContext.setLogLevel("OFF")
    yield out
    out.stop()


@pytest.fixture
def lines(spark):
    """Makes raw_logs from (source_file, line_number, line) rows."""
    def make(rows):
        return spark.createDataFrame(
            [(f, n, text, "generic") for f, n, text in rows],
            "source_file string, line_number bigint, line string, log_type string")
    return make
