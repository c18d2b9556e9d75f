import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def labels(spark):
    """Long-form streams from strings such as TFFT."""

    def make(truth: list[str], pred: list[str] | None = None):
        rows = [(s, p, t == "T", (pred[s][p] == "T") if pred else None) for s, marks in enumerate(truth) for p, t in enumerate(marks)]
        return spark.createDataFrame(rows, "stream_id long, pos long, truth boolean, pred boolean")

    return make
