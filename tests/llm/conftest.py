import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name in spark.checkpoint.dir."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def texts(spark):
    """A documents table from (id, text) rows, with columns whose names clash with the operators' own."""

    def build(rows, **extra):
        names = {"source": "s", "key": 1, "print": 2, "component_id": 3, "line": 4, "kept": 5, **extra}
        schema = "doc_id bigint, text string" + "".join(f", `{k}` {'string' if isinstance(v, str) else 'int'}" for k, v in names.items())
        return spark.createDataFrame([(*row, *names.values()) for row in rows], schema)

    return build

