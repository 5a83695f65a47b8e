import pytest


@pytest.fixture(scope="session")
def scratch(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(scratch):
    """Rows (doc_id, text, lang, source) as documents, with a column whose name the operators use themselves."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return scratch.createDataFrame([(*r, "mine") for r in full], DOCS + ", spans string")
    return make
