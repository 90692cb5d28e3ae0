import os

import pytest

from loomspan.llm import common
from loomspan.llm.common import Scratch

READ, ARROW = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"


class _Watched:
    """A table that notes the session's settings when it is written."""

    def __init__(self, df, broken=False):
        self.df, self.schema, self.write, self.broken, self.seen = df, df.schema, self, broken, {}

    def option(self, key, value):
        return self

    def parquet(self, path):
        self.seen = {key: int(self.df.sparkSession.conf.get(key)) for key in (READ, ARROW)}
        if self.broken:
            raise RuntimeError("no space")
        self.df.write.parquet(path)


def test_few_texts_are_decoded_at_once_while_a_result_is_written(spark, sf):
    own = {key: spark.conf.get(key) for key in (READ, ARROW)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    watched = _Watched(docs)
    kept = Scratch(spark, "t").keep(watched, "docs")
    assert watched.seen == {READ: common.READ_ROWS, ARROW: common.ARROW_ROWS}
    assert watched.seen[READ] < int(own[READ])
    assert {key: spark.conf.get(key) for key in own} == own
    assert kept.exceptAll(docs).count() == docs.exceptAll(kept).count() == 0


def test_smaller_settings_of_a_session_stay_and_come_back_after_a_failure(spark):
    own = spark.conf.get(READ)
    try:
        spark.conf.set(READ, 7)
        watched = _Watched(spark.range(3), broken=True)
        with pytest.raises(RuntimeError):
            Scratch(spark, "t").keep(watched, "rows")
        assert watched.seen[READ] == 7 and spark.conf.get(READ) == "7"
    finally:
        spark.conf.set(READ, own)


def test_the_driver_keeps_no_file_lists_of_written_tables(spark):
    key = common.FILE_LISTS
    own = spark.conf.get(key)
    kept = Scratch(spark, "t").keep(spark.range(5), "rows")
    index = kept._jdf.queryExecution().analyzed().relation().location()
    field = next(x for x in index.getClass().getDeclaredFields() if x.getName().endswith("fileStatusCache"))
    field.setAccessible(True)
    assert "NoopCache" in field.get(index).toString()
    assert spark.conf.get(key) == own and int(own) > 0
    assert sorted(r.id for r in kept.collect()) == list(range(5))


def test_written_tables_have_no_marker_file(spark):
    kept = Scratch(spark, "t").keep(spark.range(5), "rows")
    folder = kept.inputFiles()[0].split("://")[-1].rsplit("/", 1)[0]
    assert not [x for x in os.listdir(folder) if "_SUCCESS" in x]
