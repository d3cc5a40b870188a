import pytest
from pyspark.sql import functions as F

from folioframe import session


class Named:
    """A session whose cluster names a checkpoint folder."""

    class sparkContext:  # noqa: N801
        found = None

        @classmethod
        def getConf(cls):  # noqa: N802
            return {"spark.checkpoint.dir": "file:///shared"}

        @classmethod
        def getCheckpointDir(cls):  # noqa: N802
            return cls.found

        @classmethod
        def setCheckpointDir(cls, path):  # noqa: N802
            cls.found = path

    conf = {}


def test_the_named_folder_is_used():
    assert session.ensure_checkpoint_dir(Named) == "file:///shared" and Named.sparkContext.found == "file:///shared"


def test_cut_ends_the_lineage(spark):
    df = spark.range(10).select((F.col("id") * 2).alias("x"))
    done = session.cut(df)
    assert done.count() == 10 and "Range" not in done._jdf.queryExecution().toString()
    assert session.cut(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"])
def test_defaults(spark, key):
    assert spark.conf.get(key) == "true"


def test_a_cluster_has_to_name_its_folder():
    class Unnamed(Named):
        class sparkContext(Named.sparkContext):  # noqa: N801
            master = "spark://somewhere:7077"
            found = None

            @classmethod
            def getConf(cls):  # noqa: N802
                return {}

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Unnamed)
    Unnamed.sparkContext.master = "local[2]"
    assert session.ensure_checkpoint_dir(Unnamed) == Unnamed.sparkContext.found
