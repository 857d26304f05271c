"""The registered experiments use whole embeddings."""

from pyspark.sql import functions as F

from faultline.plans import experiments
from faultline.plans.standins import vec


def test_all_entries_are_features(spark):
    d = "/root/testdata/sf0.001"
    names = experiments._vec_split(spark, d)[2]
    assert len(names) == vec(spark, d).agg(F.max(F.size("v"))).first()[0]
