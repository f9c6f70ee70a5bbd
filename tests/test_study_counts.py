"""Resampling queries at the study's number of draws; the twins compare their values in test_catalogue."""

import os

import pytest

from cohortlake import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def test_draws_and_permutations_are_those_of_the_study(spark):
    draws = catalogue.QUERIES["rsm_02_cluster_bootstrap_study"](spark, DATA).select("draw").distinct().count()
    null = catalogue.QUERIES["agg_25_null_distribution_study"](spark, DATA).first()
    assert draws == 1000
    assert 190 <= null.null_n <= 200 and null.p_value >= 1 / 201
