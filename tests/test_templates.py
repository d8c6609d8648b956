"""Rows of a product of templates: exact count, no repeats, all parts used."""

import itertools
from math import gcd

import pytest

from postlake.operators import templates


def lists(spark, *words):
    return [spark.createDataFrame([(x,) for x in w], f"c{i} string") for i, w in enumerate(words)]


@pytest.mark.parametrize("count", [0, 1, 17, 60])
def test_distinct_rows_of_a_count(spark, count):
    words = [["a", "b", "b", None, "c"], ["x", "y", "z", "w"], ["1", "2", "3", "4", "5"]]
    got = templates.template_product(spark, lists(spark, *words), count).collect()
    product = {" ".join(p) for p in itertools.product("abc", "xyzw", "12345")}
    texts = [r.text for r in got]
    assert sorted(r.i for r in got) == list(range(count)) and len(set(texts)) == count and set(texts) <= product
    if count == 60:
        assert set(texts) == product
    if count == 17:
        assert {t.split()[0] for t in texts} == set("abc") and {t.split()[2] for t in texts} == set("12345")


def test_more_than_the_product_and_empty_lists(spark):
    with pytest.raises(ValueError):
        templates.template_product(spark, lists(spark, ["a"], ["b", "c"]), 3)
    assert templates.template_product(spark, lists(spark, ["a"], [None]), 0).count() == 0
    assert all(gcd(templates.spread(n), n) == 1 for n in range(1, 300))


def test_a_product_far_beyond_what_could_be_built(spark):
    many = [spark.range(2000).selectExpr("cast(id as string) as c") for _ in range(5)]
    got = [r.text for r in templates.template_product(spark, many, 500).collect()]
    assert len(set(got)) == 500 and all(0 <= int(x) < 2000 for t in got for x in t.split())
    assert len({t.split()[0] for t in got}) > 300
