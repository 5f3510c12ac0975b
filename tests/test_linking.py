"""Schema metadata and the router's text on literal tables."""

import json

from quarry.functions import texts as TX
from quarry.operators import linking as L

COLUMNS = [("orders", "key", 4), ("orders", "it's", 1), ("nation", "name", 2)]
SAMPLES = [("orders", "key", "2", 2), ("orders", "key", "1", 1), ("orders", 'it\'s', 'a "b"', 1)]


def frames(spark):
    return (spark.createDataFrame(COLUMNS, "id string, column string, freq long"), spark.createDataFrame(SAMPLES, "id string, column string, value string, rn int"))


def test_metadata_holds_the_samples(spark):
    got = {r.id: r for r in L.schema_metadata(*frames(spark)).collect()}
    assert got["orders"].samples == {"key": ["1", "2"], "it's": ['a "b"']} and got["orders"].columns == "it's,key"
    assert got["nation"].samples == {} and got["nation"].sample_columns == ""


def test_router_text_and_its_fallback(spark):
    of = lambda *names: L.router_schema(*frames(spark), spark.createDataFrame([(n,) for n in names], "table string")).first()[0]
    want = {"nation": {"name": TX.NO_EXAMPLES}, "orders": {"it's": "Examples: ['a \"b\"']", "key": "Examples: ['1', '2']"}}
    assert of("orders", "nation", "ghost") == json.dumps(want, indent=2)
    assert of("ghost", "b") == str(["b", "ghost"])
