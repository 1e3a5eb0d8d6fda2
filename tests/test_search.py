"""Search in the texts of a node besides its name."""

from loomtrace.operators import suggest


def test_collection_tags_and_title_are_searched(spark):
    n = spark.createDataFrame(
        [("mb_card::1", "mb_card", "Orders", None, None, 7), ("model.shop.a", "model", "alpha", "about Revenue", "Old Revenue", None), ("model.shop.b", "model", "beta", None, "Old Revenue", None), ("mb_card::2", "mb_card", "Revenue", None, None, 7), ("mb_card::3", "mb_card", "Lost", None, None, 9)],
        "node_id string, node_type string, name string, description string, title string, collection_id int",
    )
    c = spark.createDataFrame([(7, "Board of Finance")], "collection_id int, name string")
    t = spark.createDataFrame([("model.shop.a", "nightly"), ("model.shop.a", "core"), ("model.shop.b", None), ("model.shop.b", "Finance")], "node_id string, tag string")
    q = spark.createDataFrame([(x,) for x in ("FINANCE", "core nightly", "revenue")], "query string")
    got = {(r.query, r.node_id, r.tier, r.field) for r in suggest.search(suggest.searchable(n, c, t), q).collect()}
    assert got == {
        ("FINANCE", "mb_card::1", 2, "properties.collection_name"), ("FINANCE", "mb_card::2", 2, "properties.collection_name"), ("FINANCE", "model.shop.b", 2, "properties.tags"),
        ("core nightly", "model.shop.a", 2, "properties.tags"),
        ("revenue", "mb_card::2", 5, "name"), ("revenue", "model.shop.a", 2, "description"), ("revenue", "model.shop.b", 2, "properties.title"),
    }
