"""Documents of any shape come back from tagged rows as they were."""

from pyspark.sql import functions as F

from terrashift.sources.trees import tree_documents, tree_rows


def test_trees_come_back_as_they_were(spark):
    typed = """to_variant_object(named_struct('a', 1, 'd', date'2024-02-29', 't', timestamp'2024-01-02 03:04:05.5', 'z', timestamp_ntz'2024-01-02 03:04:05', 'ds', array(date'2024-01-02', date'2025-01-02'),
        'ts', array(timestamp'2024-01-02 03:04:05'), 'l', array(1.5D, 2.0D), 'i', array(3, 4), 's', array('x', 'null', '2024-01-02'), 'f', 2.0D, 'big', 1e300D, 'nan', double('NaN'),
        'dec', 1.25, 'b', true, 'text', '2024-01-02', 'g', named_struct('n', cast(null as string), 'deep', named_struct('e', array(named_struct('q', 1)))))) """
    plain = """parse_json('{"q": {"r": {"s": 5, "": "empty name", "a.b": [1, "a", null, {"x": []}]}}, "z": {}, "l": [], "n": null, "u": "é \\\\n \\\\"", "n2": [[1, 2], [3]], "m": [1, 2.5]}')"""
    rows = spark.sql(f"SELECT 1 AS k, {typed} AS v UNION ALL SELECT 2, {plain} UNION ALL SELECT 3, parse_json('[1, 2]') UNION ALL SELECT 4, parse_json('{{}}') UNION ALL SELECT 5, parse_json('null') UNION ALL SELECT NULL, parse_json('{{\"a\": 1}}') UNION ALL SELECT 7, NULL")
    leaves = tree_rows(rows, "k", "v")
    shape = lambda c: (F.to_json(c), F.schema_of_variant(c))
    got = {r[0]: tuple(r)[1:] for r in tree_documents(leaves, "k").select("k", *shape(F.col("document"))).collect()}
    want = {r[0]: tuple(r)[1:] for r in rows.filter("v IS NOT NULL").select("k", *shape(F.col("v"))).collect()}
    assert got == want and len(got) == 6
    tags = {tuple(r["path"]): r["tag"] for r in leaves.collect() if r["k"] == 1}
    assert {tags[p] for p in ((n,) for n in ("d", "t", "z"))} == {"datetime-iso"} and tags[("l",)] == "float64[]" and tags[("text",)] == "utf-8" and tags[("g", "n")] == "null"
    assert tree_documents(tree_rows(rows.limit(0), "k", "v"), "k").count() == 0
