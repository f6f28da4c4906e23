import pytest
import os

from pyspark.sql import functions as F

from revsift.operators import prompts as PR
from revsift.operators.records import key_intersection, key_union, skip_existing
from revsift.sources import readers


def test_positional_rename_and_null_columns(spark):
    df = spark.createDataFrame([("t", "a", 1)], "Title string, Abstract string, x int")
    out = PR.append_null_columns(PR.positional_rename(df, ["title", "abstract"]),
                                 {"relevance": "int", "probability": "double"})
    assert out.columns == ["title", "abstract", "relevance", "probability"]
    assert dict(out.dtypes)["probability"] == "double" and out.first().relevance is None


def test_truncate_counts_code_points(spark):
    df = spark.createDataFrame([("ab😀cd",)], "t string")
    assert df.select(PR.truncate_text("t", 3).alias("c")).first().c == "ab😀"


def test_first_n_is_ordered(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7, 2)], "row_id int")
    assert [r.row_id for r in PR.first_n(df, "row_id", 3).collect()] == [1, 2, 3]


def test_key_sets_and_skip(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(r.k for r in key_union(a, b, "k").collect()) == ["x", "y", "z"]
    assert [r.k for r in key_intersection(a, b, "k").collect()] == ["y"]
    assert sorted(r.k for r in skip_existing(a, b, "k").collect()) == ["x"]


def test_semicolon_golden_csv(spark, tmp_dir):
    path = os.path.join(tmp_dir, "g.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("Title;doi_adjusted;Relevance\nA; 10_1 ;1\n\"B; quoted\";;0\n")
    g = readers.golden_labels_from(readers.read_golden_screening(spark, path, sep=";"), extra=["doi_adjusted"])
    rows = sorted((r.title, r.doi_adjusted, r.relevance) for r in g.collect())
    assert rows == [("A", " 10_1 ", 1), ("B; quoted", None, 0)]
    assert g.select(F.sum("relevance")).first()[0] == 1


def test_fields_are_found_in_the_records(spark):
    from revsift.operators.records import discovered_fields, records_wide

    texts = ['{"a": 1, "odd.key": "x", "n": null, "l": [1, 2]}', '{"a": 2.5, "b": true, "o": {"p": 1}, "m": 1}', '{"m": "text", "A": 3}', "[1]", "7", "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.parse_json("t").alias("record"))
    kinds = dict(discovered_fields(rows))
    assert sorted(kinds) == ["A", "a", "b", "l", "m", "n", "o", "odd.key"]
    assert kinds["odd.key"] == "string" and kinds["b"] == "boolean" and kinds["n"] == "string" and kinds["A"] == "bigint"
    assert kinds["l"] == kinds["o"] == kinds["m"] == "variant" and kinds["a"].startswith("decimal")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        wide = {r["id"]: r for r in records_wide(rows, id_cols=["id"]).select("id", "`odd.key`", "a", "b", "A").collect()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert wide[0]["odd.key"] == "x" and float(wide[1]["a"]) == 2.5 and wide[1]["b"] is True and wide[2]["A"] == 3 and wide[3]["a"] is None
    assert discovered_fields(rows.where("false")) == [] and records_wide(rows.where("false"), id_cols=["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        discovered_fields(rows, most=3)
