"""Places of repeated stretches, in the order that the SQL has."""

from weftline.operators import finders


def test_the_first_place_of_a_stretch_is_in_order_of_file_and_line_as_text(spark):
    text = [(f, k, x) for f in ("doc:1", "doc:10", "doc:2") for k, x in ((1, "a"), (2, "b"), (3, "c"))]
    lines = spark.createDataFrame(text, "file string, line long, text string")
    assert [(r.n, r.file, r.line) for r in finders.duplicate_lines(lines, 3).collect()] == [(3, "doc:10", 1)]
