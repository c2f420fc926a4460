"""A table's layout doesn't change with the number of its rows."""

from phenogrid.llm import html_text


def test_rows_are_laid_out_alike_in_tables_of_any_size():
    wide = "w" * 150
    for n in (3, 3000):
        got = html_text.visible_text(f"<table><tr><td>{wide}<td>y" + "<tr><td>a<td>b" * n + "</table>").split("\n")
        assert got == [wide + "  y"] + ["a" + " " * 151 + "b"] * n


def test_far_columns_are_reached_by_the_same_blanks_in_tables_of_any_size():
    for n in (3, 3000):
        got = html_text.visible_text("<table><tr><td>" + "w" * 500 + "<td>y" + "<tr><td>a<td>b" * n + "</table>").split("\n")
        assert got == ["w" * 500 + "  y"] + ["a" + " " * 200 + "b"] * n
