"""Spacing inside cells and items, and deep nesting between the rows of a table."""

import time

import pytest

from phenogrid.llm import html_text


def test_paragraphs_of_cells_and_items_stay_apart():
    assert html_text.visible_text("<table><tr><td><p>one</p><p>two</p></td></tr></table>").split("\n") == ["one", "", "two"]
    assert html_text.visible_text("<ul><li><p>one</p><p>two</p></li></ul>").split("\n") == ["- one", "", "  two"]


def test_unclosed_tags_between_rows():
    page = "<table>" + "<font><tr><td>x</td></tr>" * 5000 + "</table>"
    assert html_text.visible_text(page).split() == ["x"] * 5000


def text(page):
    return html_text.visible_text(page).split("\n")


@pytest.mark.parametrize("part", [
    "</a", "<a ", "<a", "<!", "<?", "<b></x>", "<a '\">", "<a \"'> ", "<div", "<!--", "&#99999999999", "<p><table>", "<li><div>", "<svg><g>", "<a b='"])
def test_time_grows_with_the_page_whatever_stays_open(part):
    took = []
    for n in (4_000, 32_000):
        start = time.perf_counter()
        html_text.visible_text(part * n + " '>")
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * max(took[0], 0.02)


def test_deep_nesting_between_closing_tags():
    start = time.perf_counter()
    page = "<p>" + "<table><tr><td>" + "<div>" * 8000 + "<li>" * 8000 + "<ul></ul>" * 3000 + "<b>" * 8000 + "</x>" * 8000 + "end"
    assert "end" in html_text.visible_text(page) and time.perf_counter() - start < 20


def test_tags_end_outside_quotes():
    assert text("<a title='x>y'>one</a> two") == ["one two"]
    assert text("a <b title='x>one</b> two") == ["a <b title='x>one two"]
    assert text("a < b <!-- c") == ["a < b"]
    assert text("1 < 2 and 3 > 2 <") == ["1 < 2 and 3 > 2 <"]


def test_drawings_and_formulas():
    assert text("<svg><defs><text>no</text></defs><title>no</title><text>one</text><text>two</text></svg>") == ["one two"]
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> then") == ["if x=2 then"]


def test_visibility_is_inherited_and_turned_on_again():
    assert text("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>") == ["yes"]
    assert text("<div style='display:none'>no <b style='visibility:visible;display:block'>no</b></div>") == [""]
    assert text("<dialog>no</dialog><dialog open>yes</dialog>") == ["yes"]


def test_numbers_of_items():
    assert text("<ol><li>a<li value=7>b<li>c<li value=x>d</ol>") == ["1. a", "7. b", "8. c", "9. d"]


def test_cells_of_several_rows_and_columns():
    assert text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == ["a  b", "   c", "d  e"]
    assert text("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>") == ["ab     c", "1   2  3"]
    assert text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == ["a  b", "   c", "   d"]
    assert text("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e</table>") == ["a  b  c", "      d", "   e"]
    assert text(f"<table><tr><td colspan={'9' * 5000} rowspan=-1>a<td>b</table>") == ["a  b"]


def test_wide_letters_count_twice():
    assert text("<table><tr><td>日本<td>a<tr><td>abcd<td>b<tr><td>é<td>c</table>") == ["日本  a", "abcd  b", "é     c"]


def test_alignment_stays_in_proportion():
    page = "<table><tr>" + "<td rowspan=60000>a" * 5000 + "<tr><td>b" * 5000
    got = html_text.visible_text(page)
    assert len(got) < 25 * len(page) and got.count("b") == 5000 and got.count("a") == 5000
