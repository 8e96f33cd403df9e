import pytest

from quillframe.render import comma_separated, footer, full, markdown, renderer, simple


def test_simple():
    assert simple(["name", "age"], [["alice", "30"], ["b", "7"]]) == "name   age\n----   ---\nalice  30\nb      7\n"
    assert simple(["a"], [["x" * 40]]).splitlines()[2] == "x" * 29 + "…"


def test_full():
    assert full(["name", "age"], [["alice", "30"]]) == "┌───────┬─────┐\n│ name  │ age │\n├───────┼─────┤\n│ alice │ 30  │\n└───────┴─────┘\n"


def test_csv_and_markdown():
    assert comma_separated(["a", "b"], [['say "hi"', "1,2"]]) == 'a,b\n"say ""hi""","1,2"\n'
    assert markdown(["a", "b"], [["x|y", "z"]]) == "| a | b |\n| --- | --- |\n| x\\|y | z |\n"


def test_footers_and_names():
    assert footer(1) == "(1 row)\n" and footer(2, 3).startswith("(2 rows)\n(3 more") and footer(5, mutation=True) == ""
    with pytest.raises(ValueError):
        renderer("odd")
