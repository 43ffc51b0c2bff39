from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablewright import names
from tablewright.errors import ConfigValidationError

words = st.from_regex(r"[A-Za-z_][A-Za-z0-9_]{0,8}", fullmatch=True)
columns = st.text(st.characters(codec="utf-8", exclude_characters="_"), min_size=1, max_size=9)


@given(words, words)
def test_dotted_names_round_trip(alias, column):
    written = names.to_config_column(alias, column)
    assert names.is_config_column_reference(written)
    assert names.parse_qualified_column(written) == (alias, column)
    assert names.resolve_column_reference(written) == names.to_physical_column(alias, column)


@given(words, columns)
def test_frame_names_round_trip(alias, column):
    assert names.from_physical_column(names.to_physical_column(alias, column)) == (alias, column)


@given(words)
def test_computed_names_round_trip(variable):
    reference = names.to_derivation_ref(variable)
    assert names.parse_derivation_ref(reference) == variable
    assert names.resolve_column_reference(reference) == names.to_derivation_column(variable)


@pytest.mark.parametrize(("text", "parts"), [("q____r", ("q__", "r")), ("q__r__", ("q", "r__")), ("q__2nd r", ("q", "2nd r"))])
def test_frame_names_with_many_underscores(text, parts):
    assert names.from_physical_column(text) == parts


def test_all_columns_of_a_table():
    assert names.prefix_source_columns(["k", "odd name"], "t2") == ["t2__k", "t2__odd name"]


@pytest.mark.parametrize("text", ["", "q", ".", "q.", ".r", "7q.r", "q.7", "q.r.s", "q.r\n", "q r.s", "q-r.s"])
def test_what_is_no_reference(text):
    assert not names.is_config_column_reference(text)
    with pytest.raises(ConfigValidationError) as caught:
        names.resolve_column_reference(text)
    assert caught.value.gate == "G0"


@pytest.mark.parametrize("text", ["", "__", "q__", "__r", "q_r", "7q__r"])
def test_what_is_no_frame_name(text):
    with pytest.raises(ConfigValidationError):
        names.from_physical_column(text)


def test_only_computed_columns_have_a_derivation_reference():
    with pytest.raises(ConfigValidationError):
        names.parse_derivation_ref("q.r")


@pytest.mark.parametrize(
    ("text", "translated"),
    [
        ("q.r + s.t * 2.5", "q__r + s__t * 2.5"),
        ("q.r=='s.t' or q.u == \"it's v.w\"", "q__r=='s.t' or q__u == \"it's v.w\""),
        ("q.r.str.upper() + len(s.t)", "q__r.str.upper() + len(s__t)"),
        ("q.r == 'a\\'b.c'", "q__r == 'a\\'b.c'"),
        ("(q.r\n + s.t)", "(q__r\n + s__t)"),
        ("", ""),
    ],
)
def test_translation(text, translated):
    assert names.translate_expression(text) == translated


def test_an_unreadable_expression_is_an_error():
    with pytest.raises(ConfigValidationError):
        names.translate_expression("(q.r")
