"""Composed and decomposed forms read the same in every script."""

import unicodedata

import pytest

from kenmark.llm.lookalikes import Canon


@pytest.mark.parametrize("composed", ["が", "آ", "ொ", "≠", "é", "가"])
def test_composed_and_decomposed_read_the_same(composed):
    apart = unicodedata.normalize("NFD", composed)
    assert apart != composed
    for vocabulary in ({}, {composed: 3}, {apart: 3}):
        canon = Canon(vocabulary, 0)
        assert canon.text(f"x {composed} y") == canon.text(f"x {apart} y") == f"x {composed} y"
        assert canon.text(f"ab{composed}c") == canon.text(f"ab{apart}c")
