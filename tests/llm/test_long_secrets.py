"""Spans of the method's own kinds are whole at any length, in linear time."""

import time

import pytest

from litsieve.llm import pii


@pytest.mark.parametrize("n", [10, 512, 600, 100_000])
def test_long_password_in_a_url(n):
    text = f"see https://bob:{'s' * n}@host/path"
    assert pii.redact(text, pii.find(text)) == "see https://[URL_USER]@host/path"


@pytest.mark.parametrize("n", [7, 128, 129, 5000])
def test_long_account_number(n):
    text = f"account: {'1' * n} end"
    assert ("account", 9, 9 + n) in pii.find(text)
    assert "1" not in pii.redact(text, pii.find(text))


def test_time_is_linear():
    many = {"url": "http://a:" * 200_000, "user": "://" + "a" * 1_000_000, "schemes": "://" * 400_000, "cue": "account 12345 " * 100_000, "digits": "account " + "1 " * 800_000, "words": "account number " * 100_000}
    for name, text in many.items():
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 15, name
