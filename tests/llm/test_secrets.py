"""Every form of cue, passwords of any length, and keys that show themselves."""

import time

import pytest

from litsieve.llm import pii

KEY = "abcd1234efgh5678"


@pytest.mark.parametrize("cue", ["token", "secret", "api key", "api_key", "api-key", "apikey", "access key", "Bearer", "TOKEN"])
@pytest.mark.parametrize("between", ["=", " = ", ": ", ":", " : ", "=>", " => ", '" => "', '": "', "='", " is ", " is '", " ", ":="])
def test_cue_forms(cue, between):
    text = f"x {cue}{between}{KEY} y"
    assert pii.find(text) == [("secret", text.index(KEY), text.index(KEY) + 16)]


@pytest.mark.parametrize("text,value", [("password: Tr0ub4dor3", "Tr0ub4dor3"), ("password=x", "x"), ("Passwd => 'two words'", "two words"), ('{"password":"a b"}', "a b"), ("password is Tr0ub4dor3 now", "Tr0ub4dor3"), ("passphrase := p@ss-w.rd!", "p@ss-w.rd!"), ("password: 'open", None), ("the password is wrong", None), ("password", None), ("password: ", None), ("mypassword: x", None)])
def test_passwords(text, value):
    got = [text[a:b] for k, a, b in pii.find(text) if k == "secret"]
    assert got == ([] if value is None else [value])


@pytest.mark.parametrize("key", ["ghp_" + "a1B2" * 9, "AKIA" + "ABCD1234" * 2, "xoxb-1234567890-abcdefghijk", "-----BEGIN RSA PRIVATE KEY-----\nMIIE+/=\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nabc"])
def test_keys_without_a_cue(key):
    assert ("secret", 4, 4 + len(key)) in pii.find("see " + key)


def test_words_that_are_no_secrets():
    for text in ("a token of esteem", "secret is out", "bearer of news", "akia is a word", "ghp_short", "-----BEGIN CERTIFICATE-----", "password policy and token rules", "token=abcdefghijklmnopqrst"):
        assert pii.find(text) == [], text


def test_time_stays_linear():
    for text in ("password: " * 200_000, "password=" + "x" * 1_000_000, "password is " * 150_000, "-----BEGIN PRIVATE KEY-----" * 60_000, "-----BEGIN " * 200_000, "ghp_" + "a" * 1_000_000, 'password="' * 100_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 15
