"""Credentials inside addresses, and parts however far a line is padded."""

import random

import pytest

from tessera.llm import secrets
from tests.llm.conftest import prose

KEY = "kX92mfPq7LrT0aVbZ3cY8w"


def parts(text):
    return {(kind, text[s:e]) for s, e, kind, _ in secrets.all_spans(text)}


def test_user_info_is_a_credential():
    text = f"see postgres://svc_app:{KEY}@db.example.com/prod for all"
    assert parts(text) == {("weak_id", "svc_app"), ("weak_secret", KEY), ("endpoint", "db.example.com/prod")}
    assert parts("see https://example.com:8080/a@b and https://example.com/x") == set()
    assert parts("jdbc:averylongdrivername://root:hunter22@h.example.com") == {("weak_id", "root"), ("weak_secret", "hunter22"), ("endpoint", "h.example.com")}


@pytest.mark.parametrize("blanks", [0, 1, 6, 300])
def test_padded_pairs_are_linked(blanks):
    text = f"user:{' ' * blanks}alice.smith {KEY}"
    assert parts(text) == {("weak_id", f"user:{' ' * blanks}alice.smith"), ("weak_secret", KEY)}


def test_recall_on_planted_credentials_and_clean_text():
    """Of 200 credentials in four forms, planted in prose, all are linked; the prose alone has none."""
    rng, found, false = random.Random(9), 0, 0
    for i in range(200):
        key = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(22)) + "a7"
        form = [f"mysql://app:{key}@db{i}.example.org/x", f"login = bob{i} and {key}", f"client_id: c-{i}99 then {key}", f"redis://u:{key}@c.example.net"][i % 4]
        base = prose(rng, "en", 80)
        false += len(secrets.all_spans(base))
        cut = base.index(" ", len(base) // 2)
        found += ("weak_secret", key) in parts(f"{base[:cut]} {form} {base[cut:]}")
    assert (found, false) == (200, 0)


def test_very_long_text_is_scanned_whole():
    text = "word " * 400_000 + f"ftp://u:{KEY}@h.example.com" + " word" * 1000
    assert ("weak_secret", KEY) in parts(text)
