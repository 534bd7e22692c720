"""Weak secrets longer than 88 characters are candidates too."""

import time

import pytest

from lamella.llm import secret_scan

PAT = "github_pat_" + "11ABCDEFG0" + "aZ3kQ9xW7mT5" * 6
LATE = "abcDEFghi_" * 12 + "7"
JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9" * 4


@pytest.mark.parametrize("key", [PAT, LATE, JWT, PAT + "=="])
def test_long_runs_link_and_are_redacted(docs, key):
    text = f"client_id=abc123 with {key} at host: db.example.com"
    row = secret_scan.find(docs([text])).first()
    assert [text[s.start : s.end] for s in row.more] == ["client_id=abc123", key, "host: db.example.com"]
    assert secret_scan.redact(docs([text])).first().text == "[SECRET] with [SECRET] at [SECRET]"


@pytest.mark.parametrize("run", [PAT, "g" * 300, "g1" * 200, "A1" * 200, "aB" * 200])
def test_long_runs_alone_or_unmixed_are_left(docs, run):
    around = "{}" if run == PAT else "client_id=abc123 with {} at host: db.example.com"
    assert secret_scan.find(docs([around.format(run)])).first().more == []


def test_a_run_longer_than_the_scope_links_what_is_beside_it(docs):
    key = "aB3" * 20_000
    text = f"client_id=abc123 with {key}"
    row = secret_scan.find(docs([text])).first()
    assert [text[s.start : s.end] for s in row.more] == ["client_id=abc123", key]


def test_long_runs_take_linear_time(docs):
    took = []
    for n in (100_000, 1_000_000):
        start = time.monotonic()
        assert secret_scan.find(docs(["aB3" * n + " " + "ab-" * n + " " + "-" * n])).first().more == []
        took.append(time.monotonic() - start)
    assert took[1] < 10 + 20 * took[0]
