from datetime import UTC, datetime

import pytest

from leakscan.operators.providers import signing_key, sts_headers, verifier


@pytest.mark.parametrize(("kind", "answer", "want"), [
    ("GITHUB_TOKEN", (200, b""), True), ("GITHUB_TOKEN", (401, b""), False), ("GITHUB_TOKEN", (403, b""), None), ("GITHUB_TOKEN", None, None), ("STRIPE_KEY", (401, b""), False),
    ("SLACK_TOKEN", (200, b'{"ok": true}'), True), ("SLACK_TOKEN", (200, b'{"ok": false, "error": "invalid_auth"}'), False), ("SLACK_TOKEN", (200, b'{"error": "ratelimited"}'), None), ("SLACK_TOKEN", (200, b"<"), None),
    ("AWS_ACCESS_KEY", (200, b""), True), ("AWS_ACCESS_KEY", (403, b"InvalidClientTokenId"), False), ("AWS_ACCESS_KEY", (403, b"SignatureDoesNotMatch"), None), ("JWT", (200, b""), None),
])
def test_verdicts(kind, answer, want):
    assert verifier(lambda *_: answer)(kind, "value", "secret") is want


def test_pairs_and_empty_values_are_needed():
    assert verifier(lambda *_: (200, b""))("AWS_ACCESS_KEY", "value", None) is None
    assert verifier(lambda *_: (200, b""))("GITHUB_TOKEN", "") is None


def test_signing_key():
    # the published example of the signature's documentation
    key = signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCY" + "EXAMPLEKEY", "20120215", "us-east-1", "iam")
    assert key.hex() == "f4780e2d9f65fa895f9c67b32ce1baf0b0d8a43505a000a1a9e090d414db404d"
    assert "20240102/us-east-1/sts/aws4_request" in sts_headers("A", "b", datetime(2024, 1, 2, tzinfo=UTC))["Authorization"]
