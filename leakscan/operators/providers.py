"""Verdicts of providers on secrets, for verify.verified: true (accepted), false (rejected), None (anything else).

Nothing is asked unless a caller passes one of these verifiers. The transport is a parameter, so that tests ask no network.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import urllib.error
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

Http = Callable[[str, str, dict, bytes | None], tuple[int, bytes] | None]
TIMEOUT = 6.0
# What a rejected Slack token is answered with, and the request that names its own caller.
SLACK_DEAD = {"invalid_auth", "token_revoked", "token_expired", "account_inactive"}
STS_HOST, STS_BODY = "sts.amazonaws.com", b"Action=GetCallerIdentity&Version=2011-06-15"


def urllib_http(method: str, url: str, headers: dict, body: bytes | None = None) -> tuple[int, bytes] | None:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=TIMEOUT) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError:
        return None


def by_status(answer: tuple[int, bytes] | None) -> bool | None:
    return None if answer is None else {200: True, 401: False}.get(answer[0])


def signing_key(secret: str, date: str, region: str, service: str) -> bytes:
    key = ("AWS4" + secret).encode()
    for part in (date, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def sts_headers(access: str, secret: str, now: datetime) -> dict:
    """Signed headers of a GetCallerIdentity request."""
    stamp, date = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    kind = "application/x-www-form-urlencoded; charset=utf-8"
    signed = "content-type;host;x-amz-date"
    request = "\n".join(["POST", "/", "", f"content-type:{kind}", f"host:{STS_HOST}", f"x-amz-date:{stamp}", "", signed, hashlib.sha256(STS_BODY).hexdigest()])
    scope = f"{date}/us-east-1/sts/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    mac = hmac.new(signing_key(secret, date, "us-east-1", "sts"), text.encode(), hashlib.sha256).hexdigest()
    return {"Content-Type": kind, "Host": STS_HOST, "X-Amz-Date": stamp, "Authorization": f"AWS4-HMAC-SHA256 Credential={access}/{scope}, SignedHeaders={signed}, Signature={mac}"}


def verifier(http: Http = urllib_http) -> Callable[[str, str, str | None], bool | None]:
    """A verifier over the given transport."""

    def slack(secret: str) -> bool | None:
        answer = http("POST", "https://slack.com/api/auth.test", {"Authorization": f"Bearer {secret}"}, b"")
        try:
            body = json.loads(answer[1]) if answer else {}
        except ValueError:
            return None
        return True if body.get("ok") is True else False if body.get("error") in SLACK_DEAD else None

    def aws(access: str, secret: str | None) -> bool | None:
        if not secret:
            return None
        answer = http("POST", f"https://{STS_HOST}/", sts_headers(access, secret, datetime.now(UTC)), STS_BODY)
        return None if answer is None else True if answer[0] == 200 else False if b"InvalidClientTokenId" in answer[1] else None

    def ask(kind: str, secret: str, aws_secret: str | None = None) -> bool | None:
        if not secret:
            return None
        if kind == "GITHUB_TOKEN":
            return by_status(http("GET", "https://api.github.com/user", {"Authorization": f"Bearer {secret}", "User-Agent": "leakscan"}, None))
        if kind == "STRIPE_KEY":
            return by_status(http("GET", "https://api.stripe.com/v1/balance", {"Authorization": f"Bearer {secret}"}, None))
        if kind == "SLACK_TOKEN":
            return slack(secret)
        return aws(secret, aws_secret) if kind == "AWS_ACCESS_KEY" else None

    return ask
