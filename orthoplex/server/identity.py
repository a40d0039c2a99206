"""Who a request comes from: a trusted header, or a signed token (HS256, RS256, ES256) whose claims name
the user.

Keys are handed in; nothing is fetched.  Whatever is wrong with a token means no user,
and no user means no access where a model has an ``auth`` section.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from collections.abc import Mapping
from typing import Any

from orthoplex.plans.model import User

#: DER prefix of a SHA-256 digest in a PKCS #1 v1.5 signature (a fixed value of the standard).
_SHA256_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")


# The curve P-256 of FIPS 186 (prime, coefficient b, base point, order; coefficient a is -3).
_P = 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF
_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
_G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)
_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551

Point = tuple[int, int] | None


def _add(a: Point, b: Point) -> Point:
    """Sum on the curve; None is the point at infinity."""
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % _P == 0:
            return None
        slope = (3 * a[0] * a[0] - 3) * pow(2 * a[1], -1, _P)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, _P)
    x = (slope * slope - a[0] - b[0]) % _P
    return x, (slope * (a[0] - x) - a[1]) % _P


def _times(k: int, a: Point) -> Point:
    out: Point = None
    while k:
        if k & 1:
            out = _add(out, a)
        a, k = _add(a, a), k >> 1
    return out


def _on_curve(x: int, y: int) -> bool:
    return 0 <= x < _P and 0 <= y < _P and (y * y - x * x * x + 3 * x - _B) % _P == 0


def _decode(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _number(part: str) -> int:
    return int.from_bytes(_decode(part), "big")


def _signed(head: Mapping[str, Any], message: bytes, signature: bytes, keys: list[Mapping[str, Any]]) -> bool:
    for key in keys:
        if head.get("kid") not in (None, key.get("kid")) and key.get("kid") is not None:
            continue
        if head.get("alg") == "HS256" and key.get("kty") == "oct":
            if hmac.compare_digest(hmac.new(_decode(key["k"]), message, hashlib.sha256).digest(), signature):
                return True
        elif head.get("alg") == "RS256" and key.get("kty") == "RSA":
            n, e = _number(key["n"]), _number(key["e"])
            size = (n.bit_length() + 7) // 8
            plain = pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big")
            tail = _SHA256_PREFIX + hashlib.sha256(message).digest()
            if len(signature) == size and hmac.compare_digest(plain, b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail):
                return True
        elif head.get("alg") == "ES256" and key.get("kty") == "EC" and key.get("crv") == "P-256" and len(signature) == 64:
            public = _number(key["x"]), _number(key["y"])
            r, s = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:], "big")
            if _on_curve(*public) and 0 < r < _N and 0 < s < _N:
                digest, inverse = int.from_bytes(hashlib.sha256(message).digest(), "big"), pow(s, -1, _N)
                point = _add(_times(digest * inverse % _N, _G), _times(r * inverse % _N, public))
                if point is not None and point[0] % _N == r:
                    return True
    return False


def user_of_token(token: str, oidc: Mapping[str, Any], keys: list[Mapping[str, Any]], now: float | None = None) -> User | None:
    """The user of a valid token: signed by a known key, of this issuer, for this audience, not expired."""
    try:
        head_part, body_part, signature = token.split(".")
        head, claims = json.loads(_decode(head_part)), json.loads(_decode(body_part))
        if not _signed(head, f"{head_part}.{body_part}".encode(), _decode(signature), keys):
            return None
        now = time.time() if now is None else now
        audience = claims.get("aud", [])
        audience = [audience] if isinstance(audience, str) else audience
        if claims.get("iss") != oidc["issuer"] or oidc["audience"] not in audience or float(claims.get("exp", 0)) <= now or float(claims.get("nbf", 0)) > now:
            return None
        name = claims.get(oidc.get("user_claim", "sub"))
        if not name:
            return None
        return User(str(name), _names(claims.get(oidc.get("group_claim") or "")), _names(claims.get(oidc.get("role_claim") or "")))
    except (ValueError, KeyError, TypeError):
        return None


def _names(value: Any) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(map(str, value or ()))


def user_of(headers: Mapping[str, str], auth: Mapping[str, Any] | None, keys: list[Mapping[str, Any]] | None = None) -> User | None:
    """The user of a request's headers under a model's ``auth`` section."""
    if not auth:
        return None
    bearer = headers.get("Authorization") or ""
    if auth.get("oidc") and bearer.lower().startswith("bearer "):
        return user_of_token(bearer[7:].strip(), auth["oidc"], keys or [])
    if auth.get("trusted_proxy"):
        name = headers.get(auth.get("trusted_header") or "X-User")
        return User(name, tuple(filter(None, (headers.get("X-Groups") or "").split(",")))) if name else None
    return None
