"""Identity and the HTTP shell."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import urllib.error
import urllib.request

import pytest

from orthoplex.plans.model import User
from orthoplex.server.identity import user_of, user_of_token
from orthoplex.server.xmla import json_trace, make_server
from tests.demo import demo_cube

OIDC = {"issuer": "https://id", "audience": "cube", "user_claim": "name", "group_claim": "groups"}
KEY = b"secret"


def b64(data):
    return base64.urlsafe_b64encode(data if isinstance(data, bytes) else json.dumps(data).encode()).rstrip(b"=").decode()


def token(claims, key=KEY, alg="HS256"):
    body = f"{b64({'alg': alg})}.{b64(claims)}"
    return f"{body}.{b64(hmac.new(key, body.encode(), hashlib.sha256).digest())}"


GOOD = {"iss": "https://id", "aud": ["cube"], "exp": 200, "name": "ada", "groups": ["staff"]}


@pytest.mark.parametrize(
    ("given", "key", "want"),
    [(GOOD, KEY, User("ada", ("staff",))), (GOOD, b"other", None), ({**GOOD, "exp": 50}, KEY, None), ({**GOOD, "aud": "x"}, KEY, None), ({**GOOD, "iss": "x"}, KEY, None), ({**GOOD, "name": None}, KEY, None), ({**GOOD, "nbf": 150}, KEY, None)],
)
def test_tokens(given, key, want):
    keys = [{"kty": "oct", "k": b64(KEY)}]
    assert user_of_token(token(given, key), OIDC, keys, now=100) == want
    assert user_of_token(token(given, alg="none"), OIDC, keys, now=100) is None
    assert user_of_token("a.b", OIDC, keys) is None


def test_rsa_token():
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    body = f"{b64({'alg': 'RS256'})}.{b64(GOOD)}"
    size = (n.bit_length() + 7) // 8
    tail = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(body.encode()).digest()
    block = b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail
    signature = pow(int.from_bytes(block, "big"), d, n).to_bytes(size, "big")
    keys = [{"kty": "RSA", "n": b64(n.to_bytes(size, "big")), "e": b64(e.to_bytes(3, "big"))}]
    assert user_of_token(f"{body}.{b64(signature)}", OIDC, keys, now=100) == User("ada", ("staff",))
    assert user_of_token(f"{body}.{b64(signature[::-1])}", OIDC, keys, now=100) is None


def test_elliptic_token():
    from orthoplex.server.identity import _G, _N, _times

    secret, k = 0x1234567890ABCDEF1234567890ABCDEF, 0xFEDCBA0987654321FEDCBA0987654321
    public, body = _times(secret, _G), f"{b64({'alg': 'ES256'})}.{b64(GOOD)}"
    r = _times(k, _G)[0] % _N
    s = pow(k, -1, _N) * (int.from_bytes(hashlib.sha256(body.encode()).digest(), "big") + r * secret) % _N
    signature = r.to_bytes(32, "big") + s.to_bytes(32, "big")
    keys = [{"kty": "EC", "crv": "P-256", "x": b64(public[0].to_bytes(32, "big")), "y": b64(public[1].to_bytes(32, "big"))}]
    assert user_of_token(f"{body}.{b64(signature)}", OIDC, keys, now=100) == User("ada", ("staff",))
    assert user_of_token(f"{body}.{b64(signature[::-1])}", OIDC, keys, now=100) is None
    assert _times(_N, _G) is None


def test_headers():
    assert user_of({"X-User": "ada"}, None) is None and user_of({"X-User": "ada"}, {}) is None
    assert user_of({"X-User": "ada", "X-Groups": "a,b"}, {"trusted_proxy": True}) == User("ada", ("a", "b"))
    assert user_of({"Authorization": "Bearer x.y.z", "X-User": "ada"}, {"oidc": OIDC, "trusted_proxy": True}) is None


def test_http(spark, tmp_path):
    cube = demo_cube(spark, auth={"trusted_proxy": True}, roles=[{"name": "r", "members": [{"member_name": "ada"}]}])
    server = make_server(cube, ("127.0.0.1", 0), trace=json_trace(str(tmp_path / "trace.jsonl")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/xmla"
    body = b"<Envelope><Body><Execute><Command><Statement>SELECT FROM [Sales] WHERE ([Measures].[Revenue])</Statement></Command></Execute></Body></Envelope>"
    try:
        def ask(path=url, **headers):
            return urllib.request.urlopen(urllib.request.Request(path, body, headers), timeout=60).read().decode()

        assert "521586767.0" in ask(**{"X-User": "ada"}) and "521586767.0" not in ask()
        with pytest.raises(urllib.error.HTTPError):
            ask(url.replace("xmla", "other"))
    finally:
        server.shutdown()
    assert len((tmp_path / "trace.jsonl").read_text().splitlines()) == 2


def test_replay(spark, tmp_path):
    from orthoplex.server import replay
    from orthoplex.server.xmla import respond

    cube = demo_cube(spark)
    body = "<Envelope><Body><Execute><Command><Statement>{}</Statement></Command></Execute></Body></Envelope>"
    texts = ["SELECT FROM [Sales] WHERE ([Measures].[Revenue])", "SELECT {[Measures].[Units]} ON 0, TopCount([Channel].[Channel].Members, 2, [Measures].[Units]) ON 1 FROM [Sales]"]
    write = json_trace(str(tmp_path / "t.jsonl"))
    for t in texts:
        write({"request": body.format(t), "response": respond(cube, body.format(t))})
    entries = replay.read_trace(str(tmp_path / "t.jsonl"))
    assert replay.differences(cube, entries) == [] and set(replay.statements(entries)) == set(texts)
    changed = [{**entries[0], "response": entries[0]["response"].replace("521586767", "521586768000")}]
    assert replay.differences(cube, changed)[0]["values"]
    assert replay.shapes(texts[1]) == {"two axes", "topcount", "members"} and "compound key" in replay.shapes("SELECT {DrilldownLevel({[D].[H].[Q].&[1]&[2]})} ON 0 FROM [S]")
    found = replay.load(cube, [e["request"] for e in entries], iterations=4, workers=2, warm_up=0)
    assert found["requests"] == 4 and found["error_rate"] == 0 and found["p50_ms"] <= found["max_ms"]
