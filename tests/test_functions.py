"""Behaviour of single functions, on synthetic values."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import classify as C
from siftline.functions import params as P
from siftline.functions import redact as R
from siftline.functions import urls as U
from siftline.operators import inventory as inv
from siftline.operators import report, sessions
from siftline.sources import files

ROW = dict(
    id="a", crawl_id="c", task_id="", page_url="", auth_session_id="", method="GET", url="https://app.example.test/x", body="", body_type="", source_type="cdp_observed", resource_type="",
    lifecycle_state="completed", body_complete=True, body_completeness_known=True, completeness_status="COMPLETE", request_timestamp=1.0, cdp_request_id="n1", created_at=datetime(2026, 1, 1),
    headers={"Accept": "application/json"}, response=None,
)
SCHEMA = "id string, crawl_id string, task_id string, page_url string, auth_session_id string, method string, url string, body string, body_type string, source_type string, resource_type string, lifecycle_state string, body_complete boolean, body_completeness_known boolean, completeness_status string, request_timestamp double, cdp_request_id string, created_at timestamp, headers map<string,string>, response struct<status_code:int>"


def made(spark, *changes):
    keys = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((ROW | c)[k] for k in keys) for c in changes], SCHEMA)


def value(spark, column, **cells):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items())) if cells else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://h.example.test/a/6f9619ff-8b86-4011-b42d-00c04fc964ff", "/a/{uuid}"), ("https://h.example.test/p/1/i/2", "/p/{int}/i/{int}"), ("https://h.example.test/c/CVE-2020-12345", "/c/{cve}"),
        ("https://h.example.test/c/cpe%3A2.3%3Aa", "/c/{cpe}"), ("https://h.example.test/" + "a1" * 10, "/{hash}"), ("https://h.example.test/" + "Zz_-" * 6, "/{id}"), ("https://h.example.test", "/"), ("https://h.example.test/%zz", "https://h.example.test/%zz"), ("https://h.example.test/a%20b/7\n", "https://h.example.test/a%20b/7\n"),
    ],
)
def test_template(spark, url, want):
    assert value(spark, U.endpoint_template(F.col("u")), u=url) == want


def test_normalized_urls_agree(spark):
    a = value(spark, U.normalize_url(F.lit("HTTPS://App.Example.test:443/a/?b=2&a=1#x")))
    assert a == value(spark, U.normalize_url(F.lit("https://app.example.test/a?a=1&b=2"))) == "https://app.example.test/a?a=1&b=2"


def test_fingerprints_agree(spark):
    f = lambda body, ct, url: value(spark, U.fingerprint(F.lit("post"), F.lit(url), F.lit(body), F.lit(ct), P.canonical_json(F.lit(body))))
    a = f('{"a": 1, "b":2}', "application/json; charset=utf-8", "https://x.example.test:443/p?b=1&a=2")
    assert a == f('{"b":2,"a":1}', "Application/JSON", "https://X.example.test/p/?a=2&b=1#f")
    assert a != f('{"b":3,"a":1}', "application/json", "https://x.example.test/p?a=2&b=1")
    deep = f('{"l":[{"y":1,"x":[2, 3]}],"o":{"b":null,"a":"z"}}', "application/json", "https://x.example.test/")
    assert deep == f(' {"o": {"a":"z", "b":null}, "l":[{"x":[2,3],"y":1}]}', "application/json", "https://x.example.test/") != f('{"o":{"a":"z","b":null},"l":[{"x":[3,2],"y":1}]}', "application/json", "https://x.example.test/")


#: Method, URL, and the hashes that their shape must have.
GOLDEN = [
    ("GET", "/", "6e909b425b28b051a08045ced4043d6a1210409138f2b189ecdbfcf332a772cb", "c6e19854bc33167955fd5553023272a307b6111b11c743f7270fbeae383e56a5", "e89aeed75a74ef43b2b5c4aec7f65282b90f4e0d1303d0018b175feed43d8f3d"),
    ("GET", "/api/profile?id=7", "6c7dae21bfa97d0529d7268fd990a599bca1b4e56d5d44bf9e009751fe7fdcca", "116a62617dd804228f3b8104e58a611f85a54e6cf4250c7d18c679fdb299d2d4", "2c8f25575519e3a40fc0600ddee0f012341edb19cb01c9ac58500a1ff019263a"),
    ("GET", "/app.js", "9a04beae2711b9879398d03dc942f7c6b8aaf6c22ae1c333900aa60986d418ba", "7751fde1a477a2c9d603214da6a0a63a4594c8789c3eaf877e6d5424c1029d15", "e68c160b20b62aeab240531071c869f51c0c1e82e85e9c641be9065c0d55d976"),
    ("GET", "/escaped?q=hello", "7494b35a20a6e570f9630d480a33cf808c734f8e457eae728638427d19c3af03", "7f50b1aa66e1fe83ab50c8d7c26bfdbcd38e7e8d9b570d407a45b8f772ee759a", "17b0a2169a97afbeda00c1c86dcca9a3a5a4796913d7c6dc12953ded2f1f72ec"),
    ("GET", "/exposure", "9077b021f72a68faa99ac0bda690e401cc05a1e56a52296c64cc10b2b399bfe4", "a7ffbcb8b250bb29816b422e667a0a7ea77190aa55691b3ea7f207382c7a0b03", "dd4ab9c48e6023765caaa8d37b7309914c22e1f799fcd92e3a5396ed90806ef3"),
    ("GET", "/file?path=marker.txt", "e015f7819dd0779d09018b95f852c37c6dd8270ae191c9a27fb05cbaed8dbc86", "ce6af2a5ab0975948ecfc31fdd0e116c13aad8938a94d945c4d6633f74b79c30", "6b987a28714a078605a09caa71952e79afb56697195ec9b11010f9a1452edf5d"),
    ("GET", "/item?id=1", "37d86e17a950c9957766c916fd57b498d7fe22126b9b2fcc9d3c6637493a96ae", "63e09a21151c492f92511d892ef0014e3cd712bf8b1b47afe93a8fabe9118c55", "031da0c172d4db44522917d54c9423e2db02b5217b9be5fca533c87e6518d65f"),
    ("GET", "/login", "f966a614424dbfcf04536e48ef6a88198f1e746e1235378b7ec4e7cb67d4ac16", "4a3fc7520763129f46ec115f15fb6b5f13caa4b8382575c62ea026ea7a59f337", "85311da64f3b672e8284883717c1f8f4c7b5c63cb1c8923765a45295b0ee2e0e"),
    ("GET", "/no-exposure", "5a5647d09f419a64aa19990f43ce6fbe9a974e50af0182522967e379ecb82cb6", "161f78d96352f4d794cad0e76affb38c4fa1099e000b3841ded2baac9aca397b", "7eec6ef156099502b206ea4e0c1baf887e332e2ba27045a75e7985ea6cc7eee6"),
    ("GET", "/reflect?q=hello", "2800f77373277b0917eeee3fa42cd6dae25d7ddfbe6c7a10421c94f162772e95", "203ec6192e64baa09f17635ed41ee39991c83c439efa27a8529f7f0d4dbc5626", "2603e115c5154dc4424c2e67bd28b13c77b68aa3649ff5ed7b62ff9c7d01757d"),
    ("GET", "/safe-file?path=marker.txt", "e65a7a33a77298d70caf37b326eb8107f954148d3575cd0b708f9fdc9e2f8737", "801be8f6b0edfe1979e807fbd5dc7b0c69c1cca2f25777d13c4e06de9fa6b834", "d99e4af7bffac63744dcce9007ce6004bed0b52a77b4562c1677b0278d3878a0"),
    ("GET", "/safe-item?id=1", "103f3556fe3fecddb684c4162b72450a331736ca038eb5a82b85f7dd42dfab96", "8561f5fa997cf817add50897a91af34d0c0aab1601fbbaa6d2e84b5ff0696ad4", "9cf529ff81122ad36cc27f8ef758f0e5c2e6b468850208e62086c3bf1d0736f9"),
    ("POST", "/form-search", "35a22512aa6557b1778b968396e739db0a25eb78d1218c2e5d1e4ca9068a7a9e", "e0ce280ac11d8bc17914b1235bd90315a173af0aca74c1c542246e37fb873b92", "f50f85fcb310f1bcb78b42e862aab7546e63c15db1c9291d8d6822d424a4b9a1"),
]


def test_hashes_of_known_requests(spark):
    form = {"Content-Type": "application/x-www-form-urlencoded"}
    rows = [{"id": u, "method": m, "url": f"http://127.0.0.1:18080{u}", "headers": {"Cookie": "c"} | (form if m == "POST" else {}), "body": "dGVybT10ZXN0" if m == "POST" else "", "body_type": "" if m == "POST" else "binary"} for m, u, *_ in GOLDEN]
    got = {r["id"]: (r["schema_hash"], r["identity"], r["inventory_id"]) for r in inv.analyze(made(spark, *rows)).collect()}
    assert got == {u: (a, b, c) for _, u, a, b, c in GOLDEN}


@pytest.mark.parametrize("ct,want", [("application/problem+json", "json"), ("multipart/form-data; boundary=x", "multipart"), ("application/x-www-form-urlencoded", "form-urlencoded"), ("application/graphql", "graphql"), ("text/xml", "xml"), ("text/plain", "text"), ("", "binary"), ("image/png", "binary")])
def test_body_type(spark, ct, want):
    assert value(spark, U.body_type(F.lit(ct))) == want


@pytest.mark.parametrize(
    "change,want",
    [
        ({"method": "OPTIONS"}, "PREFLIGHT"), ({"url": "https://a.example.test/_next/x.js"}, "FRAMEWORK"), ({"url": "https://a.example.test/p?_rsc=1"}, "FRAMEWORK"), ({"url": "https://a.example.test/auth/refresh-token", "method": "POST"}, "AUTH_SESSION"),
        ({"url": "https://a.example.test/graphql", "method": "POST"}, "GRAPHQL"), ({"url": "https://a.example.test/orders", "method": "POST"}, "APPLICATION"), ({"body": '{"query":"shoes"}', "method": "POST"}, "GRAPHQL"), ({"url": "https://a.example.test/x.pdf"}, "STATIC"),
        ({"headers": {"sec-fetch-dest": "document"}, "method": "POST"}, "NAVIGATION"), ({"url": "https://a.example.test/s?q=1"}, "PARAMETERIZED_NAVIGATION"), ({"url": "https://a.example.test/s?page=1&token=x"}, "APPLICATION"), ({"method": "HEAD"}, "UNKNOWN"),
    ],
)
def test_classes(spark, change, want):
    assert inv.analyze(made(spark, change)).first()["classification"] == want


def test_nested_json_and_schema(spark):
    a, b = ('{"a":{"b":%d},"l":[{"id":"%s"}],"n":null}' % x for x in ((1, "x"), (2, "yy")))
    ct = {"Content-Type": "application/json"}
    rows = inv.analyze(made(spark, {"id": "a", "method": "POST", "body": a, "headers": ct}, {"id": "b", "method": "POST", "body": b, "headers": ct}))
    got = rows.orderBy("id").collect()
    assert [p["path"] + ":" + p["type"] for p in got[0]["parameters"]] == ["json.a.b:integer", "json.l[0].id:string", "json.n:null"]
    assert got[0]["schema_hash"] == got[1]["schema_hash"] and got[0]["body_hash"] != got[1]["body_hash"]
    one = inv.inventory(rows).collect()
    assert len(one) == 1 and one[0]["observation_count"] == 2 and one[0]["distinct_body_count"] == 2


def test_incomplete_body_is_kept_but_not_eligible(spark):
    row = inv.analyze(made(spark, {"method": "POST", "body": '{"a":1}', "headers": {"Content-Type": "application/json"}, "body_complete": False})).first()
    assert row["replayability"] == "INCOMPLETE" and row["reasons"] == ["request_body_incomplete"] and not row["request_eligible"]


@pytest.mark.parametrize("url,want", [("https://a.example.test/s?n=5", True), ("https://a.example.test/s?page=5&utm_source=x", False)])
def test_query_eligibility(spark, url, want):
    assert inv.analyze(made(spark, {"url": url})).first()["query_eligible"] is want


def test_better_example_wins(spark):
    rows = made(spark, {"id": "a", "response": (400,), "request_timestamp": 1.0}, {"id": "b", "response": (200,), "request_timestamp": 2.0})
    row = inv.inventory(inv.analyze(rows)).first()
    assert row["representative_request_id"] == "b" and row["status_codes"] == "[200,400]"


def test_stopped_request_stays_stopped(spark):
    rows = made(spark, {"lifecycle_state": "policy_enforcement_failed"}, {"lifecycle_state": "completed", "created_at": datetime(2026, 1, 2)})
    now = inv.latest(inv.analyze(rows))
    assert now.first()["lifecycle_state"] == "policy_enforcement_failed"
    assert inv.inventory(now).count() == 0


def test_a_request_saved_again_keeps_its_status_codes(spark):
    """Seen first without body and answer, then completed with three answers: one request, one body, three codes."""
    post = {"method": "POST", "url": "http://host.example.test:38415/api/items?q=x", "headers": {"Content-Type": "application/json"}}
    body = {"body": '{"name":"x"}'}
    saves = [post | {"lifecycle_state": "observed"}, *(post | body | {"response": (code,), "created_at": datetime(2026, 1, 2 + k)} for k, code in enumerate((400, 401, 200)))]
    row = inv.inventory(inv.latest(inv.analyze(made(spark, *saves)))).collect()
    assert len(row) == 1 and (row[0]["observation_count"], row[0]["distinct_body_count"], row[0]["status_codes"], row[0]["origin"]) == (1, 1, "[200,400,401]", "http://host.example.test:38415")
    other = saves + [post | body | {"id": "b", "url": "http://host.example.test:49253/api/items?q=x"}]
    assert inv.inventory(inv.latest(inv.analyze(made(spark, *other)))).count() == 2


def test_first_class_and_last_eligibility(spark):
    ct = {"Content-Type": "application/json", "Accept": "text/html"}
    rows = made(spark, {"id": "a", "method": "POST", "body": '{"a":1}', "headers": ct}, {"id": "b", "method": "POST", "body": '{"a":2}', "headers": {"Content-Type": "application/json"}, "created_at": datetime(2026, 1, 2), "body_complete": False})
    row = inv.inventory(inv.analyze(rows)).first()
    assert (row["classification"], row["replayability"], row["exclusion_reasons"], row["content_type"]) == ("NAVIGATION", "REPLAYABLE", '["request_body_incomplete"]', "application/json")
    assert row["created_at"] == datetime(2026, 1, 1) and row["updated_at"] == datetime(2026, 1, 2)


@pytest.mark.parametrize("text,want", [("true", "boolean"), ("12", "integer"), ("+5", "integer"), (" 5", "string"), ("1e5", "number"), (".5", "number"), ("9223372036854775808", "number"), ("1d", "string"), ("", "string"), ("nan", "number")])
def test_infer_type(spark, text, want):
    assert value(spark, P.infer_type(F.col("v")), v=text) == want


@pytest.mark.parametrize("name,want", [("password", True), ("accessToken", True), ("X-CSRF", True), ("user[session]", True), ("tokens", True), ("name", False), ("secretary", False), ("client_secret", True), ("monkey", False), ("pass]word", True), ("passWord", False), (" Set-Cookie ", True), ("cookies", False), ("x_secret", True)])
def test_sensitive_names(spark, name, want):
    assert value(spark, C.sensitive_name(F.col("n")), n=name) is want
    assert C.is_sensitive(name) is want


def test_policy(spark):
    def decide(config, **change):
        return made(spark, change).select(C.policy(config).alias("x")).first()["x"]["rule_id"]

    off, on = C.PolicyConfig(), C.PolicyConfig(allow_mutations=True, read_only_graphql=(("/graphql", "Q"),))
    js = {"Content-Type": "application/json"}
    assert decide(off) == "READ_ONLY"
    assert decide(off, method="POST") == "MUTATION_BLOCKED"
    assert decide(on, method="POST") == "MUTATIONS_ENABLED"
    assert decide(on, method="DELETE") == "DELETE_BLOCKED"
    assert decide(on, method="POST", url="https://a.example.test/logout") == "LOGOUT_BLOCKED"
    assert decide(on, method="TRACE") == "UNKNOWN_METHOD"
    assert decide(on, method="POST", url="https://a.example.test/graphql", headers=js, body='{"query":"query Q {a}","operationName":"Q"}') == "GRAPHQL_QUERY"
    assert C.parse_flag(" YES ") and not C.parse_flag(None)
    with pytest.raises(ValueError):
        C.parse_flag("maybe")


def test_redaction(spark):
    body = 'user=a&password=p1&x=eyJhbGci.eyJzdWIi.c2ln'
    got = made(spark, {"body": body}).select(R.redact_body(F.col("body")).alias("x")).first()["x"]
    assert got == "user=a&password=%5BREDACTED%5D&x=[JWT_REDACTED:length=22]"
    js = json.dumps({"a": [{"authToken": "s"}], "b": 1})
    got = made(spark, {"body": js}).select(R.redact_body(F.col("body")).alias("x")).first()["x"]
    assert json.loads(got) == {"a": [{"authToken": "[REDACTED]"}], "b": 1}
    deep = "[" * 1200 + "]" * 1200
    for body in ('{"password":"hunter2","a":%s}' % deep, '{"password":"hunter2","a":%s}' % ("9" * 5000), '{"password":"hunter2","a":[}', '["hunter2'):
        for redact in (R.redact_body, R.redact_api_body):
            got = made(spark, {"body": body}).select(redact(F.col("body")).alias("x")).first()["x"]
            assert "hunter2" not in got and "[REDACTED]" in got
    field = '--B\r\nContent-Disposition: form-data; name="%s"\r\n\r\n%s\r\n'
    got = value(spark, R.redact_multipart(F.col("b")), b=field % ("accessToken", "ab-cd\r\n--ef") + field % ("note", "x-y") + field % ("user[password]", "p") + "--B--\r\n")
    assert got == field % ("accessToken", "[REDACTED]") + field % ("note", "x-y") + field % ("user[password]", "[REDACTED]") + "--B--\r\n"
    assert value(spark, R.redact_jwt(F.col("t")), t="a eyJh.b-_c.d e") == "a [JWT_REDACTED:length=11] e"
    part = 'Content-Disposition: form-data; name="password"\r\n\r\nabc\r\n'
    assert "abc" not in value(spark, R.redact_multipart(F.col("b")), b=part)
    assert value(spark, R.redact_url(F.col("u")), u="https://a.example.test/p?token=x&b=1") == "https://a.example.test/p?b=1&token=%5BREDACTED%5D"
    assert value(spark, R.redact_log_url(F.col("u")), u="https://a.example.test/%zz") == "<redacted-url>"


def test_base64_parts_fail_closed(spark):
    assert value(spark, U.joined_base64(F.array(F.lit("YQ=="), F.lit("Yg==")))) == "6162"
    assert value(spark, U.joined_base64(F.array(F.lit("YQ=="), F.lit("%%")))) is None


def test_required_fields(spark):
    got = lambda b, ct="application/x-www-form-urlencoded", names=("name",): value(spark, report.has_fields(F.col("b"), F.lit(ct), list(names)), b=b)
    assert got("name=a") and not got("name=a&name=+") and not got("x=1") and not got("name=a&b=%zz") and got("", names=())
    js, multi = "application/json", "multipart/form-data; boundary=B.1"
    assert got('{"a":[{"name":"x"}]}', js) and got('{"name":0}', js) and not got('{"name":" "}', js) and not got('{"name":["x"]}', js) and not got("{", js)
    field = '--B.1\r\nContent-Disposition: form-data; name="%s"\r\n\r\n%s\r\n'
    assert got(field % ("name", "x") + "--B.1--", multi) and not got(field % ("name", " ") + "--B.1--", multi) and not got(field % ("other", "x") + "--B.1--", multi)


def test_deep_json_keeps_its_parameters(spark):
    body = '{"n":%s,"d":%s1%s,"k":true}' % ("9" * 5000, "[" * 1500, "]" * 1500)
    row = inv.analyze(made(spark, {"method": "POST", "body": body, "headers": {"Content-Type": "application/json"}})).first()
    assert sorted((p["path"][-10:], p["type"], p["sample_length"]) for p in row["parameters"]) == [("[0][0][0]"[-10:].rjust(10, "]"), "integer", 1), ("json.k", "boolean", 4), ("json.n", "number", 5000)]


def test_first_of_each_parameter(spark):
    row = inv.analyze(made(spark, {"url": "https://a.example.test/s?b=1&a=x&b=2&a=3"})).first()
    assert [(p["path"], p["type"]) for p in row["parameters"]] == [("query.a", "string"), ("query.b", "integer")]


def test_claims_are_used_once_on_each_side(spark):
    """A user with most of the rows; brute force over all pairs."""
    import random

    rng = random.Random(3)
    at = lambda: datetime(2026, 1, 1, rng.randrange(24), rng.randrange(60), rng.randrange(60))
    submits = [(i, rng.choice("aaab"), at()) for i in range(60)]
    clicks = [(i, rng.choice("aaab"), at()) for i in range(300)]
    got = report.claims(spark.createDataFrame(submits, "submit_id int, user string, submit timestamp"), spark.createDataFrame(clicks, "claim_id int, user string, at timestamp"), ["user"], 900)
    own = {}
    for c, user, t in clicks:
        near = [(s, i) for i, u, s in submits if u == user and 0 <= (t - s).total_seconds() <= 900]
        if near:
            own.setdefault(max(near)[1], []).append((t, c))
    assert {r["submit_id"]: r["claim_id"] for r in got.collect()} == {s: min(x)[1] for s, x in own.items()}


def test_numbers_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(i * 7 % 100, f"t{i * 7 % 100}") for i in range(100)], "k int, text string")
    rows = files.numbered(df, "n", "k")
    assert [(r["n"], r["k"]) for r in rows.orderBy("n").collect()] == [(i + 1, i) for i in range(100)]
    files.write_document(rows.select("n", F.to_json(F.struct("k")).alias("text")), '{"a":[', "]}", str(tmp_path / "d"))
    parts = list((tmp_path / "d").glob("part-*"))
    assert len(parts) == 1 and json.loads(parts[0].read_text()) == {"a": [{"k": i} for i in range(100)]}


def test_tokens(spark, tmp_path):
    state = {"id": "s", "cookies": [{"name": "XSRF", "value": "v"}], "origins": [{"origin": "o", "localStorage": [{"name": "k", "value": "eyJa.b.c"}, {"name": "t", "value": "x"}], "sessionStorage": []}]}
    (tmp_path / "s.json").write_text(json.dumps(state))
    got = sessions.tokens(sessions.flatten_state(files.read_sessions(spark, str(tmp_path / "s.json")))).collect()
    assert sorted((r["source"], r["kind"]) for r in got) == [("cookie", "csrf"), ("localStorage", "jwt")]
    assert all("value" not in r.asDict() for r in got)


def test_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"request":{"method":"GET","endpoint":"https://a.example.test"}}\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "d.jsonl")).count() == 1
    (tmp_path / "e.jsonl").write_bytes(b'{"timestamp":"a\xffb"}\n\n{"timestamp":"c"}\n[1\n')
    assert sorted(r["timestamp"] for r in files.read_jsonl(spark, str(tmp_path / "e.jsonl")).collect()) == ["a\ufffdb", "c"]
    files.write_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    (tmp_path / "scanner").mkdir()
    (tmp_path / "scanner/log.txt").write_text("exit_code=3")
    row = files.read_manifest(spark, str(tmp_path / "scanner")).first()
    assert (row["tool"], row["exit_code"], row["length"]) == ("scanner", 3, 11)
    assert row["redaction_status"] == "not_required"
    (tmp_path / "r.req").write_text("POST /a HTTP/1.1\r\nHost: a.example.test\r\n\r\nx=1")
    assert tuple(files.read_requests(spark, str(tmp_path / "r.req")).first()) == ("POST", "/a", "a.example.test", "x=1")
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    files.write_jsonl(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()["value"] == '{"a":"x","b":1}'
    assert files.read_env(["A='1'", "# c", "B=2"], {"B": "9"}) == {"A": "1", "B": "9"}


def test_request_detail_of_other_crawl(spark):
    df = made(spark, {"id": "a", "crawl_id": "c"})
    assert report.request_detail(df, "c", "a").count() == 1 and report.request_detail(df, "d", "a").count() == 0
