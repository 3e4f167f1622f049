"""Claims on files, tree guard and sign-up decisions."""

import json

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import keys
from fleetscope.operators import claims, identity
from fleetscope.sources import readers


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("key, tail", [("r:f.rs:Type::method", "method"), ("r:f.rs:name", "name"), ("bare", "bare"), ("x:", "")])
def test_symbol_tail(spark, key, tail):
    assert value(spark, keys.symbol_tail(F.lit(key))) == tail


@pytest.mark.parametrize(
    "path, want",
    [("/d/Foo/", "d:/foo"), ("D:\\A\\b", "d:/a/b"), ("/home/X//", "/home/x/"), ("/dd/x", "/dd/x"), ("/d/", "d:"), ("", "")],
)
def test_normalize(spark, path, want):
    assert value(spark, keys.normalize_resource_key(F.lit(path))) == want


def test_small_key_rules(spark):
    assert value(spark, keys.provider_of(F.lit("Google_1_2"))) == "Google"
    assert value(spark, keys.subject_of(F.lit("Google_1_2"))) == "1_2"
    assert value(spark, keys.provider_of(F.lit("plain"))) is None
    assert value(spark, keys.subject_of(F.lit("plain"))) is None
    assert value(spark, keys.local_identity(F.lit("d"), F.lit("m"))) == "d"
    assert value(spark, keys.local_identity(F.lit(""), F.lit("m"))) == "m"
    assert value(spark, keys.local_identity(F.lit(None), F.lit(""))) is None
    key = keys.cold_key(F.lit("t1"), F.lit("s1"))
    assert value(spark, key) == "tenant/t1/session/s1.log"
    assert value(spark, keys.tenant_of_key(key)) == "t1" and value(spark, keys.session_of_key(key)) == "s1"
    assert value(spark, keys.tenant_of_key(F.lit("tenant/t1/other/s1.log"))) is None


CLAIMS = [
    ("symbol", "r:src/a.rs:one", "other", 60),
    ("symbol", "r:src/a.rs:Type::two", "me", 60),
    ("symbol", "r:src/a.rs:three", None, 60),
    ("symbol", "r:src/a.rs2:four", "other", 60),
    ("symbol", "r:src/a.rs", "other", 60),
    ("worktree", "r:src/a.rs:five", "other", 60),
    ("symbol", "q:src/a.rs:six", "other", 60),
]


def test_conflicts(spark, rows):
    held = spark.createDataFrame(CLAIMS, "kind string, resource_key string, machine_id string, ttl_seconds int")
    files = spark.createDataFrame([("r", " src/a.rs "), ("r", "src/a.rs"), ("r", " "), ("r", "src/b.rs")], "repo string, rel_file string")
    scope = claims.scope_files(files, files)
    assert rows(scope) == [("r", "src/a.rs"), ("r", "src/b.rs")]
    found = claims.claims_on_files(scope, held)
    assert rows(found, "symbol") == [("one",), ("three",), ("two",)]
    assert rows(claims.exclude_self(found, F.lit("me")), "symbol") == [("one",), ("three",)]
    assert claims.exclude_self(found, F.lit(None).cast("string")).count() == 3
    assert claims.exclude_self(found, F.lit("")).count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_errors_do_not_hide_other_answers(spark, rows, tmp_path):
    holder = {"kind": "symbol", "machine_id": "m", "resource_key": "r:a:b", "ttl_seconds": 9}
    bodies = {"a": json.dumps({"holders": [holder, holder], "truncated": True}), "b": "no json", "c": '{"holders": 3}', "d": '{"holders": []}'}
    lines = [json.dumps({"repo": "r", "file": f, "body": b}) for f, b in bodies.items()]
    (tmp_path / "answers.json").write_text("\n".join(lines))
    holders, errors = readers.scan_claims(spark, str(tmp_path))
    assert rows(holders) == [("r", "a", "symbol", "m", "r:a:b", 9, True)] * 2
    assert rows(errors) == [("r", "b", "not JSON"), ("r", "c", "no holders list")]
    summary = claims.conflict_summary(holders, errors)
    assert rows(summary) == [("r", "a", 2, 1, 0, True), ("r", "b", 0, 0, 1, False), ("r", "c", 0, 0, 1, False)]


def test_live_claims_end_exactly_at_their_ttl(spark):
    held = spark.createDataFrame([("k", 60)], "resource_key string, ttl_seconds int").withColumn(
        "observed_at", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    at = lambda text: claims.live_claims(held, F.lit(text).cast("timestamp")).count()
    assert (at("2024-01-01 00:00:59"), at("2024-01-01 00:01:00")) == (1, 0)


GUARD = [  # machine, session, flags, holder, holder session, decision, reason
    ("me", "s", {"skip": True}, "other", None, "ALLOW", "skip"),
    ("me", "s", {"tool_present": False}, "other", None, "ALLOW", "no-tool"),
    ("me", "s", {"in_tree": False}, "other", None, "ALLOW", "not-a-tree"),
    ("", "s", {}, "other", None, "ALLOW", "no-identity"),
    ("me", "s", {"lookup_ok": False}, "other", None, "ALLOW", "lookup-failed"),
    ("me", "s", {}, False, None, "WARN", "no claim held"),
    ("me", "s", {"enforce": True}, False, None, "BLOCK", "no claim held"),
    ("me", "s", {"enforce": True}, "", None, "ALLOW", "no-holder-field"),
    ("me", "s", {"enforce": True}, "other", "s", "BLOCK", "held by another machine"),
    ("me", "s", {"enforce": True}, "me", None, "ALLOW", "held-by-us"),
    ("me", "s", {"enforce": True}, "me", "s", "ALLOW", "held-by-us"),
    ("me", "s", {"enforce": True}, "me", "t", "BLOCK", "held by another session"),
    ("me", None, {}, "me", "t", "WARN", "held by another session"),
]


@pytest.mark.parametrize("machine, session, flags, holder, holder_session, decision, reason", GUARD)
def test_guard(spark, machine, session, flags, holder, holder_session, decision, reason):
    defaults = {"skip": False, "enforce": False, "tool_present": True, "in_tree": True, "lookup_ok": True}
    call = spark.range(1).selectExpr("'/d/Tree/' AS path").withColumns(
        {"machine_id": F.lit(machine), "session_id": F.lit(session).cast("string")}
        | {name: F.lit(flags.get(name, default)) for name, default in defaults.items()}
    )
    held = [] if holder is False else [("worktree", "d:/tree", holder, holder_session)]
    table = spark.createDataFrame(held, "kind string, resource_key string, machine_id string, session_id string")
    table = table.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp"))
    got = claims.guard_decision(claims.lookup_tree_claim(call, table)).first()
    assert (got.decision, got.reason) == (decision, reason)


def test_guard_log(spark, rows):
    lines = ["t pid=1 ALLOW reason=skip (x)", 't pid=22 BLOCK reason="no claim" key=k', "t pid=1 ALLOW reason=skip", "noise"]
    table = spark.createDataFrame([(x,) for x in lines], "message string")
    assert rows(claims.guard_decision_counts(table)) == [("ALLOW", "skip", 2), ("BLOCK", "no claim", 1)]


EXT, ADMIN, NATIVE = "PreSignUp_ExternalProvider", "PreSignUp_AdminCreateUser", "PreSignUp_SignUp"
ACCOUNTS = [
    ("one", "CONFIRMED", {"email": "a@x", "email_verified": "true"}),
    ("two", "CONFIRMED", {"email": "b@x", "email_verified": "true"}),
    ("three", "CONFIRMED", {"email": "b@x", "email_verified": "true", "identities": ""}),
    ("four", "CONFIRMED", {"email": "c@x", "email_verified": "true", "identities": "[1]"}),
    ("five", "UNCONFIRMED", {"email": "d@x", "email_verified": "true"}),
    ("six", "CONFIRMED", {"email": "e@x", "email_verified": "false"}),
]


@pytest.mark.parametrize(
    "user, trigger, email, verified, allow, action",
    [
        ("Google_1_2", EXT, "a@x", "true", None, "link"),
        ("MicrosoftEntra_1", EXT, "a@x", "true", None, "link"),
        ("Google_1", EXT, "a@x", "True", None, "skip_unverified"),
        ("Google_1", EXT, "a@x", None, None, "skip_unverified"),
        ("Google_1", EXT, "", "true", None, "skip_unverified"),
        ("GitHub_1", EXT, "a@x", "true", None, "skip_untrusted"),
        ("plain", EXT, "a@x", "true", None, "skip_untrusted"),
        ("Google_1", EXT, "none@x", "true", None, "skip_no_unique_match"),
        ("Google_1", EXT, "b@x", "true", None, "skip_no_unique_match"),
        ("Google_1", EXT, "c@x", "true", None, "skip_no_unique_match"),
        ("Google_1", EXT, "d@x", "true", None, "skip_no_unique_match"),
        ("Google_1", EXT, "e@x", "true", None, "skip_no_unique_match"),
        ("u", NATIVE, "a@x", "true", None, "untouched"),
        ("u", None, "a@x", "true", None, "untouched"),
        ("u", NATIVE, "a@x", "true", ["z@x"], "blocked"),
        ("u", None, None, "true", ["z@x"], "blocked"),
        ("u", ADMIN, "a@x", "true", ["z@x"], "untouched"),
        ("Google_1", EXT, " A@x ".strip(), "true", [" a@X "], "skip_no_unique_match"),
        ("Google_1", EXT, "a@x", "true", [" A@X "], "link"),
        ("Google_1", EXT, "a@x", "true", [" ", ""], "link"),
    ],
)
def test_signups(spark, user, trigger, email, verified, allow, action):
    directory = spark.createDataFrame(ACCOUNTS, "Username string, UserStatus string, attributes map<string,string>")
    signup = spark.createDataFrame(
        [(user, trigger, email, verified)], "user_name string, trigger_source string, email string, email_verified string"
    )
    listed = None if allow is None else spark.createDataFrame([(a,) for a in allow], "email string")
    got = identity.signup_decisions(signup, directory, listed).first()
    assert got.action == action and got.auto_confirm == (action == "link")
    if action == "link":
        assert (got.destination_user, got.provider, got.subject) == ("one", *user.split("_", 1))
    else:
        assert got.destination_user is None and got.provider is None


def test_identity_files(spark, rows, tmp_path):
    event = {"userName": "Google_1", "triggerSource": EXT, "request": {"userAttributes": {"email": "a@x", "email_verified": "true"}}}
    pairs = [{"Name": "email", "Value": "old@x"}, {"Name": "email", "Value": "a@x"}, {"Name": "email_verified", "Value": "true"}]
    (tmp_path / "s.json").write_text(json.dumps(event))
    (tmp_path / "d.json").write_text(json.dumps({"Username": "one", "UserStatus": "CONFIRMED", "Attributes": pairs}))
    signups = readers.scan_signups(spark, str(tmp_path / "s.json"))
    directory = readers.scan_directory(spark, str(tmp_path / "d.json"))
    assert identity.signup_decisions(signups, directory).first().action == "link"
