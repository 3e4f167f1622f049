"""Change classification, folds and scrubbed batches."""

import json

import pytest
from pyspark.sql import functions as F

from fleetscope import fixed_values as fv
from fleetscope.operators import changes
from fleetscope.sources import readers, writers

DB, ECS, TASK = "aws_db_instance", "aws_ecs_service", "aws_task"


def change(address, kind, actions, before=None, after=None, unknown=None):
    out = {"change": {"actions": actions, "before": before, "after": after, "after_unknown": unknown}}
    return out | ({"address": address} if address else {}) | ({"type": kind} if kind else {})


def classify(spark, *items):
    docs = spark.createDataFrame([("run", json.dumps({"resource_changes": list(items)}))], "run_id string, doc string")
    return changes.classify_changes(readers.explode_changes(docs)[0])


def updated(**names):
    return {k: 1 for k in names}, {k: 2 for k in names}


def test_reference_tables_are_complete():
    assert len(fv.SERVING_TYPES) == 16 and len(fv.SENSITIVE_CREATE_TYPES) == 6
    assert len(fv.NEGATING) == 32 and len(fv.NEGATING_PRIORITY) == 8
    assert all(reason.strip() for reason in fv.NEGATING.values())
    assert set(fv.NEGATING_PRIORITY) <= set(fv.NEGATING)
    assert sorted(fv.SEVERITY, key=fv.SEVERITY.get) == ["ok", "unknown", "benign_add", "in_place_change", "active_negation"]
    assert len(fv.ALARMS) == 10


@pytest.mark.parametrize(
    "kind, actions, names, want, attribute",
    [
        (DB, ["no-op"], [], None, None),
        (DB, ["read"], [], None, None),
        (DB, [], [], None, None),
        ("aws_cloudwatch_log_group", ["create"], [], "benign_add", None),
        ("aws_security_group_rule", ["create"], [], "in_place_change", None),
        (ECS, ["delete"], [], "active_negation", None),
        (DB, ["delete", "create"], [], "active_negation", None),
        (DB, ["create", "delete"], [], "active_negation", None),
        ("aws_route53_record", ["delete"], [], "in_place_change", None),
        (DB, ["update"], ["instance_class", "tags"], "active_negation", "instance_class"),
        (DB, ["update"], ["allocated_storage", "instance_class"], "active_negation", "instance_class"),
        (DB, ["update"], ["storage_encrypted", "multi_az"], "active_negation", "multi_az"),
        ("aws_lambda_function", ["update"], ["environment"], "active_negation", "environment"),
        (ECS, ["update"], ["tags", "name"], "in_place_change", "name"),
        (ECS, ["update"], [], "in_place_change", None),
        (ECS, ["no-op", "update"], ["desired_count"], "active_negation", "desired_count"),
        (DB, ["forget"], [], "unknown", None),
        (DB, ["read", "no-op"], [], "unknown", None),
    ],
)
def test_decision_order(spark, kind, actions, names, want, attribute):
    before, after = updated(**dict.fromkeys(names))
    got = classify(spark, change("a.b", kind, actions, before, after)).collect()
    if want is None:
        assert got == []
    else:
        assert [(r.classification, r.attribute, r.kind) for r in got] == [(want, attribute, kind)]


def test_reasons(spark):
    before, after = updated(allocated_storage=0, instance_class=0)
    got = classify(
        spark,
        change("1", DB, ["update"], before, after),
        change("2", DB, ["delete", "create"]),
        change("3", ECS, ["delete"]),
        change("4", DB, ["update"], *updated(instance_class=0)),
    )
    reason = {r.resource: r._reason for r in got.collect()}
    assert reason["1"].endswith("[also negating: allocated_storage]") and "downsize" in reason["1"]
    assert reason["2"].startswith("replace") and reason["3"].startswith("destroy") and "serving" in reason["3"]
    assert "also negating" not in reason["4"]


@pytest.mark.parametrize(
    "before, after, unknown, names",
    [
        (None, None, None, []),
        ({"a": None}, {}, {}, []),
        ({"a": {"x": 1, "y": [2]}}, {"a": {"y": [2], "x": 1}}, {}, []),
        ({"a": 1}, {"a": 1.0}, {}, []),
        ({"a": [1, 2]}, {"a": [2, 1]}, {}, ["a"]),
        ({"a": "1"}, {"a": 1}, {}, ["a"]),
        ({"b": 1, "a": 1}, {"c": 1}, {"id": True, "arn": False, "tags": {}, "list": [], "deep": {"x": True}}, ["a", "b", "c", "deep", "id"]),
    ],
)
def test_changed_attributes(spark, before, after, unknown, names):
    from fleetscope.functions.change_rules import changed_attributes

    docs = [json.dumps(x) if x is not None else None for x in (before, after, unknown)]
    table = spark.createDataFrame([docs], "b string, a string, u string")
    maps = [F.from_json(c, "map<string,variant>") for c in ("b", "a", "u")]
    assert table.select(changed_attributes(*maps)).first()[0] == names


def test_ownership(spark):
    task = "aws_ecs_task_definition"
    got = classify(
        spark,
        change("only", task, ["update"], *updated(container_definitions=0)),
        change("mixed", task, ["update"], *updated(container_definitions=0, cpu=0)),
        change("empty", task, ["create", "delete"]),
        change("other", ECS, ["update"], *updated(container_definitions=0)),
    )
    assert {r.resource: r.terraform_owned for r in got.collect()} == {
        "only": False, "mixed": True, "empty": True, "other": True,
    }


def test_mixed_run_and_missing_fields(spark, rows):
    items = [
        change("log.new", "aws_cloudwatch_log_group", ["create"]),
        change("db.main", DB, ["update"], {"instance_class": "big-secret"}, {"instance_class": "small-secret"}),
        change("svc", ECS, ["update"], {"tags": {"a": "1"}}, {"tags": {"a": "2"}}),
        change("rec.old", "aws_route53_record", ["delete"]),
    ]
    docs = spark.createDataFrame(
        [
            ("mixed", json.dumps({"resource_changes": items})),
            ("none", "{}"),
            ("null", '{"resource_changes": null}'),
            ("bare", '{"resource_changes": [{"change": {"actions": ["forget"]}}, {"change": {}}]}'),
        ],
        "run_id string, doc string",
    )
    records = changes.classify_changes(readers.explode_changes(docs)[0])
    assert dict(rows(changes.worst_per_run(readers.read_changes(docs)))) == {
        "mixed": "active_negation", "none": "ok", "null": "ok", "bare": "unknown",
    }
    got = [tuple(r) for r in records.where("run_id = 'mixed'").collect()]
    assert len(got) == 4 and "secret" not in repr(got)
    assert rows(records.where("run_id = 'bare'"), "resource", "kind") == [("unknown", "unknown")]
    summary = changes.drift_summary(records, docs.select("run_id").withColumn("coverage", F.lit(1.0)))
    assert summary.agg(F.sum("records")).first()[0] == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_batches_are_consecutive_rows_of_a_run(spark, tmp_path, parts):
    records = spark.range(505).selectExpr(
        "if(id < 450, 'big', 'small') AS run_id", "concat('r', lpad(id, 4, '0')) AS resource", "'secret' AS _reason"
    )
    coverage = spark.createDataFrame([("big", 1.0), ("small", 0.5)], "run_id string, coverage double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = changes.scrub_payload(records.repartition(3), coverage, batch_rows=20)
        assert out.columns == ["run_id", "resource", "batch_id", "coverage"]
        got = {(r.run_id, r.resource): r.batch_id for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {("big", f"r{i:04d}"): i // 20 for i in range(450)} | {("small", f"r{i:04d}"): (i - 450) // 20 for i in range(450, 505)}
    assert got == want
    writers.write_payload(out, str(tmp_path / "payload"))
    assert spark.read.json(str(tmp_path / "payload")).count() == 505


def test_unreadable_documents_are_never_ok(spark, rows):
    good = json.dumps({"resource_changes": [change("x", DB, ["no-op"])]})
    odd = json.dumps({"resource_changes": [change("x", DB, "update"), change("y", DB, [])]})
    docs = [
        ("cut", good[:40]), ("text", "terraform crashed"), ("object", '{"resource_changes": {"a": 1}}'), ("null", None),
        ("blank", " "), ("list", "[1]"), ("odd", odd), ("fine", good), ("half", good), ("half", "oops"),
    ]
    table = spark.createDataFrame(docs, "run_id string, doc string")
    assert dict(rows(changes.worst_per_run(readers.read_changes(table)))) == {
        "cut": "error", "text": "error", "object": "error", "null": "error", "blank": "error", "list": "error",
        "odd": "unknown", "fine": "ok", "half": "error",
    }
    found, errors = readers.explode_changes(table)
    assert sorted(r[0] for r in rows(errors)) == ["blank", "cut", "half", "list", "null", "object", "text"]
    assert sorted(r[0] for r in rows(found)) == ["fine", "half", "odd", "odd"]


def test_change_files(spark, rows, tmp_path):
    (tmp_path / "run-1.json").write_text(json.dumps({"resource_changes": [change("x", ECS, ["delete"])]}, indent=2))
    (tmp_path / "run-2.json").write_text("{}")
    (tmp_path / "run-3.json").write_text("{")
    worst = changes.worst_per_run(readers.read_changes(readers.scan_change_docs(spark, str(tmp_path))))
    assert rows(worst) == [("run-1", "active_negation"), ("run-2", "ok"), ("run-3", "error")]


KINDS = [DB, ECS, "aws_ecs_task_definition", "aws_iam_role_policy", "odd", None]
ACTIONS = [["update"], ["create", "update"], ["update", "no-op"], ["delete"], ["delete", "create"], ["create"], ["forget"], ["read"], "x"]
VALUES = [
    ({"desired_count": 1, "tags": 1}, {"desired_count": 2, "tags": 2}, None),
    ({"instance_class": "a", "policy": {"a": 1, "b": 2}}, {"policy": {"b": 2, "a": 1}, "instance_class": "b"}, {}),
    ({"policy": [1]}, {"policy": [1.0]}, {"policy": {"x": True}, "multi_az": True}),
    ({"container_definitions": 1}, {"container_definitions": 2}, {"id": False}),
    (None, None, {"container_definitions": True, "name": True}),
    (None, None, None),
]


def test_values_are_compared_only_where_a_verdict_hangs_on_them(spark, rows):
    """The verdicts are those of all changed attributes, which were compared for every change before."""
    from fleetscope.functions import change_rules as rules

    items = [(f"{i}-{j}-{k}", change("r", kind, actions, *values))
             for i, kind in enumerate(KINDS) for j, actions in enumerate(ACTIONS) for k, values in enumerate(VALUES)]
    docs = spark.createDataFrame([(run, json.dumps({"resource_changes": [item]})) for run, item in items], "run_id string, doc string")
    read = readers.read_changes(docs)
    kind, actions = F.col("type"), F.col("actions")
    whole = read.withColumn("attrs", rules.changed_attributes(F.col("before"), F.col("after"), F.col("after_unknown")))
    whole = whole.withColumn("hits", F.filter("attrs", lambda a: F.concat(kind, F.lit("|"), a).isin(*[f"{t}|{a}" for t, a in fv.NEGATING])))
    whole = whole.withColumn("v", rules.classify_change(kind, actions, F.col("attrs"), F.col("hits")))
    want = whole.select("run_id", "v.classification", "v.attribute", rules.is_terraform_owned(kind, F.col("attrs")).alias("owned"))
    assert len({r.classification for r in want.collect()}) == 5 and want.where("NOT owned").count() > 2
    got = changes.classify_changes(readers.explode_changes(docs)[0])
    assert rows(got, "run_id", "classification", "attribute", "terraform_owned") == rows(want.where("classification <> 'ok'"))
    assert rows(changes.worst_per_run(read)) == rows(want, "run_id", "classification")
    # neither a deletion nor a creation has its values read
    skipped = read.where(actions[0].isin("delete", "create", "forget") & (F.size(actions) < 2) & (kind != "aws_ecs_task_definition"))
    needed = rules.judged_by_attributes(actions) | rules.may_be_deploy_owned(kind)
    assert skipped.count() > 50 and skipped.where(needed).isEmpty()


def test_batches_shuffle_no_records_for_their_coverage(spark):
    records = spark.range(40).selectExpr("CAST(id % 2 AS STRING) AS run_id", "CAST(id AS STRING) AS resource")
    coverage = spark.createDataFrame([("0", 0.5), ("1", 1.0), ("9", 1.0)], "run_id string, coverage double")
    out = changes.scrub_payload(records, coverage, batch_rows=7)
    assert {(r.run_id, r.coverage) for r in out.collect()} == {("0", 0.5), ("1", 1.0)} and out.count() == 40
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # two before
