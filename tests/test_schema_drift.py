import json
import random

from pyspark.sql import Row

from quillon.operators import schema_drift as S

FILES = "file_id bigint, series_id string, written_at timestamp, received_at timestamp, payload string, measure string"


def files(spark, rows):
    from datetime import datetime, timedelta

    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, s, None if w is None else t + timedelta(hours=w), t, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, s, w, p in rows], FILES)


def found(df):
    return sorted(tuple(r) for r in S.changes(df).collect())


def test_each_kind_of_change(spark):
    df = files(spark, [(2, "a", 2, {"overallAccuracy": "50 %", "extra": 1}), (1, "a", 1, {"overall_accuracy": 0.5, "num_samples": 3}), (3, "a", 3, {"overallAccuracy": None, "num_samples": 4}), (4, "a", 4, {"overallAccuracy": 0.4, "num_samples": "4"}), (2, "a", 2, {"overallAccuracy": "50 %", "extra": 1}), (9, "b", 1, {"x": 1})])
    assert found(df) == [(2, "extra", "added"), (2, "num_samples", "removed"), (2, "overallAccuracy", "renamed"), (2, "overallAccuracy", "type_changed"), (3, "extra", "removed"), (3, "num_samples", "added"), (4, "num_samples", "type_changed"), (4, "overallAccuracy", "type_changed")]


def test_two_fields_of_one_measure_are_both_kept(spark):
    df = files(spark, [(1, "a", 1, {"overall_accuracy": 0.5}), (2, "a", 2, {"overall_accuracy": 0.5, "overallAccuracy": 0.5}), (3, "a", 3, {"overallAccuracy": "x"}), (4, "a", 4, {"acc": None}), (5, "a", 5, {"acc": 1})])
    assert found(df) == [(2, "overallAccuracy", "added"), (3, "overallAccuracy", "type_changed"), (3, "overall_accuracy", "removed"), (4, "acc", "renamed"), (5, "acc", "type_changed")]
    fields = {r.file_id: sorted(tuple(f) for f in r.fields) for r in S.ingest(df, trace=True).collect()}
    assert fields[2] == [("overall_accuracy", "overallAccuracy", "number", "0.5"), ("overall_accuracy", "overall_accuracy", "number", "0.5")]
    promoted = S.promote(S.ingest(df, {}, trace=True), {"overall_accuracy": "double"})
    assert sorted(tuple(r) for r in S.table_changes(promoted).collect()) == found(df)


def test_other_names_are_known_by_their_value(spark):
    df = files(spark, [(1, "a", 1, {"score_x": 0.123456, "b": 1, "p": 3.14159, "q": 3.14159}), (2, "a", 2, {"mark_y": 0.123456, "c": 1, "r": 3.14159, "s": 3.14159})])
    assert found(df) == [(2, "b", "removed"), (2, "c", "added"), (2, "mark_y", "renamed"), (2, "p", "removed"), (2, "q", "removed"), (2, "r", "added"), (2, "s", "added")]


def test_long_runs_of_nulls_keep_the_type(spark):
    df = files(spark, [(i, "a", i, {"k": 1 if i == 0 else "s" if i == 40 else None}) for i in range(41)])
    assert found(df) == [(40, "k", "type_changed")]


def test_dirty_inputs(spark):
    df = files(spark, [(1, "a", 1, "no json"), (2, "a", 2, {}), (3, None, 3, {"x": 1}), (None, "a", 4, {"x": 1}), (5, "a", 5, None), (6, "a", None, {"y": {"value": 2}})])
    assert found(df) == [(2, "y", "removed")]
    assert found(df.limit(0)) == []
    out = {r.file_id: r for r in S.ingest(df).collect()}
    assert json.loads(out[1].rescued) == {"_payload": "no json"} and set(out) == {1, 2, 3, 5, 6}


def test_ingest_rescues_and_promotes(spark):
    df = files(spark, [(1, "a", 1, {"acc_seen_types": "59.35 %", "relaxed_acc": {"value": 0.25, "n": 4}, "step": "many", "gpu_hours": 1.5}), (2, "a", 2, {"step": 7, "gpuHours": "x"})])
    rows = {r.file_id: r for r in S.promote(S.ingest(df), {"gpu_hours": "double"}).collect()}
    assert abs(rows[1].seen_type_accuracy - 0.5935) < 1e-9 and rows[1].relaxed_accuracy == 0.25 and rows[1].gpu_hours == 1.5
    assert json.loads(rows[1].rescued) == {"step": "many"}
    assert rows[2].global_step == 7 and rows[2].gpu_hours is None and json.loads(rows[2].rescued) == {"gpuHours": "x"}


def test_random_series_against_a_loop(spark):
    rng = random.Random(3)
    names = {"overall_accuracy": ["overall_accuracy", "overallAccuracy", "overall_acc"], "global_step": ["step", "global_step"], "zeta": ["zeta"]}
    rows = [(i, f"s{i % 3}", rng.randint(0, 50), {rng.choice(n): rng.choice([1, "a", None, {"v": 1}, [1]]) for n in names.values() if rng.random() < 0.7}) for i in range(120)]
    kind = lambda v: None if v is None else type(v).__name__
    back = {x: m for m, n in names.items() for x in n}
    want, state = set(), {}
    for i, s, _, p in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        cur = {back[k]: (k, kind(v)) for k, v in p.items()}
        if s in state:
            prev, types = state[s]
            want |= {(i, k, "added") for m, (k, _) in cur.items() if m not in prev}
            want |= {(i, k, "removed") for m, (k, _) in prev.items() if m not in cur}
            want |= {(i, k, "renamed") for m, (k, _) in cur.items() if m in prev and prev[m][0] != k}
            want |= {(i, k, "type_changed") for m, (k, t) in cur.items() if t and types.get(m) and types[m] != t}
        else:
            types = {}
        state[s] = (cur, {m: t or types.get(m) for m, (_, t) in cur.items()})
    assert set(found(files(spark, rows))) == want
    assert isinstance(Row(a=1), tuple)
