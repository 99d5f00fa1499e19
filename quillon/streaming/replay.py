"""Logs of robot trials replayed: attempts, phases, closed loops, missions, protocols and positions.

A log row is (run_id, seq, phase, question_type, answer): the control itself is not run again, its rules are
held against what was logged. Rows of a run are worked on in windows by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import boxes
from quillon.functions import text as T

# The protocols and what a trial of each ends for.
PROTOCOLS = {
    "face_arrive": ["arrived", "failed_to_arrive", "failed_to_face_target"],
    "egocentric": ["arrived", "parse_failure_or_no_action", "timeout"],
    "closest_navigation": ["no_valid_target", "arrived", "failed_to_arrive", "failed_to_face_target"],
    "conditioned_closest_occupied_bench": ["no_occupied_bench", "arrived", "failed_to_arrive", "failed_to_face_target"],
    "conditioned_list": ["empty_target_list", "arrived", "failed_to_arrive", "failed_to_face_target"],
    "obstacle_aware": ["arrived", "turn_parse_failure", "obstacle_action_parse_failure", "timeout"],
    "obstacle_aware_closest": ["no_valid_closest_target", "arrived", "obstacle_action_parse_failure", "timeout"],
    "ordered_visit": ["empty_ordered_list", "ordered_visit_complete", "ordered_visit_failed"],
    "pairwise_then_visit": ["invalid_pairwise_choice", "arrived", "failed_to_arrive", "failed_to_face_target"],
}
# What a mission ends for, by its phase.
MISSION_PICKUP = ["count_people_parse_failure", "no_occupied_bench_found", "failed_to_reach_pickup_bench", "max_pickups_exceeded"]
MISSION_TOUR = ["no_animal_stops_found", "no_unvisited_stop_found", "failed_to_reach_animal_stop"]


def _run() -> Window:
    return Window.partitionBy("run_id")


def attempts(log: DataFrame, valid: Column, retries: int = 2) -> DataFrame:
    """(run_id, step, question_type, tries, value, ok): a question asked again until its answer is ``valid``, at most ``retries`` times more.

    Rows (run_id, step, attempt, question_type, answer) past the first valid one or the last allowed one
    are not counted; the value is that of the last counted row.
    """
    group = Window.partitionBy("run_id", "step", "question_type").orderBy("attempt")
    rows = log.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn("_k", F.row_number().over(group))
    rows = rows.withColumn("_done", F.coalesce(F.max(F.col("_ok").cast("int")).over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = rows.where((F.col("_done") == 0) & (F.col("_k") <= retries + 1))
    return kept.groupBy("run_id", "step", "question_type").agg(F.max("_k").alias("tries"), F.max_by("answer", "_k").alias("value"), F.bool_or("_ok").alias("ok"))


def stretches(log: DataFrame) -> DataFrame:
    """(run_id, stretch, phase, first_seq, last_seq, rows): runs of rows of one phase, in the order of seq."""
    order = _run().orderBy("seq")
    rows = log.withColumn("_new", (~F.lag("phase").over(order).eqNullSafe(F.col("phase")) | F.lag("seq").over(order).isNull()).cast("int")).withColumn("stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("run_id", "stretch").agg(F.first("phase").alias("phase"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("rows"))


def _first(when: Column, name: str) -> Column:
    return F.min(F.when(when, F.col("seq"))).alias(name)


def face_and_arrive(log: DataFrame, *, max_turns: int = 20, max_steps: int = 30) -> DataFrame:
    """(run_id, faced, arrived, reason, last_seq) of turn and arrival checks (question_type starting with Turn or Arrived).

    A run faces its target at the first check that says so within ``max_turns`` of them, if no reply before is without an action; it
    arrives at the first yes among the ``max_steps`` arrival checks after that, if no reply before is neither yes nor no.
    """
    turn, came = F.col("question_type").startswith("Turn"), F.col("question_type").startswith("Arrived")
    said = F.when(turn, T.reply_turn(F.col("answer"))).when(came, T.reply_yes_no(F.col("answer")))
    rows = log.where(turn | came).withColumn("_said", said).withColumn("_turn", turn)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "_turn").orderBy("seq")))
    faced = rows.where(F.col("_turn") & (F.col("_n") <= max_turns)).groupBy("run_id").agg(_first(F.col("_said") == "already facing", "f"), _first(F.col("_said").isNull(), "bad"))
    faced = faced.select("run_id", F.when(F.col("f").isNotNull() & (F.col("bad").isNull() | (F.col("f") < F.col("bad"))), F.col("f")).alias("face_seq"))
    after = rows.where(~F.col("_turn")).join(faced, "run_id").where(F.col("seq") > F.col("face_seq"))
    after = after.withColumn("_n", F.row_number().over(_run().orderBy("seq"))).where(F.col("_n") <= max_steps)
    arrived = after.groupBy("run_id").agg(_first(F.col("_said") == "yes", "a"), _first(F.col("_said").isNull(), "bad")).select("run_id", F.when(F.col("a").isNotNull() & (F.col("bad").isNull() | (F.col("a") < F.col("bad"))), F.col("a")).alias("arrive_seq"))
    runs = log.groupBy("run_id").agg(F.max("seq").alias("last_seq")).join(faced, "run_id", "left").join(arrived, "run_id", "left")
    ok_f, ok_a = F.col("face_seq").isNotNull(), F.col("arrive_seq").isNotNull()
    return runs.select("run_id", ok_f.alias("faced"), ok_a.alias("arrived"), F.when(~ok_f, "failed_to_face_target").when(ok_a, "arrived").otherwise("failed_to_arrive").alias("reason"), "last_seq")


def until_arrived(log: DataFrame, acts: Column, *, max_steps: int = 30, failure: str = "parse_failure_or_no_action") -> DataFrame:
    """(run_id, arrived, reason, steps) of loops that ask in each step whether they are there and else act.

    ``log`` has a row per step (run_id, step, arrived, ...), ``acts``: whether the step's replies gave an action.
    """
    rows = log.withColumn("_yes", F.coalesce(T.reply_yes_no(F.col("arrived")) == "yes", F.lit(False))).withColumn("_acts", F.coalesce(acts, F.lit(False))).where(F.col("step") <= max_steps)
    per = rows.groupBy("run_id").agg(F.min(F.when(F.col("_yes"), F.col("step"))).alias("y"), F.min(F.when(~F.col("_yes") & ~F.col("_acts"), F.col("step"))).alias("n"), F.max("step").alias("last"))
    ok = F.col("y").isNotNull() & (F.col("n").isNull() | (F.col("y") < F.col("n")))
    return per.select("run_id", ok.alias("arrived"), F.when(ok, "arrived").when(F.col("n").isNotNull(), failure).otherwise("timeout").alias("reason"), F.when(ok, F.col("y")).otherwise(F.coalesce("n", "last")).alias("steps"))


def target_of(protocol: str, reply: Column, pair: Column | None = None) -> Column:
    """struct(target, reason): what a protocol's choice of a target comes to; the reason is null if it can go on."""
    if protocol == "conditioned_list" or protocol == "ordered_visit":
        first = F.try_element_at(F.filter(T.reply_ids(reply), lambda x: x > 0), F.lit(1))
        why = "empty_target_list" if protocol == "conditioned_list" else "empty_ordered_list"
        return F.struct(first.alias("target"), F.when(first.isNull(), why).alias("reason"))
    n = T.reply_int(reply)
    if protocol == "pairwise_then_visit":
        ok = F.coalesce(F.array_contains(pair, n), F.lit(False))
        return F.struct(F.when(ok, n).alias("target"), F.when(~ok, "invalid_pairwise_choice").alias("reason"))
    why = {"closest_navigation": "no_valid_target", "conditioned_closest_occupied_bench": "no_occupied_bench", "obstacle_aware_closest": "no_valid_closest_target"}[protocol]
    ok = F.coalesce(n > 0, F.lit(False))
    return F.struct(F.when(ok, n).alias("target"), F.when(~ok, why).alias("reason"))


def ordered_visits(visits: DataFrame) -> DataFrame:
    """(run_id, visited, reason) of visits (run_id, place, arrived) in the order of place: a tour stops at the first target it does not reach."""
    order = _run().orderBy("place")
    rows = visits.withColumn("_missed", F.coalesce(F.max((~F.col("arrived")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = rows.where("_missed = 0").groupBy("run_id").agg(F.count_if("arrived").alias("visited"), F.bool_and("arrived").alias("ok"))
    return per.select("run_id", "visited", F.when(F.col("ok"), "ordered_visit_complete").otherwise("ordered_visit_failed").alias("reason"))


def reasons_by_protocol(finals: DataFrame) -> DataFrame:
    """(protocol, reason, n, known) of final rows (protocol, reason); ``known``: whether the protocol can end so."""
    can = F.create_map(*[x for p, r in PROTOCOLS.items() for x in (F.lit(p), F.array(*[F.lit(v) for v in r]))])
    known = F.coalesce(F.array_contains(F.try_element_at(can, F.col("protocol")), F.col("reason")), F.lit(False))
    return finals.groupBy("protocol", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("known", known)


def missions(log: DataFrame, *, max_pickups: int = 10, max_stops: int = 10) -> DataFrame:
    """(run_id, pickups, stops, success, reason) of mission logs (run_id, seq, event, target).

    Events: people (target: how many are waiting, null if unparsed), pickup (target: the bench reached, null for none found, -1 for
    not reached), stops (target: how many there are to visit), stop (target: the stop reached, null or -1 likewise).
    Picking up ends when nobody waits, within ``max_pickups`` rounds; then each stop is visited once.
    """
    e, t = F.col("event"), F.col("target")
    rows = log.withColumn("_bad", F.when((e == "people") & t.isNull(), MISSION_PICKUP[0]).when((e == "pickup") & t.isNull(), MISSION_PICKUP[1]).when((e == "pickup") & (t == -1), MISSION_PICKUP[2]).when((e == "stops") & (F.coalesce(t, F.lit(0)) <= 0), MISSION_TOUR[0]).when((e == "stop") & t.isNull(), MISSION_TOUR[1]).when((e == "stop") & (t == -1), MISSION_TOUR[2]))
    per = rows.groupBy("run_id").agg(
        F.count_if((e == "pickup") & (t > 0)).alias("pickups"), F.count_distinct(F.when((e == "stop") & (t > 0), t)).alias("stops"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("seq"))).alias("bad"),
        F.bool_or((e == "people") & (t == 0)).alias("done"), F.max(F.when(e == "stops", F.least(t, F.lit(max_stops)))).alias("want"),
    )
    reason = F.when(F.col("bad").isNotNull(), F.col("bad")).when(~F.col("done") & (F.col("pickups") >= max_pickups), MISSION_PICKUP[3]).when(F.col("done") & (F.col("stops") >= F.col("want")), "task_complete").otherwise("task_failed")
    return per.select("run_id", "pickups", "stops", (reason == "task_complete").alias("success"), reason.alias("reason"))


def movements(positions: DataFrame) -> DataFrame:
    """(run_id, ts, x, y, distance, speed, heading) of positions (run_id, ts, x, y): each against the one before; the first has none."""
    order = _run().orderBy("ts")
    px, py, pt = (F.lag(c).over(order) for c in ("x", "y", "ts"))
    rows = positions.select("run_id", "ts", "x", "y", px.alias("px"), py.alias("py"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(pt.cast("timestamp"))).alias("dt"))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    return rows.select("run_id", "ts", "x", "y", d.alias("distance"), F.try_divide(d * 1e6, F.col("dt")).alias("speed"), F.when(F.col("px").isNotNull(), boxes.bearing(F.col("px"), F.col("py"), F.col("x"), F.col("y"))).alias("heading"))


def cached(work: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The work with the answers of a cache (keys, answer), and what is still to be asked, each key once."""
    known = cache.groupBy(*keys).agg(F.min("answer").alias("answer"))
    both = work.join(known, keys, "left")
    return both, work.join(known, keys, "left_anti").dropDuplicates(keys)
