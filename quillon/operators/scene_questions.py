"""Questions about a scene: people at benches, animals at stop signs, and the ways of the bus (the clock) to them.

A question is an ``Ask``: for which images it is asked, and its items (target, answer) as an array
expression over the columns of ``scenes``. ``target`` is the number the question names (0 where it
names none), ``answer`` the reply as text. Images for which a question can't be asked, or where the
answer is too close to call, have no row. As asks are expressions, any number of them are worked out
in one pass over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import geo
from quillon.operators.scenes import all_known, at_place, bound, detour

C = F.col
PLACES = {"bench": ("benches", "people", "people_at", "bench_order"), "sign": ("signs", "animals", "animals_at", "sign_order")}
ARRIVED = 190.0


class Ask(NamedTuple):
    """A question over ``scenes``: where it is asked, and its items, an array of (target, answer)."""

    where: Column
    items: Column


def rows_of(s: DataFrame, ask: Ask) -> DataFrame:
    """(image_id, target, answer)"""
    return s.where(ask.where).select("image_id", F.explode(ask.items).alias("e")).select("image_id", F.col("e.target").cast("bigint").alias("target"), F.col("e.answer").cast("string").alias("answer")).where("answer is not null")


def _one(answer: Column, where: Column | None = None) -> Ask:
    return Ask(F.lit(True) if where is None else where, F.array(_pair(F.lit(0), answer)))


def _and(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _pair(target: Column, answer: Column) -> Column:
    return F.struct(target.alias("target"), answer.alias("answer"))


def _gate() -> Column:
    return C("has_single") & C("clock").isNotNull()


def count_of(objects: str) -> Ask:
    return _one(F.size(objects))


def count_at(kind: str) -> Ask:
    places, _, at, _ = PLACES[kind]
    return Ask(all_known(C(at)), F.transform(places, lambda p, i: _pair(i + 1, at_place(C(at), i))))


def list_at_least(kind: str, ks: list[int]) -> Ask:
    """target is k."""
    places, _, at, _ = PLACES[kind]

    def ids(k: int) -> Column:
        full = F.filter(F.transform(places, lambda p, i: F.when(at_place(C(at), i) >= k, i + 1)), lambda x: x.isNotNull())
        return F.when(F.size(full) == 0, "0").otherwise(F.array_join(F.transform(full, lambda x: x.cast("string")), ", "))

    return Ask(all_known(C(at)) & (F.size(places) > 0), F.array(*[_pair(F.lit(k), ids(k)) for k in ks]))


def _arrived(d: Column, s: Column, limit: float) -> Column:
    near = d < limit * s
    return F.when(F.abs(d - limit * s) <= geo.margin(geo.ARRIVAL_MARGIN, s), F.lit(None)).when(near, "Yes").otherwise("No")


def arrived_bench(dist_threshold: float = ARRIVED) -> Ask:
    return Ask(_gate(), F.transform("benches", lambda p, i: _pair(i + 1, _arrived(geo.gap_between(C("clock"), p), C("scale"), dist_threshold))))


def arrived_animals(dist_threshold: float = ARRIVED) -> Ask:
    """Signs without animals are never reached; images without animals are not asked about."""

    def nearest(i: Column) -> Column:
        mine = F.transform(F.filter(F.arrays_zip("animals", "animals_at"), lambda z: z["animals_at"] == i), lambda z: geo.gap_between(C("clock"), z["animals"]))
        return F.array_min(mine)

    answer = lambda i: F.when(nearest(i).isNull(), "No").otherwise(_arrived(nearest(i), C("scale"), dist_threshold))
    return Ask(_and(_gate(), F.size("animals") > 0, all_known(C("animals_at"))), F.transform("signs", lambda p, i: _pair(i + 1, answer(i))))


def _asked(order: str) -> Column:
    return C("has_single") & C(order).isNotNull()


def closest(kind: str) -> Ask:
    order = PLACES[kind][3]
    return _one(C(order)[0]["i"] + 1, _asked(order))


def pairwise_closer(kind: str, most: int = 4, seed: int = 0) -> Ask:
    """target is 1000 * i + j; of more than ``most`` pairs those with the least hash of image and pair are asked about."""
    places = PLACES[kind][0]
    edge = geo.margin(geo.DISTANCE_MARGIN, C("scale"))
    dist = F.transform(places, lambda p: geo.distance(p["cx"], p["cy"], C("clock")["cx"], C("clock")["cy"]))
    pairs = F.flatten(F.transform(places, lambda p, i: F.transform(F.filter(F.transform(places, lambda q, j: j), lambda j: j > i), lambda j: F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), C("image_id").cast("string"), (i + 1).cast("string"), (j + 1).cast("string"))).alias("h"), i.alias("i"), j.alias("j")))))
    answer = lambda d, x: F.when(F.abs(d[x["i"]] - d[x["j"]]) > edge, F.when(d[x["i"]] < d[x["j"]], x["i"] + 1).otherwise(x["j"] + 1))
    chosen = F.slice(F.array_sort(pairs), 1, most)
    return Ask(_gate() & (F.size(places) >= 2), bound(dist, lambda d: F.transform(chosen, lambda x: _pair((x["i"] + 1) * 1000 + x["j"] + 1, answer(d, x)))))


def order_of(kind: str) -> Ask:
    order = PLACES[kind][3]
    return _one(F.array_join(F.transform(order, lambda x: (x["i"] + 1).cast("string")), ", "), _asked(order))


def _compass(p: Column, clock: Column) -> Column:
    angle = F.atan2(p["cy"] - clock["cy"], p["cx"] - clock["cx"])
    return F.when(geo.sector_is_stable(angle, geo.SECTOR_MARGIN), geo.sector(angle, geo.COMPASS))


def direction_to(kind: str) -> Ask:
    return Ask(_gate(), F.transform(PLACES[kind][0], lambda p, i: _pair(i + 1, _compass(p, C("clock")))))


def _ways(kind: str) -> tuple[Column, Callable[[Column, Column], Column]]:
    """Where ways are asked about, and the way to place p with index i."""
    places, objects, at, _ = PLACES[kind]
    plain = lambda o: F.struct(*[o[b].alias(b) for b in ("x1", "y1", "x2", "y2")])
    others = F.concat(*[F.transform(x, plain) for x in (("signs", "animals") if kind == "bench" else ("benches", "people"))])

    def way(p: Column, i: Column) -> Column:
        rest = F.filter(F.transform(places, lambda q, j: F.when(j != i, plain(q))), lambda q: q.isNotNull())
        away = F.transform(F.filter(F.arrays_zip(objects, at), lambda z: z[at] != i), lambda z: plain(z[objects]))
        return detour(C("clock"), p, F.concat(rest, away, others), C("img_w"), C("img_h"), C("scale"))

    return _and(_gate(), F.size(places) > 0, all_known(C(at))), way


def avoid_to(kind: str) -> Ask:
    where, way = _ways(kind)
    return Ask(where, F.transform(PLACES[kind][0], lambda p, i: _pair(i + 1, way(p, i))))


def avoid_to_closest(kind: str) -> Ask:
    places, _, _, order = PLACES[kind]
    where, way = _ways(kind)
    first = C(order)[0]["i"]
    goal = F.struct(C(places)[first].alias("p"), first.alias("i"))
    return _one(bound(goal, lambda x: way(x["p"], x["i"])), where & C(order).isNotNull())


def _dotted() -> Column:
    return _gate() & C("dot_x").isNotNull() & C("dot_y").isNotNull()


def _heading() -> tuple[Column, Column]:
    """From the clock to the heading dot."""
    return C("dot_x") - C("clock")["cx"], C("dot_y") - C("clock")["cy"]


def heading() -> Ask:
    """Needs the heading dot."""
    hx, hy = _heading()
    angle = F.atan2(hy, hx)
    return _one(F.when(geo.sector_is_stable(angle, geo.SECTOR_MARGIN), geo.sector(angle, geo.COMPASS)), _dotted())


def _delta(p: Column) -> Column:
    return geo.angle_between(*_heading(), p["cx"] - C("clock")["cx"], p["cy"] - C("clock")["cy"])


def turn_to(kind: str) -> Ask:
    return Ask(_dotted(), F.transform(PLACES[kind][0], lambda p, i: _pair(i + 1, F.when(geo.turn_is_stable(_delta(p)), geo.turn(_delta(p))))))


def relative_to(kind: str) -> Ask:
    return Ask(_dotted(), F.transform(PLACES[kind][0], lambda p, i: _pair(i + 1, F.when(geo.sector_is_stable(_delta(p), geo.RELATIVE_MARGIN), geo.sector(_delta(p), geo.RELATIVE)))))


def count_at_closest() -> Ask:
    return _one(at_place(C("people_at"), C("bench_order")[0]["i"]), _asked("bench_order") & all_known(C("people_at")))


def closest_with_person() -> Ask:
    """0 if there are no people at all, whatever else is unclear."""
    taken = F.filter("bench_order", lambda x: at_place(C("people_at"), x["i"]) > 0)
    clear = C("bench_order").isNotNull() & all_known(C("people_at"))
    first = F.try_element_at(taken, F.lit(1))["i"] + 1
    return _one(F.when(F.size("people") == 0, "0").when(clear, F.coalesce(first.cast("string"), F.lit("0"))), _gate() & (F.size("benches") > 0))


def direction_to_closest(kind: str) -> Ask:
    places, _, _, order = PLACES[kind]
    return _one(_compass(C(places)[C(order)[0]["i"]], C("clock")), _asked(order))


#: Query name to (question type, ask with its parameters); asks are made when called for, as columns need a session.
ASKS: dict[str, tuple[str, Callable[..., Ask]]] = {
    "count_people": ("CountPeople", lambda: count_of("people")),
    "count_animals": ("CountAnimals", lambda: count_of("animals")),
    "people_at_bench": ("CountPeopleAtBench", lambda: count_at("bench")),
    "animals_at_stop_sign": ("CountAnimalsAtStopSign", lambda: count_at("sign")),
    "list_benches_k": ("ListBenchesWithAtLeastKPeople", lambda ks=(1, 2): list_at_least("bench", list(ks))),
    "list_stop_signs_k": ("ListStopSignsWithAtLeastKAnimals", lambda ks=(3, 4): list_at_least("sign", list(ks))),
    "arrived_bench": ("ArrivedAtBench", arrived_bench),
    "arrived_animals": ("ArrivedAtAnimalsAroundStopSigns", arrived_animals),
    "closest_bench": ("ClosestBench", lambda: closest("bench")),
    "closest_stop_sign": ("ClosestStopSign", lambda: closest("sign")),
    "pairwise_bench": ("PairwiseCloserBench", lambda **p: pairwise_closer("bench", **p)),
    "pairwise_stop_sign": ("PairwiseCloserStopSign", lambda **p: pairwise_closer("sign", **p)),
    "order_benches": ("ClosestToFurthestBenches", lambda: order_of("bench")),
    "order_stop_signs": ("ClosestToFurthestStopSigns", lambda: order_of("sign")),
    "direction_bench": ("GeometricDirectionToBench", lambda: direction_to("bench")),
    "direction_stop_sign": ("GeometricDirectionToStopSign", lambda: direction_to("sign")),
    "avoid_to_bench": ("AvoidObstacleToReachBench", lambda: avoid_to("bench")),
    "avoid_to_stop_sign": ("AvoidObstacleToReachStopSign", lambda: avoid_to("sign")),
    "heading": ("BusHeadingDirection", heading),
    "turn_bench": ("TurnDirectionToBench", lambda: turn_to("bench")),
    "turn_stop_sign": ("TurnDirectionToStopSign", lambda: turn_to("sign")),
    "relative_bench": ("BenchRelativeToHeading", lambda: relative_to("bench")),
    "relative_stop_sign": ("StopSignRelativeToHeading", lambda: relative_to("sign")),
    "count_at_closest_bench": ("CountPersonAtClosestBench", count_at_closest),
    "closest_bench_with_person": ("ClosestBenchWithPerson", closest_with_person),
    "avoid_to_closest_bench": ("AvoidObstacleToReachClosestBench", lambda: avoid_to_closest("bench")),
    "avoid_to_closest_stop": ("AvoidObstacleToReachClosestStopSign", lambda: avoid_to_closest("sign")),
    "direction_closest_bench": ("DirectionToClosestBench", lambda: direction_to_closest("bench")),
    "direction_closest_stop": ("DirectionToClosestStopSign", lambda: direction_to_closest("sign")),
}


def _builder(ask: Callable[..., Ask]) -> Callable[[DataFrame], DataFrame]:
    return lambda s: rows_of(s, ask())


#: Query name to (question type, builder of (image_id, target, answer) from ``scenes``).
REGISTRY: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {name: (kind, _builder(ask)) for name, (kind, ask) in ASKS.items()}
