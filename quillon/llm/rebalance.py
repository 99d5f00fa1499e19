"""A sample matching target proportions of question types (problem 1).

The rows of a snapshot are cross-classified by question type and split. One network per snapshot
carries each type's demand (its floor ``min_rows`` or its target, whichever is more) through the type to
its cells and on to the sample, whose size is the capacity of the last arc. An arc from a type to a cell holds the
margin of the split and one what goes beyond; an arc out of a cell holds the rows there are. Slack arcs
expose each shortfall: one before the cells takes what there are no rows for, one behind them what
has no room in the sample, floors at a higher cost than targets, so these give way first. What the
types leave of the sample others fill beyond their targets, at the highest cost.
Fractional quotas are drawn to integers at random (systematic draws from seeded starts, one of its own
for each type), the flow keeps them integer, and the rows of a cell are drawn by the hash of their id.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spelling import plain_key, plain_split
from quillon.operators.ordered import hash_running
from quillon.session import cut, shuffle_width

PLAN_SCHEMA = "snapshot_id string, question_type string, split string, kind string, available bigint, wanted bigint, quota bigint, missing bigint, no_room bigint, floor_missing bigint"
# Costs of a row: outside its split's margin; a target or floor without room; a target or floor without rows; beyond the target; not given.
MARGIN, TARGET_ROOM, FLOOR_ROOM, TARGET_ROWS, FLOOR_ROWS, BEYOND, UNUSED = 10, 50, 5_000, 6_000, 10_000, 20_000, 20_020


class Network:
    """Min-cost flow by the primal-dual method; integer capacities and costs >= 0."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Adds an arc and its reverse; returns its number."""
        k = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def used(self, k: int) -> int:
        return self.room[k ^ 1]

    def push(self, source: int, sink: int, amount: int) -> int:
        """Sends up to ``amount`` at least cost; returns what was sent.

        Each round finds the cheapest way and sends all that goes at that cost along tight arcs.
        """
        height, sent = [0] * len(self.out), 0
        while sent < amount:
            best, heap = [math.inf] * len(self.out), [(0, source)]
            best[source] = 0
            while heap:
                d, a = heapq.heappop(heap)
                if d > best[a]:
                    continue
                for k in self.out[a]:
                    if self.room[k]:
                        n = d + self.cost[k] + height[a] - height[self.to[k]]
                        if n < best[self.to[k]]:
                            best[self.to[k]] = n
                            heapq.heappush(heap, (n, self.to[k]))
            if best[sink] == math.inf:
                break
            height = [h + min(b, best[sink]) for h, b in zip(height, best)]
            while sent < amount and (step := self._tight(source, sink, amount - sent, height)):
                sent += step
        return sent

    def _tight(self, source: int, sink: int, most: int, height: list[int]) -> int:
        """Sends along one way of arcs without reduced cost, found depth first; returns what was sent."""
        by, todo = {source: -1}, [source]
        while todo and sink not in by:
            a = todo.pop()
            for k in self.out[a]:
                b = self.to[k]
                if self.room[k] and b not in by and self.cost[k] + height[a] == height[b]:
                    by[b] = k
                    todo.append(b)
        if sink not in by:
            return 0
        way, at = [], sink
        while at != source:
            way.append(by[at])
            at = self.to[by[at] ^ 1]
        step = min(most, *(self.room[k] for k in way))
        for k in way:
            self.room[k] -= step
            self.room[k ^ 1] += step
        return step


def nearest(x: float) -> int:
    """The nearest integer, halves up."""
    return math.floor(x + 0.5)


def draw_integers(amounts: list[float], total: int, start: float) -> list[int]:
    """Integers next to ``amounts`` scaled to ``total``, drawn systematically from ``start`` in 0 .. 1."""
    whole = sum(amounts)
    if whole <= 0 or total <= 0:
        return [0] * len(amounts)
    upto, last, out = 0.0, 0, []
    for i, x in enumerate(amounts):
        upto += x * total / whole
        now = total if i == len(amounts) - 1 else min(total, math.floor(upto + start))
        out.append(now - last)
        last = now
    return out


def start_of(*parts: object) -> float:
    """A start in 0 .. 1 drawn by the hash of ``parts``."""
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big") / 2**64


def plan_snapshot(cells: pd.DataFrame, seed: int = 0) -> list[tuple]:
    """Rows (question_type, split, kind, available, wanted, quota, missing, no_room, floor_missing) of one snapshot.

    ``cells`` has question_type, split, n, target_share, min_rows, sample_rows. kind is ``type`` (one row per
    type, null split) or ``cell``. ``missing``: what is wanted and there are no rows for; ``no_room``: what
    there are rows for, but no room in the sample; ``floor_missing``: what of both is below the floor.
    """
    types = cells.drop_duplicates("question_type").sort_values("question_type")
    names = list(types.question_type)
    size = int(types.sample_rows.max())
    share = [float(x) for x in types.target_share]
    floor = [int(x) for x in types.min_rows]
    aims = draw_integers(share, size, start_of(seed, names, size))
    part = cells[cells.n > 0].sort_values(["question_type", "split"])
    members: dict[str, list[tuple[str, int]]] = {t: [] for t in names}
    for t, s, n in zip(part.question_type, part.split, part.n):
        members[t].append((s, int(n)))
    # Shortfalls are told against the rounded target, rows are given up to the drawn one.
    wanted = [max(f, nearest(s * size)) for f, s in zip(floor, share)]
    n = len(names)
    source, sink, sample = 0, 1, 2
    net, cell = Network(3 + 3 * n + sum(map(len, members.values()))), 3 + 3 * n
    net.arc(source, sink, sum(wanted) + size, UNUSED)
    net.arc(sample, sink, size, 0)
    lacks, rooms, ends = [], [], []
    for i, t in enumerate(names):
        demand, kind, given = 3 + i, 3 + n + i, 3 + 2 * n + i
        more = wanted[i] - floor[i]
        net.arc(source, demand, wanted[i], 0)
        net.arc(demand, kind, wanted[i], 0)
        net.arc(source, kind, size, BEYOND)
        lacks.append((net.arc(demand, sink, more, TARGET_ROWS), net.arc(demand, sink, floor[i], FLOOR_ROWS)))
        # Rounded targets may add up to more than the sample; the drawn ones say who gives way at no loss.
        spare = max(0, more - max(0, aims[i] - floor[i]))
        rooms.append((net.arc(given, sink, spare, TARGET_ROOM - 1), net.arc(given, sink, more - spare, TARGET_ROOM), net.arc(given, sink, floor[i], FLOOR_ROOM)))
        net.arc(given, sample, size, 0)
        have = members[t]
        margin = draw_integers([k for _, k in have], min(wanted[i], sum(k for _, k in have)), start_of(seed, t, size))
        mine = []
        for (_, k), m in zip(have, margin):
            net.arc(kind, cell, m, 0)
            net.arc(kind, cell, k, MARGIN)
            mine.append(net.arc(cell, given, k, 0))
            cell += 1
        ends.append(mine)
    net.push(source, sink, sum(wanted) + size)
    out = []
    for i, t in enumerate(names):
        have, spilled = members[t], sum(net.used(k) for k in rooms[i])
        used = [net.used(k) for k in ends[i]]
        # What has no room is taken off the cells in proportion.
        off = draw_integers(used, spilled, start_of(seed, t, "room")) if spilled else [0] * len(used)
        off = [min(o, u) for o, u in zip(off, used)]
        for j in range(len(used)):
            off[j] += min(used[j] - off[j], spilled - sum(off))
        lack = [net.used(k) for k in lacks[i]]
        out.append((t, None, "type", sum(k for _, k in have), wanted[i], sum(used) - spilled, sum(lack), spilled, lack[1] + net.used(rooms[i][2])))
        out += [(t, s, "cell", k, None, u - o, None, None, None) for (s, k), u, o in zip(have, used, off)]
    return out


def cell_rows(qa: DataFrame) -> DataFrame:
    """(id, snapshot_id, kind, split): each distinct id once, as ingested last; kind is the plain key of its type."""
    last = F.max_by(F.struct("snapshot_id", "question_type", "split"), F.struct("ingested_at", "snapshot_id", "question_type", "split"))
    rows = qa.where("id is not null").groupBy("id").agg(last.alias("r"))
    return rows.select("id", F.col("r.snapshot_id").alias("snapshot_id"), plain_key(F.col("r.question_type")).alias("kind"), F.coalesce(plain_split(F.col("r.split")), F.lit("none")).alias("split"))


def valid_stats(stats: DataFrame) -> DataFrame:
    """(snapshot_id, kind, stated_pairs, stated_share): the latest row of each snapshot and type; shares above 1 are percentages."""
    rows = stats.select("snapshot_id", plain_key(F.col("question_type")).alias("kind"), "qa_pairs", "dataset_share", "computed_at")
    last = F.max_by(F.struct("qa_pairs", "dataset_share"), F.struct("computed_at", "qa_pairs", "dataset_share"))
    per = rows.where("snapshot_id is not null and kind is not null").groupBy("snapshot_id", "kind").agg(last.alias("r"))
    share = F.when(F.col("r.dataset_share") > 1, F.col("r.dataset_share") / 100).otherwise(F.col("r.dataset_share"))
    return per.select("snapshot_id", "kind", F.col("r.qa_pairs").alias("stated_pairs"), share.alias("stated_share"))


def quotas(qa: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The plan (``PLAN_SCHEMA``) of every snapshot of ``targets``; one network per snapshot, as large as its cells, not its rows.

    Targets with null snapshot or type are ignored, null shares, floors and sizes count as 0.
    Repeated targets of a type keep the greatest share and floor. A snapshot without rows has
    quota 0 everywhere. Rows of types without a target are never drawn.
    """
    counts = cell_rows(qa).where("kind is not null").groupBy("snapshot_id", "kind", "split").agg(F.count(F.lit(1)).alias("n"))
    aims = targets.where("snapshot_id is not null").select("snapshot_id", "question_type", plain_key(F.col("question_type")).alias("kind"), "target_share", "min_rows", "sample_rows").where("kind is not null")
    aims = aims.groupBy("snapshot_id", "kind").agg(F.min("question_type").alias("question_type"), *[F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(c) for c in ("target_share", "min_rows", "sample_rows")])
    cells = aims.join(counts, ["snapshot_id", "kind"], "left").select("snapshot_id", "question_type", F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("n", F.lit(0)).alias("n"), "target_share", "min_rows", "sample_rows")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], *r) for r in plan_snapshot(pdf, seed)]
        out = pd.DataFrame(rows, columns=["snapshot_id", "question_type", "split", "kind", "available", "wanted", "quota", "missing", "no_room", "floor_missing"])
        return out.astype({c: "Int64" for c in out.columns[4:]})

    spread = cells.repartition(4 * shuffle_width(qa.sparkSession), "snapshot_id")  # small rows, much work: not to be coalesced
    return spread.groupBy("snapshot_id").applyInPandas(solve, PLAN_SCHEMA)


def shortfalls(qa: DataFrame, targets: DataFrame) -> DataFrame:
    """(snapshot_id, question_type) of the targets whose slack arc before the cells carries rows: more is asked than there is."""
    return quotas(qa, targets).where("kind = 'type' and missing > 0").select("snapshot_id", "question_type")


def report(qa: DataFrame, targets: DataFrame, stats: DataFrame, seed: int = 0) -> DataFrame:
    """(snapshot_id, question_type, available, stated_pairs, stated_share, wanted, quota, missing, no_room, floor_missing, reached_share) per target.

    ``stated_pairs`` and ``stated_share`` are those of the valid row of ``stats``, to be held against ``available``.
    """
    plan = quotas(qa, targets, seed).where("kind = 'type'").drop("split", "kind")
    sums = plan.groupBy("snapshot_id").agg(F.sum("quota").alias("_all"))
    joined = plan.withColumn("kind", plain_key(F.col("question_type"))).join(valid_stats(stats), ["snapshot_id", "kind"], "left").join(sums, "snapshot_id")
    reached = F.when(F.col("_all") > 0, F.col("quota") / F.col("_all")).otherwise(F.lit(0.0))
    return joined.select("snapshot_id", "question_type", "available", "stated_pairs", "stated_share", "wanted", "quota", "missing", "no_room", "floor_missing", reached.alias("reached_share"))


def sample(qa: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(id, snapshot_id, question_type, split): the rows drawn, as many of each cell as its quota."""
    cells = cut(quotas(qa, targets, seed).where("kind = 'cell' and quota > 0").select("snapshot_id", "question_type", plain_key(F.col("question_type")).alias("kind"), "split", "quota"))
    rows = cell_rows(qa).join(cells, ["snapshot_id", "kind", "split"])
    ranked = hash_running(rows, ["snapshot_id", "kind", "split"], ["id"], seed=seed)
    return ranked.where("rank <= quota").select("id", "snapshot_id", "question_type", F.nullif("split", F.lit("none")).alias("split"))
