"""Splits that keep all records of one scene together (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.spelling import file_name, plain_key, plain_split, scene_name
from quillon.operators.joins import bounded_join
from quillon.operators.ordered import HASH_BITS, hash_running, unit_hash
from quillon.session import cut

#: Most rounds in which scenes are moved between splits, and the miss of a question type's share at which they end.
ROUNDS, NEAR = 12, 0.005


def scene_components(qa: DataFrame) -> DataFrame:
    """(source_id, component) for each distinct non-null source_id of ``qa``, exactly as written.

    Each name is linked to its file name, and that to the scene of the picture it was derived from;
    names of one scene are one component. A name that is blank or has no file part is a scene of its
    own. Names are made distinct before their forms are worked out.
    """
    names = cut(qa.select("source_id").where("source_id is not null").distinct())
    s = F.col("source_id")
    forms = cut(names.select("source_id", F.concat(F.lit("name:"), s).alias("name"), F.concat(F.lit("file:"), file_name(s)).alias("file"), F.concat(F.lit("scene:"), scene_name(s)).alias("scene")))
    alone = F.concat(F.lit("scene:as written "), s)
    links = F.when(F.col("scene").isNull(), F.array(F.struct(F.col("name").alias("src"), alone.alias("dst")))).otherwise(F.array(F.struct(F.col("name").alias("src"), F.col("file").alias("dst")), F.struct(F.col("file").alias("src"), F.col("scene").alias("dst"))))
    found = components(forms.select(F.explode(links).alias("e")).select("e.*"))
    return found.where(F.col("node").startswith("name:")).select(F.substring("node", 6, 1 << 30).alias("source_id"), "component")


def leaking_sources(qa: DataFrame) -> DataFrame:
    """(source_id): the names, as written, whose scene has rows in more than one split at present."""
    comp = cut(scene_components(qa))
    now = qa.where("source_id is not null").groupBy("source_id", "split").agg(F.lit(1).alias("_")).select("source_id", plain_split(F.col("split")).alias("now")).where("now is not null").distinct()
    mixed = now.join(comp, "source_id").groupBy("component").agg(F.count_distinct("now").alias("n")).where("n > 1")
    return comp.join(mixed, "component", "left_semi").select("source_id")


def target_shares(targets: DataFrame) -> DataFrame:
    """(split_name, share): the named splits with a positive target, their shares adding up to 1; one row per split."""
    named = targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.max("target_share").alias("share"))
    return named.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def by_hash_order(sizes: DataFrame, aims: DataFrame, seed: int) -> DataFrame:
    """(component, split): components (component, size) laid end to end in the order of their hash and cut where the shares are reached.

    A component goes where its middle lies.
    """
    ranked = hash_running(sizes.withColumn("_one", F.lit(1)), ["_one"], ["component"], "size", seed=seed, total="upto")
    total = F.broadcast(sizes.agg(F.sum("size").alias("_all")))  # one row
    at = ranked.crossJoin(total).withColumn("_at", (F.col("upto") - F.col("size") / 2) / F.col("_all"))
    w = Window.orderBy(F.desc("share"), "split_name")
    cuts = aims.withColumn("hi", F.sum("share").over(w)).withColumn("lo", F.col("hi") - F.col("share"))
    cuts = cuts.withColumn("hi", F.when(F.lead("hi").over(w).isNull(), F.lit(2.0)).otherwise(F.col("hi"))).select(F.col("split_name").alias("split"), "lo", "hi")
    return at.join(F.broadcast(cuts), (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))).select("component", "split")  # split_targets: one row per split


def balanced(cells: DataFrame, placed: DataFrame, aims: DataFrame, *, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``placed`` (component, split), with components moved so that each kind comes nearer to its target shares.

    ``cells`` (component, kind, n). In a round every component works out, from the sums of kinds and
    splits alone, how much each move would lower the squared misses of all kinds together, and takes
    the best with a chance that keeps all moves together from overshooting, drawn by the hash of component
    and round. Components decide by themselves, so a round costs a few aggregations and joins with
    tables of one row per kind and split. A round without gain is taken back and the chances are halved.
    """
    totals = cut(cells.groupBy("kind").agg(F.sum("n").alias("all")))
    want = totals.crossJoin(F.broadcast(aims)).select("kind", F.col("split_name").alias("split"), (F.col("all") * F.col("share")).alias("want"), "all")
    best, best_miss, least, damp = placed, None, None, 1.0
    for turn in range(rounds + 1):
        sums = cells.join(placed, "component").groupBy("kind", "split").agg(F.sum("n").alias("now"))
        miss = cut(want.join(sums, ["kind", "split"], "left").select("kind", "split", "all", (F.coalesce("now", F.lit(0)) - F.col("want")).alias("miss")))
        # Misses count by the share of their kind.
        share = F.col("miss") / F.col("all")
        cost, worst = miss.agg(F.coalesce(F.sum(share * share), F.lit(0.0)), F.coalesce(F.max(F.abs(share)), F.lit(0.0))).first()
        if least is not None and cost >= least:
            placed, miss, damp = best, best_miss, damp / 2
        else:
            best, best_miss, least = placed, miss, cost
        if turn == rounds or worst <= NEAR:
            break
        here = bounded_join(cells.join(placed, "component"), miss.select("kind", "split", F.col("miss").alias("miss_here")), ["kind", "split"])
        there = bounded_join(here, miss.select("kind", F.col("split").alias("to"), F.col("miss").alias("miss_there"), "all"), ["kind"]).where("to <> split")
        # (h - n)^2 - h^2 + (t + n)^2 - t^2, over all^2
        change = F.sum(2 * (F.col("n") / F.col("all")) * (F.col("miss_there") - F.col("miss_here") + F.col("n")) / F.col("all"))
        moves = there.groupBy("component", "split", "to").agg(change.alias("change")).where("change < 0")
        move = moves.groupBy("component", "split").agg(F.min_by("to", F.struct("change", "to")).alias("to"))
        moving = cut(there.join(move, ["component", "split", "to"]).select("component", "split", "to", "kind", "n", (F.greatest("miss_here", F.lit(0)) / 2 + F.greatest(-F.col("miss_there"), F.lit(0)) / 2).alias("need")))
        # Of each kind, no more is to move between two splits than is too much here and too little there.
        flow = moving.groupBy("split", "to", "kind").agg(F.sum("n").alias("flow"), F.max("need").alias("need")).select("split", "to", "kind", F.least(F.lit(1.0), F.col("need") / F.col("flow")).alias("part"))
        chance = bounded_join(moving, cut(flow), ["split", "to", "kind"]).groupBy("component", "to").agg((F.sum(F.col("n") * F.col("part")) / F.sum("n") * damp).alias("chance"))
        drawn = unit_hash("component", seed=seed + 1 + turn) / (1 << HASH_BITS)
        taken = chance.where(drawn < F.col("chance")).select("component", "to")
        placed = cut(placed.join(taken, "component", "left").select("component", F.coalesce("to", "split").alias("split")))
    return best


def assign_splits(qa: DataFrame, targets: DataFrame, seed: int = 0, *, rounds: int = ROUNDS) -> DataFrame:
    """(id, source_id, question_type, component, split) for every distinct row of ``qa`` by id.

    Components are placed in the order of their hash, cut in the proportions of ``targets`` (split_name, target_share), and
    then moved, as a whole, where that brings the shares of each question_type nearer to the targets
    (``balanced``). Large and small components are treated alike. Records with a null source_id are
    components of their own; repeated ids keep the row ingested last; null ids are dropped, as they
    can't be assigned.
    """
    last = F.max_by(F.struct("source_id", "question_type"), F.struct("ingested_at", "source_id", "question_type"))
    rows = qa.where("id is not null").groupBy("id").agg(last.alias("r")).select("id", "r.*")
    comp = scene_components(qa)
    rows = cut(rows.join(comp, "source_id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("row:"), F.col("id").cast("string")))))
    cells = cut(rows.groupBy("component", F.coalesce(plain_key(F.col("question_type")), F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    aims = cut(target_shares(targets))
    placed = cut(by_hash_order(cells.groupBy("component").agg(F.sum("n").alias("size")), aims, seed))
    chosen = balanced(cells, placed, aims, rounds=rounds, seed=seed)
    return rows.join(chosen, "component").select("id", "source_id", "question_type", "component", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """(question_type, split, records, share): shares reached per question_type, any spelling of it, and over all ('*')."""
    kinds = assigned.withColumn("question_type", F.coalesce(plain_key(F.col("question_type")), F.lit("")))
    per = kinds.groupBy("question_type", "split").agg(F.count(F.lit(1)).alias("records"))
    both = per.union(per.groupBy("split").agg(F.sum("records").alias("records")).select(F.lit("*").alias("question_type"), "split", "records"))
    return both.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy("question_type")))
