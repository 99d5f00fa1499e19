"""Mixing sources to target weights (problem 8).

Weighted fair queueing: the documents of a source are shuffled by hash and laid end to end, over and
over up to the allowed repeats. A document's virtual finish time is the tokens of its source up to
and including it divided by the source's target weight. All copies are range-sorted by finish time
and the mix ends where their tokens, summed in that order, reach the total budget. A source whose
last finish time lies before the budget runs dry; what it lacks the others give in proportion.

Copies that can't get into the mix are never made: the virtual time at which the mix is full is
bounded beforehand from the sizes of the sources alone (``lanes``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillon.llm.spelling import plain_key
from quillon.operators.joins import bounded_join
from quillon.operators.ordered import hash_running, ordered_running
from quillon.session import cut

#: The session setting that names the vocabulary file, which every executor must have at that path.
SETTING = "spark.quillon.tokenizer"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def encoding(path: str):
    """The byte-level BPE of ``path`` (ranks in tiktoken's format), once per Python worker."""
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(path: str = TOKENIZER):
    """A Pandas UDF: tokens of a whole text, 0 for null."""

    @F.pandas_udf(LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = encoding(path)
        for batch in texts:
            yield pd.Series([0 if t is None else len(code.encode_ordinary(t)) for t in batch], dtype="int64")

    return count


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): each distinct doc_id once (the row collected last), source as its plain key."""
    path = path or documents.sparkSession.conf.get(SETTING, TOKENIZER)
    last = F.max_by(F.struct("source", "text"), F.struct("collected_at", "source"))
    one = documents.where("doc_id is not null").groupBy("doc_id").agg(last.alias("r"))
    return one.select("doc_id", plain_key(F.col("r.source")).alias("source"), token_counts(path)(F.col("r.text")).alias("tokens"))


def plain_targets(targets: DataFrame) -> DataFrame:
    """(mix_id, name, source, share, repeats, mix_ratio): one row per mix and source; null, negative and missing numbers count as 0."""
    rows = targets.where("mix_id is not null").select("mix_id", F.col("source").alias("name"), plain_key(F.col("source")).alias("source"), "target_share", "max_repeats", "mix_ratio").where("source is not null")
    zero = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0))
    return rows.groupBy("mix_id", "source").agg(F.min("name").alias("name"), zero("target_share").alias("share"), zero("max_repeats").alias("repeats"), zero("mix_ratio").alias("mix_ratio"))


def lanes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, name, share, repeats, budget, size, end, stop) of every mix and source with documents and a share.

    ``budget`` is the size of the mix in tokens, ``size`` that of the source, ``end`` the virtual finish
    time of its last allowed copy. ``stop`` is a virtual time before which the mix is full: there every
    source, less one document for the copy that is cut, has given its share or all it may give, and
    that is the budget. As sources go dry in the order of ``end``, it lies between two of these.
    Documents of sources without a target, and of a null source, count towards the corpus only.
    """
    whole = F.broadcast(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all")))  # one row
    totals = sized.where("source is not null and tokens > 0").groupBy("source").agg(F.sum("tokens").alias("size"), F.max("tokens").alias("_longest"))
    rows = plain_targets(targets).where("share > 0 and repeats > 0").join(totals, "source").crossJoin(whole)
    rows = rows.withColumn("budget", F.col("mix_ratio") * F.col("_all")).withColumn("end", F.col("repeats") * F.col("size") / F.col("share"))
    mix, order = Window.partitionBy("mix_id"), Window.partitionBy("mix_id").orderBy("end", "source")  # rows of the targets, not of the corpus
    asked = F.col("budget") + F.sum("_longest").over(mix)
    dry = F.coalesce(F.sum(F.col("repeats") * F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wet = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_at", (asked - dry) / wet)
    stop = F.min(F.when(F.col("_at") <= F.col("end"), F.struct("end", "source", "_at"))).over(mix)["_at"]
    return rows.withColumn("stop", F.coalesce(stop, F.max("end").over(mix))).select("mix_id", "source", "name", "share", "repeats", "budget", "size", "end", "stop")


def schedule(sized: DataFrame, lane: DataFrame, *, seed: int = 0) -> DataFrame:
    """From ``sized_documents`` and ``lanes``: (mix_id, source, doc_id, copy, tokens, finish, budget) of every copy that finishes by ``stop``."""
    laid = hash_running(sized.where("source is not null and tokens > 0"), ["source"], ["doc_id"], "tokens", seed=seed, total="upto").drop("rank")
    # (copy - 1) * size + upto <= share * stop, and copy <= repeats.
    most = F.least(F.col("repeats"), F.floor((F.col("share") * F.col("stop") - F.col("upto")) / F.col("size")) + 1).cast("int")
    copies = bounded_join(laid, lane, ["source"]).withColumn("_most", most).where("_most > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_most"))))
    finish = ((F.col("copy") - 1) * F.col("size") + F.col("upto")) / F.col("share")
    return copies.select("mix_id", F.col("name").alias("source"), "doc_id", "copy", "tokens", finish.alias("finish"), "budget")


def served(sized: DataFrame, lane: DataFrame, *, seed: int = 0) -> DataFrame:
    """The copies in the mix: in the order of their finish times, as long as their tokens are within the budget."""
    copies = schedule(sized, lane, seed=seed)
    return ordered_running(copies, ["mix_id"], ["finish", "source", "doc_id", "copy"], "tokens", "upto").where("upto <= budget").drop("upto")


def mix(documents: DataFrame, targets: DataFrame, *, path: str | None = None, seed: int = 0) -> DataFrame:
    """(mix_id, source, doc_id, copy, tokens, finish): the copies of each mix, source as written in the targets.

    Each mix holds as many tokens as fit into its budget or as its sources may give. Shares that don't
    add up to 1 count in proportion. Null and empty texts are never drawn; repeated doc_ids count once.
    """
    sized = cut(sized_documents(documents, path))
    return served(sized, cut(lanes(sized, targets)), seed=seed).select("mix_id", "source", "doc_id", "copy", "tokens", "finish")


def mix_report(documents: DataFrame, targets: DataFrame, *, path: str | None = None, seed: int = 0) -> DataFrame:
    """(mix_id, source, target_share, target_tokens, given_tokens, reached_share, dry): per row of the targets.

    ``reached_share`` is the share of the tokens in the mix, null for an empty mix. ``dry``: the last
    virtual finish time of the source is before the budget, so even all copies end before its target
    is given. Sources without documents give 0 tokens and are dry if anything is asked of them.
    """
    sized = cut(sized_documents(documents, path))
    lane = cut(lanes(sized, targets))
    gave = served(sized, lane, seed=seed).groupBy("mix_id", F.col("source").alias("name")).agg(F.sum("tokens").alias("given"))
    mixed = gave.groupBy("mix_id").agg(F.sum("given").alias("_mixed"))
    whole = F.broadcast(sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all")))  # one row
    joined = plain_targets(targets).join(lane.select("mix_id", "name", "end"), ["mix_id", "name"], "left").join(gave, ["mix_id", "name"], "left").join(mixed, "mix_id", "left").crossJoin(whole)
    budget = F.col("mix_ratio") * F.col("_all")
    given = F.coalesce(F.col("given"), F.lit(0))
    dry = (F.col("share") * budget > 0) & F.coalesce(F.col("end") < budget, F.lit(True))
    return joined.select("mix_id", F.col("name").alias("source"), F.col("share").alias("target_share"), (F.col("share") * budget).alias("target_tokens"), given.alias("given_tokens"), (given / F.col("_mixed")).alias("reached_share"), dry.alias("dry"))


def dry_sources(documents: DataFrame, targets: DataFrame, *, path: str | None = None) -> DataFrame:
    """(mix_id, source) of the targets that can't be given even with every document used as often as allowed."""
    return mix_report(documents, targets, path=path).where("dry").select("mix_id", "source")
