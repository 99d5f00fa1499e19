"""Chat turns to question/answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import WS


def qa_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer) of turns (conv_id, turn, role, text).

    An assistant's turn answers the user's turn right before it; of several user turns in a row the
    last counts, further assistant turns answer nothing. Other roles and blank texts don't exist.
    """
    said = turns.where(F.col("role").isin("user", "assistant") & (F.regexp_replace("text", f"{WS}+", "") != ""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = said.withColumn("_role", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    return rows.where("role = 'assistant' and _role = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))
