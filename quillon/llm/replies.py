"""Broken prompt and response pairs (problem 3).

Each reply is held against its question: a suffix automaton of the question's words measures how
much of the reply is copied, an automaton of refusal phrases finds replies that decline, stacks of
delimiters and the last word find replies that break off, and votes of common words (or the script)
tell the languages of question and reply. What can't be seen in one reply, that it ends where many
other replies go on, or inside a word, is found by a count of all replies, their beginnings and words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import languages
from quillon.llm.refusals import refuses
from quillon.operators.joins import bounded_join
from quillon.session import cut

#: A reply breaks off if at most this share as many replies end there as go on in the same way.
ENDING_SHARE = 0.25
#: A beginning counts if at least so many replies go on from it, whatever their forms.
SUPPORT = 3
#: Share of the question's words that a reply must repeat to be a copy, and the share of its own words that may differ.
COPIED, DIFFERENT = 0.6, 0.12
#: Shortest run of words that counts as copied.
RUN = 3

# Labels that may stand before a reply, and placeholders for none.
LABELS = "answer final reply response result output solution q a question prompt antwort frage ergebnis respuesta pregunta resultado réponse".split()
PLACEHOLDERS = "empty blank null nil nan none na tbd todo missing undefined placeholder unknown".split() + ["n/a", "no answer", "not available", "no response", "no reply"]

# Words after which a sentence goes on.
OPEN_ENDS = set(
    """the a an of to in at by from with for and or but because since as when while if that which than its near nearest between towards toward is are was lies it i
    el la los las un una de del al y en que por para con su según hacia más está son
    der die das den dem des ein eine einen im am zum zur und oder weil von vom mit nach dass vor sind""".split()
)
# Whole answers that also begin longer ones.
WHOLE = set("north south back front norte sur yes no ja nein sí left right".split())
_ZERO = re.compile("[​-‏⁠﻿­]")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class SuffixAutomaton:
    """All runs of the words of a text; ``longest`` gives, for each word of another, the longest run ending there."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, last = [-1], [0], 0
        for w in words:
            cur = self._state(self.size[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    copy = self._state(self.size[p] + 1, dict(self.next[q]))
                    self.link[copy] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def _state(self, size: int, arcs: dict[str, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.size.append(size)
        return len(self.next) - 1

    def longest(self, words: list[str]) -> list[int]:
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            else:
                at, n = 0, 0
            out.append(n)
        return out


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def covered(ends: list[int], run: int) -> list[bool]:
    """Which words lie in a matched run of at least ``run`` words."""
    out, reach = [False] * len(ends), len(ends)
    for i in range(len(ends) - 1, -1, -1):
        if ends[i] >= run:
            reach = min(reach, i - ends[i] + 1)
        out[i] = reach <= i
        if i <= reach:
            reach = len(ends)
    return out


@lru_cache(maxsize=1)
def automaton(question: str) -> tuple[SuffixAutomaton, int]:
    """Of the last question asked for only: rows come in the order of their questions."""
    words = tokens(question)
    return SuffixAutomaton(words), len(words)


def copies(question: str, reply: str) -> bool:
    """True if the reply holds nothing but the question's words in runs."""
    auto, n = automaton(question)
    words = tokens(reply)
    while words and words[0] in LABELS:
        words = words[1:]
    if n < RUN or len(words) < max(RUN, COPIED * n):
        return False
    ends = auto.longest(words)
    if max(ends) < COPIED * n:
        return False
    rest = [w for w, c in zip(words, covered(ends, RUN)) if not c]
    asked = set(tokens(question))
    if any(w.isdigit() or w in WHOLE for w in rest):
        return False
    return sum(map(len, rest)) <= DIFFERENT * sum(map(len, words)) and all(w in asked or any(SequenceMatcher(None, w, a).ratio() >= 0.75 for a in asked) for w in rest)


def content(reply: str | None) -> str:
    """The reply without marks, labels, placeholders and JSON around it; '' if nothing is left."""
    text = _ZERO.sub("", unicodedata.normalize("NFKC", reply or "")).strip()
    if text.startswith("{"):
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        if isinstance(value, dict):
            keys = [k for k in value if k.lower() in ("answer", "final_answer", "response", "reply")] or list(value)
            text = " ".join("" if value[k] is None else str(value[k]) for k in keys).strip()
    bare = re.sub(r"^[\s\"'`*_>#\-]*(?:" + "|".join(LABELS) + r")\b\s*(?:is\s*)?[:\-=]+", "", text, count=1, flags=re.I).strip()
    plain = re.sub(r"[^\w/]+", " ", bare).replace("_", " ").strip().lower()
    if not plain.strip("/ ") or plain in PLACEHOLDERS or plain in LABELS:
        return ""
    return bare or text


@lru_cache(maxsize=1)
def question_language(question: str) -> str | None:
    return languages.language(languages.words_of(question))


def speaks_other(question: str, reply: str) -> bool:
    """True if more speaks for another language than for the question's: the votes of common words and scripts, or without any the letter groups."""
    mine = question_language(question)
    if mine is None:
        return False
    words = languages.words_of(reply)
    got = languages.votes(words)
    own = got.get(mine, 0)
    if any(n > own for lang, n in got.items() if lang != mine and (lang != "?" or own == 0)):
        return True
    return own == 0 and languages.by_letters(words) not in (None, mine)


def unclosed(text: str) -> bool:
    """True if a bracket, a double quote or a code fence is opened and not closed."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“"}
    for part in re.findall(r'```|[()\[\]{}"“”]', re.sub(r'\\.', "", text)):
        if part in '([{“':
            stack.append(part)
        elif part in pairs:
            if stack and stack[-1] == pairs[part]:
                stack.pop()
        elif stack and stack[-1] == part:
            stack.pop()
        else:
            stack.append(part)
    return bool(stack)


def breaks_off(text: str) -> bool:
    """True if delimiters stay open or the last word or mark asks for more."""
    text = text.rstrip()
    if unclosed(text):
        return True
    if re.search(r"[,;:(\[{/–—]$|\w-$", text):
        return True
    words = tokens(text)
    return len(words) > 1 and text[-1].isalpha() and words[-1] in OPEN_ENDS


def defect(question: str | None, reply: str | None, ends_early: bool) -> str | None:
    """The defect of a reply, or None. ``ends_early``: many other replies go on from its end."""
    rest = content(reply)
    if not rest:
        return "empty_answer"
    if question and copies(question, rest):
        return "copies_question"
    if question and speaks_other(question, rest):
        return "other_language"
    if refuses(rest):
        return "refusal"
    if ends_early or breaks_off(reply or ""):
        return "truncated_answer"
    return None


def form(text: Column) -> Column:
    """The text without blanks at its ends, numbers and lists of numbers as '0'."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[\s ​]+", " ")), r"\d+(?:, \d+)*", "0")


def early_endings(replies: DataFrame) -> DataFrame:
    """(form): the forms of ``replies`` (text) at which a reply breaks off, as others go on.

    Counts all replies by form. The beginnings of every form, of whatever length, are hashed and
    summed where a form without an end mark has that length, so that nothing depends on how often
    one form occurs.
    """
    forms = cut(replies.where("text is not null").select(form(F.col("text")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    closed = F.col("form").rlike(r"[.!?\"}\])]$")
    ends = forms.where(~closed & (F.length("form") > 0)).withColumn("i", F.length("form"))
    lengths = F.broadcast(ends.agg(F.collect_set("i").alias("lengths")))  # one row
    begin = forms.crossJoin(lengths).select("form", "n", F.explode(F.filter("lengths", lambda i: i < F.length("form"))).alias("i"))
    rest = F.substring("form", F.col("i") + 1, F.length("form"))
    begin = begin.where(rest.rlike(r"[\p{L}\p{Nd}]"))
    glued = F.regexp_like(rest, F.lit(r"^[\p{L}\p{Nd}-]"))
    sums = begin.groupBy("i", F.xxhash64(F.substring("form", F.lit(1), F.col("i"))).alias("h"), glued.alias("glued")).agg(F.sum("n").alias("n"))
    per = sums.groupBy("i", "h").agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(~F.col("glued"), F.col("n"))), F.lit(0)).alias("apart")).where(F.col("all") >= SUPPORT)
    last = F.lower(F.regexp_extract("form", r"([\p{L}]+)$", 1))
    goes_on = F.when(last.isin(*sorted(WHOLE)) | (F.col("form").rlike(r"\d$")), F.col("apart")).otherwise(F.col("all"))
    return ends.withColumn("h", F.xxhash64("form")).join(per, ["i", "h"]).where(F.col("n") <= goes_on * ENDING_SHARE).select("form")


def cut_words(replies: DataFrame) -> DataFrame:
    """(last): last words of ``replies`` (text, question), without an end mark, at which a text breaks off inside a word.

    Such a word stands nowhere else inside a question or reply, but longer words that begin with it do, SUPPORT times or more.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{2,})"), F.lit(1))
    open_end = F.col("text").rlike(r"\p{L}\s*$")
    inner = F.when(open_end, F.slice(words("text"), 1, F.greatest(F.size(words("text")) - 1, F.lit(0)))).otherwise(words("text"))
    seen = replies.where("text is not null").select(F.explode(inner).alias("word")).unionByName(replies.where("question is not null").select("question").distinct().select(F.explode(words("question")).alias("word")))
    vocabulary = cut(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    lasts = cut(replies.where(open_end).select(last_word(F.col("text")).alias("last")).where("length(last) >= 2").distinct().join(vocabulary.select(F.col("word").alias("last")), "last", "left_anti"))
    sizes = F.broadcast(lasts.agg(F.collect_set(F.length("last")).alias("sizes")))  # one row
    begin = vocabulary.crossJoin(sizes).select("n", F.explode(F.transform(F.filter("sizes", lambda i: i < F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("last"))
    longer = begin.groupBy("last").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    return lasts.join(longer, "last", "left_semi")


def last_word(text: Column) -> Column:
    """The last word of a text in lower case, of texts of three words or more; shorter ones are judged by ``early_endings`` only, as they may be misspelt answers."""
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]+"))
    return F.when(words >= 3, F.lower(F.regexp_extract(text, r"(\p{L}+)\s*$", 1)))


def judged(question: Column, reply: Column, ends_early: Column) -> Column:
    """``defect`` as an Arrow-batched column; short pairs already judged are kept, within bounds of number and length."""

    @F.pandas_udf("string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        short = lru_cache(maxsize=20_000)(defect)
        for q, r, e in batches:
            yield pd.Series([(short if len(a or "") + len(b or "") <= 500 else defect)(a, b, bool(c)) for a, b, c in zip(q, r, e)], dtype=object)

    return judge(question, reply, ends_early)


def broken_replies(predictions: DataFrame) -> DataFrame:
    """(pred_id, field, defect) of every defective gold_answer and raw_prediction.

    Repeated pred_ids keep the row scored last; null pred_ids are ignored. A null question leaves
    the checks that need none. Null and blank replies are empty_answer. A reply has one defect,
    the first of: empty, copy, other language, refusal, truncation.
    """
    last = F.max_by(F.struct("question", "gold_answer", "raw_prediction"), F.struct("scored_at", "raw_prediction", "gold_answer"))
    rows = predictions.where("pred_id is not null").groupBy("pred_id").agg(last.alias("r")).select("pred_id", "r.*")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("gold_answer", "raw_prediction")])
    flat = cut(rows.select("pred_id", "question", F.explode(fields).alias("e")).select("pred_id", "question", "e.field", "e.text"))
    early = cut(early_endings(flat)).withColumn("early", F.lit(True))
    broken = cut(cut_words(flat)).withColumn("broken", F.lit(True))
    # Few forms and words are those of many replies, so these are hot keys.
    marked = bounded_join(flat.withColumn("form", form(F.col("text"))), early, ["form"], "left")
    marked = bounded_join(marked.withColumn("last", last_word(F.col("text"))), broken, ["last"], "left")
    ready = marked.select("pred_id", "field", "question", "text", F.coalesce("early", "broken", F.lit(False)).alias("ends")).sortWithinPartitions("question")
    found = ready.select("pred_id", "field", judged(F.col("question"), F.col("text"), F.col("ends")).alias("defect"))
    return found.where("defect is not null")


def defect_report(predictions: DataFrame) -> DataFrame:
    """(field, defect, replies)"""
    return broken_replies(predictions).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("replies"))
