"""Subject areas of documents (problem 9).

Labelling functions speak for or against each area of a document:

* lexicon: the words of the areas' names and descriptions, by their stems;
* model: a term model of sentences, learned from hand-rated documents, the lexicon and texts that are
  known to have no subject;
* section: runs of neighbouring sentences that the model gives to one area;
* source: how much more often the source of the document has the area than the corpus.

A latent model learns how reliable each function is from how they agree, without labels, and gives
every document and area a posterior probability. There is no word list: areas are known by their
description and the ratings only, so any list of areas works.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spelling import plain_key
from quillon.operators.ordered import HASH_BITS, unit_hash
from quillon.session import cut, spread

#: The term model is fitted on the driver on about so many rated documents, others and texts without a subject, chosen by hash ...
RATED, OTHERS, SUBJECTLESS = 4_000, 2_000, 1_000
#: ... and of these on about so many sentences, those with more than so many different terms left out.
SENTENCES, TERMS = 80_000, 1_000
#: Rounds of its expectation maximisation, and the round from which unrated documents take part.
ROUNDS, LATE = 25, 15
#: Nats by which an area that raters did not give is less likely for a sentence, as ratings may be missing or wrong.
UNRATED = 4.0
#: Terms are hashed to so many cells, which bounds the model's size; more areas than MOST_AREAS are an error.
CELLS, MOST_AREAS = 1 << 16, 1000
#: A sentence votes for an area by the model if it is so many nats more likely than any other and than none.
ODDS = 3.0
#: Sentences for an area that make it a subject of a text; fewer do if they are at least HALF of all that vote.
ENOUGH, HALF = 3, 0.5
#: Neighbouring sentences that make a section, and sentences with words of its description that make the lexicon speak for an area.
SECTION, DESCRIBED = 2, 2
#: A source speaks for an area if it has it so many times as often as the corpus.
LIFT = 1.5
FUNCTIONS = ("lexicon", "model", "section", "source")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
# Longer words that tell nothing about a subject.
_COMMON = set("about after also among before between from have here into other over such than that their them then there these they this those through under very what when where which while with without".split())


def sentences(text: str) -> list[str]:
    """The sentences of a text: without tags, list marks, quote marks and log stamps; wrapped lines are joined."""
    text = re.sub(r"<[^<>]{1,80}>", "\n", text)
    parts: list[str] = []
    ended = True
    for line in text.splitlines():
        line = re.sub(r"^\s*>+ ?", "", line)
        bare = re.sub(r"^\s*(?:\[?\d\d:\d\d(?::\d\d)?\]?|[-*•#]+|\d+[.)])\s+", "", line)
        if not bare.strip():
            ended = True
            continue
        if ended or bare != line or not parts:
            parts.append(bare.strip())
        else:
            parts[-1] += " " + bare.strip()
        ended = bool(re.search(r"[.?!:][\"'”)]*\s*$", bare))
    return [s for p in parts for s in re.split(r"(?<=[.?!])\s+", p) if s]


def words_of(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower().replace("’", "'"))


def stem(word: str) -> str:
    """A word without up to three letters of its ending."""
    return word[: max(4, len(word) - 3)] if len(word) > 5 else word


def lexicon_of(areas: dict[str, str | None]) -> dict[str, list[str]]:
    """Stem to areas, of the words of 4 letters or more in names and descriptions."""
    out: dict[str, list[str]] = {}
    for area in sorted(areas):
        for s in dict.fromkeys(stem(w) for w in words_of(f"{areas[area] or ''} {area.replace('_', ' ')}") if len(w) >= 4 and w not in _COMMON):
            out.setdefault(s, []).append(area)
    return out


def lexicon_vote(words: list[str], lexicon: dict[str, list[str]]) -> str | None:
    """The area whose words lead in a sentence, None without a lead."""
    got: Counter[str] = Counter()
    for s in {stem(w) for w in words}:
        areas = lexicon.get(s, ())
        for a in areas:
            got[a] += 1 / len(areas)
    top = got.most_common(2)
    return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1]) else None


def cell(word: str) -> int:
    """A cell of CELLS that is the same in every process; words with a digit share one."""
    h = 2166136261
    for b in b"0" if any(c.isdigit() for c in word) else word.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) % CELLS


def learning_rows(batches: Iterator[pd.DataFrame], lexicon: dict[str, list[str]]) -> Iterator[pd.DataFrame]:
    """(doc, text, rated) to a row per different sentence: (doc, at, rated, cells, seed), seed being the lexicon's area."""
    for batch in batches:
        out = []
        for doc, text, rated in zip(batch.doc, batch.text, batch.rated):
            seen = set()
            for at, s in enumerate(sentences(text)):
                words = words_of(s)
                cells = tuple(sorted({cell(w) for w in words}))
                if 0 < len(cells) <= TERMS and cells not in seen:
                    seen.add(cells)
                    out.append((doc, at, rated, cells, lexicon_vote(words, lexicon)))
        yield pd.DataFrame(out, columns=["doc", "at", "rated", "cells", "seed"])


class TermModel:
    """Odds of areas, and of none, by the hashed terms of a sentence."""

    def __init__(self, areas: list[str], weight: np.ndarray, prior: np.ndarray, known: np.ndarray):
        self.areas, self.weight, self.prior, self.known = areas, weight, prior, known
        self.cells: dict[str, int] = {}

    @classmethod
    def fit(cls, areas: list[str], rows: list[tuple[list[int], list[str] | None, str | None]]) -> TermModel:
        """Expectation maximisation over sentences (cells, areas of the document, seed).

        The areas of a document are None if it is not rated and [] if it is known to have no subject.
        A sentence of a rated document begins as equally likely of each rated area and of none; a seed
        counts for one nat more. Terms spread evenly over the areas so come to speak for none.
        """
        k, at = len(areas), {a: i for i, a in enumerate(areas)}
        if not rows:
            return cls(areas, np.zeros((CELLS, k + 1)), np.zeros(k + 1), np.zeros(CELLS, bool))
        flat = np.concatenate([r[0] for r in rows])
        sizes = np.array([len(r[0]) for r in rows])
        start, sent = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
        hard, share, seeds = np.zeros((len(rows), k + 1)), np.zeros((len(rows), k + 1)), np.zeros((len(rows), k + 1))
        share[:, k] = 1.0
        for i, (_, rated, seed) in enumerate(rows):
            if rated is None:
                share[i] = 1.0
            else:
                hard[i, :k] = -UNRATED if rated else -math.inf
                for a in rated:
                    hard[i, at[a]], share[i, at[a]] = 0.0, 1.0
            if seed is not None and rated != []:
                seeds[i, at[seed]] = 1.0
        free = np.array([r[1] is None for r in rows])
        alone = not any(r[1] for r in rows)
        if alone:  # no ratings: the lexicon's seeds start the areas
            share = share * np.where(seeds > 0, 30.0, 1.0)
        share /= share.sum(axis=1, keepdims=True)
        for turn in range(ROUNDS):
            taken = share if alone or turn >= LATE else share * ~free[:, None]
            n = np.stack([np.bincount(flat, weights=taken[sent, j], minlength=CELLS) for j in range(k + 1)], axis=1)
            size = taken.sum(axis=0)
            # What speaks for none is as broad as the terms of all areas, so that no single kind of sentence settles there.
            n[:, k] += n.sum(axis=1) / (k + 1)
            size[k] += size.sum() / (k + 1)
            weight, prior = np.log((n + 0.05) / (size + 0.1)), np.log((size + 1) / (size.sum() + k + 1))
            odds = np.add.reduceat(weight[flat], start, axis=0) + prior + seeds + hard
            odds -= odds.max(axis=1, keepdims=True)
            share = np.exp(odds)
            share /= share.sum(axis=1, keepdims=True)
        return cls(areas, weight, prior, n.sum(axis=1) >= 2)

    def votes(self, said: list[list[str]]) -> list[str | None]:
        """The area of each sentence, None without a clear one."""
        flat, sizes = [], []
        for words in said:
            cells = set()
            for w in words:
                c = self.cells.get(w)
                if c is None:
                    c = cell(w)
                    if len(self.cells) < 200_000:
                        self.cells[w] = c
                if self.known[c]:
                    cells.add(c)
            flat += sorted(cells)
            sizes.append(len(cells))
        out: list[str | None] = [None] * len(said)
        some = [i for i, n in enumerate(sizes) if n]
        if some:
            n = np.array(sizes)[some]
            odds = np.add.reduceat(self.weight[flat], np.cumsum(n) - n, axis=0) + self.prior
            first = odds.argmax(axis=1)
            top = odds[np.arange(len(some)), first]
            odds[np.arange(len(some)), first] = -np.inf
            for i, a, clear in zip(some, first, top - odds.max(axis=1) >= ODDS):
                out[i] = self.areas[a] if clear and a < len(self.areas) else None
        return out


def evidence(text: str, model: TermModel, lexicon: dict[str, list[str]]) -> dict[str, tuple[int, int, int]]:
    """Area to the votes (1, 0 or -1) of lexicon, model and section."""
    said = [words_of(s) for s in sentences(text)]
    by_model = model.votes(said)
    described = Counter(v for v in (lexicon_vote(w, lexicon) for w in said) if v)
    counts = Counter(v for v in by_model if v)
    run: Counter[str] = Counter()
    last, length = None, 0
    for v in by_model:
        if v:
            length = length + 1 if v == last else 1
            last = v
            run[v] = max(run[v], length)
    total, out = sum(counts.values()), {}
    for area in set(counts) | set(described):
        n = counts[area]
        votes = 1 if n >= ENOUGH or n and n >= HALF * total else 0 if n == ENOUGH - 1 else -1
        out[area] = (1 if described[area] >= DESCRIBED else 0, votes, 1 if run[area] >= SECTION or n and len(said) <= SECTION else -1 if n < SECTION else 0)
    return out


def fit_reliability(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, by expectation maximisation over how often each pattern occurs.

    Each function has, for subjects and for others, its own rates of speaking for, against and not at all;
    the start trusts each a little.
    """
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    votes = np.array(keys) + 1
    post = np.clip(0.5 + 0.3 * (votes - 1).mean(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        prior = (post @ n + 1) / (n.sum() + 2)
        score = np.full(len(keys), math.log(prior / (1 - prior)))
        for f in range(votes.shape[1]):
            yes = np.array([n[votes[:, f] == v] @ post[votes[:, f] == v] + 0.5 for v in range(3)])
            no = np.array([n[votes[:, f] == v] @ (1 - post)[votes[:, f] == v] + 0.5 for v in range(3)])
            rate = np.log(yes / yes.sum()) - np.log(no / no.sum())
            score += rate[votes[:, f]]
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {k: float(p) for k, p in zip(keys, post)}


def about(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows of ``df``, all if it has no more, by the hash of ``key``."""
    share = rows / max(1, df.count())
    return df if share >= 1 else df.where(unit_hash(*key, seed=9) < int(share * (1 << HASH_BITS)))


def learned_model(one: DataFrame, areas: list[str], lexicon: dict[str, list[str]], ratings: DataFrame | None, subjectless: DataFrame | None) -> TermModel:
    """The term model, fitted on bounded samples of ``one`` (doc_id, text)."""
    none = F.lit(None).cast("array<string>")
    if ratings is None:
        rated = one.select("doc_id", none.alias("rated")).limit(0)
    else:
        kept = ratings.where(F.col("subject_area").isin(*areas)) if areas else ratings.limit(0)
        rated = cut(kept.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_area").alias("rated")))
    sample = one.join(about(rated, RATED, "doc_id"), "doc_id").select(F.col("doc_id").cast("string").alias("doc"), "text", "rated")
    others = about(one.select("doc_id").join(rated, "doc_id", "left_anti"), OTHERS, "doc_id")
    sample = sample.unionByName(one.join(others, "doc_id").select(F.col("doc_id").cast("string").alias("doc"), "text", none.alias("rated")))
    if subjectless is not None:
        texts = subjectless.select("text").where("trim(text) <> ''").distinct()
        sample = sample.unionByName(about(texts, SUBJECTLESS, "text").select(F.concat(F.lit("none:"), "text").alias("doc"), "text", F.array().cast("array<string>").alias("rated")))
    rows = cut(sample.mapInPandas(lambda batches: learning_rows(batches, lexicon), "doc string, at int, rated array<string>, cells array<int>, seed string"))
    picked = about(rows, SENTENCES, "doc", "at").select("doc", "at", "cells", "rated", "seed").orderBy(F.xxhash64("doc"), "at")  # a bounded sample
    return TermModel.fit(areas, [(r.cells, r.rated, r.seed) for r in picked.collect()])


def posteriors(documents: DataFrame, areas: DataFrame, ratings: DataFrame | None = None, subjectless: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject_area, probability) of each area that any sentence of a document speaks for.

    ``areas`` (subject_area, description), ``ratings`` (doc_id, subject_area) by hand, which may be wrong
    or missing, ``subjectless`` (text) with texts that speak for no area. Null and blank texts give no
    rows; repeated doc_ids keep the text collected last. The term model is fitted on bounded samples;
    every text is judged whole, and reliabilities and source statistics are over the whole corpus.
    More than MOST_AREAS areas are an error.
    """
    spark = documents.sparkSession
    listed = areas.where("subject_area is not null").groupBy("subject_area").agg(F.max("description").alias("description")).limit(MOST_AREAS + 1).collect()
    if len(listed) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} subject areas")
    names = sorted(r.subject_area for r in listed)
    lexicon = lexicon_of({r.subject_area: r.description for r in listed})
    last = F.max_by(F.struct("text", "source"), F.struct("collected_at", "text"))
    one = documents.where("doc_id is not null").groupBy("doc_id").agg(last.alias("r")).select("doc_id", F.col("r.text").alias("text"), plain_key(F.col("r.source")).alias("source"))
    one = cut(one.where("trim(text) <> ''"))
    held = spark.sparkContext.broadcast(learned_model(one, names, lexicon, ratings, subjectless))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for batch in batches:
            out = [(d, s, a, *v) for d, s, t in zip(batch.doc_id, batch.source, batch.text) for a, v in evidence(t, model, lexicon).items()]
            yield pd.DataFrame(out, columns=["doc_id", "source", "subject_area", "lexicon", "model", "section"])

    texts = spread(one, "doc_id").select("doc_id", "source", "text")
    votes = cut(texts.mapInPandas(judge, "doc_id bigint, source string, subject_area string, lexicon int, model int, section int"))
    # One row per source and area; joined, not broadcast.
    per = votes.where("model = 1").groupBy("source", "subject_area").agg(F.count(F.lit(1)).alias("n"))
    sizes = one.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    overall = per.groupBy("subject_area").agg(F.sum("n").alias("n_all"))
    total = F.broadcast(one.agg(F.count(F.lit(1)).alias("docs_all")))  # one row
    lift = per.join(sizes, "source").join(overall, "subject_area").crossJoin(total)
    lift = lift.select("source", "subject_area", ((F.col("n") / F.col("docs")) / (F.col("n_all") / F.col("docs_all"))).alias("lift"))
    said = votes.join(lift, ["source", "subject_area"], "left")
    source = F.when(F.col("source").isNull(), 0).when(F.coalesce("lift", F.lit(0.0)) >= LIFT, 1).when(F.coalesce("lift", F.lit(0.0)) < 1 / LIFT, -1).otherwise(0)
    said = cut(said.select("doc_id", "subject_area", "lexicon", "model", "section", source.alias("source")))
    # At most 3 to the power of the functions patterns.
    patterns = {(r.lexicon, r.model, r.section, r.source): r.n for r in said.groupBy(*FUNCTIONS).agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = fit_reliability(patterns) if patterns else {}
    table = spark.createDataFrame([(*k, p) for k, p in learned.items()], "lexicon int, model int, section int, source int, probability double")
    return said.join(F.broadcast(table), list(FUNCTIONS)).select("doc_id", "subject_area", "probability")


def assigned_subjects(documents: DataFrame, areas: DataFrame, ratings: DataFrame | None = None, subjectless: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject_area): the areas more likely than not."""
    return posteriors(documents, areas, ratings, subjectless).where("probability > 0.5").select("doc_id", "subject_area")


def subject_report(documents: DataFrame, areas: DataFrame, ratings: DataFrame, subjectless: DataFrame | None = None) -> DataFrame:
    """(subject_area, documents, share, rated, agreed): the make-up of the corpus by subject, of all documents with a text.

    ``rated``: documents that a rater gave the area, ``agreed`` those of them that were assigned it.
    """
    found = cut(assigned_subjects(documents, areas, ratings, subjectless))
    total = F.broadcast(documents.where("doc_id is not null and trim(text) <> ''").agg(F.count_distinct("doc_id").alias("_all")))  # one row
    hand = ratings.select("doc_id", "subject_area").where("doc_id is not null").distinct()
    checked = hand.join(found.withColumn("hit", F.lit(1)), ["doc_id", "subject_area"], "left").groupBy("subject_area").agg(F.count(F.lit(1)).alias("rated"), F.count("hit").alias("agreed"))
    per = found.groupBy("subject_area").agg(F.count(F.lit(1)).alias("documents")).crossJoin(total).join(checked, "subject_area", "left")
    return per.select("subject_area", "documents", (F.col("documents") / F.col("_all")).alias("share"), F.coalesce("rated", F.lit(0)).alias("rated"), F.coalesce("agreed", F.lit(0)).alias("agreed"))
