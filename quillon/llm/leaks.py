"""Evaluation texts leaking into training text (problem 7).

Greedy string tiling, seeded by a join. Texts of one make share most of their words, so only what few
held-out descriptions hold tells that a document comes from one of them: a rare word (a name, a code),
or a run of as many words as make a leak. Seeds are the windows of WINDOW words with a rare word, and
such runs, each made longer until few descriptions hold it. Documents and descriptions are brought to one normal form and joined on the rolling (Karp-Rabin) hashes of their
seeds. Only joined pairs are tiled: the longest common runs that don't overlap are marked first, runs
that follow each other in both texts make a passage, whose altered words count against it. A document
holds a held-out text if its passages with a seed cover enough words of it, in whatever order. As only
these count, the join loses nothing.

A fixed bitmap of the seeds' hashes, whatever their number, keeps most windows of the documents from
leaving their task; what it lets through by chance is sorted out by the join.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.joins import bounded_join
from quillon.session import cut, spread

#: Words in a Karp-Rabin window, the least length of a tile.
WINDOW = 3
#: Words without a match between two tiles of a passage.
GAP = 4
#: Least score of a passage (matched words less altered ones), and of a document for a held-out text ("some fifteen words").
PASSAGE, LEAK = 4, 13
#: Share of a short held-out text that a document must hold.
SHORT_SHARE = 0.8
#: A word is rare if at most this share of the distinct descriptions has it, or at most LEAST of them; a seed shorter than its description is held by no more than MOST.
RARE_SHARE, LEAST, MOST = 0.03, 4, 30
#: Bits of the bitmap.
BITS = 1 << 25
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"<[^<>]{1,60}>|\[\d\d:\d\d(?::\d\d)?\]")
_DESCRIPTION = re.compile(r"(?is)^(.*?)(?:\bquestion\s*:|$)")


def words_of(text: str) -> list[str]:
    """Lower-case words without tags and times of day, in compatibility form."""
    plain = unicodedata.normalize("NFKC", text).replace("\u00ad", "").replace("\u200b", "")
    return _WORD.findall(_MARKS.sub(" ", plain).lower())


def hash_of(word: str) -> int:
    """A hash of a word that is the same in every process."""
    h = 0
    for b in word.encode():
        h = (h * 257 + b + 1) % _MOD
    return h


class Hasher:
    """Rolling hashes of windows, with the hashes of common words kept."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def codes_of(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            c = self.codes.get(w)
            if c is None:
                c = hash_of(w)
                if len(self.codes) < 200_000 and len(w) < 40:
                    self.codes[w] = c
            out.append(c)
        return out

    def windows(self, codes: list[int], size: int = WINDOW) -> list[int]:
        """The hashes of all windows of ``size`` words; different sizes have different hashes."""
        if len(codes) < size:
            return []
        top = pow(_BASE, size - 1, _MOD)
        h = 0
        for c in codes[:size]:
            h = (h * _BASE + c) % _MOD
        out = [h ^ size]
        for old, new in zip(codes, codes[size:]):
            h = ((h - old * top) * _BASE + new) % _MOD
            out.append(h ^ size)
        return out


def tiles(a: list[str], b: list[str], at_a: dict[int, list[int]], hash_b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of the greedy tiling of a and b, longest first.

    ``at_a`` has the places of a's windows. Runs are kept whole as long as nothing of them is
    marked; a run that lost words to a longer tile comes back with what is left of it.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    open_at: dict[int, int] = {}
    for j, h in enumerate(hash_b):
        now: dict[int, int] = {}
        for i in at_a.get(h, ()):
            if a[i : i + WINDOW] == b[j : j + WINDOW]:
                now[i - j] = open_at.get(i - j, j)
        for d, start in open_at.items():
            if d not in now:
                runs.setdefault(d, []).append((start, j - 1 + WINDOW))
        open_at = now
    for d, start in open_at.items():
        runs.setdefault(d, []).append((start, len(hash_b) - 1 + WINDOW))
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for d, parts in runs.items():
        for s, e in parts:
            by_size.setdefault(e - s, []).append((d, s, e))
    used_a, used_b, out = [False] * len(a), set(), []
    for size in range(max(by_size, default=0), WINDOW - 1, -1):
        for d, s, e in sorted(by_size.get(size, ()), key=lambda x: (x[1], x[0])):
            free = [not used_a[k + d] and k not in used_b for k in range(s, e)]
            if all(free):
                out.append((s + d, s, size))
                for k in range(s, e):
                    used_a[k + d] = True
                    used_b.add(k)
                continue
            k = s
            while k < e:
                n = k
                while n < e and free[n - s]:
                    n += 1
                if n - k >= WINDOW:
                    by_size.setdefault(n - k, []).append((d, k, n))
                k = max(n, k + 1)
    return out


def needed(words: int) -> int:
    """The score from which a held-out text of so many words is found; short ones must be there almost whole."""
    return min(LEAK, max(PASSAGE, math.ceil(SHORT_SHARE * words)))


def score(a: list[str], b: list[str], at_a: dict[int, list[int]], hash_b: list[int], seeds: list[tuple[int, int]]) -> int:
    """The matched words less altered ones of all passages of b that come from a and hold one of the ``seeds`` (start, end) of a."""
    total = 0
    passage: list[tuple[int, int, int]] = []

    def close(parts: list[tuple[int, int, int]]) -> int:
        matched, altered, special = 0, 0, False
        for k, (i, j, n) in enumerate(parts):
            matched += n
            special = special or any(i <= s and e <= i + n for s, e in seeds)
            if k:
                pi, pj, pn = parts[k - 1]
                left, right = a[pi + pn : i], b[pj + pn : j]
                same = sum(x == y or len(x) > 3 and SequenceMatcher(None, x, y).ratio() >= 0.75 for x, y in zip(left, right))
                matched += same
                altered += max(len(left), len(right)) - same
        return matched - altered if special and matched - altered >= PASSAGE else 0

    for tile in sorted(tiles(a, b, at_a, hash_b), key=lambda t: t[1]):
        if passage:
            i, j, n = passage[-1]
            if not (0 <= tile[0] - i - n <= GAP and 0 <= tile[1] - j - n <= GAP):
                total += close(passage)
                passage = []
        passage.append(tile)
    return total + (close(passage) if passage else 0)


def descriptions(items: DataFrame) -> DataFrame:
    """(description, words, items, rare): each distinct description, the words before the question, its item_ids and rare words."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch.item_id, "words": [words_of(_DESCRIPTION.match(t).group(1)) for t in batch.text]})

    one = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text"))
    each = one.mapInPandas(split, "item_id bigint, words array<string>").where("size(words) > 0")
    rows = cut(each.groupBy("words").agg(F.sort_array(F.collect_list("item_id")).alias("items")).select(F.col("items")[0].alias("description"), "words", "items"))
    own = rows.select("description", F.explode(F.array_distinct("words")).alias("word"))
    limit = F.broadcast(rows.agg(F.greatest(F.lit(LEAST), F.ceil(F.count(F.lit(1)) * RARE_SHARE)).alias("limit")))  # one row
    rare = own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).crossJoin(limit).where("n <= limit").select("word")
    mine = own.join(rare, "word").groupBy("description").agg(F.collect_list("word").alias("rare"))
    return rows.join(mine, "description", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


def seeds_of(asked: DataFrame) -> DataFrame:
    """(description, at, size, hash): the windows with a rare word and the runs of each description that few of all hold.

    Those that more hold are made longer, word by word on either side, until few hold them or they are the whole description; so a
    description made of phrases that many others share is known by what only few have together.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for d, words, rare in zip(batch.description, batch.words, batch.rare):
                words, rare = list(words), set(rare)
                codes = hasher.codes_of(words)
                out += [(d, at, WINDOW, h) for at, h in enumerate(hasher.windows(codes)) if not rare.isdisjoint(words[at : at + WINDOW])]
                size = needed(len(words))
                out += [(d, at, size, h) for at, h in enumerate(hasher.windows(codes, size))]
            yield pd.DataFrame(out, columns=["description", "at", "size", "hash"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            yield batch.drop(columns="words").assign(hash=[hasher.windows(hasher.codes_of(list(w)), len(w))[0] for w in batch.words])

    most, texts = few(asked), asked.select("description", "words")
    every = cut(asked.select("description", "words", "rare").mapInPandas(windows, "description bigint, at int, size int, hash bigint"))
    seeds = None
    while True:
        held = every.select("description", "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        counted = cut(every.join(held, "hash").join(texts.select("description", F.size("words").alias("words")), "description"))
        is_seed = (F.col("n") <= most) | (F.col("size") == F.col("words"))
        kept = counted.where(is_seed).select("description", "at", "size", "hash")
        seeds = kept if seeds is None else seeds.unionByName(kept)
        common = counted.where(~is_seed)
        if common.isEmpty():
            return seeds
        # A word more on either side, within the description.
        longer = common.select("description", F.explode(F.array(F.col("at"), F.col("at") - 1)).alias("at"), (F.col("size") + 1).alias("size"), "words").where("at >= 0 and at + size <= words").drop("words").distinct()
        runs = longer.join(texts, "description").withColumn("words", F.slice("words", F.col("at") + 1, F.col("size")))
        every = cut(runs.select("description", "at", "size", "words").mapInPandas(hashed, "description bigint, at int, size int, hash bigint"))


def few(asked: DataFrame) -> int:
    """How many descriptions are few: a share of all distinct ones, within LEAST and MOST."""
    return max(LEAST, min(MOST, math.ceil(asked.count() * RARE_SHARE)))


def bitmap(seeds: DataFrame) -> bytes:
    """BITS bits, those of the seeds' hashes set; made in four tasks, so at most four bitmaps reach the driver."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[batch.hash.to_numpy() % BITS] = True
        yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(BITS // 8, np.uint8)
    for r in seeds.select("hash").coalesce(4).mapInPandas(mark, "bits binary").collect():
        out |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def touched(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, doc_id, text, hashes): the documents with windows that the bitmap has; one pass over the corpus."""
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most LEAK of them, and those of longer seeds
    held = documents.sparkSession.sparkContext.broadcast(bitmap(seeds))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, hasher = held.value, Hasher()
        for batch in batches:
            out = []
            for d, t in zip(batch.doc_id, batch.text):
                codes = hasher.codes_of(words_of(t))
                got = {h for size in sizes for h in hasher.windows(codes, size) if bits[(h % BITS) >> 3] >> (h & 7) & 1}
                if got:
                    out.append((d, t, sorted(got)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "hashes"])

    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    found = texts.mapInPandas(search, "doc_id bigint, text string, hashes array<bigint>")
    return cut(found.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", "hashes"))


def leaked_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score) of every document that holds a held-out text or enough words of it.

    Null and empty texts match nothing; repeated doc_ids are judged together; a held-out text
    shorter than the needed number of words must be there almost whole. Equal descriptions are
    judged once and found for all their items.
    """
    asked = cut(descriptions(items))
    seeds = cut(seeds_of(asked))
    hit = touched(documents, seeds)
    pairs = bounded_join(hit.select("key", F.explode("hashes").alias("hash")), seeds.select("hash", "description").distinct(), ["hash"]).select("key", "description").distinct()
    own = seeds.groupBy("description").agg(F.collect_list(F.struct("at", "size")).alias("seeds"))  # of one held-out text
    texts = asked.select("description", "words").join(own, "description")
    rows = bounded_join(pairs.join(hit.select("key", "doc_id", "text"), "key"), texts, ["description"], most=20_000)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, last, words, hashes = Hasher(), None, [], []
        for batch in batches:
            out = []
            for d, t, desc, own, marks in zip(batch.doc_id, batch.text, batch.description, batch.words, batch.seeds):
                if t != last:  # pairs of one document come together
                    last, words = t, words_of(t)
                    hashes = hasher.windows(hasher.codes_of(words))
                own = list(own)
                places: dict[int, list[int]] = {}
                for i, h in enumerate(hasher.windows(hasher.codes_of(own))):
                    places.setdefault(h, []).append(i)
                n = score(own, words, places, hashes, [(m["at"], m["at"] + m["size"]) for m in marks])
                if n >= needed(len(own)):
                    out.append((d, desc, n))
            yield pd.DataFrame(out, columns=["doc_id", "description", "score"])

    found = rows.select("doc_id", "text", "description", "words", "seeds").mapInPandas(judge, "doc_id bigint, description bigint, score bigint")
    best = found.groupBy("doc_id", "description").agg(F.max("score").alias("score"))
    return best.join(asked.select("description", F.explode("items").alias("item_id")), "description").select("doc_id", "item_id", "score")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents): the held-out texts found, with the number of documents that hold each."""
    return leaked_documents(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
