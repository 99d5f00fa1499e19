"""The same or nearly the same records across splits (problem 5).

A record is a picture and a question about it, brought to one normal sequence: the means of the cells of
a small grid less the mean of all, in coarse steps, then the kind of question and its numbers. Pictures
are cut into chunks where a rolling hash of their values says so; digests of equal chunks are joined
across the splits and the lengths of the shared ones are summed into an overlap fraction, from which a
pair is a candidate. As re-encoding moves single values over the border of a step, the normal form is
taken with several offsets and cuts. Candidates are then compared pixel by pixel. Pictures of digests too
common for a join are compared in blocks at some of their pixels first.

Two questions are the same if they have the same numbers and are of one kind: the question_type of
their rows, or where that is null the type that most rows with the same wording have, or else the wording.

Everything is worked out once per distinct picture and per class of records (picture, kind, numbers).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.llm.spelling import plain_key, plain_split
from quillon.operators.joins import bounded_join
from quillon.session import cut, spread

GRID = 5
#: Grey values in a step of a cell, and in one of the further digests of pictures whose coarse ones are too common.
STEP, FINE = 24, 12
#: Offsets of a step, for either.
OFFSETS = {STEP: 3, FINE: 6}
SEEDS = (1, 2)
#: The mean of a picture is told in steps of so many grey values, in each view with the offset of its cells, so that means near each other share it in most views.
MEAN_STEP = 48
#: A chunk has at least so many cells; after that one cell in ``CUT`` ends it.
SHORTEST, CUT = 7, 4
#: Pairs of pictures that a digest may link in a join; the pairs of more common ones are compared in blocks.
COMMON = 100_000
#: Pictures of either side in a block, and pixels compared there.
BLOCK, PROBES = 4_000, 64
#: Greatest difference of a pixel (0 to 255) between two encodings of one picture.
PIXEL_DIFFERENCE = 16


def grey_map(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """(width, height, values 0..255) of a binary grey map."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m:
        return None
    w, h, top = map(int, m.groups())
    body = np.frombuffer(data[m.end() :], dtype=np.uint8)
    if not w or not h or not 0 < top < 256 or len(body) < w * h:
        return None
    return w, h, body[: w * h].astype(np.float32) * (255.0 / top)


def png(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """(width, height, mean of the colours 0..255) of a PNG with 8 bits a channel, without palette and interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}
    if head is None or head[2] != 8 or head[3] not in channels or head[6] or not head[0] or not head[1]:
        return None
    w, h, c = head[0], head[1], channels[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error:
        return None
    if len(raw) != h * (w * c + 1):
        return None
    rows, before = np.zeros((h, w * c), np.int64), np.zeros(w * c, np.int64)
    for y, line in enumerate(raw.reshape(h, w * c + 1).astype(np.int64)):
        kind, now = int(line[0]), line[1:].copy()
        if kind == 2:
            now = (now + before) & 255
        elif kind in (1, 3, 4):
            for x in range(w * c):
                left, up, corner = (now[x - c] if x >= c else 0), before[x], (before[x - c] if x >= c else 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                now[x] = (now[x] + guess) & 255
        elif kind:
            return None
        rows[y] = before = now
    colours = rows.reshape(h * w, c)[:, : 1 if c < 3 else 3]
    return w, h, colours.mean(axis=1).astype(np.float32)


def pixels(data: bytes | None) -> tuple[int, int, np.ndarray] | None:
    """(width, height, grey values 0..255) of a grey map or PNG, None for anything else."""
    return (grey_map(data) or png(data)) if data else None


def normal_forms(w: int, h: int, values: np.ndarray, step: int = STEP) -> np.ndarray:
    """One row of cells per offset: means of a GRID x GRID division less the mean of all, in steps."""
    image = values.reshape(h, w)
    rows = np.minimum(np.arange(h) * GRID // h, GRID - 1)
    cols = np.minimum(np.arange(w) * GRID // w, GRID - 1)
    cell = rows[:, None] * GRID + cols[None, :]
    n = np.bincount(cell.ravel(), minlength=GRID * GRID)
    means = np.bincount(cell.ravel(), weights=image.ravel(), minlength=GRID * GRID) / np.maximum(n, 1) - image.mean()
    return np.floor(means[None, :] / step + (np.arange(OFFSETS[step]) / OFFSETS[step])[:, None]).astype(np.int64)


def chunks(cells: list[int], seed: int) -> Iterator[tuple[int, ...]]:
    """The content-defined chunks with at least SHORTEST cells."""
    start, last = 0, 0
    for i, c in enumerate(cells):
        h = ((c + 64) * 2654435761 + last * 40503 + seed * 97) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 2246822519 & 0xFFFFFFFF
        h ^= h >> 13
        last = c + 64
        if i - start + 1 >= SHORTEST and (h % CUT == 0 or i == len(cells) - 1):
            yield tuple(cells[start : i + 1])
            start = i + 1


def picture_chunks(batches: Iterator[pd.DataFrame], step: int = STEP) -> Iterator[pd.DataFrame]:
    """(pic, bytes, in_train, in_other) to (pic, digest, cells, in_train, in_other), a row per chunk.

    A digest is of the picture's size, its mean, the view and the chunk's values, not of the place.
    """
    for batch in batches:
        out = []
        for pic, data, train, other in zip(batch.pic, batch.bytes, batch.in_train, batch.in_other):
            got = pixels(data)
            if got is None:
                continue
            mean = float(got[2].mean()) / MEAN_STEP
            for o, row in enumerate(normal_forms(*got, step).tolist()):
                m = int(mean + o / OFFSETS[step])
                # Hashes of whole numbers are the same in every Python process.
                out += [(pic, hash((step, *got[:2], o, s, m, v)), len(v), train, other) for s in SEEDS for v in chunks(row, s)]
        yield pd.DataFrame(out, columns=["pic", "digest", "cells", "in_train", "in_other"])


@F.pandas_udf(DoubleType())
def pixel_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greatest difference of a pixel, null if the sizes differ."""

    def one(x: bytes, y: bytes) -> float | None:
        p, q = pixels(x), pixels(y)
        if p is None or q is None or p[:2] != q[:2]:
            return None
        return float(np.abs(p[2] - q[2]).max())

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def digests_of(pictures: DataFrame, step: int) -> DataFrame:
    """(pic, digest, cells, in_train, in_other) of the digests that occur on both sides, with the number of pairs they link."""
    work = lambda batches: picture_chunks(batches, step)
    rows = pictures.select("pic", "bytes", "in_train", "in_other").mapInPandas(work, "pic binary, digest bigint, cells int, in_train boolean, in_other boolean")
    rows = cut(rows)
    sides = rows.groupBy("digest").agg(F.sum(F.col("in_train").cast("bigint")).alias("a"), F.sum(F.col("in_other").cast("bigint")).alias("b")).where("a > 0 and b > 0")
    return cut(rows.join(sides.select("digest", (F.col("a") * F.col("b")).alias("pairs")), "digest"))


def overlaps_of(digests: DataFrame, step: int) -> DataFrame:
    """(pic_a, pic_b, overlap): pictures of both sides with the share of their cells, over all views, in shared chunks.

    A pair shares a chunk of one view at least; a chunk that comes twice in a view counts twice, so more than all is all.
    """
    left = digests.where("in_train").select(F.col("pic").alias("pic_a"), "digest", "cells")
    right = digests.where("in_other").select(F.col("pic").alias("pic_b"), "digest")
    share = F.least(F.lit(1.0), F.sum("cells") / (GRID * GRID * OFFSETS[step] * len(SEEDS)))
    return left.join(right, "digest").where("pic_a <> pic_b").groupBy("pic_a", "pic_b").agg(share.alias("overlap"))


def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pic, bytes) to (pic, w, h, probes): up to PROBES pixels spread over the picture, as packed floats."""
    for batch in batches:
        out = []
        for pic, data in zip(batch.pic, batch.bytes):
            got = pixels(data)
            if got is not None:
                at = np.linspace(0, len(got[2]) - 1, min(PROBES, len(got[2]))).astype(int)
                out.append((pic, got[0], got[1], got[2][at].astype("<f4").tobytes()))
        yield pd.DataFrame(out, columns=["pic", "w", "h", "probes"])


def near_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """(pic_a, pic_b) of a block (left, pic, probes) whose probes all differ by at most PIXEL_DIFFERENCE; every pair is compared."""
    a, b = block[block.left], block[~block.left]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(a) and len(b):
        x, y = (np.frombuffer(b"".join(side.probes), "<f4").reshape(len(side), -1) for side in (a, b))
        order = np.argsort(-np.vstack([x, y]).var(axis=0))  # what tells most apart comes first
        x, y = np.ascontiguousarray(x[:, order].T), np.ascontiguousarray(y[:, order].T)
        for at in range(0, len(a), 256):
            i, j = np.nonzero(np.abs(x[0, at : at + 256, None] - y[0][None, :]) <= PIXEL_DIFFERENCE)
            i += at
            for p, q in zip(x[1:], y[1:]):
                if not len(i):
                    break
                kept = np.abs(p[i] - q[j]) <= PIXEL_DIFFERENCE
                i, j = i[kept], j[kept]
            found.append((i, j))
    one, two = (np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))
    return pd.DataFrame({"pic_a": a.pic.to_numpy(object)[one], "pic_b": b.pic.to_numpy(object)[two]})


def compared(digests: DataFrame, pictures: DataFrame) -> DataFrame:
    """(pic_a, pic_b): all pictures of both sides that share one of ``digests`` and are near each other at their probes.

    The pictures of a digest are cut into blocks of about BLOCK of either side, each of them compared with each of the other side, so
    that no task holds a digest as a whole.
    """
    rows = cut(digests.select("digest", "pic", "in_train", "in_other").distinct())
    n = lambda c: F.ceil(F.sum(F.col(c).cast("bigint")) / BLOCK).cast("bigint")
    blocks = rows.groupBy("digest").agg(n("in_train").alias("blocks_a"), n("in_other").alias("blocks_b"))
    told = spread(pictures.join(rows.select("pic").distinct(), "pic").select("pic", "bytes"), "pic").mapInPandas(probed, "pic binary, w int, h int, probes binary")
    rows = cut(rows.join(blocks, "digest").join(told, "pic"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("pic"), F.col(c))
    a = rows.where("in_train").select("digest", "w", "h", own("blocks_a").alias("i"), every("blocks_b").alias("j"), F.lit(True).alias("left"), "pic", "probes")
    b = rows.where("in_other").select("digest", "w", "h", every("blocks_a").alias("i"), own("blocks_b").alias("j"), F.lit(False).alias("left"), "pic", "probes")
    return a.unionByName(b).groupBy("digest", "w", "h", "i", "j").applyInPandas(near_in_block, "pic_a binary, pic_b binary").where("pic_a <> pic_b")


def share_of(pairs: DataFrame, digests: DataFrame, step: int) -> DataFrame:
    """``pairs`` (pic_a, pic_b, overlap), overlap at least as in ``overlaps_of`` with all of ``digests``."""
    per = digests.groupBy("pic").agg(F.collect_list(F.struct("digest", "cells")).alias("d"))  # a few dozen of a picture
    both = pairs.join(per.select(F.col("pic").alias("pic_a"), F.col("d").alias("d_a")), "pic_a", "left").join(per.select(F.col("pic").alias("pic_b"), F.col("d").alias("d_b")), "pic_b", "left")
    cells = F.aggregate("d_a", F.lit(0).cast("bigint"), lambda n, x: n + x["cells"] * F.size(F.filter("d_b", lambda y: y["digest"] == x["digest"])))
    share = F.least(F.lit(1.0), cells / (GRID * GRID * OFFSETS[step] * len(SEEDS)))
    return both.select("pic_a", "pic_b", F.greatest("overlap", F.coalesce(share, F.lit(0.0))).alias("overlap"))


def picture_links(pictures: DataFrame, *, common: int = COMMON) -> DataFrame:
    """(pic_a, pic_b, overlap): linked pictures of ``pictures`` (pic, bytes, in_train, in_other), pic_a in train, pic_b in another split.

    A picture in both is linked to itself. ``overlap`` is the share of cells in shared chunks, over all
    views. The pictures of digests that would link more than ``common`` pairs, as those of nearly flat pictures do, are
    compared at some pixels before they are paired, so none of these pairs is lost; they also have fine digests, and the greater share counts.
    """
    coarse = digests_of(pictures, STEP)
    shared = overlaps_of(coarse.where(F.col("pairs") <= common), STEP)
    crowded = cut(coarse.where(F.col("pairs") > common).select("pic").distinct())
    fine = None
    if not crowded.isEmpty():
        some = pictures.join(crowded, "pic")
        fine = digests_of(some, FINE)
        parts = [shared, *(compared(x.where(F.col("pairs") > common), some) for x in (coarse, fine)), overlaps_of(fine.where(F.col("pairs") <= common), FINE)]
        shared = parts[0].select("pic_a", "pic_b")
        for part in parts[1:]:
            shared = shared.unionByName(part.select("pic_a", "pic_b"))
        shared = shared.distinct().withColumn("overlap", F.lit(0.0))
    a = pictures.select(F.col("pic").alias("pic_a"), F.col("bytes").alias("bytes_a"))
    b = pictures.select(F.col("pic").alias("pic_b"), F.col("bytes").alias("bytes_b"))
    near = shared.join(a, "pic_a").join(b, "pic_b").where(pixel_difference("bytes_a", "bytes_b") <= PIXEL_DIFFERENCE).select("pic_a", "pic_b", "overlap")
    if fine is not None:
        near = share_of(share_of(near, coarse, STEP), fine, FINE)
    same = pictures.where("in_train and in_other").select(F.col("pic").alias("pic_a"), F.col("pic").alias("pic_b"), F.lit(1.0).alias("overlap"))
    return near.unionByName(same)


def picture_key(data: Column) -> Column:
    """The first 128 bits of the SHA-256 of the bytes; null for null and empty."""
    return F.when(F.length(data) > 0, F.unhex(F.substring(F.sha2(data, 256), 1, 32)))


def record_rows(qa: DataFrame) -> DataFrame:
    """(id, now, source_id, pic, kind, numbers): each id once as ingested last, with split, picture key, and kind and numbers of the question.

    Rows with a null split, picture or question, or a question without letters or digits, are left out.
    """
    small = qa.where("id is not null").select("id", "ingested_at", "split", "source_id", "question", plain_key(F.col("question_type")).alias("type"), picture_key(F.col("image.bytes")).alias("pic"))
    last = F.max_by(F.struct("split", "source_id", "question", "type", "pic"), F.struct("ingested_at", "split", "question"))
    rows = small.groupBy("id").agg(last.alias("r")).select("id", plain_split(F.col("r.split")).alias("now"), "r.source_id", "r.pic", "r.question", "r.type")
    words = F.trim(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{Nd}]+", " "))
    rows = rows.withColumn("words", words).where("now is not null and pic is not null and words <> ''")
    rows = rows.withColumn("numbers", F.array_join(F.regexp_extract_all("words", F.lit(r"(\d+)"), F.lit(1)), " ")).withColumn("form", F.xxhash64(F.regexp_replace("words", r"\d+", "0"))).drop("question", "words")
    rows = cut(rows)
    counts = rows.where("type is not null").groupBy("form", "type").agg(F.count(F.lit(1)).alias("n"))
    usual = cut(counts.groupBy("form").agg(F.max_by("type", F.struct("n", "type")).alias("usual")))
    untyped = bounded_join(rows.where("type is null"), usual, ["form"], "left").withColumn("kind", F.coalesce("usual", F.concat(F.lit("form "), F.col("form").cast("string"))))
    cols = ["id", "now", "source_id", "pic", "kind", "numbers"]
    return rows.where("type is not null").withColumn("kind", F.col("type")).select(*cols).unionByName(untyped.select(*cols))


def linked_classes(qa: DataFrame, rows: DataFrame) -> DataFrame:
    """(pic_a, pic_b, kind, numbers, overlap): classes of records of train and of another split that are the same, from ``record_rows``.

    ``overlap`` is that of the records' sequences: the picture's cells and one more for the question.
    """
    train, other = F.bool_or(F.col("now") == "train").alias("in_train"), F.bool_or(F.col("now") != "train").alias("in_other")
    data = qa.select(picture_key(F.col("image.bytes")).alias("pic"), F.col("image.bytes").alias("bytes")).where("pic is not null").groupBy("pic").agg(F.first("bytes").alias("bytes"))
    pictures = spread(cut(rows.groupBy("pic").agg(train, other).join(data, "pic")), "pic")
    links = cut(picture_links(pictures))
    classes = rows.groupBy("pic", "kind", "numbers").agg(train, other)
    a = classes.where("in_train").select(F.col("pic").alias("pic_a"), "kind", "numbers")
    b = classes.where("in_other").select(F.col("pic").alias("pic_b"), "kind", "numbers")
    n = GRID * GRID
    return links.join(a, "pic_a").join(b, ["pic_b", "kind", "numbers"]).withColumn("overlap", (F.col("overlap") * n + 1) / (n + 1))


def overlapping_rows(qa: DataFrame) -> DataFrame:
    """(id_a, id_b, overlap) of all pairs of a train row and a row of another split with the same picture and question.

    Rows with a null split, picture or question are in no pair. Pictures that are neither grey maps nor
    plain PNGs are the same only if their bytes are equal. Bytes are shuffled once per distinct picture;
    ids are joined at the end, so that a picture used by a third of all rows costs no more than one.
    """
    rows = record_rows(qa)
    pairs = cut(linked_classes(qa, rows))
    one = rows.where("now = 'train'").select(F.col("id").alias("id_1"), F.col("pic").alias("pic_a"), "kind", "numbers")
    two = rows.where("now <> 'train'").select(F.col("id").alias("id_2"), F.col("pic").alias("pic_b"), "kind", "numbers")
    found = pairs.join(one, ["pic_a", "kind", "numbers"]).join(two, ["pic_b", "kind", "numbers"])
    return found.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), "overlap")


def overlap_report(qa: DataFrame) -> DataFrame:
    """(split, source_id, pairs): pairs per split, other than train, and source_id as written; counted from the sizes of the classes."""
    rows = record_rows(qa)
    pairs = linked_classes(qa, rows)
    n_train = rows.where("now = 'train'").groupBy(F.col("pic").alias("pic_a"), "kind", "numbers").agg(F.count(F.lit(1)).alias("n_train"))
    n_other = rows.where("now <> 'train'").groupBy(F.col("pic").alias("pic_b"), "kind", "numbers", "now", "source_id").agg(F.count(F.lit(1)).alias("n_other"))
    both = pairs.join(n_train, ["pic_a", "kind", "numbers"]).join(n_other, ["pic_b", "kind", "numbers"])
    return both.groupBy(F.col("now").alias("split"), "source_id").agg(F.sum(F.col("n_train") * F.col("n_other")).alias("pairs"))
