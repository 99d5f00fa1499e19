"""Answers of models and people as column expressions: normal forms and parsers."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in a form that Java and RE2 both read.
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# What answers begin with, in the order in which it is taken off.
PREFIXES = ["answer:", "the answer is", "it is", "it's", "there are", "there is"]
# Words for yes and no.
YES_WORDS, NO_WORDS = ["yes", "true", "correct"], ["no", "false", "incorrect"]
YES_STARTS, NO_STARTS = ["yes", "correct", "indeed", "true", "that is true"], ["no", "incorrect", "false", "that is false"]
# Prepositions and their patterns, first match wins.
PREPOSITIONS = [
    ("in_front_of", r"(?i)\b(in front of|in-front-of|front of|front)\b"),
    ("left_of", r"(?i)\b(left of|to the left of|left)\b"),
    ("right_of", r"(?i)\b(right of|to the right of|right)\b"),
    ("under", r"(?i)\b(under|below|beneath)\b"),
    ("behind", r"(?i)\b(behind|back of)\b"),
    ("on", r"(?i)\b(on top of|on)\b"),
]
# Words for directions.
DIRECTIONS = {
    "left": ["left"], "right": ["right"], "above": ["above", "over", "higher"], "below": ["below", "under", "lower"], "front": ["front"],
    "behind": ["behind", "back"], "closer": ["closer", "nearest", "nearer"], "farther": ["farther", "further", "distant"],
}
# Kinds of questions and answers by the words they contain, first match wins.
QUESTION_KINDS = [
    ("DistanceSpatial", ["how far", "distance", "away", "closer", "closest", "nearer", "nearest"]),
    ("SizeSpatial", ["height", "width", "tall", "wide", "large", "larger", "small", "smaller", "size", "bigger", "biggest"]),
    ("RelativePosition", ["left", "right", "above", "below", "under", "over", "front", "behind", "back", "between"]),
    ("ObjectSelection", ["which", "what object", "what is", "identify"]),
]
ANSWER_DIRECTIONS = ["left", "right", "above", "below", "under", "over", "front", "behind"]
# Actions by the words they contain, first match wins.
ACTIONS = [("keep straight", ["straight", "forward"]), ("turn left", ["left"]), ("turn right", ["right"])]
COMPASS = ["north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest"]
EGOCENTRIC = ["front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left"]
NUMBER = r"[-+]?\d*\.?\d+"
# How a reply names a letter, first match wins; role marks before a reply; first words of yes/no questions; units and their metres.
LETTERS = [r"^\s*\(?([A-D])\)?(?:[.):\s]|$)", r"\bOPTION\s+([A-D])\b", r"\bANSWER\s+(?:IS\s+)?([A-D])\b", r"\bTHE\s+ANSWER\s+IS\s+([A-D])\b", r"\bCHOICE\s+([A-D])\b"]
ROLES = ["ASSISTANT:", "Assistant:", "assistant:", "[INST]", "</s>", "<s>"]
ASKS_YES_NO = r"^(is|are|do|does|did|can|could|would|will|has|have)\b"
UNITS = [(["centimeter", "centimetre", " cm"], 0.01), (["millimeter", "millimetre", " mm"], 0.001), (["feet", "foot", " ft"], 0.3048), (["inch", " in"], 0.0254)]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def any_of(test, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [test(w) for w in words])


def normalize_answer(text: Column) -> Column:
    """Lower case without lead-ins, sentence marks and blanks around commas; '' for null."""
    out = F.lower(strip(F.coalesce(text, F.lit(""))))
    for p in PREFIXES:
        out = F.regexp_replace(out, f"^{p}{WS}*", "")
    out = squeeze(F.translate(out, "\n\t.!?;", "      "))
    return F.regexp_replace(out, " *, *", ",")


def yes_no(text: Column) -> Column:
    """struct(value, method): by the first word, else by the only kind of keyword; value is null if unparsed."""
    low = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"""^[`'"\s({\[]+""", "")
    first = F.regexp_extract(low, r"^([a-z]*)", 1)
    found = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"\b(yes|no|true|false|correct|incorrect)\b"), F.lit(1)), lambda w: F.when(w.isin(*YES_WORDS), "yes").otherwise("no")))
    by_first = F.when(first.isin(*YES_WORDS), "yes").when(first.isin(*NO_WORDS), "no")
    value = F.coalesce(by_first, F.when(F.size(found) == 1, found[0]))
    method = F.when(by_first.isNotNull(), "first_token").when(F.size(found) == 1, "single_keyword").otherwise("unparsed")
    return F.struct(value.alias("value"), method.alias("method"))


def caption(text: Column) -> Column:
    """Lower case letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]+", " "), r" +", " "))


def letter(text: Column, options: Column) -> Column:
    """struct(value, method): the letter a reply names, else that of the first option it contains."""
    up = F.upper(strip(F.coalesce(text, F.lit(""))))
    named = F.coalesce(*[F.nullif(F.regexp_extract(up, t, 1), F.lit("")) for t in LETTERS])
    said = caption(F.coalesce(text, F.lit("")))
    hit = F.array_min(F.filter(F.transform(options, lambda o, i: F.when(F.contains(said, caption(o)), i)), lambda i: i.isNotNull()))
    by_text = F.char(F.lit(65) + hit)
    return F.struct(F.coalesce(named, by_text).alias("value"), F.when(named.isNotNull(), "letter").when(by_text.isNotNull(), "caption_match").otherwise("unparsed").alias("method"))


_NUM = r"(-?\d+(?:\.\d+)?)"
_PAIR = rf"[(\[]\s*{_NUM}\s*,\s*{_NUM}\s*[)\]]"
_BARE_PAIR = _PAIR.replace("(-?", "(?:-?")
_LITERAL = rf"^\s*(?:{_BARE_PAIR}|\[\s*(?:{_BARE_PAIR}\s*(?:,\s*{_BARE_PAIR}\s*)*,?)?\s*\])\s*$"


def points(text: Column, most: int = 10) -> Column:
    """struct(points, method): points 0..1 of a reply; values up to 100 are percentages.

    The reply is a list of pairs or a pair (literal), or has pairs in brackets (regex_pairs), or else
    its numbers are taken two by two (loose_numbers).
    """
    xs, ys = (F.regexp_extract_all(text, F.lit(_PAIR), F.lit(k)) for k in (1, 2))

    def scaled(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        top = F.greatest(F.abs(x), F.abs(y))
        f = F.when((top > 1) & (top <= 100), 100.0).otherwise(1.0)
        return F.struct((x / f).alias("x"), (y / f).alias("y"))

    def kept(a: Column) -> Column:
        return F.filter(a, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))

    pairs = F.slice(kept(F.zip_with(xs, ys, scaled)), 1, most)
    loose = F.regexp_extract_all(text, F.lit(_NUM), F.lit(1))
    twos = F.when(F.size(loose) >= 2, F.transform(F.sequence(F.lit(0), F.least(F.floor(F.size(loose) / 2) - 1, F.lit(most - 1)).cast("int")), lambda i: scaled(F.get(loose, 2 * i), F.get(loose, 2 * i + 1))))
    loose_points = kept(F.coalesce(twos, F.array().cast("array<struct<x:double,y:double>>")))
    found = F.when(F.size(pairs) > 0, pairs).otherwise(loose_points)
    method = F.when((F.size(pairs) > 0) & text.rlike(_LITERAL), "literal").when(F.size(pairs) > 0, "regex_pairs").when(F.size(loose_points) > 0, "loose_numbers").otherwise("unparsed")
    return F.struct(found.alias("points"), method.alias("method"))


def preposition(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), n) for n, p in PREPOSITIONS], F.lit("unknown"))


def preposition_pair(name: Column) -> Column:
    return F.when(name.isin("left_of", "right_of"), "left_right").when(name.isin("on", "under"), "on_under").when(name.isin("in_front_of", "behind"), "front_behind")


def polarity(text: Column) -> Column:
    return let(normalize_answer(text), _polarity)


def _polarity(n: Column) -> Column:
    return F.when(any_of(n.startswith, YES_STARTS), "yes").when(any_of(n.startswith, NO_STARTS), "no")


def metres(text: Column) -> Column:
    """The first number of a text in metres by the unit right after it; metres without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.struct(F.regexp_extract(low, f"({NUMBER})", 1).try_cast("double").alias("v"), F.regexp_extract(low, f"{NUMBER}(?s:(.{{0,24}}))", 1).alias("after"))

    def scaled(p: Column) -> Column:
        has = lambda *units: any_of(lambda u: F.contains(p["after"], F.lit(u)), list(units))
        v = p["v"]
        return F.coalesce(*[F.when(has(*names), v * f) for names, f in UNITS], v)

    return let(parts, scaled)


def direction_set(text: Column) -> Column:
    """The directions a text names, sorted."""
    return let(normalize_answer(text), _directions)


def _directions(n: Column) -> Column:
    return F.array_compact(F.array(*[F.when(n.rlike(r"\b(" + "|".join(w) + r")\b"), k) for k, w in sorted(DIRECTIONS.items())]))


def relaxed_correct(gold: Column, said: Column) -> Column:
    """1 or 0: by equal normal forms, else by polarity, measurement or directions, whichever both have first."""
    names = F.struct(normalize_answer(gold).alias("g"), normalize_answer(said).alias("s"))
    read = lambda n: F.struct(
        (n["g"] == n["s"]).alias("same"), _polarity(n["g"]).alias("gp"), _polarity(n["s"]).alias("sp"), metres(gold).alias("gm"), metres(said).alias("sm"), _directions(n["g"]).alias("gd"), _directions(n["s"]).alias("sd")
    )

    def decide(r: Column) -> Column:
        return (
            F.when(r["same"], 1)
            .when(r["gp"].isNotNull() & r["sp"].isNotNull(), (r["gp"] == r["sp"]).cast("int"))
            .when(r["gm"].isNotNull() & r["sm"].isNotNull(), (F.abs(r["gm"] - r["sm"]) <= F.greatest(F.lit(0.05), F.abs(r["gm"]) * 0.15)).cast("int"))
            .when((F.size(r["gd"]) > 0) & (F.size(r["sd"]) > 0), (r["gd"] == r["sd"]).cast("int"))
            .otherwise(0)
        )

    return let(names, lambda n: let(read(n), decide))


def question_kind(question: Column, answer: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    yes_no_question = q.rlike(ASKS_YES_NO) | F.lower(strip(F.coalesce(answer, F.lit("")))).isin("yes", "no")
    return F.coalesce(F.when(yes_no_question, "YesNoSpatial"), *[F.when(any_of(lambda w: F.contains(q, F.lit(w)), words), kind) for kind, words in QUESTION_KINDS], F.lit("GeneralSpatial"))


def answer_kind(answer: Column) -> Column:
    n = F.regexp_replace(F.lower(strip(F.coalesce(answer, F.lit("")))), r"[.!?]+$", "")
    words = F.size(F.filter(F.split(squeeze(n), " "), lambda w: w != ""))
    return F.when(n.isin("yes", "no"), "yes_no").when(n.rlike(NUMBER), "numeric").when(any_of(lambda w: F.contains(n, F.lit(w)), ANSWER_DIRECTIONS), "directional").when(words <= 4, "short_phrase").otherwise("long_phrase")


def clean_reply(text: Column) -> Column:
    """A chat reply without role marks and quotes, in lower case with single blanks."""
    out = strip(F.coalesce(text, F.lit("")))
    for p in ROLES:
        out = F.regexp_replace(out, f"^{re.escape(p)}{WS}*", "")
    out = F.regexp_replace(strip(F.substring_index(out, "</s>", 1)), "^[\"'`]+|[\"'`]+$", "")
    return squeeze(F.lower(out))


def reply_int(text: Column) -> Column:
    return F.regexp_extract(clean_reply(text), r"(-?\d+)", 1).try_cast("bigint")


def reply_ids(text: Column) -> Column:
    n = clean_reply(text)
    ids = F.transform(F.regexp_extract_all(n, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.when(n.isin("", "none", "no", "n/a"), F.array().cast("array<bigint>")).otherwise(ids)


def reply_yes_no(text: Column) -> Column:
    n = F.regexp_replace(clean_reply(text), r"\.+$", "")
    word = F.regexp_extract(n, r"\b(yes|no|true|false)\b", 1)
    return F.when(n.isin("yes", "true", "y"), "yes").when(n.isin("no", "false", "n"), "no").when(word.isin("yes", "true"), "yes").when(word.isin("no", "false"), "no")


def reply_action(text: Column) -> Column:
    n = F.translate(clean_reply(text), "_", " ")
    return F.coalesce(*[F.when(any_of(lambda w: F.contains(n, F.lit(w)), words), a) for a, words in ACTIONS])


def reply_turn(text: Column) -> Column:
    n = F.translate(clean_reply(text), "_", " ")
    return F.coalesce(reply_action(text), F.when(F.contains(n, F.lit("facing")), "already facing"))


def reply_compass(text: Column) -> Column:
    n = F.regexp_replace(clean_reply(text), "[- ]", "")
    return F.when(n.isin(*COMPASS), F.initcap(n))


def reply_egocentric(text: Column) -> Column:
    n = F.translate(clean_reply(text), " ", "-")
    return F.when(n.isin(*EGOCENTRIC), n)


def exact_match(said: Column, gold: Column) -> Column:
    """1.0 if the answer in JSON, in a code fence or in plain text equals the gold one, case apart."""
    return (F.lower(final_answer(said)) == F.lower(final_answer(gold))).cast("double")


def contains_match(said: Column, gold: Column) -> Column:
    return F.contains(F.lower(final_answer(said)), F.lower(final_answer(gold))).cast("double")


def final_answer(text: Column) -> Column:
    """The ``answer`` or ``final_answer`` of a JSON reply, else the text in a code fence, else the stripped text."""
    v = F.try_parse_json(text)
    field = F.coalesce(F.try_variant_get(v, "$.answer", "string"), F.try_variant_get(v, "$.final_answer", "string"))
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(.*?)```", 1), F.lit(""))
    return strip(F.coalesce(field, fence, text))


def stable_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
