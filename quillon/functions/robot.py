"""Replies of a robot's language model to commands and observations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.geo import modulo

# Speeds, centimetres of a step and degrees of a turn in commands.
DRIVE_SPEED, TURN_SPEED, STEP_CM, TURN_DEG = 10, 10, 5, 15
STOP = "s,0,0"
# Degrees of compass names, clockwise from north.
COMPASS_DEGREES = {"North": 0, "Northeast": 45, "East": 90, "Southeast": 135, "South": 180, "Southwest": 225, "West": 270, "Northwest": 315}


def command(kind: str) -> str:
    return {"f": f"f,{DRIVE_SPEED},{STEP_CM}", "l": f"l,{TURN_SPEED},{TURN_DEG}", "r": f"r,{TURN_SPEED},{TURN_DEG}", "s": STOP}[kind]


def _commands(*kinds: str) -> Column:
    return F.array(*[F.lit(command(k)) for k in kinds])


NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def action_commands(action: Column) -> Column:
    """The commands of keep straight, turn left and turn right; turns go on with a step."""
    return F.when(action == "keep straight", _commands("f")).when(action == "turn left", _commands("l", "f")).when(action == "turn right", _commands("r", "f")).otherwise(none())


def reply_to_commands(reply: Column) -> Column:
    return action_commands(T.reply_action(reply))


def turn_commands(turn: Column) -> Column:
    """The command of a turn; none when already facing or unknown."""
    return F.when(turn == "turn left", _commands("l")).when(turn == "turn right", _commands("r")).otherwise(none())


def side_commands(side: Column) -> Column:
    """The command towards a side seen from the heading; straight back counts as left."""
    return F.when(side == "front", _commands("f")).when(side.isin("front-left", "left", "back-left", "back"), _commands("l")).when(side.isin("front-right", "right", "back-right"), _commands("r")).otherwise(none())


def degrees_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in COMPASS_DEGREES.items() for x in kv]), name)


def compass_commands(heading: Column, target: Column) -> Column:
    """The command that brings a heading to a target direction; half a turn goes right, unknown names give none."""
    turn = modulo(degrees_of(target) - degrees_of(heading), 360)
    return F.when(turn == 0, _commands("f")).when(turn <= 180, _commands("r")).when(turn > 180, _commands("l")).otherwise(none())


# Observations that are yes or no, counts, lists and numbers.
FLAGS = ["ArrivedAtBench", "ArrivedAtAnimalsAroundStopSigns", "waiting_time_exceeded", "all_zoos_visited"]
COUNTS = ["CountPeople", "CountPersonAtClosestBench"]
LISTS = ["ClosestToFurthestBenches", "ClosestToFurthestStopSigns"]
NUMBERS = ["ClosestBench", "ClosestStopSign", "ClosestBenchWithPerson", "CountPeopleAtBench", "CountAnimalsAtStopSign"]


def observation(key: Column, reply: Column) -> Column:
    """struct(flag, number, list, text): a reply as the observation ``key`` has it.

    Counts are flags of whether there are any, with the count as number, and false if unparsed; numbers are -1 then.
    """
    n = F.lower(T.strip(reply))
    number = F.regexp_extract(n, r"(-?\d+)", 1).try_cast("bigint")
    flag = F.when(key.isin(*FLAGS), F.when(n.isin("yes", "true", "1"), True).when(n.isin("no", "false", "0"), False)).when(key.isin(*COUNTS), F.coalesce(number > 0, F.lit(False)))
    ids = F.transform(F.regexp_extract_all(n, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.struct(flag.alias("flag"), F.when(key.isin(*COUNTS), number).when(key.isin(*NUMBERS), F.coalesce(number, F.lit(-1))).alias("number"), F.when(key.isin(*LISTS), ids).alias("list"), F.when(flag.isNull() & ~key.isin(*COUNTS, *LISTS, *NUMBERS), n).alias("text"))


def clean_ids(ids: Column) -> Column:
    """The positive ids in their order, each once."""
    return F.array_distinct(F.filter(ids, lambda x: x > 0))


def tournament(ids: Column, answers: Column) -> Column:
    """The winner of a pairwise tournament over ``clean_ids``: each next one meets the winner so far.

    ``answers``: array of structs (i, j, answer); an answer that names neither, or none, leaves the winner. Null without ids.
    """
    clean = clean_ids(ids)

    def meet(winner: Column, other: Column) -> Column:
        said = F.try_element_at(F.filter(answers, lambda a: (a["i"] == winner) & (a["j"] == other)), F.lit(1))["answer"]
        return F.when(said == other, other).otherwise(winner)

    return F.when(F.size(clean) > 0, F.aggregate(F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), F.try_element_at(clean, F.lit(1)), meet))


def _unfenced(reply: Column) -> Column:
    """What stands in the last code fence of a reply, or the reply."""
    parts = F.split(reply, "```")
    return F.when(F.contains(reply, F.lit("```")), F.element_at(parts, F.when(F.endswith(reply, F.lit("```")), -2).otherwise(-1))).otherwise(reply)


def confirms(reply: Column) -> Column:
    """Whether the first word of a check's reply says yes; anything else doesn't."""
    n = T.strip(_unfenced(F.lower(T.strip(F.coalesce(reply, F.lit(""))))))
    return F.regexp_extract(n, r"^(\S+)", 1).isin("yes", "true", "y", "1")


def listed(reply: Column) -> Column:
    """The items of a list in a reply ('["a", 'b']'); a single literal is a list of one, what can't be read an empty one."""
    n = T.strip(_unfenced(T.strip(F.coalesce(reply, F.lit("")))))
    items = F.regexp_extract_all(n, F.lit(r"""(?:"([^"]*)"|'([^']*)'|([^\[\],'"\s]+))"""), F.lit(0))
    bare = F.transform(items, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return F.when(n.rlike(r"(?s)^\[.*\]$"), bare).when(n.rlike(r"""^("[^"]*"|'[^']*'|-?\d+(\.\d+)?)$"""), bare).otherwise(none())


# What answer a question asks for, by the words in it; the first match wins, specific ones first.
ANSWER_CLASSES = [
    ("IsObjectCentered", "centered in the image"), ("WidthVsHeight", "width of the .* larger than the height"), ("Quadrants", "in what (quadrant|cell) does .* appear"), ("LargestAppearance", "appears the largest"),
    ("MostAppearance", "appears the most frequently"), ("LeastAppearance", "appears the least frequently"), ("LeftOf", "to the left of any"), ("RightOf", "to the right of any"),
    ("LeftMostWidthVsHeight", "leftmost object .* wider than .* tall"), ("RightMostWidthVsHeight", "rightmost object .* wider than .* tall"), ("LeftMost", "leftmost object"), ("RightMost", "rightmost object"),
    ("HowMany", "how many .* are there"), ("AreMore", "are there more .* than .*"), ("WhichMore", "what appears the most in this image"),
    ("ObjectsInRow", "are there any objects arranged in a row"), ("ObjectsInLine", "what objects are arranged in a row"), ("MostClusteredObjects", "group of objects .* clustered together"),
]


def answer_class(question: Column) -> Column:
    """The class of answer a question asks for, null if none is known."""
    return F.coalesce(*[F.when(F.lower(question).rlike(p), name) for name, p in ANSWER_CLASSES])


def file_name(index: Column, source: Column, prefix: str = "image_") -> Column:
    """The base name of a source, or prefix and number for none."""
    base = F.nullif(F.substring_index(F.coalesce(source, F.lit("")), "/", -1), F.lit(""))
    return F.coalesce(base, F.format_string(f"{prefix}%06d.jpg", index))


def safe_file_name(url: Column, fallback: Column) -> Column:
    """The last part of a URL without its query, or the fallback."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(F.substring_index(url, "/", -1), "?", 1)), F.lit("")), fallback)
