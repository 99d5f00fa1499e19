"""The sentence of every question type and how its parts are filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences of the questions, as datasets have them; {n}, {i}, {j} and {k} are numbers, {a}, {b}, {c} and {d} names or ranges.
_BENCH = "Each bench in the image has a visible number label beside it (e.g., 1, 2, 3, ...). Use these printed numbers as the bench IDs. "
_SIGN = "Each stop sign in the image has a visible number label beside it (e.g., 1, 2, 3, ...). Use these printed numbers as the stop sign IDs. "
_CIRCLE = "A red circle is placed in front of the clock to indicate its current heading direction. "
_NAMES = "Answer with exactly one of: 'North', 'South', 'East', 'West', 'Northeast', 'Northwest', 'Southeast', or 'Southwest'."
_TURNS = "Answer with exactly one of: 'turn left', 'turn right', or 'already facing'."
_SIDES = "Answer with exactly one of: 'front', 'front-right', 'right', 'back-right', 'back', 'back-left', 'left', or 'front-left'."
_AVOID = "Otherwise, answer 'turn left' or 'turn right' to avoid the first blocking object along that path."
_LETTER = "Respond with the letter only."
SCENE = {
    "CountPeople": "How many people are currently visible in this scene? Respond with only an integer.",
    "CountAnimals": "How many animals are currently visible in this scene? Respond with only an integer.",
    "CountPeopleAtBench": _BENCH + "How many people are currently at bench #{n}? Respond with only an integer.",
    "CountAnimalsAtStopSign": _SIGN + "How many animals are currently around stop sign #{n}? Respond with only an integer.",
    "ListBenchesWithAtLeastKPeople": _BENCH + "List the IDs of all benches that have at least {n} people in ascending order, separated by commas. If none, respond with '0'.",
    "ListStopSignsWithAtLeastKAnimals": _SIGN + "List the IDs of all stop signs that have at least {n} animals around them in ascending order, separated by commas. If none, respond with '0'.",
    "ArrivedAtBench": _BENCH + "Is the clock close enough to be considered arrived at bench number {n}? Respond with 'Yes' or 'No'.",
    "ArrivedAtAnimalsAroundStopSigns": _SIGN + "For each stop sign, consider all animals that are spatially closest to that stop sign. Is the clock close enough to be considered arrived at at least one of the animals around stop sign number {n}? Respond with 'Yes' or 'No'.",
    "ClosestBench": _BENCH + "Which bench is closest to the clock? Answer with the bench ID.",
    "ClosestStopSign": _SIGN + "Which stop sign is closest to the clock? Answer with its ID.",
    "PairwiseCloserBench": _BENCH + "Which is closer to the clock, bench #{i} or bench #{j}? Respond with only the bench number.",
    "PairwiseCloserStopSign": _SIGN + "Which is closer to the clock, stop sign #{i} or stop sign #{j}? Respond with only the stop sign number.",
    "ClosestToFurthestBenches": _BENCH + "List the benches in order from closest to furthest from the clock, separated by commas. For example, '2, 1, 4, 3'. ",
    "ClosestToFurthestStopSigns": _SIGN + "List the stop signs in order from closest to furthest from the clock, separated by commas. For example, '2, 1, 4, 3'. ",
    "GeometricDirectionToBench": _BENCH + "What is the relative direction of bench #{n} to the clock? " + _NAMES + " ",
    "GeometricDirectionToStopSign": _SIGN + "What is the relative direction of stop sign #{n} to the clock? " + _NAMES + " ",
    "AvoidObstacleToReachBench": _BENCH + _CIRCLE + "The clock is currently facing bench {n} and wants to reach that bench. Ignore the people already at bench {n}. If no other object blocks the straight path between the clock and bench {n}, answer 'keep straight'. " + _AVOID,
    "AvoidObstacleToReachStopSign": _SIGN + _CIRCLE + "The clock is currently facing stop sign {n} and wants to reach that stop sign. Ignore the animals already grouped with stop sign {n}. If no other object blocks the straight path between the clock and stop sign {n}, answer 'keep straight'. " + _AVOID,
    "BusHeadingDirection": "A red circle is placed in front of the clock in the image to indicate its current heading direction. Based on the position of the red circle relative to the clock, in which direction is the clock currently heading? " + _NAMES,
    "TurnDirectionToBench": _BENCH + _CIRCLE + "To face bench #{n}, should the clock turn left, turn right, or is it already facing that bench? " + _TURNS,
    "TurnDirectionToStopSign": _SIGN + _CIRCLE + "To face stop sign #{n}, should the clock turn left, turn right, or is it already facing that stop sign? " + _TURNS,
    "BenchRelativeToHeading": _BENCH + _CIRCLE + "Where is bench #{n} relative to the clock's current heading direction? " + _SIDES,
    "StopSignRelativeToHeading": _SIGN + _CIRCLE + "Where is stop sign #{n} relative to the clock's current heading direction? " + _SIDES,
    "CountPersonAtClosestBench": "How many people are at the bench closest to the clock? Respond with only an integer.",
    "ClosestBenchWithPerson": _BENCH + "Which bench is closest to the clock that has at least one person at it? Answer with the bench ID. If no benches have people, respond with '0'. ",
    "AvoidObstacleToReachClosestBench": _CIRCLE + "The clock is currently facing the closest bench and wants to reach that bench. Ignore the people already at that bench. If no other object blocks the straight path between the clock and the closest bench, answer 'keep straight'. " + _AVOID,
    "AvoidObstacleToReachClosestStopSign": _CIRCLE + "The clock is currently facing the closest stop sign and wants to reach that stop sign. Ignore the animals already grouped with that stop sign. If no other object blocks the straight path between the clock and the closest stop sign, answer 'keep straight'. " + _AVOID,
    "DirectionToClosestBench": "What is the relative direction of the closest bench to the clock? " + _NAMES,
    "DirectionToClosestStopSign": "What is the relative direction of the closest stop sign to the clock? " + _NAMES,
}
BOX = {
    "IsObjectCentered": "Divide the image into thirds. In which third does the {a} primarily appear? Respond with the letter only: A) left third, B) middle third, C) right third.",
    "WidthVsHeight": "Is the width of the {a} appear to be larger than the height?",
    "Quadrants": "Divide the image into a grid of {N} rows x {M} columns. Number the cells from left to right, then top to bottom, starting with 1. In what cell does the {a} appear?",
    "LargestAppearance": "If you were to draw a tight box around each object in the image, which type of object would have the biggest box?",
    "RankLargestK": "Rank the {a} kinds of objects that appear the largest (by pixel area) in the image from largest to smallest. Provide your answer as a comma-separated list of object names only.",
    "MostAppearance": "What kind of object appears the most frequently in the image?",
    "LeastAppearance": "What kind of object appears the least frequently in the image?",
    "LeftOf": "Is there at least one {a} to the left of any {b}?",
    "RightOf": "Is there at least one {a} to the right of any {b}?",
    "LeftMost": "What is the leftmost object in the image?",
    "RightMost": "What is the rightmost object in the image?",
    "HowMany": "How many {a}(s) are there in this image?",
    "AreMore": "Are there more {a}(s) than {b}(s) in this image?",
    "WhichMore": "What appears the most in this image: {a}s, {b}s, or {c}s?",
    "LeftMostWidthVsHeight": "Does the leftmost object in the image appear to be wider than it is tall?",
    "RightMostWidthVsHeight": "Does the rightmost object in the image appear to be wider than it is tall?",
    "MoreThanThresholdHowMany": "Are there {b} or more {a}(s) in this image? Respond Yes/No.",
    "LessThanThresholdHowMany": "Are there less than {b} {a}(s) in this image? Respond Yes/No.",
    "MultiChoiceHowMany": "How many {a}(s) are in the image? Choose one: A) {b}, B) {c}, C) {d}, D) Unsure / Not Visible. " + _LETTER,
    "ObjectsInRow": "Are there any objects arranged in a row?",
    "ObjectsInLine": "Which objects appear to be arranged in a row? A) {a}, B) {b}, C) {c}, D) No clear row arrangement. " + _LETTER,
    "MostClusteredObjects": "Which group of objects appears most tightly clustered? A) {a}, B) {b}, C) {c}, D) No clear clusters. " + _LETTER,
    "Closer": "Is there at least one {a} that appears closer to the camera than any {b}?",
    "Farther": "Is there at least one {a} that appears farther from the camera than any {b}?",
    "DepthRanking": "Rank the {a} kinds of objects that appear the closest to the camera in the image from closest to farthest. Provide your answer as a comma-separated list of object names only.",
}
# The sentence when a less-than question has nothing below its target, and of the reversed shape questions.
ANY = "Are there any {a}(s) in this image? Respond Yes/No."
REVERSED = {
    "WidthVsHeight": "Is the height of the {a} larger than the width?",
    "LeftMostWidthVsHeight": "Does the leftmost object in the image appear to be taller than it is wide?",
    "RightMostWidthVsHeight": "Does the rightmost object in the image appear to be taller than it is wide?",
}


def scene_sentence(kind: str, target: Column) -> Column:
    """The sentence of a scene question; pairs are numbered 1000 * i + j."""
    text = F.lit(SCENE[kind])
    if "{i}" in SCENE[kind]:
        return F.replace(F.replace(text, F.lit("{i}"), F.floor(target / 1000).cast("string")), F.lit("{j}"), F.pmod(target, F.lit(1000)).cast("string"))
    return F.replace(text, F.lit("{n}"), target.cast("string")) if "{n}" in SCENE[kind] else text


def box_sentence(kind: str, subject: Column, rows: int = 3, cols: int = 3) -> Column:
    """The sentence of a box question; the parts of ``subject`` are separated by '/'."""
    parts = F.split(subject, "/")
    text = F.lit(BOX[kind].replace("{N}", str(rows)).replace("{M}", str(cols)))
    if kind == "LessThanThresholdHowMany":
        text = F.when(F.get(parts, F.lit(1)) == "0", ANY).otherwise(text)
    for k, name in enumerate("abcd"):
        if "{" + name + "}" in BOX[kind]:
            text = F.replace(text, F.lit("{" + name + "}"), F.get(parts, F.lit(k)))
    return text
