"""Prompts and chat messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands before a question in each kind of prompt.
SHORT = "Answer the visual question using a short final answer only. Do not explain your reasoning.\nQuestion: "
LETTER = "Answer the embodied visual question using only the option letter (A, B, C, or D). Do not explain your reasoning.\nQuestion: "
YES_NO = "Answer the spatial question using yes or no only. Do not explain your reasoning.\nQuestion: "
POINTS = "Answer the spatial question using only a Python-style list of normalized (x, y) coordinate tuples. Do not explain your reasoning.\nQuestion: "
ZERO_SHOT = "Answer the following question related to the image. If this question involves object naming, you may only identify objects that are specified from the question or if none are specified, you may only identify objects from the COCO dataset (80 labels)."
BACKTICKS = " Make sure to wrap the answer in triple backticks. '```'"
BATCH = "Answer the following questions related to the image. Provide your answers to each question, separated by commas."
STEPS = "Look at the image carefully and think through each question step by step. Use the provided examples to guide your reasoning and arrive at the correct answer. Answer in the same step-by-step reasoning format as the examples."
FEW_SHOT = "You are a helpful assistant that provides answers to questions."
MESSAGE = "array<struct<role:string,text:string>>"


def user_question(question: Column) -> Column:
    return F.concat(F.lit(SHORT), question)


def eval_question(dataset: str, answer_format: Column, question: Column) -> Column:
    """The prompt of a benchmark question by the form of its answer."""
    q = F.trim(question)
    if dataset == "erqa":
        return F.concat(F.lit(LETTER), q)
    return F.concat(F.when(answer_format == "yes_no", YES_NO).when(answer_format == "points", POINTS).otherwise(SHORT), q)


def plain_question(question: Column) -> Column:
    """Questions that hold their own instructions, without blanks around them."""
    return F.trim(question)


def caption_question(caption: Column) -> Column:
    """Whether a sentence describes the image."""
    return F.concat(F.lit('Does the following sentence correctly describe the image?\nSentence: "'), caption, F.lit('"\nAnswer yes or no only.'))


def letter_of(index: Column) -> Column:
    """A for 0, B for 1, and so on."""
    return F.char(F.lit(65) + index)


def choice_question(options: Column) -> Column:
    """Which of the lettered captions describes the image."""
    lines = F.transform(options, lambda o, i: F.concat(letter_of(i), F.lit(". "), o))
    return F.array_join(F.concat(F.array(F.lit("Which caption best describes the image?"), F.lit("")), lines, F.array(F.lit(""), F.lit("Answer with the letter only."))), "\n")


def _message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def messages(question: Column, answer: Column | None = None) -> Column:
    """The user's prompt and, for training, the assistant's stripped answer; a null answer adds none."""
    user = F.array(_message("user", user_question(question)))
    if answer is None:
        return user.cast(MESSAGE)
    return F.when(answer.isNull(), user).otherwise(F.concat(user, F.array(_message("assistant", F.trim(answer))))).cast(MESSAGE)


def strategy(name: str, question: Column, examples: list[tuple[str, str]] | None = None, *, constrained: bool = False) -> Column:
    """The messages of a prompting strategy: zero_shot, batch, steps, few_shot or passthrough.

    ``steps`` and ``few_shot`` take worked examples (question, answer); few_shot needs some.
    """
    systems = {"zero_shot": ZERO_SHOT + ("" if constrained else BACKTICKS), "batch": BATCH, "steps": STEPS, "few_shot": FEW_SHOT}
    if name == "passthrough":
        return F.array(_message("user", question)).cast(MESSAGE)
    if name not in systems:
        raise ValueError(f"unknown strategy {name!r}; known: passthrough, {', '.join(systems)}")
    if name == "few_shot" and not examples:
        raise ValueError("few_shot needs examples")
    shown = [m for q, a in examples or [] if name in ("steps", "few_shot") for m in (_message("user", F.lit(q)), _message("assistant", F.lit(a)))]
    return F.array(_message("system", F.lit(systems[name])), *shown, _message("user", question)).cast(MESSAGE)
