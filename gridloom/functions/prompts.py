"""Prompt rendering as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import prompt_texts as P


@dataclass(frozen=True)
class Version:
    """How a version's user message is built: an introduction, examples, then its parts in order."""

    intro: str
    answer: str
    system: str = P.SYSTEM_SHORT
    #: pairs, inputs or outputs of the training samples; none for versions without examples
    examples: str = "pairs"
    level: str = "##"
    #: of: test, code, choices, verify
    parts: tuple[str, ...] = ()
    tail: str = ""


VERSIONS = {
    "output-from-examples-v0": Version(P.SOLVE_FIRST, P.ANSWER_OUTPUT, P.SYSTEM_LONG, parts=("test",)),
    "output-from-examples-v1": Version(P.SOLVE, P.ANSWER_OUTPUT, parts=("test",)),
    "input-from-inputs-v0": Version(P.NEW_GRID, P.ANSWER_NEW_GRID, examples="inputs"),
    "output-from-outputs-v0": Version(P.NEW_GRID, P.ANSWER_NEW_GRID, examples="outputs"),
    "code-from-examples-v0": Version(P.WRITE_CODE, ""),
    "code-from-examples-v1": Version(P.GENERATE, "", level="###", tail=P.CODE_TAIL),
    "code-from-examples-v2": Version(P.GENERATE, P.ANSWER_CODE, level="###"),
    "code-from-examples-v3": Version(P.GENERATE_IMG, P.ANSWER_CODE, level="###", parts=("test",)),
    "output-from-code-v0": Version(P.RUN_CODE, P.ANSWER_OUTPUT, examples="", parts=("code",)),
    "select-output-from-examples-v0": Version(P.SELECT, "", parts=("test", "choices")),
    "verify-output-from-examples-v0": Version(P.VERIFY, "", parts=("test", "verify"), tail=P.VERIFY_TAIL),
}
STOPS = ("<|eot_id|>", "<|im_end|>", "<|end|>")


def version(name: str) -> Version:
    if name not in VERSIONS:
        raise ValueError(f"unknown prompt version {name}")
    return VERSIONS[name]


def _example(v: Version, s: Column, i: Column) -> Column:
    number = (i + 1).cast("string")
    if v.examples == "pairs":
        return F.concat(F.lit(f"\n{v.level} Example "), number, F.lit(f"\n\n{v.level}# Input\n\n"), s["input"], F.lit(f"\n\n{v.level}# Output\n\n"), s["output"], F.lit("\n"))
    return F.concat(F.lit("\n## Grid example "), number, F.lit("\n\n"), s[v.examples[:-1]], F.lit("\n"))


def user_message(name: str, train: Column, test_input: Column, test_output: Column | None = None, choices: Column | None = None, code: Column | None = None) -> Column:
    """train: array<struct<input:string,output:string>> of encoded grids; the rest are encoded too."""
    v = version(name)
    out = [F.lit(v.intro)]
    if v.examples:
        out.append(F.array_join(F.transform(train, lambda s, i: _example(v, s, i)), ""))
    for part in v.parts:
        if part == "test":
            out += [F.lit(f"\n{v.level} Test case\n\n{v.level}# Input\n\n"), test_input]
        elif part == "code":
            out += [F.lit("\n## Code\n\n```python\n"), code, F.lit("\n```\n\n## Example\n\n### Input\n\n"), test_input]
        elif part == "choices":
            option = lambda c, i: F.concat(F.lit("\n### Output option "), (i + 1).cast("string"), F.lit("\n\n"), c, F.lit("\n"))
            out += [F.lit("\n"), F.array_join(F.transform(choices, option), "")]
        elif part == "verify":
            out += [F.lit("\n\n### Output\n\n"), test_output]
    return F.concat(*out, F.lit(v.tail))


def answer(name: str, train_prompt: bool, test_input: Column, test_output: Column, code: Column | None = None, choice: Column | None = None, correct: Column | None = None) -> Column:
    v = version(name)
    if not train_prompt:
        start = "```python\n" if name.startswith("code-from-examples") else "" if name.startswith(("select-", "verify-")) else "```grid"
        return F.lit(v.answer + start)
    # outputs are answered with the test output even where the examples are outputs alone
    if name.startswith("output"):
        found = test_output
    elif name.startswith("input-from-inputs"):
        found = test_input
    elif name.startswith("code-from-examples"):
        found = F.concat(F.lit("```python\n"), code, F.lit("\n```"))
    else:
        found = (choice if name.startswith("select") else correct).cast("string")
    return F.concat(F.lit(v.answer), found)


def chat(messages: Column) -> Column:
    """ChatML of array<struct<role:string,content:string>>."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def without_ending(text: Column) -> Column:
    """Text before the last stop marker; of several kinds the first in STOPS counts; null without one."""
    cut = [F.when(F.contains(text, F.lit(m)), F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, m, -1)) - len(m))) for m in STOPS]
    return F.coalesce(*cut)


def render(name: str, train: Column, test_input: Column, test_output: Column, train_prompt: bool = True, **extra: Column) -> Column:
    """The whole prompt; for inference it stops where the model goes on."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = user_message(name, train, test_input, test_output, extra.get("choices"), extra.get("code"))
    reply = answer(name, train_prompt, test_input, test_output, extra.get("code"), extra.get("choice"), extra.get("correct"))
    whole = chat(F.array(message("system", F.lit(version(name).system)), message("user", user), message("assistant", reply)))
    return whole if train_prompt else without_ending(whole)


def preview(task_id: Column, prompt: Column) -> Column:
    return F.substring(F.concat(F.lit("Task: "), task_id, F.lit(", Prompt: "), F.substring(prompt, 1, 100)), 1, 200)


def prompt_cap(asked: Column, tests: Column, augmentations: int = 8) -> Column:
    """How many prompts a task of `tests` test samples gets when `asked` per task are wanted: whole rounds of all augmentations from 8 on."""
    return tests * F.when(asked < augmentations, F.greatest(asked, F.lit(1))).otherwise(augmentations * F.floor(asked / augmentations))
