"""Rule-based scores of answers, tool calls and test reports."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions import text as T
from skein.operators.building import format_and_accuracy


def gsm8k(solution: Column, truth: Column, method: str = "strict", score: float = 1.0, format_score: float = 0.0) -> Column:
    answer = T.final_number(solution, method)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def qa_match(solution: Column, targets: Column, part: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Exact (or sub-string) match of the last answer with any target; more than ten tags quarter the score."""
    answer = T.last_tag(solution)
    norm = T.normal_answer(answer)
    hit = F.exists(targets, lambda t: norm.contains(T.normal_answer(t)) if part else norm == T.normal_answer(t))
    many = (T.count_of(solution, "<answer>") > 10) | (T.count_of(solution, "</answer>") > 10)
    return F.when(answer.isNull(), 0.0).when(hit, F.when(many, score / 4).otherwise(score)).otherwise(format_score)


# What a final answer is rid of before it is compared.
ANSWER_SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
ANSWER_REMOVALS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
)


def normal_final_answer(answer: Column) -> Column:
    out = F.try_element_at(F.split(answer, "="), F.lit(-1))
    for old, new in (*ANSWER_SUBSTITUTIONS, *((x, "") for x in ANSWER_REMOVALS)):
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, kept in (  # fixed values: marks around an answer and what stays of them
        (r"^(.*?)(\$)(.*?)(\$)(.*)$", r"\$$3\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"),
        (r"\\boxed\{(.*)\}", "$1"), (r"(frac)([^{])(.)", "$1{$2}{$3}"), (r"(sqrt)([^{])", "$1{$2}"), (r"\$", ""),
    ):
        out = F.regexp_replace(out, pattern, kept)
    digits = F.replace(out, F.lit(","), F.lit(""))
    return F.trim(F.when(digits.rlike(r"^\d+$"), digits).otherwise(out))


def math_answer(solution: Column, truth: Column) -> Column:
    """score 1 or -1, acc and pred of the last ``Answer:`` line in the last 300 characters."""
    found = F.regexp_extract_all(F.right(solution, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    pred = normal_final_answer(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]")))
    acc = pred == normal_final_answer(truth)
    return F.struct(F.when(acc, 1.0).otherwise(-1.0).alias("score"), acc.alias("acc"), pred.alias("pred"))


def strict_box(solution: Column, truth: Column) -> Column:
    pred = T.last_boxed(F.right(solution, F.lit(100)))
    return F.struct(F.when(pred == truth, 1.0).otherwise(-1.0).alias("score"), pred.alias("pred"))


def latex_plain(value: Column) -> Column:
    """A LaTeX answer in one spelling: no spacing, units or degree signs, braces around arguments, a/b as a fraction."""
    s = F.replace(F.replace(F.replace(value, F.lit("\n"), F.lit("")), F.lit("\\!"), F.lit("")), F.lit("\\\\"), F.lit("\\"))
    s = F.regexp_replace(s, "[td]frac", "frac")
    s = F.split_part(F.regexp_replace(s, r"\\left|\\right|\^\{\\circ\}|\^\\circ|\\\$", ""), F.lit("\\text{ "), F.lit(1))
    s = F.regexp_replace(s, r"\\?\\%", "")
    s = F.replace(F.replace(s, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    s = F.when(s.startswith("."), F.concat(F.lit("0"), s)).otherwise(s)
    sides = F.split(s, "=")
    s = F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), F.get(sides, F.lit(1))).otherwise(s)
    for pattern, kept in (
        (r"\\sqrt(?!\{)(.)", r"\\sqrt{$1}"), (" ", ""), (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), (r"\\frac([^{])(\{)", r"\\frac{$1}$2"),
        (r"^0\.5$", r"\\frac{1}{2}"), (r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}"),
    ):
        s = F.regexp_replace(s, pattern, kept)
    return s


def math_boxed(solution: Column, truth: Column) -> Column:
    """1 if the last boxed answer equals the truth in one spelling."""
    return F.when(latex_plain(T.last_boxed(solution)) == latex_plain(truth), 1.0).otherwise(0.0)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to limit - buffer, then falling to -factor at the limit."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


# --- tool calls


def match_share(left: list, right: list) -> float:
    a, b = Counter(left), Counter(right)
    every = sum((a | b).values())
    return 1.0 if left == right else (sum((a & b).values()) / every if every else 0.0)


def _fit(want: dict, got: dict) -> float:
    """How well the parameters of a call fit those of a wanted one: overlap of their names, and one for each equal value."""
    same = [k for k in want.keys() & got.keys() if want[k] == got[k]]
    return match_share(list(want), list(got)) + len(same)


def tool_call_score(gold: list[dict], made: list[dict], most: float = 3.0, least: float = -3.0) -> float:
    """Overlap of the names, and for each wanted call in turn the fit of its best namesake that no other took; scaled."""
    if gold == made:
        return most
    names = [[c["name"] for c in calls] for calls in (gold, made)]
    free, reached = dict(enumerate(made)), match_share(*names)
    for want in gold:
        fits = {k: _fit(want["parameters"], got["parameters"]) for k, got in free.items() if got["name"] == want["name"]}
        best = max(fits, key=fits.get, default=None)  # the first of equals
        if best is not None and fits[best] > 0:
            reached += fits[best]
            del free[best]
    possible = 1 + sum(1 + len(want["parameters"]) for want in gold)
    return least + (most - least) * reached / possible


# The parts that a response must have, by whether the truth has an answer and a call.
_FORMATS = {
    (True, False): r"<think>.*?</think>\n<response>.*?</response>", (False, True): r"<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>",
    (True, True): r"<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>", (False, False): r"<think>.*?</think>",
}


def format_score(response: Column, truth: Column) -> Column:
    """1 if the response has the parts that the truth has, once each and in order."""
    out = F.lit(0.0)
    for (answer, call), pattern in _FORMATS.items():
        once = F.lit(True)
        for tag, there in (("response", answer), ("tool_call", call)):
            if there:
                once = once & (T.count_of(response, f"<{tag}>") == 1) & (T.count_of(response, f"</{tag}>") == 1)
        wanted = (truth.contains("<response>") == F.lit(answer)) & (truth.contains("<tool_call>") == F.lit(call))
        out = F.when(wanted & once & response.rlike(f"(?s)^{pattern}$"), 1.0).otherwise(out)
    return out


def _calls(text: str | None) -> list[dict] | None:
    body = re.search(r"<tool_call>(.*?)</tool_call>", text or "", re.S)
    if not body:
        return None
    try:
        calls = [json.loads(line) for line in body[1].strip().split("\n") if line.strip()]
    except (ValueError, RecursionError):
        return None
    made = [{"name": c.get("name"), "parameters": c.get("parameters", c.get("arguments", {}))} if isinstance(c, dict) else {"name": None} for c in calls]
    return made if all(isinstance(c["name"], str) and isinstance(c["parameters"], dict) for c in made) else None


@F.pandas_udf(DoubleType())
def tool_call_reward(responses: pd.Series, truths: pd.Series) -> pd.Series:
    """The tool-call score of a response against the calls in the truth; 0 if none are wanted, the least if unreadable."""

    def one(response, truth):
        gold = _calls(truth)
        if gold is None:
            return 0.0
        made = _calls(response)
        return -3.0 if made is None else tool_call_score(gold, made)

    return pd.Series([one(r, t) for r, t in zip(responses, truths, strict=True)], dtype="float64")


# --- test reports


def graded_tests(tests: DataFrame, *keys: str, kind: str = "kind", status: str = "status", fail_only: bool = False) -> DataFrame:
    """keys, f2p_rate, p2p_rate, resolution: PASSED and XFAIL pass; FAILED, ERROR and absent fail; another status counts
    in neither. A rate without any test is 1. With ``fail_only`` all but FAILED pass."""
    s = F.col(status)
    passed = (s != "FAILED") | s.isNull() if fail_only else F.coalesce(s.isin("PASSED", "XFAIL"), F.lit(False))
    failed = F.coalesce(s == "FAILED", F.lit(False)) if fail_only else s.isNull() | s.isin("FAILED", "ERROR")
    share = lambda name: F.count_if((F.col(kind) == name) & passed) / F.nullif(F.count_if((F.col(kind) == name) & (passed | failed)), F.lit(0))
    rates = tests.groupBy(*keys).agg(F.coalesce(share("FAIL_TO_PASS"), F.lit(1.0)).alias("f2p_rate"), F.coalesce(share("PASS_TO_PASS"), F.lit(1.0)).alias("p2p_rate"))
    f, p = F.col("f2p_rate"), F.col("p2p_rate")
    return rates.withColumn("resolution", F.when((f == 1) & (p == 1), "FULL").when((f < 1) & (f > 0) & (p == 1), "PARTIAL").otherwise("NO"))


def report_reward(resolved: Column, f2p: Column, p2p: Column, sparse: bool = True) -> Column:
    dense = F.when(f2p > 0, f2p * p2p).when(p2p >= 1, 0.05).otherwise(0.0)
    return F.when(resolved, 1.0).otherwise(F.lit(0.0) if sparse else dense)


# Markers of a failed run, first match wins.
LOG_MARKERS = ((">>>>> Patch Apply Failed", "harness_apply_patch_failed"), (">>>>> Reset Failed", "harness_reset_failed"), (">>>>> Tests Timed Out", "tests_timeout"), (">>>>> Tests Errored", "tests_error"))
LOG_START, LOG_END = ">>>>> Start Test Output", ">>>>> End Test Output"


def log_status(log: Column) -> Column:
    out = F.when(log.contains(LOG_START) & log.contains(LOG_END), "ok").otherwise("test_markers_missing")
    for marker, name in reversed(LOG_MARKERS):
        out = F.when(log.contains(marker), name).otherwise(out)
    return out


def all_required_passed(required: Column, passed: Column) -> Column:
    return F.when(F.size(F.array_except(required, passed)) == 0, 1.0).otherwise(0.0)


# --- dispatch

def geometry(solution: Column, truth: Column) -> Column:
    """Nine parts accuracy of the boxed answer, one part shape: thoughts in their tag and a box after them."""
    shaped = solution.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return format_and_accuracy(math_boxed(solution, truth), shaped)


def _answer_line(solution: Column, truth: Column) -> Column:
    return math_answer(solution, truth)["score"]


def _question(solution: Column, truth: Column) -> Column:
    return qa_match(solution, F.array(truth))


# Names of data sources and the rule that scores them.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "openai/gsm8k": gsm8k, "lighteval/MATH": math_boxed, "DigitalLearningGmbH/MATH-lighteval": math_boxed, "HuggingFaceH4/MATH-500": math_boxed,
    "math_dapo": _answer_line, "math": _answer_line, "math_dapo_reasoning": _answer_line, "hiyouga/geometry3k": geometry,
    "searchR1_nq": _question, "searchR1_triviaqa": _question, "searchR1_popqa": _question, "searchR1_hotpotqa": _question,
    "searchR1_2wikimultihopqa": _question, "searchR1_musique": _question, "searchR1_bamboogle": _question,
    "rlla": lambda s, t: tool_call_reward(s, t) + format_score(s, t),
}


def register_scorer(source: str, scorer: Callable[[Column, Column], Column]) -> None:
    SCORERS[source] = scorer


def dispatch(source: Column, solution: Column, truth: Column) -> Column:
    """The score by source; names that begin with aime score as math; an unknown source raises."""
    out = F.raise_error(F.concat(F.lit("no score for source "), source)).cast("double")
    out = F.when(source.startswith("aime"), SCORERS["math_dapo"](solution, truth)).otherwise(out)
    for name, scorer in SCORERS.items():
        out = F.when(source == name, scorer(solution, truth)).otherwise(out)
    return out


def place_at_last_token(score: Column, response: Column) -> Column:
    return F.transform(response, lambda _x, i: F.when(i == F.size(response) - 1, score).otherwise(F.lit(0.0)))
