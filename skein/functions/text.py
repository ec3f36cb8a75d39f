"""String, hash and JSON functions. Columns where Catalyst can say it; else plain Python behind Arrow UDFs."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def last_tag(text: Column, tag: str = "answer", least: int = 1) -> Column:
    """Trimmed content of the last <tag>; null with fewer than ``least`` of them."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) >= least, F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"^\s+|\s+$", ""))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def final_number(text: Column, method: str = "strict", tail: int = 300) -> Column:
    """The number after the last ####, or the last number at all, in the last ``tail`` characters."""
    end = F.right(text, F.lit(tail))
    if method == "strict":
        found = F.regexp_extract_all(end, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
        return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(end, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    good = F.filter(found, lambda x: (x != "") & (x != "."))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def code_blocks(text: Column, first: bool = False) -> Column:
    """Contents of fenced blocks: the first, or all joined by newlines."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)```(?:python|py)?\s*\n(.*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.try_element_at(found, F.lit(1)) if first else F.array_join(found, "\n")


def without_binary_hunks(patch: Column) -> Column:
    """A diff without the files that are marked as binary."""
    files = F.split(patch, r"(?m)(?=^diff --git )")
    kept = F.filter(files, lambda f: ~(f.contains("GIT binary patch") | f.rlike(r"(?m)^Binary files .* differ$")))
    return F.array_join(kept, "")


def multiset_jaccard(left: Column, right: Column) -> Column:
    """Overlap of two lists as multisets: sum of the smaller counts over the sum of the larger; 1 if both are empty."""
    names = F.array_distinct(F.concat(left, right))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(names, F.lit(0), lambda s, x: s + F.least(count(left, x), count(right, x)))
    every = F.aggregate(names, F.lit(0), lambda s, x: s + F.greatest(count(left, x), count(right, x)))
    return F.when(F.size(names) == 0, 1.0).otherwise(both / every)


def sanitised_key(name: Column) -> Column:
    """A metric key as trackers take it: @ spelled out, slashes squeezed, all else that is odd an underscore."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "@", "_at_"), "/+", "/"), r"[^A-Za-z0-9_\-./ ]", "_")


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"))


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks; text that is not JSON becomes a JSON string, null stays."""

    def one(value):
        if value is None:
            return None
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):  # nested too deeply to be read counts as no JSON
            return json.dumps(value, ensure_ascii=False)

    return values.map(one)


@F.pandas_udf(ArrayType(StringType()))
def parsed_list(values: pd.Series) -> pd.Series:
    """A list written as JSON or as a Python literal; a plain text is a list of one, null and blank are empty."""

    def one(value):
        if value is None or not value.strip():
            return []
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(value)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            return [str(x) for x in got] if isinstance(got, list | tuple | set) else [str(got)]
        return [value]

    return values.map(one)


@F.pandas_udf(StringType())
def last_boxed(values: pd.Series) -> pd.Series:
    """The content of the last \\boxed{...} or \\fbox{...} whose braces close, or of \\boxed followed by a blank."""

    def one(text):
        if text is None:
            return None
        at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
        if at < 0:
            return None
        if text.startswith("\\boxed ", at):
            return text[at + 7 :].split("$")[0]
        depth, start = 0, text.find("{", at)
        for k in range(start, len(text)) if start >= 0 else ():
            depth += (text[k] == "{") - (text[k] == "}")
            if depth == 0:
                return text[start + 1 : k]
        return None

    return values.map(one)


def truncated_text(text: Column, most: int, head_share: float = 0.6, notice: str = "\n[... cut ...]\n") -> Column:
    """At most ``most`` characters: the head's share of the start, the rest of the end, a notice between."""
    head = int(most * head_share)
    cut = F.concat(F.substring(text, 1, head), F.lit(notice), F.right(text, F.lit(most - head)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def truncated_tokens(ids: Column | str, most: int, head_share: float = 0.6, notice: list[int] | None = None) -> Column:
    """At most ``most`` token ids: the head's share of the first, the rest of the last, the ids of a notice between."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    head = max(int(most * head_share), min(most, 1))
    cut = [F.slice(ids, 1, head)] if head else []
    cut += [F.array(*[F.lit(x) for x in notice])] if notice else []
    cut += [F.slice(ids, -(most - head), most - head)] if most > head else []
    return F.when(F.size(ids) <= most, ids).otherwise(F.concat(*cut) if cut else F.slice(ids, 1, 0))


def merged_maps(left: Column | str, right: Column | str, strict: bool = True) -> Column:
    """The union of two maps; a key of both must have equal values, or else, if not ``strict``, the right one wins."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    clash = F.exists(F.map_keys(left), lambda k: F.map_contains_key(right, k) & ~F.element_at(left, k).eqNullSafe(F.element_at(right, k)))
    plain = F.map_concat(F.map_filter(left, lambda k, _v: ~F.map_contains_key(right, k)), right)
    return F.when(clash, F.raise_error(F.lit("a key has two values"))).otherwise(plain) if strict else plain
