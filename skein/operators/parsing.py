"""Structured rows out of model text: tool calls in several notations, envelopes, actions, loss masks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLS = "array<struct<name string, arguments string>>"


def hermes_calls(text: Column) -> Column:
    """JSON calls between tool tags, as structs; what does not parse is left out."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    read = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(read, lambda c: c["name"].isNotNull())


def _number(value: str) -> int | float:
    number = float(value)
    return int(number) if number.is_integer() else number


def _truth(value: str) -> bool:
    return value.lower() == "true"


# Declared types of parameters, by name or by how the name begins, and how a text is read as one of them.
TYPE_NAMES = dict.fromkeys(("string", "str", "text", "varchar", "char", "enum", ""), str) | dict.fromkeys(("boolean", "bool", "binary"), _truth)
TYPE_PREFIXES = (("int", int), ("uint", int), ("long", int), ("short", int), ("unsigned", int), ("num", _number), ("float", _number))


def _coerced(value: str, kind: str):
    """A parameter by its declared type, others as JSON; what does not fit stays text (a boolean becomes false)."""
    if value.lower() == "null":
        return None
    kind = kind.strip().lower()
    read = TYPE_NAMES.get(kind) or next((r for prefix, r in TYPE_PREFIXES if kind.startswith(prefix)), json.loads)
    try:
        return read(value)
    except (ValueError, OverflowError, RecursionError):
        return value


def xml_calls(text: str, schema: dict) -> list[dict]:
    """<function=name><parameter=key>value</parameter></function> calls; the last one may be unclosed."""
    if "<tool_call>" not in text:
        return []
    blocks = re.findall(r"<tool_call>(.*?)(?:</tool_call>|\Z)", text, re.S) or [text]
    out = []
    for block in blocks:
        for name, body in re.findall(r"<function=([^>]*)>(.*?)(?:</function>|\Z)", block, re.S):
            kinds = schema.get(name, {})
            found = {}
            for key, value in re.findall(r"<parameter=([^>]*)>(.*?)(?:</parameter>|(?=<parameter=)|(?=</function>)|\Z)", body, re.S):
                value = value[1:] if value.startswith("\n") else value
                value = value[:-1] if value.endswith("\n") else value
                found[key] = _coerced(value, kinds[key]) if key in kinds else None if value.lower() == "null" else value
            out.append({"name": name, "arguments": json.dumps(found, ensure_ascii=False)})
    return out


def channel_calls(text: str, _schema: dict) -> list[dict]:
    """Calls addressed to functions in channel notation, reasoning left out."""
    plain = re.sub(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "", text, flags=re.S)
    pattern = r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    return [{"name": n, "arguments": a} for n, a in re.findall(pattern, plain, re.S)]


def braced_calls(text: str, _schema: dict) -> list[dict]:
    """call:name{key:value,...} in tool markers; texts stand between quote markers, other values are read as literals."""

    def literal(raw: str):
        raw = raw.strip()
        known = {"true": True, "false": False, "null": None}
        if raw.lower() in known:
            return known[raw.lower()]
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                continue
        return raw

    out = []
    for name, body in re.findall(r"<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>", text, re.S):
        found = {k: literal(bare) if quoted is None else quoted for k, quoted, bare in ((m[1], m[2], m[3]) for m in re.finditer(r'(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))', body))}
        out.append({"name": name, "arguments": json.dumps(found, ensure_ascii=False)})
    return out


PARSERS: dict[str, Callable[[str, dict], list[dict]]] = {"xml": xml_calls, "channel": channel_calls, "braced": braced_calls}


def tool_calls(text: Column, notation: str, schema: dict[str, dict[str, str]] | None = None) -> Column:
    """Calls of a text; ``schema`` has the type of each parameter of each function."""
    if notation == "hermes":
        return hermes_calls(text)
    parse, kinds = PARSERS[notation], schema or {}

    @F.pandas_udf(CALLS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: parse(t, kinds) if t else [])

    return run(text)


def call_rows(df: DataFrame, calls: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(calls).alias("call_no", "call")).select(*keys, "call_no", "call.name", "call.arguments")


def envelope_errors(text: Column, thinking: bool = False) -> Column:
    """What is wrong with the tool-call envelope of a response, each once and in order; empty if nothing."""
    count = lambda part: F.regexp_count(text, F.lit(part))
    starts, ends = count("<tool_call>"), count("</tool_call>")
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    shaped = r"(?s)^\s*<function=([^>\s]+)>(.*?)</function>\s*$"
    one_function = lambda b: b.rlike(shaped) & (F.regexp_count(b, F.lit("<function=")) == 1)
    parameters = lambda b: (F.regexp_count(b, F.lit("<parameter=")) == F.regexp_count(b, F.lit("</parameter>"))) & (F.regexp_count(b, F.lit(r"(?s)<parameter=[^>]+>.*?</parameter>")) == F.regexp_count(b, F.lit("<parameter=")))
    before = F.split_part(text, F.lit("<tool_call>"), F.lit(1))
    after = F.trim(F.regexp_replace(F.split_part(text, F.lit("</tool_call>"), F.lit(-1)), r"^\s+|\s+$", ""))
    checks = [
        F.when(starts != ends, "opening and closing tags differ"), F.when(F.size(bodies) != starts, "a call is not closed"),
        F.when(F.exists(bodies, lambda b: ~one_function(b)), "a call is not one closed function"),
        F.when(F.exists(bodies, lambda b: one_function(b) & ~parameters(b)), "a parameter is not closed"),
        F.when((F.size(bodies) > 0) & (after != "") & ~after.rlike(r"^(?:<\|[^|>]*\|>\s*)+$"), "text after the last call"),
    ]
    if thinking:
        checks = [F.when(before.contains("<think>"), "thinking is opened twice"), F.when(F.regexp_count(before, F.lit("</think>")) != 1, "thinking is not closed once"), *checks]
    return F.when(starts == 0, F.array(F.lit("no call"))).otherwise(F.array_distinct(F.array_compact(F.array(*checks))))


def single_action(text: Column, pattern: str) -> Column:
    """The one action of a response, and why there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(1)), lambda a: F.regexp_replace(a, r"^\s+|\s+$", ""))
    n = F.size(found)
    return F.struct(F.when(n == 1, F.try_element_at(found, F.lit(1))).alias("command"), F.when(n != 1, F.concat(F.lit("expected 1 action, found "), n.cast("string"))).alias("error"))


def call_verdict(calls: Column, single: bool = True, exact: bool = True, submission: str | None = None, marker: str | None = None) -> Column:
    """null if the calls are well-formed shell actions, else the first rule they break."""
    args = lambda c: F.from_json(c["arguments"], "map<string,string>")
    command = lambda c: F.get_json_object(c["arguments"], "$.command")
    bad = lambda test: F.exists(calls, test)
    out = F.when(F.size(calls) == 0, "no tool call")
    if single:
        out = out.when(F.size(calls) != 1, "more than one tool call")
    out = out.when(bad(lambda c: args(c).isNull()), "arguments are not an object").when(bad(lambda c: c["name"] != "bash"), "unknown tool")
    out = out.when(bad(lambda c: ~F.map_contains_key(args(c), "command")), "no command")
    if exact:
        out = out.when(bad(lambda c: F.size(F.map_keys(args(c))) > 1), "unexpected arguments")
    out = out.when(bad(lambda c: F.trim(F.coalesce(command(c), F.lit(""))) == ""), "empty command")
    if submission and marker:
        out = out.when(bad(lambda c: command(c).contains(marker) & (command(c) != submission)), "inexact submission")
    return out


def is_git_patch(patch: Column) -> Column:
    return F.coalesce(F.ltrim(patch).startswith("diff --git "), F.lit(False))


def split_media(content: Column) -> Column:
    """A message text cut at <image>, <video> and <audio> marks into (type, text) parts in order."""
    cut = F.split(F.regexp_replace(content, r"(<(?:image|video|audio)>)", "\u0001$1\u0001"), "\u0001")
    parts = F.filter(cut, lambda x: x != "")
    mark = r"^<(image|video|audio)>$"
    return F.transform(parts, lambda x: F.when(x.rlike(mark), F.struct(F.regexp_extract(x, mark, 1).alias("type"), F.lit(None).cast("string").alias("text"))).otherwise(F.struct(F.lit("text").alias("type"), x.alias("text"))))


def loss_mask(role: Column, length: Column, prefix: int = 0) -> Column:
    """1 for the tokens of an assistant's message after its generation prefix, 0 for all others."""
    return F.when(
        role == "assistant", F.concat(F.array_repeat(F.lit(0), F.least(F.lit(prefix), length).cast("int")), F.array_repeat(F.lit(1), F.greatest(length - prefix, F.lit(0)).cast("int")))
    ).otherwise(F.array_repeat(F.lit(0), length.cast("int")))
