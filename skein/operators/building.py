"""Assembling task rows: names of images and archives, problem texts, host paths, templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources whose rows name their image, and image owners of the others.
PREBUILT = ("swe-rebench-v2", "swe-bench-pro")
IMAGE_OWNERS = {"swe-bench-live": "docker.io/starryzhang", "swe-rebench": "docker.io/swerebench", "swe-rebench-leaderboard": "docker.io/swerebench"}
DEFAULT_OWNER = "docker.io/swebench"
# Fields that hold paths of the machine that built the table.
HOST_PATHS = ("local_tar_path", "local_image_tar_path", "host_image_path", "pro_run_script_path", "pro_parser_path")


def normal_source(source: Column) -> Column:
    return F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-"))


def _missing(what: str) -> Column:
    return F.raise_error(F.lit(f"a row has no {what}")).cast("string")


def image_name(instance: Column, source: Column, prebuilt: Column) -> Column:
    """The image of an instance: its own for prebuilt sources (absent raises), else by owner, repository and name."""
    kind = normal_source(source)
    owner = F.lit(DEFAULT_OWNER)
    for name, value in IMAGE_OWNERS.items():
        owner = F.when(kind == name, value).otherwise(owner)
    cut = F.instr(instance, "__")
    made = F.lower(F.concat(owner, F.lit("/sweb.eval.x86_64."), F.substring(instance, F.lit(1), cut - 1), F.lit("_1776_"), F.substring(instance, cut + 2, F.length(instance)), F.lit(":latest")))
    return F.when(kind.isin(*PREBUILT), F.coalesce(prebuilt, _missing("image name"))).otherwise(made)


def archive_name(image: Column, source: Column) -> Column:
    """File name of an image archive; the registry prefix stays only for prebuilt sources."""
    bare = F.when(normal_source(source).isin(*PREBUILT), image).otherwise(F.regexp_replace(image, r"^docker\.io/", ""))
    return F.concat(F.translate(bare, "/:", "__"), F.lit(".tar"))


def repo_dir(repo: Column, source: Column, given: Column) -> Column:
    """Where the repository stands inside an image."""
    named = F.regexp_extract(repo, r"^.+/([^/]+)$", 1)
    by_repo = F.when(named != "", F.concat(F.lit("/"), named)).otherwise(_missing("owner/name repository"))
    return F.when(normal_source(source) == PREBUILT[0], by_repo).otherwise(F.coalesce(F.nullif(F.trim(given), F.lit("")), F.lit("/testbed")))


def problem_text(problem: Column, source: Column, requirements: Column, interface: Column) -> Column:
    """The task text; one source adds requirements and interfaces."""
    long = F.concat(problem, F.lit("\n\nRequirements:\n"), F.coalesce(requirements, F.lit("")), F.lit("\n\nNew interfaces introduced:\n"), F.coalesce(interface, F.lit("")))
    return F.when(normal_source(source) == "swe-bench-pro", long).otherwise(problem)


def without_host_paths(df: DataFrame, column: str = "extra_info", names: tuple[str, ...] = HOST_PATHS) -> DataFrame:
    """A struct column without the fields that hold host paths."""
    there = [n for n in names if n in df.schema[column].dataType.names]
    return df.withColumn(column, F.col(column).dropFields(*there)) if there else df


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with {name} places; a place without a field raises here, a null field raises in its row."""
    out, rest = [], template
    while "{" in rest:
        text, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        if name not in fields:
            raise ValueError(f"no field {name!r}")
        out += [F.lit(text), F.coalesce(fields[name].cast("string"), _missing(name))]
    return F.concat(*out, F.lit(rest))


def format_and_accuracy(accuracy: Column, shaped: Column, weight: float = 0.1) -> Column:
    """Accuracy and format in one score."""
    return (1 - weight) * accuracy + weight * shaped


def build_tasks(df: DataFrame, *filters: Callable[[DataFrame], DataFrame], source: str, split: str) -> DataFrame:
    """Task rows (data_source, agent_name, prompt, reward_model, extra_info) of what the filters leave, in their order."""
    for keep in filters:
        df = keep(df)
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("problem_statement").alias("content")))
    return df.select(
        F.lit(source).alias("data_source"), F.lit("tool_agent").alias("agent_name"), prompt.alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), *[c for c in df.columns if c != "problem_statement"]).alias("extra_info"),
    )
