"""Rule generation by an external model, behind a protocol; a deterministic stand-in proposes observed paths."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RuleGenerator(Protocol):
    def generate(self, prompt: str) -> str: ...


class PathEcho:
    """Answers with the rules that the prompt lists, one a line: no model, for tests and dry runs."""

    def generate(self, prompt: str) -> str:
        return "\n".join(x for x in prompt.splitlines() if "<-" in x)


def prompt_of(head: str, paths: list[str], examples: list[str] | None = None, profile: str = "", limit: int = 4000) -> str:
    """Task, relation profile, examples, then as many paths as fit."""
    parts = [f"Write temporal chain rules with the head {head}.", profile, *(examples or []), "Observed paths:"]
    text = "\n".join(p for p in parts if p)
    for path in paths:
        if len(text) + len(path) + 1 > limit:
            break
        text += "\n" + path
    return text


def profile_block(row: dict) -> str:
    """A relation's profile as lines of text, without what is missing."""
    names = (("n", "facts"), ("first_ts", "first time"), ("last_ts", "last time"), ("density", "facts per time step"), ("level", "density class"))
    return "\n".join(f"- {label}: {row[key]}" for key, label in names if row.get(key) is not None)


def generated(paths: DataFrame, make_generator, limit: int = 4000) -> DataFrame:
    """paths (head, path, conf) -> (head, rule): one call per head with its best paths, the answer split into lines.

    make_generator is called once per task. A head's paths are bounded by the prompt's limit before they are gathered.
    """
    from pyspark.sql import Window

    best = Window.partitionBy("head").orderBy(F.desc("conf"), "path").rowsBetween(Window.unboundedPreceding, 0)
    fit = paths.withColumn("total", F.sum(F.length("path") + 1).over(best)).where(F.col("total") <= limit)
    heads = fit.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("total", "path")))["path"].alias("paths"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_generator()
        for batch in batches:
            rows = [(h, line.strip()) for h, p in zip(batch["head"], batch["paths"]) for line in model.generate(prompt_of(h, list(p), limit=limit + 200)).splitlines() if line.strip()]
            yield pd.DataFrame(rows, columns=["head", "rule"])

    return heads.mapInPandas(run, "head string, rule string")


def usage(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
