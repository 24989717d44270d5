"""Tool calls inside scripted exec wrappers: `tools.name(...)` with literal arguments, or names bound to literals.

Only what stands literally in the script is read; a call whose argument is computed is not guessed at.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|\S""", re.S)
CALLS = ("exec_command", "apply_patch")


def _literal(token: str) -> str | None:
    """The value of a string literal; null for a template that has computed parts."""
    if token[0] == "`":
        return None if re.search(r"(?<!\\)\$\{", token) else re.sub(r"\\([`$\\])", r"\1", token[1:-1])
    try:
        value = ast.literal_eval(token.replace("\\/", "/"))
    except (SyntaxError, ValueError):
        return None
    return value if isinstance(value, str) else None


def tool_calls(script: str) -> list[tuple[str, str]]:
    """(tool, argument text) of each call in order: the patch of apply_patch, the command of exec_command."""
    tokens = [t for t in TOKEN.findall(script) if not t.startswith(("//", "/*"))]
    bound: dict[str, str] = {}
    out: list[tuple[str, str]] = []

    def value(i: int) -> str | None:
        if i >= len(tokens):
            return None
        return _literal(tokens[i]) if tokens[i][0] in "\"'`" else bound.get(tokens[i])

    for i, t in enumerate(tokens):
        if t in ("const", "let", "var") and tokens[i + 2 : i + 3] == ["="] and (v := value(i + 3)) is not None:
            bound[tokens[i + 1]] = v
        if t != "tools" or tokens[i + 1 : i + 2] != ["."] or tokens[i + 3 : i + 4] != ["("]:
            continue
        name, at = tokens[i + 2], i + 4
        if name not in CALLS:
            continue
        found = value(at)
        if tokens[at : at + 1] == ["{"]:
            depth, k = 1, at + 1
            while k < len(tokens) and depth:
                depth += (tokens[k] in "{[(") - (tokens[k] in "}])")
                key = tokens[k].strip("\"'")
                if depth == 1 and key in ("cmd", "command", "patch", "input"):
                    if tokens[k + 1 : k + 2] == [":"]:
                        found = value(k + 2)
                        break
                    if key in bound and tokens[k + 1 : k + 2] in ([","], ["}"]):
                        found = bound[key]
                        break
                k += 1
        if found is not None:
            out.append((name, found))
    return out


def _calls(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: [{"tool": t, "argument": a} for t, a in tool_calls(s)] if s else [])


def expanded(rows: DataFrame, event_type: str) -> DataFrame:
    """Normalised rows whose exec events are replaced by the calls inside them; an exec without any stays itself.

    event_type: the DDL of an event struct. Only rows that have an exec event pass through Python.
    """
    def is_exec(e: Column) -> Column:
        return (e["event_type"] == "tool") & (e["name"] == "exec")

    has = F.exists("events", is_exec)
    wrapped = rows.where(has).withColumn("__e", F.filter("events", is_exec)[0]).withColumn("__c", F.pandas_udf(_calls, "array<struct<tool:string,argument:string>>")(F.col("__e.detail")))
    inner = F.transform(
        "__c",
        lambda c, i: F.struct(
            F.lit("tool").alias("event_type"), c["tool"].alias("name"), F.when(c["tool"] == "exec_command", c["argument"]).alias("command"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("bigint").alias("duration_ms"),
            F.when(F.col("__e.source_event_id").isNotNull(), F.substring(F.sha2(F.concat_ws("|", "__e.source_event_id", c["tool"], i.cast("string")), 256), 1, 16)).alias("source_event_id"), c["argument"].alias("detail"),
        ),
    ).cast(f"array<{event_type}>")
    events = F.when(F.size("__c") > 0, F.concat(F.filter("events", lambda e: ~F.coalesce(is_exec(e), F.lit(False))), inner)).otherwise(F.col("events"))
    plain = rows.where(~F.coalesce(has, F.lit(False))).withColumn("parallel", F.lit(False))
    return plain.unionByName(wrapped.withColumn("events", events).withColumn("parallel", F.coalesce(parallel_batches(F.col("__e.detail")), F.lit(False))).drop("__e", "__c"))


def parallel_batches(script: Column) -> Column:
    """Whether a script starts several calls at once."""
    return script.rlike(r"Promise\.all(?:Settled)?\b") | (F.size(F.regexp_extract_all(script, F.lit(r"(tools\.exec_command\()"), F.lit(1))) > 1)
