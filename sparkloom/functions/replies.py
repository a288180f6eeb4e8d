"""Replies of language models as columns: JSON that has to be mended, names of models, settings from the environment."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import _c, strip_thoughts

REPORT = "title string, summary string, rating double, rating_explanation string, findings array<struct<summary: string, explanation: string>>"


def json_body(text: Column | str) -> Column:
    """The text between the outermost braces, without thoughts and code fences; null where there are none."""
    bare = F.regexp_replace(strip_thoughts(text), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def _mended(body: str | None) -> dict | None:
    """A mapping from JSON that may have trailing commas, raw line ends in strings, or be cut off."""
    if body is None:
        return None
    tries = [body, re.sub(r",\s*([}\]])", r"\1", body), re.sub(r",\s*([}\]])", r"\1", body.replace("\r", " ").replace("\n", " "))]
    for x in tries:
        try:
            found = json.loads(x, strict=False)
        except ValueError:
            continue
        while isinstance(found, dict) and len(found) == 1 and isinstance(next(iter(found.values())), dict):  # a wrapper such as {"report": {...}}
            found = next(iter(found.values()))
        return found if isinstance(found, dict) else None
    return None


def report_value(text: str | None) -> dict | None:
    """title, summary, rating, rating_explanation, findings of a reply, with the types they should have; null without a mapping."""
    if text is None:
        return None
    bare = re.sub(r"```(?:json)?", "", re.sub(r"(?s)<think>.*?</think>\s*", "", text))
    found = _mended(bare[bare.find("{") : bare.rfind("}") + 1] if "{" in bare and "}" in bare else None)
    if found is None:
        return None
    as_text = lambda k: "" if found.get(k) is None else str(found[k])
    m = re.search(r"-?\d+(?:\.\d+)?", as_text("rating"))
    findings = found.get("findings") or []
    pairs = [{"summary": str(x.get("summary", "")), "explanation": str(x.get("explanation", ""))} if isinstance(x, dict) else {"summary": str(x), "explanation": ""} for x in (findings if isinstance(findings, list) else [findings])]
    return {"title": as_text("title"), "summary": as_text("summary"), "rating": float(m[0]) if m else 0.0, "rating_explanation": as_text("rating_explanation"), "findings": pairs}


def parse_report(reply: Column | str) -> Column:
    """A struct of REPORT. Sound JSON is read by Spark; the mending UDF is for the rest."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if (v := report_value(t)) is None else json.dumps(v))

    return F.from_json(F.pandas_udf(run, "string")(_c(reply)), REPORT)


def parse_points(reply: Column | str) -> Column:
    """The points (description, score) of a reply of the map step, by built-in functions; an empty array where there are none."""
    kind = "points array<struct<description: string, score: double>>"
    return F.coalesce(F.from_json(json_body(reply), kind)["points"], F.array().cast("array<struct<description: string, score: double>>"))


def model_endpoint(model: Column | str) -> Column:
    """`endpoint|model` as a struct; without a bar the endpoint is null."""
    parts = F.split(_c(model), r"\|", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, parts[0]).alias("endpoint"), F.when(two, F.try_element_at(parts, F.lit(2))).otherwise(_c(model)).alias("model"))


def substituted(text: str, environment: Mapping[str, str]) -> str:
    """${NAME} and ${NAME:-default} replaced; an unset name without a default is an empty text."""
    return re.sub(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", lambda m: environment.get(m[1]) or m[2] or "", text)


def merged_types(existing: list[str], proposed: list[str], most: int = 15) -> list[str]:
    """Existing types first, then proposed ones, each once in clean form, at most `most` of them (never fewer than the existing ones)."""
    clean = lambda x: re.sub(r"\s+", "_", x.strip().upper())
    old = list(dict.fromkeys(clean(x) for x in existing if x.strip()))
    return list(dict.fromkeys([*old, *(clean(x) for x in proposed if x.strip())]))[: max(most, len(old))]


def merged_maps(old: Column | str, new: Column | str) -> Column:
    """Both maps in one; keys that both have take the new value."""
    o, n = _c(old), _c(new)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def prompt(name: str, builtin: Mapping[str, str], overrides: Mapping[str, str] | None = None, **values: str) -> str:
    """A prompt of the registry, overridden by name, with {values} filled in; unknown braces stay."""
    template = (overrides or {}).get(name) or builtin[name]
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)
