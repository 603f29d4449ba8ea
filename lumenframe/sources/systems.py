"""System files: sectioned text with training schedules, and parquet bundles of parameters."""

from __future__ import annotations

import ast
import configparser

import numpy as np
from pyspark.sql import SparkSession

from lumenframe.operators.system import System, Units
from lumenframe.sources.networks import read_text


def read_system_config(spark: SparkSession, path: str) -> dict[str, object]:
    """name, type and schedules: schedule name to system type to settings (see train.Schedule.from_settings)."""
    config = configparser.ConfigParser(interpolation=None, strict=False)
    config.optionxform = str
    config.read_string(read_text(spark, path))
    out: dict[str, object] = dict(config["system"]) if config.has_section("system") else {}
    schedules: dict[str, dict] = {}
    for section in config.sections():
        if section.startswith("schedule "):
            blocks = {}
            for key, value in config[section].items():
                blocks[key.removeprefix("system ").strip()] = _settings(value)
            schedules[section.split(" ", 1)[1].strip()] = blocks
    return out | {"schedules": schedules}


def _settings(text: str) -> dict[str, object] | str:
    """Settings as a dictionary or as `name = value` with commas between; values are literals. Other text stays."""
    if text.strip().startswith("{"):
        return ast.literal_eval(text.strip())
    if "=" not in text:
        return text
    call = ast.parse(f"_({text.strip()})", mode="eval").body
    return {k.arg: ast.literal_eval(k.value) for k in call.keywords}


def write_system(spark: SparkSession, system: System, path: str) -> None:
    """Units and links as parquet tables."""
    system.units_table(spark).write.mode("overwrite").parquet(f"{path}/units")
    system.links_table(spark).write.mode("overwrite").parquet(f"{path}/links")


def read_system(spark: SparkSession, path: str, name: str = "system") -> System:
    layers: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/units").orderBy("layer_id", "idx").collect():
        layers.setdefault(r["layer_id"], []).append(r)
    units = tuple(
        Units(rs[0]["layer"], tuple(r["unit"] for r in rs), rs[0]["class"], rs[0]["visible"], np.array([r["bias"] for r in rs]), np.array([r["lvar"] for r in rs])) for _, rs in sorted(layers.items())
    )
    at = {c: (k, j) for k, u in enumerate(units) for j, c in enumerate(u.columns)}
    shapes = [(len(a.labels), len(b.labels)) for a, b in zip(units, units[1:], strict=False)]
    weights, adjacency = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for r in spark.read.parquet(f"{path}/links").collect():
        (k, i), (_, j) = at[r["src"]], at[r["dst"]]
        weights[k][i, j], adjacency[k][i, j] = r["weight"], r["adjacency"]
    return System(units, tuple(weights), tuple(adjacency), name)


def read_any(spark: SparkSession, path: str) -> System | dict[str, object]:
    """By the ending of a path: the settings of a sectioned file, or the system of a bundle."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("ini", "txt"):
        return read_system_config(spark, path)
    if ending == "bundle":
        return read_system(spark, path)
    raise ValueError(f"unknown file type {ending!r}")
