"""A session over workspaces: search paths of folders, of which one workspace is open, and objects by kind and name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lumenframe
from lumenframe.operators import network as net
from lumenframe.operators import train
from lumenframe.plans import model
from lumenframe.plans.resource import Resource
from lumenframe.sources import networks, systems, tables, workspace

MODES = ("debug", "exec", "shell", "silent")
#: Fixed value: the file that makes a folder a workspace.
WORKSPACE_FILE = "workspace.ini"
#: Type names `module.Class` of objects, and what builds them.
TYPES: dict[str, dict[str, Callable[..., Any]]] = {
    "dataset": {"base.Dataset": tables.Dataset},
    "network": {"base.Network": net.build, "layer.MultiLayer": net.multilayer, "layer.Shallow": net.shallow, "layer.Factor": net.factor},
    "system": {"ann.ANN": net.shallow, "dbn.DBN": net.multilayer, "rbm.RBM": train.rbm, "rbm.GRBM": train.rbm},
    "model": {"base.Model": model.create},
}
_LOG = logging.getLogger("lumenframe")


def factory(kind: str, type_name: str) -> Callable[..., Any]:
    """The builder of a type of objects, by `module.Class`."""
    if kind not in TYPES:
        raise ValueError(f"unknown kind {kind!r}")
    if type_name not in TYPES[kind]:
        raise ValueError(f"unknown {kind} type {type_name!r}")
    return TYPES[kind][type_name]


class Session:
    """bases: names and folders of search paths; a workspace is a folder in one of them that holds a workspace file."""

    def __init__(self, spark: SparkSession, bases: dict[str, str], mode: str = "exec"):
        self.spark, self.bases = spark, {k: v.rstrip("/") for k, v in bases.items()}
        self._mode, self._workspace, self._base = "exec", None, None
        self.set("mode", mode)

    # -- verbs

    def open(self, name: str, base: str | None = None) -> Session:
        """Make a workspace the current one. Without a base, only one search path may have it."""
        found = [b for b in ([base] if base else self.list_bases(name)) if name in self.list_workspaces(b)]
        if len(found) != 1:
            raise ValueError(f"workspace {name!r} is in {len(found)} search paths")
        self._workspace, self._base = name, found[0]
        return self

    def close(self) -> None:
        self._workspace = self._base = None

    def get(self, key: str = "workspace", *args: str) -> Any:
        """about, base, bases, list, mode, path, types or workspace; or the description of an object by its kind and name."""
        if key == "about":
            return (lumenframe.__doc__ or "").strip()
        if key in ("base", "mode", "workspace"):
            return getattr(self, f"_{key}")
        if key == "bases":
            return dict(self.bases)
        if key == "list":
            return self.list(*args)
        if key == "path":
            return self.path(*args)
        if key == "types":
            return {k: sorted(v) for k, v in TYPES.items()}
        if key in workspace.FOLDERS:
            return self.describe(key, *args)
        raise KeyError(f"unknown key {key!r}")

    def set(self, key: str, value: Any) -> None:
        """mode, or workspace (None closes it)."""
        if key == "mode":
            if value not in MODES:
                raise ValueError(f"unknown mode {value!r}")
            self._mode = value
        elif key == "workspace":
            self.close() if value is None else self.open(value)
        else:
            raise KeyError(f"unknown key {key!r}")

    def log(self, message: str, kind: str = "info") -> None:
        """info and notes go unsaid in silent mode, info in shell mode as well; debug has a level of its own."""
        levels = {"debug": logging.DEBUG, "info": logging.INFO, "note": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR}
        if kind not in levels:
            raise ValueError(f"unknown kind of message {kind!r}")
        if kind == "info" and self._mode in ("silent", "shell") or kind == "note" and self._mode == "silent" or kind == "debug" and self._mode != "debug":
            return
        _LOG.log(levels[kind], message)

    def create(self, kind: str, type_name: str, *args: Any, **kwargs: Any) -> Any:
        return factory(kind, type_name)(*args, **kwargs)

    # -- listings

    def list_workspaces(self, base: str | None = None) -> list[str]:
        """Names of the workspaces of a search path, or of all; listed by Spark on any file system."""
        if base is not None and base not in self.bases:
            raise ValueError(f"unknown search path {base!r}")
        names: set[str] = set()
        for folder in [self.bases[base]] if base else self.bases.values():
            try:
                files = self.spark.read.format("binaryFile").load(f"{folder}/*/{WORKSPACE_FILE}").select(F.element_at(F.split("path", "/"), -2).alias("name"))
                names |= {r["name"] for r in files.collect()}
            except AnalysisException:  # no workspace there
                continue
        return sorted(names)

    def list_bases(self, name: str | None = None) -> list[str]:
        """Search paths, or those that have a workspace of this name."""
        return sorted(b for b in self.bases if name is None or name in self.list_workspaces(b))

    def catalog(self) -> DataFrame:
        """All objects of the open workspace (workspace.catalog)."""
        if self._workspace is None:
            raise ValueError("no workspace is open")
        return workspace.catalog(self.spark, f"{self.bases[self._base]}/{self._workspace}", self._workspace)

    def list(self, key: str | None = None) -> Any:
        """workspaces, bases, or full names of the objects of a kind (`datasets`); without a key, of all kinds."""
        if key == "workspaces":
            return {b: self.list_workspaces(b) for b in sorted(self.bases)}
        if key == "bases":
            return self.list_bases()
        rows = self.catalog().select("kind", "name", "branch").distinct().collect()
        by_kind = {f"{k}s": sorted(Resource(name=r["name"], branch=r["branch"] or None).fullname for r in rows if r["kind"] == k) for k in workspace.FOLDERS}
        if key is None:
            return by_kind
        if key not in by_kind:
            raise KeyError(f"unknown key {key!r}")
        return by_kind[key]

    def path(self, kind: str, name: str) -> str:
        return workspace.find(self.catalog(), kind, name)

    def describe(self, kind: str, name: str) -> Resource:
        """What is known of an object without reading its rows: names from the path, the rest from the header of its file."""
        path = self.path(kind, name)
        stem, _, ending = PurePosixPath(path).name.rpartition(".")
        known: dict[str, object] = {"name": stem.partition(".")[0], "branch": stem.partition(".")[2] or None, "path": path}
        if kind == "dataset" and tables.READABLE.get(ending) == "delimited":
            meta = tables.read_metadata(self.spark, path)
            known |= {k: v for k, v in meta.items() if k in Resource.keys() and k not in ("fullname", "path") and v is not None}
        return Resource(**known)

    def load(self, kind: str, name: str) -> Any:
        """An object by its bare name, or by its path if it has an ending that can be read."""
        known = {"dataset": tables.READABLE, "network": networks.READABLE, "system": dict.fromkeys(workspace.SYSTEM_TYPES), "model": {"bundle": ""}}
        if kind not in known:
            raise ValueError(f"can't load a {kind}")
        path = name if "/" in name and PurePosixPath(name).suffix.lstrip(".").lower() in known[kind] else self.path(kind, name)
        return {"dataset": tables.read_dataset, "network": networks.read_network, "system": systems.read_any, "model": model.load}[kind](self.spark, path)
