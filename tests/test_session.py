"""Sessions, workspaces and descriptions of resources."""

from __future__ import annotations

import logging

import pytest

from lumenframe.operators import network as net
from lumenframe.operators.dataset import Dataset
from lumenframe.plans.resource import Resource
from lumenframe.plans.session import Session, factory
from lumenframe.sources import networks, systems, tables


def test_resources_check_types():
    r = Resource(name="one", branch="b", version=3, about="x")
    assert r.fullname == r.get("fullname") == "one.b.3" and r.get() == {"name": "one", "branch": "b", "version": 3, "about": "x"}
    assert r.set(branch=None, version=None).fullname == "one" and "license" in Resource.keys()
    for bad in ({"name": 3}, {"version": "3"}, {"version": True}, {"path": 1.5}):
        with pytest.raises(TypeError):
            r.set(**bad)
    with pytest.raises(KeyError):
        r.get("colour")
    with pytest.raises(KeyError):
        r.set(colour="red")


@pytest.fixture(scope="module")
def bases(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bases")
    for base, names in (("user", ("one", "two")), ("site", ("two",)), ("empty", ())):
        (root / base).mkdir()
        for w in names:
            for folder in ("datasets", "networks", "systems"):
                (root / base / w / folder).mkdir(parents=True)
            (root / base / w / "workspace.ini").write_text("[workspace]\nmaintainer = me\n")
    here = root / "user" / "one"
    (here / "datasets" / "plain.csv").write_text("# name = other\n# about = some rows\n# version = 2\n,a,b\nr1,1,2\n")
    (here / "datasets" / "plain.wide.csv").write_text(",a\nr1,1\n")
    tables.write_dataset(Dataset({"t": spark.createDataFrame([("r", 1.5)], "label string, a double").repartition(2)}), str(here / "datasets" / "parts.csv"))
    g = net.build(spark, [net.Layer("i", ("a", "b")), net.Layer("o", ("c",))])
    networks.write_network(g, str(here / "networks" / "small.gml"))
    networks.write_network(g, str(here / "networks" / "bound.bundle"))
    (here / "systems" / "ann.ini").write_text("[system]\ntype = ann.ANN\n")
    return {b: str(root / b) for b in ("user", "site", "empty")}


def test_session_verbs(spark, bases, caplog):
    s = Session(spark, bases)
    assert s.list("workspaces") == {"user": ["one", "two"], "site": ["two"], "empty": []} and s.list("bases") == ["empty", "site", "user"]
    with pytest.raises(ValueError, match="no workspace"):
        s.list()
    with pytest.raises(ValueError, match="2 search paths"):
        s.open("two")
    assert s.open("two", "site").get("base") == "site" and s.list("datasets") == []
    s.set("workspace", "one")
    assert (s.get(), s.get("base")) == ("one", "user")
    assert s.list() == {"datasets": ["parts", "plain", "plain.wide"], "networks": ["bound", "small"], "systems": ["ann"], "models": [], "scripts": []}
    assert s.get("path", "dataset", "plain.wide").endswith("plain.wide.csv")
    assert s.get("dataset", "plain").get() == {"name": "other", "about": "some rows", "version": 2, "path": s.path("dataset", "plain")}
    with caplog.at_level(logging.DEBUG, logger="lumenframe"):
        s.log("shown")
        s.set("mode", "silent")
        s.log("hidden")
        s.log("loud", "error")
    assert [r.message for r in caplog.records] == ["shown", "loud"]
    for bad in (lambda: s.set("mode", "loud"), lambda: s.log("x", "shout"), lambda: s.list_workspaces("no")):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: s.get("colour"), lambda: s.set("colour", 1), lambda: s.list("colours")):
        with pytest.raises(KeyError):
            bad()
    s.close()
    assert s.get() is None and s.get("types")["network"] == ["base.Network", "layer.Factor", "layer.MultiLayer", "layer.Shallow"]


def test_objects_by_name(spark, bases):
    s = Session(spark, bases).open("one")
    assert [tuple(r) for r in next(iter(s.load("dataset", "plain").tables.values())).collect()] == [("r1", 1.0, 2.0)]
    assert s.load("dataset", "parts").tables["t"].first()["a"] == 1.5
    assert s.load("dataset", f"{bases['user']}/one/datasets/plain.wide.csv").tables["plain.wide"].columns == ["label", "a"]
    assert s.load("network", "small").edges.count() == s.load("network", "bound").edges.count() == 2
    assert s.load("system", "ann")["type"] == "ann.ANN"
    with pytest.raises(ValueError, match="not in the workspace"):
        s.load("dataset", "nothing")
    with pytest.raises(ValueError):
        s.load("script", "x")
    with pytest.raises(ValueError):
        systems.read_any(spark, "x.npz")


def test_factories(spark):
    assert factory("network", "layer.Factor")(spark).nodes.count() == 6
    assert Session(spark, {}).create("system", "rbm.RBM", ["visible:a"], 2).mapping == ("visible", "hidden")
    for kind, name in (("network", "layer.Round"), ("planet", "x.Y")):
        with pytest.raises(ValueError):
            factory(kind, name)
