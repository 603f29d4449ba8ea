"""Models: a dataset, a network and a system, with their life cycle configure, initialise, optimise, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lumenframe.functions import registry
from lumenframe.operators import network as net
from lumenframe.operators import relations, train
from lumenframe.operators import system as sysm
from lumenframe.operators.dataset import Dataset
from lumenframe.operators.network import Network
from lumenframe.operators.system import System
from lumenframe.operators.train import Schedule
from lumenframe.sources.networks import read_network, write_network
from lumenframe.sources.systems import read_system, write_system
from lumenframe.sources.tables import read_bundle, write_bundle


@dataclass(frozen=True)
class Model:
    dataset: Dataset
    network: Network
    system: System | None = None
    preprocessing: dict[str, str] = field(default_factory=dict)
    name: str = "model"

    def configure(self) -> Model:
        """Bind dataset columns to the visible nodes and derive the system's layers from the network."""
        layers: dict[str, list[str]] = {}
        for r in self.network.nodes.where("visible").orderBy("node_order").collect():
            layers.setdefault(r["layer"], []).append(r["label"])
        return replace(self, dataset=self.dataset.configure(layers), system=sysm.from_network(self.network))

    def initialize(self, sigma: float = 0.1, seed: int = 0) -> Model:
        """Prepare the data, as configured or as the input layer asks for, and draw parameters from its moments."""
        if self.system is None:
            raise ValueError("the model is not configured")
        steps = self.preprocessing or {"normalize": self.system.layers[0].kind}
        dataset = self.dataset.initialize(steps)
        return replace(self, dataset=dataset, system=sysm.initialize(self.system, dataset.rows(), sigma, seed))

    def check(self) -> bool:
        """Whether the data suit the kind of the input layer: binary for sigmoid units, normalised for gauss units."""
        name = "binary" if self.system.layers[0].kind == "sigmoid" else "gauss"
        return bool(self.dataset.evaluate(name, self.system.layers[0].columns).first()["ok"])

    def optimize(self, schedule: Schedule) -> Model:
        """Train, then write the weights to the network's edges. A deep network with mirrored layers is pretrained."""
        fit = train.fit_deep if schedule.options.get("pretrain") else train.fit
        system = fit(self.dataset.rows(), self.system, schedule)
        spark = self.network.nodes.sparkSession
        return replace(self, system=system, network=replace(self.network, edges=net.push_weights(self.network.edges, system.links_table(spark).select("src", "dst", "weight"))))

    def evaluate(self, what: str, name: str, **kwargs) -> DataFrame:
        """dataset, network, system, units or relations, by the name of an algorithm."""
        rows = self.dataset.rows() if what in ("system", "units", "relations") else None
        if what == "dataset":
            return self.dataset.evaluate(name, **kwargs)
        if what == "network":
            return net.evaluate(self.network, name, **kwargs)
        if what == "units":
            return registry.get("unit_measure", name)(rows, self.system, **kwargs)
        if what == "system":
            return sysm.energy(rows, self.system) if name == "energy" else sysm.measure(rows, self.system, name, **kwargs)
        if what == "relations":
            if name == "weightsumproduct":
                return relations.evaluate(name, self.system.links_table(self.network.nodes.sparkSession), **kwargs)
            return relations.evaluate(name, rows, self.system, **kwargs)
        raise ValueError(f"unknown part {what!r}")

    @property
    def error(self) -> float:
        return self.evaluate("system", "error").first()["value"]

    @property
    def accuracy(self) -> float:
        return self.evaluate("system", "accuracy").first()["value"]

    @property
    def precision(self) -> float:
        return self.evaluate("system", "precision").first()["value"]

    def save(self, path: str) -> None:
        write_bundle(self.dataset, f"{path}/dataset")
        write_network(self.network, f"{path}/network", "bundle")
        if self.system is not None:
            write_system(self.network.nodes.sparkSession, self.system, f"{path}/system")


def load(spark: SparkSession, path: str) -> Model:
    return Model(read_bundle(spark, f"{path}/dataset"), read_network(spark, f"{path}/network", "bundle"), read_system(spark, f"{path}/system"))


def create(dataset: Dataset, network: Network, preprocessing: dict[str, str] | None = None, seed: int = 0) -> Model:
    """A configured and initialised model."""
    return Model(dataset, network, preprocessing=preprocessing or {}).configure().initialize(seed=seed)


def autoencoder(spark: SparkSession, dataset: Dataset, shape: tuple[int, ...] | None = None, seed: int = 0) -> Model:
    """A model that learns its columns by themselves."""
    return create(dataset, net.autoencoder(spark, list(dataset.columns), shape), seed=seed)
