"""What a resource (dataset, network, system, model) says of itself, with checked types."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Resource:
    name: str | None = None
    branch: str | None = None
    version: int | None = None
    type: str | None = None
    about: str | None = None
    author: str | None = None
    email: str | None = None
    license: str | None = None
    path: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value, kind = getattr(self, f.name), int if f.name == "version" else str
            if value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
                raise TypeError(f"{f.name} is of type {type(value).__name__}, not {kind.__name__}")

    @property
    def fullname(self) -> str:
        """Name, branch and version, as far as they are set."""
        return ".".join(str(x) for x in (self.name, self.branch, self.version) if x)

    @staticmethod
    def keys() -> list[str]:
        return sorted([*(f.name for f in fields(Resource)), "fullname"])

    def get(self, key: str | None = None) -> object:
        """One value, or all that are set."""
        if key is None:
            return {k: v for k, v in asdict(self).items() if v is not None}
        if key not in self.keys():
            raise KeyError(f"key {key!r} is not valid")
        return getattr(self, key)

    def set(self, **values: object) -> Resource:
        if unknown := [k for k in values if k not in {f.name for f in fields(self)}]:
            raise KeyError(f"key {unknown[0]!r} is not valid")
        return replace(self, **values)
