"""Features that users add: by name, in the order they were added, looked up before the built-in ones are asked."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


class Registry:
    """Named functions from a table and its settings to a table with more columns."""

    def __init__(self, kind: str) -> None:
        self.kind, self._known = kind, {}

    def add(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """As a decorator: a name that is taken is an error."""

        def put(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self._known:
                raise ValueError(f"there is a {self.kind} {name!r} already")
            self._known[name] = function
            return function

        return put

    def __getitem__(self, name: str) -> Callable[..., DataFrame]:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self._known)}")
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)

    def apply(self, df: DataFrame, names: list[str], lenient: bool = False, **settings: object) -> DataFrame:
        """The named functions in the given order, each on what the one before gave. lenient: unknown names are left out
        with a warning."""
        for name in names:
            if lenient and name not in self._known:
                log.warning("no %s %r, it is left out", self.kind, name)
                continue
            df = self[name](df, **settings)
        return df


NODE_PROPERTIES, NODE_TRANSFORMS, EDGE_PROPERTIES, NORMALISERS = (Registry(k) for k in ("node property", "node transform", "edge property", "normaliser"))


def _built_in() -> None:
    from trackweave.operators import crops, edges, nodes, predictions

    NODE_PROPERTIES.add("shapes")(crops.shapes)
    NODE_TRANSFORMS.add("aspect_ratio")(nodes.aspect_ratio)
    EDGE_PROPERTIES.add("relative_size")(edges.relative_size)
    EDGE_PROPERTIES.add("intensity_mean_diff")(edges.intensity_difference)
    NORMALISERS.add("sigmoid")(predictions.with_sigmoid)
    NORMALISERS.add("softmax")(predictions.with_softmax)


_built_in()
