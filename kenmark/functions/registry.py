"""Pluggable comparators and weights, resolved when a plan is built.

A registry is immutable; ``with_*`` and ``without_*`` return another one. A comparator is
a function of two Columns and the path that gives a Column; a pandas UDF wrapped in such a
function works too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column

from kenmark.functions.similarity import DECAY_TAU_MS, folded_similarity, is_finite_positive, jaccard, same_text, screen_similarity
from kenmark.schema import DEFAULT_WEIGHT, FINGERPRINT, WEIGHTS

Comparator = Callable[[Column, Column, str], Column]


def _of_two(f: Callable[[Column, Column], Column]) -> Comparator:
    return lambda a, b, path: f(a, b)


def default_comparators() -> dict[str, Comparator]:
    return dict(_DEFAULT)  # the same functions each time, so that registries can be compared


def _made() -> dict[str, Comparator]:
    lists = {name: _of_two(partial(jaccard, kind=FINGERPRINT[name].dataType)) for name in ("fonts", "languages", "plugins", "mimeTypes")}
    texts = {name: _of_two(folded_similarity) for name in ("userAgent", "platform")}
    digests = {name: _of_two(same_text) for name in ("canvas", "webgl", "audio")}
    return lists | texts | digests | {"screen": _of_two(screen_similarity)}


_DEFAULT = _made()


@dataclass(frozen=True)
class Registry:
    comparators: Mapping[str, Comparator] = field(default_factory=default_comparators)
    weights: Mapping[str, float] = field(default_factory=dict)
    default_weight: float = DEFAULT_WEIGHT

    @classmethod
    def empty(cls) -> Registry:
        return cls({}, {})

    def with_comparator(self, path: str, comparator: Comparator) -> Registry:
        if not callable(comparator):
            raise TypeError(f"the comparator of {path} must be callable")
        return replace(self, comparators={**self.comparators, path: comparator})

    def with_weight(self, path: str, weight: float) -> Registry:
        if not is_finite_positive(weight):
            raise ValueError(f"the weight of {path} must be a number of at least 0")
        return replace(self, weights={**self.weights, path: weight})

    def with_plugin(self, path: str, comparator: Comparator | None = None, weight: float | None = None) -> Registry:
        changed = self.with_comparator(path, comparator) if comparator is not None else self
        return changed.with_weight(path, weight) if weight is not None else changed

    def with_default_weight(self, weight: float) -> Registry:
        """Kept for introspection; scoring takes the default weight of its options."""
        return replace(self, default_weight=max(0.0, weight))

    def without_comparator(self, path: str) -> Registry:
        return replace(self, comparators={k: v for k, v in self.comparators.items() if k != path})

    def without_weight(self, path: str) -> Registry:
        return replace(self, weights={k: v for k, v in self.weights.items() if k != path})


@dataclass(frozen=True)
class ScoringOptions:
    """How two fingerprints are compared.

    Weights here win over the built-in ones, which win over the registry's. ``stabilities``
    and ``field_stabilities`` are Columns of maps from field to stability: the first scales
    dimensions, the second the weights of fields. ``age`` is a Column of milliseconds.
    """

    weights: Mapping[str, float] = field(default_factory=dict)
    comparators: Mapping[str, Comparator] = field(default_factory=dict)
    default_weight: float = DEFAULT_WEIGHT
    tlsh_weight: float = 0.3
    max_depth: int = 5
    registry: Registry = field(default_factory=Registry)
    attractor_model: Callable[[Column], Column] | None = None
    stabilities: Column | None = None
    field_stabilities: Column | None = None
    age: Column | None = None
    decay_tau_ms: float = DECAY_TAU_MS

    def comparator(self, path: str) -> Comparator | None:
        return self.comparators.get(path) or self.registry.comparators.get(path)

    def weight(self, path: str) -> float:
        return float({**self.registry.weights, **WEIGHTS, **self.weights}.get(path, self.default_weight))
