"""How generic a fingerprint is: the built-in estimate and one from population frequencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.similarity import present, score, total
from kenmark.functions.text import strip
from kenmark.schema import COMMON_BROWSERS, COMMON_HARDWARE, COMMON_LANGUAGES, COMMON_RESOLUTIONS, ENTROPY_FIELDS, MOBILE_MARKS

Model = Callable[[Column], Column]


def _lower(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _number(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")).try_cast("double"), F.lit(0.0))


def _resolution(fp: Column) -> Column:
    w, h = fp["screen"]["width"], fp["screen"]["height"]
    return F.when((w != 0) & (h != 0), F.concat_ws("x", w.cast("string"), h.cast("string"))).otherwise("")


def signals(fp: Column) -> dict[str, Column]:
    """The six signs of a generic profile, each true or false."""
    agent = _lower(fp["userAgent"])
    return {
        "platform": _lower(fp["platform"]).contains("win") | _any([agent.contains(m) for m in MOBILE_MARKS]),
        "language": _lower(fp["language"]).isin(COMMON_LANGUAGES),
        "browser": _any([agent.contains(m) for m in COMMON_BROWSERS]),
        "resolution": _resolution(fp).isin(COMMON_RESOLUTIONS),
        "hardware": _number(fp["hardwareConcurrency"]).isin(COMMON_HARDWARE) & _number(fp["deviceMemory"]).isin(COMMON_HARDWARE),
        "entropy": ~_any([present(fp[f], T.StringType()) for f in ENTROPY_FIELDS]),
    }


def attractor_risk(fp: Column) -> Column:
    """The share of the signs that hold, 0 to 100."""
    return score(total([s.cast("int") for s in signals(fp).values()]) / 6 * 100)


def frequency_model(
    platforms: Mapping[str, float] | None = None,
    languages: Mapping[str, float] | None = None,
    browsers: Mapping[str, float] | None = None,
    resolutions: Mapping[str, float] | None = None,
    hardware: Sequence[tuple[float, float, float]] | None = None,
) -> Model:
    """A model from population frequencies; what a table lacks falls back to the built-in sign.

    The first entry that fits decides: platforms and browsers by substring, languages by
    equality or by either being a '-' prefix of the other, resolutions as '<w>x<h>',
    hardware as (cores, memory, frequency).
    """

    def model(fp: Column) -> Column:
        agent, language, size = _lower(fp["userAgent"]), _lower(fp["language"]), _resolution(fp)
        cores, memory = _number(fp["hardwareConcurrency"]), _number(fp["deviceMemory"])
        spoken = lambda k: (language == k) | language.startswith(f"{k}-") | F.lit(k).startswith(F.concat(language, F.lit("-")))
        rules = {
            "platform": [(_lower(fp["platform"]).contains(k.lower()), v) for k, v in (platforms or {}).items()],
            "language": [(spoken(k.lower()), v) for k, v in (languages or {}).items()],
            "browser": [(agent.contains(k.lower()), v) for k, v in (browsers or {}).items()],
            "resolution": [((size == k) & (size != ""), v) for k, v in (resolutions or {}).items()],
            "hardware": [((cores == c) & (memory == m), v) for c, m, v in hardware or ()],
            "entropy": [],
        }
        parts = []
        for name, sign in signals(fp).items():
            value = sign.cast("double")
            for condition, frequency in reversed(rules[name]):
                value = F.when(condition, float(frequency)).otherwise(value)
            parts.append(value)
        return score(total(parts) / 6 * 100)

    return model
