"""Seeded synthetic fingerprints and labelled pairs, generated where the rows are needed."""

from __future__ import annotations

import copy
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.schema import FINGERPRINT

Record = dict

# Plausible profiles to draw from.
SYSTEMS = [("Win32", "Windows NT 10.0; Win64; x64", "Windows"), ("MacIntel", "Macintosh; Intel Mac OS X 10_15_7", "macOS"), ("Linux x86_64", "X11; Linux x86_64", "Linux")]
LOCALES = [["en-US", "en"], ["en-GB", "en"], ["de-DE", "de", "en"], ["fr-FR", "fr", "en"], ["es-ES", "es"], ["pt-BR", "pt"], ["zh-CN", "zh"]]
ZONES = ["Europe/Berlin", "Europe/London", "America/New_York", "America/Sao_Paulo", "Asia/Tokyo", "Australia/Perth"]
SCREENS = [(1920, 1080), (2560, 1440), (1366, 768), (1536, 864), (1440, 900), (3840, 2160)]
READERS = ["Portable Viewer", "Page Reader", "Document Pane"]
FONTS = [f"{a} {b}" for a in ("Alder", "Birch", "Cedar", "Elm", "Hazel", "Linden", "Maple", "Oak", "Rowan", "Willow", "Yew") for b in ("Sans", "Serif", "Mono")]


def _digest(rng: random.Random) -> str:
    return f"{rng.getrandbits(60):012x}"


def set_version(record: Record, major: int) -> None:
    """Another browser version, wherever the record states it."""
    system = next(s for p, s, _ in SYSTEMS if p == record["platform"]) if any(p == record["platform"] for p, _, _ in SYSTEMS) else "Mobile"
    record["appVersion"] = f"5.0 ({system}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{major}.0.0.0 Safari/537.36"
    record["userAgent"] = "Mozilla/" + record["appVersion"]
    if record["highEntropyValues"]:
        record["highEntropyValues"]["uaFullVersion"] = f"{major}.0.{6000 + major}.10"
        record["highEntropyValues"]["brands"] = [{"brand": "Chromium", "version": str(major)}, {"brand": "Not A Brand", "version": "99"}]


def base(seed: int) -> Record:
    """An ordinary desktop browser; the same seed gives the same record."""
    rng = random.Random(seed)
    platform, _, system = rng.choice(SYSTEMS)
    locale, (w, h) = rng.choice(LOCALES), rng.choice(SCREENS)
    readers = rng.sample(READERS, rng.randint(0, 2))
    record = dict.fromkeys(FINGERPRINT.fieldNames())
    record |= {
        "platform": platform,
        "timezone": rng.choice(ZONES),
        "language": locale[0],
        "languages": list(locale),
        "cookieEnabled": rng.random() < 0.97,
        "doNotTrack": "1" if rng.random() < 0.15 else "false",
        "hardwareConcurrency": rng.choice([2, 4, 6, 8, 12, 16, 24]),
        "deviceMemory": str(rng.choice([2, 4, 8, 16, 32])),
        "product": "Gecko",
        "productSub": "20030107",
        "vendor": "Example Inc.",
        "vendorSub": "",
        "appName": "Netscape",
        "appCodeName": "Mozilla",
        "plugins": [{"name": r, "description": "Portable documents"} for r in readers],
        "mimeTypes": [{"type": "application/pdf", "suffixes": "pdf", "description": "Portable documents"}] if readers else [],
        "screen": {"width": w, "height": h, "colorDepth": 24, "pixelDepth": 24, "orientation": {"type": "landscape-primary", "angle": 0}},
        "fonts": rng.sample(FONTS, rng.randint(8, 18)),
        "canvas": _digest(rng),
        "webgl": _digest(rng),
        "audio": _digest(rng),
        "highEntropyValues": {"architecture": "x86", "bitness": "64", "brands": [], "mobile": False, "model": "", "platform": system, "platformVersion": "10.0", "uaFullVersion": ""},
    }
    set_version(record, rng.randint(112, 130))
    return record


def common(seed: int) -> Record:
    """A profile that many devices share, without digests of their own."""
    record = base(seed)
    record |= {"platform": "Win32", "language": "en-US", "languages": ["en-US", "en"], "hardwareConcurrency": 8, "deviceMemory": "8", "canvas": None, "webgl": None, "audio": None, "fonts": FONTS[:8], "plugins": [], "mimeTypes": [], "timezone": "UTC", "doNotTrack": "false", "cookieEnabled": True}
    record["screen"] |= {"width": 1920, "height": 1080}
    record["highEntropyValues"] |= {"platform": "Windows"}
    set_version(record, 124)
    return record


def mutate(record: Record, strength: float, seed: int) -> Record:
    """A copy in which about ``strength`` of the drifting members changed."""
    rng, out = random.Random(seed), copy.deepcopy(record)
    other = base(seed + 1_000_003)
    for name in ("timezone", "doNotTrack", "deviceMemory", "hardwareConcurrency", "screen", "fonts", "canvas", "webgl", "audio", "plugins", "mimeTypes", "languages", "language"):
        if rng.random() < strength:
            out[name] = other[name]
    if rng.random() < strength * 2:
        set_version(out, rng.randint(112, 130))
    return out


def _changed(**members: object) -> Callable[[Record, random.Random], Record]:
    def change(record: Record, rng: random.Random) -> Record:
        return record | {k: v(record, rng) if callable(v) else v for k, v in members.items()}

    return change


def _version(step: int) -> Callable[[Record, random.Random], Record]:
    def change(record: Record, rng: random.Random) -> Record:
        set_version(record, 130 + step)
        return record

    return change


def _other(offset: int, *kept: str) -> Callable[[Record, random.Random], Record]:
    def change(record: Record, rng: random.Random) -> Record:
        return base(rng.randrange(10**6) + offset) | {k: record[k] for k in kept}

    return change


def _both(*steps: Callable) -> Callable[[Record, random.Random], Record]:
    def change(record: Record, rng: random.Random) -> Record:
        for step in steps:
            record = step(record, rng)
        return record

    return change


_new = lambda r, rng: _digest(rng)
_fonts = lambda r, rng: sorted(set(FONTS) - set(r["fonts"]))[: len(r["fonts"])]
_more_fonts = lambda r, rng: r["fonts"] + [x for x in FONTS if x not in r["fonts"]][:2]
_phone = _changed(platform="iPhone", hardwareConcurrency=4, deviceMemory="4")
_docked = lambda r, rng: r["screen"] | {"width": 2560, "height": 1440}
_zone = lambda r, rng: rng.choice([z for z in ZONES if z != r["timezone"]])

#: name -> (record of the seed, its change, whether both are one device, whether it is a common profile)
SCENARIOS: dict[str, tuple[Callable[[int], Record], Callable[[Record, random.Random], Record], bool, bool]] = {
    "browser-drift:minor": (base, _version(1), True, False),
    "browser-drift:major": (base, _both(_version(9), _changed(plugins=[], mimeTypes=[], fonts=_more_fonts)), True, False),
    "browser-drift:cross-browser": (base, _other(9000, "platform", "screen", "hardwareConcurrency", "deviceMemory"), False, False),
    "environment-change:home-office": (base, _changed(), True, False),
    "environment-change:external-dock": (base, _changed(screen=_docked), True, False),
    "environment-change:mobile-desktop": (base, _both(_other(7000), _phone), False, False),
    "privacy-resistance:tor": (common, _changed(webgl=_new), False, True),
    "privacy-resistance:resistant-browser": (common, _changed(), False, True),
    "privacy-resistance:canvas-defender": (base, _changed(canvas=_new, webgl=_new), True, False),
    "adversarial-perturbation:canvas-noise": (base, _changed(canvas=_new, webgl=_new), True, False),
    "adversarial-perturbation:font-randomization": (base, _changed(fonts=_fonts, plugins=[], mimeTypes=[]), True, False),
    "adversarial-perturbation:ua-rotation": (base, _both(_version(4), _changed(vendor="Other Inc.", product="Other", productSub="1")), True, False),
    "travel-network-change:timezone-travel": (base, _changed(timezone=_zone), True, False),
    "travel-network-change:vpn-activation": (base, _changed(), True, False),
    "commodity-collision:corporate-fleet": (common, _changed(fonts=_more_fonts, hardwareConcurrency=4), False, True),
    "commodity-collision:iphone-defaults": (lambda seed: _phone(base(seed), random.Random(seed)), _both(_other(5000), _phone), False, True),
    "commodity-collision:public-terminal": (common, _changed(), False, True),
    "antifingerprint:metadock-balanced": (base, _changed(canvas=_new), True, False),
    "antifingerprint:metadock-max": (base, _both(_version(3), _changed(canvas=_new, webgl=_new, fonts=_fonts, plugins=[], mimeTypes=[], doNotTrack="1")), True, False),
}

PAIR = T.StructType(
    [T.StructField("scenario", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("f", FINGERPRINT), T.StructField("g", FINGERPRINT), T.StructField("same_device", T.BooleanType()), T.StructField("is_attractor", T.BooleanType())]
)


def scenario_pairs(spark: SparkSession, seeds: int = 50) -> DataFrame:
    """(scenario, seed, f, g, same_device, is_attractor): one pair per scenario and seed."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for seed in frame["id"].tolist():
                for place, (name, (start, change, same, attractor)) in enumerate(SCENARIOS.items()):
                    first = start(seed * 100 + place)
                    second = change(copy.deepcopy(first), random.Random(f"{name}/{seed}"))
                    rows.append((name, seed, first, second, same, attractor))
            yield pd.DataFrame(rows, columns=PAIR.fieldNames())

    return spark.range(seeds).mapInPandas(make, PAIR)


def dataset(spark: SparkSession, devices: int, sessions: int, strength: float = 0.1) -> DataFrame:
    """(id, device_label, is_attractor, fingerprint): sessions of devices, every fifth device a common profile."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("device_label", T.StringType()), T.StructField("is_attractor", T.BooleanType()), T.StructField("fingerprint", FINGERPRINT)])

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for device in frame["id"].tolist():
                shared = device % 5 == 0
                first = (common if shared else base)(device)
                for k in range(sessions):
                    rows.append((f"{device}/{k}", f"d{device}", shared, mutate(first, strength if k else 0.0, device * 1000 + k)))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return spark.range(devices).mapInPandas(make, schema)


def score_table(scored: DataFrame) -> str:
    """The mean scores per scenario as text."""
    rows = scored.groupBy("scenario").agg(F.round(F.avg("score"), 2).alias("avg"), F.min("score").alias("min"), F.max("score").alias("max")).orderBy("avg").collect()
    width = max([8, *(len(r["scenario"]) for r in rows)])
    return "\n".join([f"{'scenario':<{width}}    avg  min  max", *(f"{r['scenario']:<{width}} {r['avg']:6.2f} {r['min']:4d} {r['max']:4d}" for r in rows)])
