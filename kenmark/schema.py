"""The fingerprint record: its scored fields in their order, weights and comparators."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXTS = ["product", "productSub", "vendor", "vendorSub", "appName", "appVersion", "appCodeName", "appMinorVersion", "buildID"]

SCREEN = _struct(width=_I, height=_I, colorDepth=_I, pixelDepth=_I, orientation=_struct(type=_S, angle=_I))
HIGH_ENTROPY = _struct(architecture=_S, bitness=_S, brands=T.ArrayType(_struct(brand=_S, version=_S)), mobile=_B, model=_S, platform=_S, platformVersion=_S, uaFullVersion=_S)
BEHAVIOUR = _struct(
    mouse=_struct(sampleCount=_I, avgVelocityPxMs=_D, velocityStdDev=_D, straightnessRatio=_D, avgAcceleration=_D, hasMovement=_B),
    keyboard=_struct(keystrokeCount=_I, avgDwellMs=_D, dwellStdDev=_D, avgFlightMs=_D, flightStdDev=_D, estimatedWpm=_D),
    scroll=_struct(eventCount=_I, avgVelocityPxMs=_D, velocityStdDev=_D, directionChangeCount=_I, totalDistancePx=_D),
    session=_struct(sessionDurationMs=_I, timeToFirstInteractionMs=_I, interactionEventCount=_I, touchEventCount=_I),
    collectionDurationMs=_I,
    hasTouchEvents=_B,
)

FINGERPRINT = _struct(
    userAgent=_S,
    platform=_S,
    timezone=_S,
    language=_S,
    languages=T.ArrayType(_S),
    cookieEnabled=_B,
    doNotTrack=_S,
    hardwareConcurrency=_I,
    deviceMemory=_S,
    **dict.fromkeys(_TEXTS, _S),
    plugins=T.ArrayType(_struct(name=_S, description=_S)),
    mimeTypes=T.ArrayType(_struct(type=_S, suffixes=_S, description=_S)),
    screen=SCREEN,
    fonts=T.ArrayType(_S),
    canvas=_S,
    webgl=_S,
    audio=_S,
    highEntropyValues=HIGH_ENTROPY,
    behavioralMetrics=BEHAVIOUR,
)

#: The member that is neither scored nor hashed.
VOLATILE = "behavioralMetrics"
FIELDS = [f.name for f in FINGERPRINT.fields if f.name != VOLATILE]

# Base weight of every scored field, in field order.
WEIGHTS = {
    "userAgent": 10,
    "platform": 20,
    "timezone": 10,
    "language": 15,
    "languages": 20,
    "cookieEnabled": 5,
    "doNotTrack": 5,
    "hardwareConcurrency": 5,
    "deviceMemory": 5,
    "product": 5,
    "productSub": 5,
    "vendor": 5,
    "vendorSub": 5,
    "appName": 5,
    "appVersion": 5,
    "appCodeName": 5,
    "appMinorVersion": 5,
    "buildID": 5,
    "plugins": 15,
    "mimeTypes": 15,
    "screen": 10,
    "fonts": 15,
    "canvas": 30,
    "webgl": 25,
    "audio": 25,
    "highEntropyValues": 20,
}
#: Weight of every other path, such as screen.width.
DEFAULT_WEIGHT = 5.0

STABLE_FIELDS = ["screen", "hardwareConcurrency", "deviceMemory", "platform", "highEntropyValues"]
ENTROPY_FIELDS = ["canvas", "webgl", "audio"]

# Profiles so common that many devices share them.
COMMON_RESOLUTIONS = ["1920x1080", "1366x768", "1280x800", "390x844"]
COMMON_LANGUAGES = ["en", "en-us", "zh-cn"]
COMMON_BROWSERS = ["chrome/", "firefox/", "safari/"]
COMMON_HARDWARE = [4, 8]
MOBILE_MARKS = ["android", "iphone", "ipad"]

SNAPSHOT = T.StructType(
    [
        T.StructField("snapshot_id", _S),
        T.StructField("device_id", _S),
        T.StructField("user_id", _S),
        T.StructField("ts", T.TimestampType()),
        T.StructField("fingerprint", FINGERPRINT),
        T.StructField("ip", _S),
        T.StructField("signals_hash", _S),
        T.StructField("metadata", T.MapType(_S, _S)),
        T.StructField("match_confidence", _I),
    ]
)

DIMENSIONS = ["deviceSimilarity", "evidenceRichness", "fieldAgreement", "structuralStability", "entropyContribution", "attractorRisk", "missingOneSide", "missingBothSides"]
SCORES = [*DIMENSIONS, "composite"]
