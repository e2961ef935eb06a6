"""Codes, labels and schemas of the catalog, the announcements and the personal state."""

from __future__ import annotations

from pyspark.sql import types as T

STATUSES = ("released", "upcoming", "development")
SHELVES = ("interested", "playing", "finished", "paused")
DIMENSIONS = ("gameplay", "story", "visuals", "music")
SIGNALS = ("official", "interview")
SCORE_MODES = ("initial", "expected")
OFFICIAL_KINDS = ("announcement", "date_change", "interview")
KINDS = (*OFFICIAL_KINDS, "event_preview")

# The labels that users of the product see.
STATUS_LABELS = {"released": "已发售", "upcoming": "待发售", "development": "开发中"}
SHELF_LABELS = {"interested": "想玩", "playing": "在玩", "finished": "已通关", "paused": "搁置"}
SCORE_MODE_LABELS = {"initial": "初始参考", "expected": "期待值"}
WISHLIST_LABEL = "愿望单"
OWN_SCORES_LABEL = "我的评分"
TBA, OUT_NOW, TODAY = "TBA", "OUT NOW", "TODAY"

#: Platform codes of the derived catalog, and their labels by rule.
PLATFORM_LABELS = {a + b: f"{a}-{b}" for a in "ANR" for b in "FO"}

SCORES = T.StructType([T.StructField(d, T.DecimalType(3, 1)) for d in DIMENSIONS])
STATE = T.StructType([
    T.StructField("wishlist", T.ArrayType(T.StringType())),
    T.StructField("shelf", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ratings", T.MapType(T.StringType(), SCORES)),
    T.StructField("notes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt", T.StringType()),
])
EVENTS = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampNTZType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])
