"""Hand-written catalog entries that replace discovered ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERRIDE_SCHEMA = (
    "actor string, message string, arity int, slot0 string, slot1 string, comment string"
)

# Comments of the default overrides.
_COMPLEX = "This type is very complex."
_ABOUT_MESSAGE = "message with complex type for about: page"
_ABOUT_QUERY = "query message with complex type for about: page"

# Fixed values: (actor, message, slots, comment).
_MESSAGES = [
    ("BrowserToolboxDevToolsProcess", "DevToolsProcessChild:packet", ["any"], _COMPLEX),
    ("BrowserToolboxDevToolsProcess", "DevToolsProcessChild:targetAvailable", ["any"], _COMPLEX),
    ("BrowserToolboxDevToolsProcess", "DevToolsProcessChild:targetDestroyed", ["any"], _COMPLEX),
    ("DevToolsProcess", "DevToolsProcessChild:packet", ["any"], _COMPLEX),
    ("DevToolsProcess", "DevToolsProcessChild:targetAvailable", ["any"], _COMPLEX),
    ("DevToolsProcess", "DevToolsProcessChild:targetDestroyed", ["any"], _COMPLEX),
    (
        "Conduits",
        "APICall",
        ["any"],
        "This type is very complex, and we're not logging it.",
    ),
    (
        "Conduits",
        "RunListener",
        [None, "undefined | structuredClone | Array<undefined | structuredClone>"],
        "This message is very frequent and boring, so we don't log it.",
    ),
    (
        "ExtensionContent",
        "Execute",
        [None, "Array<any>"],
        "Return values from extension scripts.",
    ),
    ("TestProcessTypeCheck", "Test", ["{ good: boolean }"], "Weird test actor"),
    ("TestProcessTypeCheck", "GetTestCount", ["undefined", "never"], "Weird test actor"),
    (
        "ReportBrokenSite",
        "GetWebCompatInfo",
        [None, "any"],
        "The message reply contains complex about:support-like information.",
    ),
    (
        "MessageHandlerFrame",
        "MessageHandlerFrameChild:messageHandlerEvent",
        [
            "{ contextInfo: { contextId: number; type: string }; data: any; "
            "name: string; sessionId: string; }"
        ],
        "The data field for this WebDriver actor is very complex.",
    ),
    (
        "MessageHandlerFrame",
        "MessageHandlerFrameParent:sendCommand",
        [None, "any"],
        "This WebDriver message is very complex.",
    ),
    (
        "UserCharacteristics",
        "UserCharacteristics::PageReady",
        [
            "{ debug: Array<string>; gamepads: Array<string>; "
            "output: Map<string, string | number | boolean>; }"
        ],
        "TEMP: See bug 1932495.",
    ),
    ("AboutNewTab", "ActivityStream:ContentToMain", ["any"], _ABOUT_MESSAGE),
    ("AboutPrivateBrowsing", "IsPromoBlocked", ["any", None], _ABOUT_QUERY),
    ("AboutWelcome", "AWPage:ADD_SCREEN_IMPRESSION", ["any", None], _ABOUT_QUERY),
    ("AboutWelcome", "AWPage:EVALUATE_SCREEN_TARGETING", ["any", None], _ABOUT_QUERY),
    ("AboutWelcomeShopping", "AWPage:ADD_SCREEN_IMPRESSION", ["any", None], _ABOUT_QUERY),
    ("AboutWelcomeShopping", "AWPage:EVALUATE_SCREEN_TARGETING", ["any", None], _ABOUT_QUERY),
]

# Actors with one type for everything, (actor, type, comment).
_WHOLE_ACTORS = [
    (
        "AboutPocket",
        "any",
        "Tests for this actor don't actually go through IPC, so we can't infer types.",
    ),
    ("MarionetteCommands", "any", "actor with complex types only used for automation"),
    ("ASRouter", "any", "actor with complex types for about: page"),
    ("AppTestDelegate", "testOnly", ""),
    ("BrowserTestUtils", "testOnly", ""),
    ("DocShellHelpers", "testOnly", ""),
    ("FissionTestHelper", "testOnly", ""),
    ("ForceRefresh", "testOnly", ""),
    ("ReftestFission", "testOnly", ""),
    ("SpecialPowers", "testOnly", ""),
    ("StartupContentSubframe", "testOnly", ""),
    ("TestProcessActor", "testOnly", ""),
    ("TestWindow", "testOnly", ""),
]


def override_rows():
    """The default overrides as rows of ``OVERRIDE_SCHEMA``."""
    messages = [
        (actor, message, len(slots), slots[0], slots[1] if len(slots) > 1 else None, comment)
        for actor, message, slots, comment in _MESSAGES
    ]
    whole = [(actor, None, 1, t, None, comment) for actor, t, comment in _WHOLE_ACTORS]
    return messages + whole


def read_overrides(spark: SparkSession, source=None) -> DataFrame:
    """Overrides from rows, from JSON files, or the default ones.

    A row without a message overrides the whole actor; a null slot keeps the
    discovered type.  Slots hold type text, read by ``operators.catalog``.
    """
    if isinstance(source, str):
        df = spark.read.schema(OVERRIDE_SCHEMA).json(source)
    else:
        rows = override_rows() if source is None else list(source)
        df = spark.createDataFrame(rows, OVERRIDE_SCHEMA)
    return df.withColumn("comment", F.coalesce("comment", F.lit("")))
