"""Fixed values of the log format and of the type language.

They have to equal those of the programs that write the logs and read the
catalog, so they are stated here as plain data.
"""

# Log modules whose lines are records.
LOG_MODULES = [
    "JSIPCValSend",
    "JSIPCValRecv",
    "JSIPCTypeSend",
    "JSIPCTypeRecv",
    "JSIPCTypeChecking",
    "JSIPCTypeMemory",
    "JSIPCSerializer",
]
TYPE_MODULE = "JSIPCTypeSend"
SERIALIZER_MODULE = "JSIPCSerializer"

# Kind word -> kind code, and the name a kind is reported under.
KIND_CODES = {"Message": 0, "Query": 1, "QueryResolve": 2, "QueryReject": 3}
KIND_LABELS = {
    0: "sendAsyncMessage()",
    1: "sendQuery()",
    2: "query reply",
    3: "query reject",
}

# Raw types that stand for "nothing logged" and "typing failed".
NO_VALUE = "NO VALUE"
FAILED = "FAILED"

# Type words.
PRIMITIVES = [
    "undefined",
    "string",
    "null",
    "boolean",
    "number",
    "structuredClone",
    "nsIPrincipal",
    "BrowsingContext",
    "DOMRect",
]
WILDCARDS = ["any", "never", "testOnly"]
CONTAINERS = ["Array", "Set", "Map"]

# Fixed patterns. A message name may start with neither a digit, '-' nor ':';
# the class holds the range '$' to ':' and so also % & ' ( ) * + , . /
IDENTIFIER = r"(?!\d)[\w$]+"
MESSAGE_NAME = r"(?![\d\-:])[\w$-:]+"

# Actors that may log a reject type without a resolve type.
REJECT_ONLY_ACTORS = ["TestWindow", "TestProcessActor"]

# Rules dropped by default, one list per log format.
TYPE_EXCLUSIONS = [("Conduits", "CreateProxyContext", 1)]
VALUE_EXCLUSIONS = [("DevToolsFrame", "DevToolsFrameChild:packet", None)]
