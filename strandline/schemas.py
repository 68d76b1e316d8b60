"""Schemas and closed vocabularies of the file graph, the symbol graph and their side tables."""

from __future__ import annotations

FILE_NODES = (
    "id string, t string, k string, s string, g array<string>, h string, "
    "a array<struct<name:string,line:int>>, st string, w int, by string, ts bigint"
)
FILE_EDGES = "src string, type string, dst string, meta map<string,string>"
SYM_NODES = (
    "id string, kind string, lang string, path string, name string, "
    "span struct<sl:int,sb:int,el:int,eb:int>, sigHash string, confidence string, sig string, "
    "exported boolean, decorators array<string>, summary string"
)
SYM_EDGES = "src string, dst string, type string, label string, confidence string, f string"
DEF = (
    "struct<key:string,kind:string,name:string,sl:int,sb:int,el:int,eb:int,sig:string,sigHash:string,exported:boolean,"
    "decorators:array<string>,summary:string,paramTokens:array<string>,ownerKey:string,receiverType:string,ifaceMethods:array<string>>"
)
FACTS = (
    "path string, lang string, hash string, size bigint, lineCount int, moduleSummary string, packageName string, "
    f"namespace string, testFramework boolean, defs array<{DEF}>, "
    "imports array<struct<spec:string,level:int,ns:string,defaultAlias:string,wildcard:boolean,static:boolean,"
    "segments:array<string>,names:array<struct<name:string,alias:string>>>>, "
    "reexports array<struct<spec:string,wildcard:boolean,entries:array<struct<exported:string,origin:string>>>>, "
    "calls array<struct<head:string,prop:string,selfRef:boolean,isNew:boolean,sb:int,defKey:string,calleeText:string>>, "
    "heritage array<struct<defKey:string,rel:string,name:string>>, "
    "routes array<struct<verb:string,path:string,sl:int,sb:int,el:int,eb:int,confidence:string,defKey:string>>, "
    "locals array<struct<name:string,sb:int>>"
)
LEDGER = (
    "seq bigint, v int, op string, kind string, key string, nodeId string, path string, name string, text string, "
    "span struct<sl:int,el:int>, fromKey string, toKey string, fromNodeId string, toNodeId string, fromPath string, "
    "toPath string, fromSpan struct<sl:int,el:int>, toSpan struct<sl:int,el:int>"
)
GIT_STATE = "path string, state string"
ISSUES = (
    "number int, title string, state string, labels array<string>, assignees array<string>, body string, url string, "
    "updatedAt timestamp, blockedBy array<int>, subs array<int>"
)

NODE_PREFIX = {"file": "f", "mod": "m", "sym": "y", "concept": "c", "adr": "d", "entry": "e", "note": "n", "issue": "i", "skill": "k"}
FILE_EDGE_TYPES = ("imports", "exports", "part-of", "tested-by", "documents", "calls", "blocks", "closes", "mentions", "relates", "implements")
SYM_PREFIX = {
    "function": "fn", "method": "method", "class": "cls", "interface": "iface", "type": "type",
    "enum": "enum", "module": "mod", "route": "route", "impl": "imp", "symbol": "sym",
}
SYM_EDGE_TYPES = ("call", "import", "contains", "route", "extends", "implements", "tests")
IMPACT_TYPES = ("call", "import", "route", "extends", "implements")
FLOW_TYPES = ("imports", "calls")
SCAN_OWNED = ("imports", "part-of", "tested-by", "documents")
GIT_RANK = {"pushed": 0, "unpushed": 1, "staged": 2, "modified": 3, "untracked": 4, "conflicted": 5}
CHECK_RANK = {"drift": 3, "dangling": 2, "orphan": 1, "ambiguous": 1}
CONFIDENCE_RANK = {"exact": 2, "heuristic": 1, "rough": 1}
