"""Explicit schemas of the relations; nothing is inferred. A null Boolean means that there is no evidence."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = "struct<path:string,line:int,column:int>"

TABLES: dict[str, str] = {
    "symbols": f"ordinal long, usr string, name string, kind string, module string, location {LOCATION}, parentUSR string, isExternal boolean, accessibility string, attributes array<string>, compilerUnitTest boolean",
    "references": f"ordinal long, sourceUSR string, targetUSR string, kind string, location {LOCATION}, targetKind string, origin string, position string, receiverTypeUSR string",
    "parameters": f"usr string, name string, module string, location {LOCATION}, functionUSR string, isReferenced boolean",
    "property_accesses": "usr string, hasRead boolean, hasWrite boolean, hasAmbiguous boolean",
    "imports": f"modulePath array<string>, scopedKind string, isConditional boolean, isReexported boolean, isIgnored boolean, isIgnoredOnlyByFileComment boolean, fileHasConditionalCompilation boolean, location {LOCATION}",
    "file_module_usages": "path string, owningModule string, referencedModules array<string>, hasUnattributedReferences boolean",
    "file_dates": "path string, latest timestamp, oldest timestamp",
    "enum_inventories": f"path string, enumUSR string, caseUSRs array<string>, location {LOCATION}, complete boolean, limitations array<string>",
    "enum_decisions": f"path string, kind string, location {LOCATION}, endLocation {LOCATION}, enumUSR string, ownerUSR string, explicitCaseUSRs array<string>, guardedCaseUSRs array<string>, operationTargetUSRs array<string>, evidenceLocations array<{LOCATION}>, status string, limitations array<string>",
    "nodes": f"id string, name string, kind string, module string, usr string, location {LOCATION}, accessibility string, attributes array<string>, isExternal boolean",
    "edges": "source string, target string, kind string, weight long",
    "findings": f"ruleIdentifier string, severity string, message string, location {LOCATION}, subject string, details array<string>",
    "layers": "ordinal int, name string, patterns array<string>, match_on array<string>",
    "rules": "ordinal int, name string, `from` string, allow array<string>, deny array<string>, severity string",
    "runtime_contracts": "id string, source string, target string, mechanism string, requiredScenarios array<string>, expectedValue string",
    "runtime_observations": "contract string, scenario string, outcome string, value string",
    "trace_events": "ordinal int, api string, phase string, name string, result boolean, receiverClass string, receiverIsClass boolean, callerSymbol string, callerImage string, callerOffset decimal(20,0), calleeSymbol string, calleeImage string, dispatchUncertain boolean",
    "route_calls": f"method string, channel string, isDynamic boolean, channelPrefix string, pathAnchor string, authority string, service string, queryTailStripped boolean, maskedSegments int, isTestSource boolean, limitation string, location {LOCATION}",
}

#: Declaration order is the rank.
EDGE_KINDS = ("call", "reference", "inheritance", "conformance", "extends", "overrides", "member", "import", "retention")
USAGE_KINDS = tuple(k for k in EDGE_KINDS if k != "member")
SOURCE_KINDS = tuple(k for k in USAGE_KINDS if k != "retention")
CYCLE_KINDS = tuple(k for k in EDGE_KINDS if k not in ("member", "retention"))
TYPE_KINDS = ("class", "struct", "enum", "protocol", "extension", "typealias", "associatedtype")
ACCESS_RANK = {"private": 0, "fileprivate": 1, "internal": 2, "package": 3, "public": 4, "open": 5}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name])
