"""The property graph's contract: labels, keys, relationships, their properties. One place; everything else derives from it."""

from __future__ import annotations

import json

VERSION = "1.0.0"
SPAN = "start_line integer, end_line integer"
ENTRY = "framework string, detection_source string, route_path string, http_methods string[], entrypoint_count integer"
FLAGS = "is_exported boolean, is_ambient boolean"

# Label, merge label, key, properties.
NODES = {
    "Application": ("Application", "name", "name string, schema_version string"),
    "Module": ("Module", "file_key", "file_key string, module_name string, is_tsx boolean, is_declaration_file boolean, content_hash string, last_modified integer, file_size integer, _module string"),
    "Class": ("Symbol", "signature", f"signature string, name string, code string, base_classes string[], implements_types string[], type_parameter_names string[], docstring string, is_abstract boolean, {FLAGS}, {SPAN}, {ENTRY}, _module string"),
    "Interface": ("Symbol", "signature", f"signature string, name string, code string, base_classes string[], type_parameter_names string[], call_signatures string[], index_signatures string[], docstring string, {FLAGS}, {SPAN}, _module string"),
    "Enum": ("Symbol", "signature", f"signature string, name string, code string, member_names string[], member_values string[], docstring string, is_const boolean, {FLAGS}, {SPAN}, _module string"),
    "TypeAlias": ("Symbol", "signature", f"signature string, name string, code string, aliased_type string, type_parameter_names string[], docstring string, {FLAGS}, {SPAN}, _module string"),
    "Namespace": ("Symbol", "signature", f"signature string, name string, docstring string, {FLAGS}, {SPAN}, _module string"),
    "Callable": ("Symbol", "signature", f"signature string, name string, path string, kind string, return_type string, cyclomatic_complexity integer, code string, code_start_line integer, {SPAN}, accessibility string, accessor_kind string, docstring string, type_parameter_names string[], parameters_json string, accessed_symbols_json string, is_static boolean, is_abstract boolean, is_async boolean, is_generator boolean, is_optional boolean, is_readonly boolean, {FLAGS}, is_implicit boolean, {ENTRY}, _module string"),
    "External": ("Symbol", "signature", "signature string, name string, module string"),
    "AnonymousCallable": ("Symbol", "signature", "signature string, name string, path string, start_line integer, start_column integer, _module string"),
    "Package": ("Package", "name", "name string"),
    "Decorator": ("Decorator", "qualified_name", "qualified_name string, name string"),
    "CallSite": ("CallSite", "id", "id string, method_name string, receiver_expr string, receiver_type string, argument_types string[], type_arguments string[], return_type string, callee_signature string, is_constructor_call boolean, is_optional_chain boolean, start_line integer, start_column integer, end_line integer, end_column integer, _module string"),
    "Attribute": ("Attribute", "id", f"id string, name string, type string, initializer string, accessibility string, docstring string, is_static boolean, is_readonly boolean, is_optional boolean, is_abstract boolean, {SPAN}, _module string"),
    "Variable": ("Variable", "id", f"id string, name string, type string, initializer string, scope string, declaration_kind string, is_readonly boolean, is_exported boolean, {SPAN}, _module string"),
}
DECLARED = "Class Interface Enum TypeAlias Namespace Callable"
# Type, from, to, properties.
RELATIONSHIPS = {
    "HAS_MODULE": ("Application", "Module", ""),
    "DECLARES": ("Module Namespace Class Callable", DECLARED, ""),
    "HAS_METHOD": ("Class Interface", "Callable", ""),
    "HAS_ATTRIBUTE": ("Class Interface", "Attribute", ""),
    "DECLARES_VAR": ("Module Namespace Callable", "Variable", ""),
    "HAS_CALLSITE": ("Callable", "CallSite", ""),
    "RESOLVES_TO": ("CallSite", "Callable External", ""),
    "CALLS": ("Callable", "Callable External", "weight integer, provenance string[], dispatch string, external boolean, module string"),
    "EXTENDS": ("Class Interface", "Class Interface", ""),
    "IMPLEMENTS": ("Class", "Interface", ""),
    "IMPORTS": ("Module", "Module Package", "imported_names string[], import_kinds string[], is_type_only boolean"),
    "RE_EXPORTS": ("Module", "Module Package", ""),
    "MEMBER_OF": ("External", "Package", ""),
    "DECORATED_BY": ("Class Callable Attribute", "Decorator", "positional_arguments string[], keyword_arguments_json string, start_line integer, end_line integer"),
}
MARKERS = ["Entrypoint"]
# Further indexes, as statements.
INDEXES = [
    "CREATE INDEX callable_name IF NOT EXISTS FOR (c:Callable) ON (c.name)",
    "CREATE INDEX decorator_name IF NOT EXISTS FOR (d:Decorator) ON (d.name)",
    "CREATE FULLTEXT INDEX code_fts IF NOT EXISTS FOR (c:Callable) ON EACH [c.code, c.docstring]",
]


def properties(text: str) -> dict[str, str]:
    return dict(p.split(" ") for p in text.split(", ")) if text else {}


def merge_label(label: str) -> str:
    return NODES[label][0]


def constraints() -> list[tuple[str, str]]:
    """Unique (merge label, key), derived from the labels."""
    return sorted({(m, k) for m, k, _ in NODES.values()})


def as_dict() -> dict:
    return {
        "schema_version": VERSION,
        "node_labels": [{"label": n, "merge_label": m, "key": k, "properties": properties(p)} for n, (m, k, p) in NODES.items()],
        "marker_labels": MARKERS,
        "relationship_types": [{"type": t, "from": a.split(), "to": b.split(), "properties": properties(p)} for t, (a, b, p) in RELATIONSHIPS.items()],
        "constraints": [f"{m}.{k} is unique" for m, k in constraints()],
        "indexes": INDEXES,
    }


def as_json() -> str:
    return json.dumps(as_dict(), indent=2) + "\n"
