"""The record types of the engine as Spark types, the values of its enumerations, and their JSON Schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations as users see them.
BUILD_STATUS = ("built", "unbuilt", "error", "rebuild")
CONFIDENCE = ("high", "medium", "low")
LANGUAGES = ("TypeScript", "Rust", "Go", "Python", "Java", "Kotlin", "Scala", "CSharp", "Swift", "Cpp", "PHP", "Ruby")
LANGUAGE_LABELS = {"CSharp": "C#", "Cpp": "C++"}
VISIBILITY = ("public", "private", "protected", "internal", "crate", "unknown")
INTERFACE_KINDS = ("interface", "trait", "protocol", "abstract_class", "pure_virtual", "module")
SERVICE_KINDS = ("http_controller", "grpc_service", "graphql_resolver", "worker", "microservice", "cli_command", "event_handler", "middleware", "repository")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
EXPORT_KINDS = ("named", "default", "re_export")
SCHEMA_KINDS = ("validation_schema", "orm_model", "data_transfer", "domain_event")
ENTITY_KINDS = ("interface", "service", "class", "function", "schema", "impl", "type_alias", "method")
SEVERITIES = ("warn", "fail")
MATCH_STRATEGIES = ("file_path", "import_graph", "name_match")
MANIFEST_STATUS = ("built", "rebuild", "new", "boilerplate")
CONNECTION_TYPES = ("depends_on", "uses", "triggers")

SPAN = "struct<start_line: int, start_col: int, end_line: int, end_col: int, byte_range: struct<start: bigint, end: bigint>>"
PARAMETER = "struct<name: string, type_annotation: string, is_optional: boolean, has_default: boolean, is_rest: boolean>"
PROPERTY = "struct<name: string, type_annotation: string, is_optional: boolean, is_readonly: boolean, visibility: string>"
SIGNATURE = f"struct<name: string, span: {SPAN}, is_async: boolean, parameters: array<{PARAMETER}>, return_type: string, has_default: boolean>"
METHOD = (
    f"struct<name: string, file: string, span: {SPAN}, visibility: string, is_async: boolean, is_static: boolean, is_generator: boolean, parameters: array<{PARAMETER}>, return_type: string, "
    "decorators: array<string>, owner: string, implements: string>"
)
INTERFACE = (
    f"struct<name: string, file: string, span: {SPAN}, visibility: string, generics: array<string>, extends: array<string>, methods: array<{SIGNATURE}>, properties: array<{PROPERTY}>, "
    "language_kind: string, decorators: array<string>>"
)
ROUTE = "struct<method: string, path: string, handler: string>"
SERVICE = f"struct<name: string, file: string, span: {SPAN}, kind: string, methods: array<{METHOD}>, dependencies: array<string>, decorators: array<string>, routes: array<{ROUTE}>>"
CLASS = (
    f"struct<name: string, file: string, span: {SPAN}, visibility: string, generics: array<string>, extends: string, implements: array<string>, methods: array<{METHOD}>, properties: array<{PROPERTY}>, "
    "is_abstract: boolean, decorators: array<string>>"
)
FUNCTION = f"struct<name: string, file: string, span: {SPAN}, visibility: string, is_async: boolean, is_generator: boolean, parameters: array<{PARAMETER}>, return_type: string, decorators: array<string>>"
ALIAS = f"struct<name: string, file: string, span: {SPAN}, target: string, generics: array<string>, visibility: string>"
SYMBOL = "struct<name: string, alias: string, is_default: boolean, is_namespace: boolean>"
IMPORT = f"struct<source: string, symbols: array<{SYMBOL}>, is_wildcard: boolean, span: {SPAN}>"
EXPORT = f"struct<name: string, kind: string, source: string, span: {SPAN}>"
IMPL = f"struct<target: string, trait_name: string, file: string, span: {SPAN}, methods: array<{METHOD}>>"
FIELD = "struct<name: string, type_annotation: string, is_optional: boolean, is_primary_key: boolean, constraints: array<string>>"
SCHEMA = f"struct<name: string, file: string, span: {SPAN}, kind: string, fields: array<{FIELD}>, source_framework: string, table_name: string, derives: array<string>, visibility: string>"

#: The nine entity arrays of a file, by column.
ENTITIES = {
    "interfaces": INTERFACE, "services": SERVICE, "classes": CLASS, "functions": FUNCTION, "type_aliases": ALIAS, "imports": IMPORT, "exports": EXPORT,
    "implementations": IMPL, "schemas": SCHEMA,
}
IR_FILE = "path string, language string, content_hash string, build_status string, confidence string, " + ", ".join(f"{k} array<{v}>" for k, v in ENTITIES.items())


def ir_type() -> T.StructType:
    return T.StructType.fromDDL(IR_FILE)


def confidence(build_status: Column) -> Column:
    """built gives high, error medium, unbuilt and rebuild low; anything else null."""
    return F.when(build_status == "built", "high").when(build_status == "error", "medium").when(build_status.isin("unbuilt", "rebuild"), "low")


def status_of_manifest(status: Column) -> Column:
    """The build status that a manifest's status, in any case, stands for."""
    plain = F.lower(status)
    return F.when(plain == "built", "built").when(plain == "rebuild", "rebuild").when(plain.isin("new", "boilerplate"), "unbuilt")


def json_schema(kind: T.DataType, title: str | None = None) -> dict:
    """A draft-07 JSON Schema of a Spark type."""
    simple = {"string": "string", "boolean": "boolean", "integer": "integer", "long": "integer", "double": "number", "float": "number"}
    if isinstance(kind, T.StructType):
        out: dict = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable]}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = {"type": "string", "format": "date-time"}
    else:
        out = {"type": simple.get(kind.typeName(), "string")}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": title, **out} if title else out
