"""The configuration as plain objects, checked before anything is read (gate G0).

``load`` collects every finding instead of stopping at the first, so a
configuration can be put right in one go.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from tablewright import names
from tablewright.errors import ConfigValidationError, ErrorDetail
from tablewright.functions.casts import CAST_TYPES
from tablewright.functions.expressions import dotted_names
from tablewright.operators.conditions import LISTS, NULL_TESTS, normalize_operator

JOIN_TYPES = ("LEFT", "INNER", "RIGHT", "OUTER")
SOURCE_TYPES = ("DIRECT", "DERIVED", "EXPRESSION")
CONNECTION_TYPES = ("LOCAL_FILE_DIRECTORY", "LOCAL_CSV_DIRECTORY")
MULTI_LINE = ("auto", "always", "never")
PUBLISH = ("auto", "rename", "in_place")


@dataclass(frozen=True)
class Predicate:
    left: str
    operator: str
    right: Any = None
    right_type: str | None = None


@dataclass(frozen=True)
class ConditionGroup:
    logic: str
    conditions: tuple[Predicate | ConditionGroup, ...]


@dataclass(frozen=True)
class ExpressionFilter:
    value: str


Condition = Predicate | ConditionGroup
Filter = Predicate | ConditionGroup | ExpressionFilter


@dataclass(frozen=True)
class FileOptions:
    """How files of a connection look. The last four are about places and sizes:

    ``max_file_size_mb`` refuses larger sources (no limit unless set). ``multi_line``
    says whether fields hold line breaks; ``auto`` finds out, ``never`` takes every line
    for a row. ``publish`` says how a target appears: by a rename of its folder, ``in_place``
    by taking a marker away, or as its file system can. ``single_file`` asks for one output
    file, which ``max_single_file_mb``
    bounds where it is set.
    """

    format: str = "CSV"
    encoding: str = "utf-8"
    delimiter: str = ","
    quote_char: str = '"'
    header_row: bool = True
    max_file_size_mb: int | None = None
    multi_line: str = "auto"
    single_file: bool = False
    max_single_file_mb: int | None = None
    publish: str = "auto"


@dataclass(frozen=True)
class Connection:
    base_path: str
    target_path: str
    file_options: FileOptions = FileOptions()
    type: str = CONNECTION_TYPES[0]


@dataclass(frozen=True)
class Table:
    """A source: ``schema`` (a Spark DDL string) spares the type inference pass."""

    connection_ref: str
    file_name: str
    alias: str
    schema: str | None = None


@dataclass(frozen=True)
class Join:
    table: Table
    join_type: str
    conditions: tuple[Condition, ...]
    pre_filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class ExpressionDerivation:
    variable_name: str
    expression: str


@dataclass(frozen=True)
class RegexpReplaceDerivation:
    variable_name: str
    source: str
    pattern: str
    replacement: str


@dataclass(frozen=True)
class CaseBranch:
    when: Condition
    then: Any


@dataclass(frozen=True)
class CaseDerivation:
    variable_name: str
    branches: tuple[CaseBranch, ...]
    otherwise: Any = None


Derivation = ExpressionDerivation | RegexpReplaceDerivation | CaseDerivation


@dataclass(frozen=True)
class Mapping:
    """A target column. ``datetime_format`` (a Spark pattern) spares the layout search."""

    target_column: str
    source_type: str
    source_value: str
    cast_to: str
    is_nullable: bool = True
    default_value: Any = None
    datetime_format: str | None = None


@dataclass(frozen=True)
class Target:
    connection_ref: str
    file_name: str


@dataclass(frozen=True)
class Blueprint:
    blueprint_id: str
    sequence_order: int
    root: Table
    target: Target
    mappings: tuple[Mapping, ...]
    joins: tuple[Join, ...] = ()
    pre_filters: tuple[Filter, ...] = ()
    derivations: tuple[Derivation, ...] = ()
    post_filters: tuple[Filter, ...] = ()

    @property
    def tables(self) -> list[Table]:
        return [self.root, *(join.table for join in self.joins)]


@dataclass(frozen=True)
class Pipeline:
    migration_id: str
    client_id: str
    version: str
    connections: dict[str, Connection]
    blueprints: tuple[Blueprint, ...]

    def in_order(self) -> list[Blueprint]:
        return sorted(self.blueprints, key=lambda blueprint: blueprint.sequence_order)

    def blueprint(self, blueprint_id: str | None = None) -> Blueprint:
        """The named blueprint, or the only one."""
        if blueprint_id is None and len(self.blueprints) == 1:
            return self.blueprints[0]
        for blueprint in self.blueprints:
            if blueprint.blueprint_id == blueprint_id:
                return blueprint
        raise ConfigValidationError(f"No blueprint named {blueprint_id!r}")

    def source_files(self) -> set[str]:
        """Names of all source files, each once."""
        return {table.file_name for blueprint in self.blueprints for table in blueprint.tables}

    def output_files(self) -> list[str]:
        """Target files in the order they are written."""
        return [blueprint.target.file_name for blueprint in self.in_order()]


def load_file(path: str) -> Pipeline:
    """Read a JSON configuration from the driver's file system."""
    if not path.lower().endswith(".json"):
        raise ConfigValidationError(f"Unsupported configuration format: {path}")
    try:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
    except FileNotFoundError as problem:
        raise ConfigValidationError(f"Configuration not found: {path}") from problem
    except ValueError as problem:
        raise ConfigValidationError(f"Configuration is not valid JSON: {problem}") from problem
    return load(content)


def load(config: dict[str, Any] | Pipeline) -> Pipeline:
    """Build and check a configuration; every finding is reported together."""
    if isinstance(config, Pipeline):
        return config
    findings: list[ErrorDetail] = []
    pipeline = _Node(config, "", findings).read(_pipeline)
    if not findings:
        findings.extend(_contradictions(pipeline))
    if findings:
        first = findings[0]
        raise ConfigValidationError(
            f"{first.message} ({first.field})" if first.field else first.message,
            migration_id=config.get("migration_id") if isinstance(config, dict) else None,
            details=findings,
        )
    return pipeline


# --- shape ---------------------------------------------------------------------


class _Node:
    """One JSON object being read; remembers which of its keys were asked for."""

    def __init__(self, raw: Any, path: str, findings: list[ErrorDetail]) -> None:
        self.raw = raw if isinstance(raw, dict) else {}
        self.path = path
        self.findings = findings
        self.asked = {"comment", "$schema"}
        if not isinstance(raw, dict):
            self.blame("must be an object")

    def blame(self, message: str, key: str | None = None) -> None:
        field = ".".join(part for part in (self.path, key) if part)
        self.findings.append(ErrorDetail(message, field or None))

    def read(self, build: Callable[[_Node], Any]) -> Any:
        result = build(self)
        for key in self.raw.keys() - self.asked:
            self.blame("unknown field", key)
        return result

    def has(self, key: str) -> bool:
        return key in self.raw

    def any(self, key: str, required: bool = False) -> Any:
        self.asked.add(key)
        if required and key not in self.raw:
            self.blame("is required", key)
        return self.raw.get(key)

    def text(self, key: str, default: str | None = None, required: bool = True, empty: bool = False) -> Any:
        found = self.any(key, required)
        if key not in self.raw:
            return default
        if not isinstance(found, str) or not (found or empty):
            self.blame("must be a non-empty text", key)
            return default
        return found

    def choice(self, key: str, options: tuple[str, ...], default: str | None = None) -> Any:
        found = self.text(key, default, required=default is None)
        if found is not None and found not in options:
            self.blame(f"must be one of {', '.join(options)}", key)
        return found

    def flag(self, key: str, default: bool | None = None) -> Any:
        found = self.any(key, default is None)
        if key in self.raw and not isinstance(found, bool):
            self.blame("must be true or false", key)
        return found if key in self.raw else default

    def whole(self, key: str, default: int | None = None, required: bool = False) -> Any:
        found = self.any(key, required)
        if key not in self.raw or (found is None and not required):
            return default
        if not isinstance(found, int) or isinstance(found, bool) or found < 1:
            self.blame("must be a whole number from 1", key)
            return default
        return found

    def child(self, key: str, build: Callable[[_Node], Any], default: Any = None) -> Any:
        found = self.any(key, default is None)
        if key not in self.raw:
            return default
        return _Node(found, self._below(key), self.findings).read(build)

    def each(self, key: str, build: Callable[[_Node], Any], at_least: int = 0) -> tuple[Any, ...]:
        found = self.any(key, at_least > 0)
        if key not in self.raw:
            return ()
        if not isinstance(found, list) or len(found) < at_least:
            self.blame(f"must be a list with at least {at_least} entries", key)
            return ()
        return tuple(
            _Node(item, f"{self._below(key)}[{i}]", self.findings).read(build) for i, item in enumerate(found)
        )

    def named(self, key: str, build: Callable[[_Node], Any]) -> dict[str, Any]:
        found = self.any(key, True)
        if not isinstance(found, dict) or not found:
            self.blame("must name at least one entry", key)
            return {}
        return {
            name: _Node(item, f"{self._below(key)}.{name}", self.findings).read(build)
            for name, item in found.items()
        }

    def _below(self, key: str) -> str:
        return f"{self.path}.{key}" if self.path else key


def _pipeline(node: _Node) -> Pipeline:
    return Pipeline(
        migration_id=node.text("migration_id"),
        client_id=node.text("client_id"),
        version=node.text("version"),
        connections=node.named("connections", _connection),
        blueprints=node.each("blueprints", _blueprint, at_least=1),
    )


def _connection(node: _Node) -> Connection:
    return Connection(
        type=node.choice("type", CONNECTION_TYPES) and CONNECTION_TYPES[0],
        base_path=node.text("base_path"),
        target_path=node.text("target_path"),
        file_options=node.child("file_options", _file_options, FileOptions()),
    )


def _file_options(node: _Node) -> FileOptions:
    standard = FileOptions()
    return FileOptions(
        format=node.text("format", standard.format, required=False),
        encoding=node.text("encoding", standard.encoding, required=False),
        delimiter=node.text("delimiter", standard.delimiter, required=False),
        quote_char=node.text("quote_char", standard.quote_char, required=False),
        header_row=node.flag("header_row", standard.header_row),
        max_file_size_mb=node.whole("max_file_size_mb"),
        multi_line=node.choice("multi_line", MULTI_LINE, standard.multi_line),
        single_file=node.flag("single_file", standard.single_file),
        max_single_file_mb=node.whole("max_single_file_mb", standard.max_single_file_mb),
        publish=node.choice("publish", PUBLISH, standard.publish),
    )


def _blueprint(node: _Node) -> Blueprint:
    root, joins = node.child("sources", lambda n: (n.child("root_table", _table), n.each("joins", _join))) or (
        None,
        (),
    )
    return Blueprint(
        blueprint_id=node.text("blueprint_id"),
        sequence_order=node.whole("sequence_order", required=True),
        root=root,
        joins=joins,
        target=node.child("target", lambda n: Target(n.text("connection_ref"), n.text("file_name"))),
        mappings=node.each("mappings", _mapping, at_least=1),
        pre_filters=node.each("pre_filters", _filter),
        derivations=node.each("derivations", _derivation),
        post_filters=node.each("post_filters", _filter),
    )


def _table(node: _Node) -> Table:
    return Table(
        connection_ref=node.text("connection_ref"),
        file_name=node.text("file_name"),
        alias=node.text("alias"),
        schema=node.text("schema", required=False),
    )


def _join(node: _Node) -> Join:
    return Join(
        table=_table(node),
        join_type=node.choice("join_type", JOIN_TYPES),
        conditions=node.each("conditions", _condition, at_least=1),
        pre_filters=node.each("pre_filters", _filter),
    )


def _condition(node: _Node) -> Condition:
    if node.has("logic") or node.has("conditions"):
        return ConditionGroup(
            logic=node.choice("logic", ("AND", "OR")),
            conditions=node.each("conditions", _condition, at_least=1),
        )
    return Predicate(
        left=node.text("left"),
        operator=node.text("operator"),
        right=node.any("right"),
        right_type=node.text("right_type", required=False),
    )


def _filter(node: _Node) -> Filter:
    if node.has("type") or node.has("value"):
        node.choice("type", ("expression",))
        return ExpressionFilter(node.text("value"))
    return _condition(node)


def _derivation(node: _Node) -> Derivation:
    name = node.text("variable_name")
    kind = node.choice("transform_type", ("EXPRESSION", "REGEXP_REPLACE", "CASE"))
    if kind == "REGEXP_REPLACE":
        return RegexpReplaceDerivation(
            name,
            node.text("source"),
            node.text("pattern", "", empty=True),
            node.text("replacement", "", empty=True),
        )
    if kind == "CASE":
        return CaseDerivation(name, node.each("branches", _branch, at_least=1), node.any("else"))
    return ExpressionDerivation(name, node.text("expression"))


def _branch(node: _Node) -> CaseBranch:
    return CaseBranch(node.child("when", _condition), node.any("then", required=True))


def _mapping(node: _Node) -> Mapping:
    return Mapping(
        target_column=node.text("target_column"),
        source_type=node.choice("source_type", SOURCE_TYPES),
        source_value=node.text("source_value"),
        cast_to=node.choice("cast_to", CAST_TYPES),
        is_nullable=node.flag("is_nullable"),
        default_value=node.any("default_value"),
        datetime_format=node.text("datetime_format", required=False),
    )


# --- meaning -------------------------------------------------------------------


def _contradictions(pipeline: Pipeline) -> Iterator[ErrorDetail]:
    """What is wrong although every field has the right shape."""
    yield from _repeated([b.blueprint_id for b in pipeline.blueprints], "Duplicate blueprint_id", "blueprints")
    yield from _repeated([b.sequence_order for b in pipeline.blueprints], "Duplicate sequence_order", "blueprints")
    for index, blueprint in enumerate(pipeline.blueprints):
        yield from _in_blueprint(pipeline, blueprint, f"blueprints[{index}]")


def _in_blueprint(pipeline: Pipeline, blueprint: Blueprint, at: str) -> Iterator[ErrorDetail]:
    for user in (*blueprint.tables, blueprint.target):
        if user.connection_ref not in pipeline.connections:
            yield ErrorDetail(f"No connection is called '{user.connection_ref}'", at)
    for table in blueprint.tables:
        if not names.ALIAS.match(table.alias):
            yield ErrorDetail(f"'{table.alias}' cannot be an alias", f"{at}.sources")
    yield from _repeated([t.alias for t in blueprint.tables], "Duplicate alias", f"{at}.sources")
    targets = [mapping.target_column for mapping in blueprint.mappings]
    yield from _repeated(targets, "Duplicate target_column", f"{at}.mappings")
    variables = [derivation.variable_name for derivation in blueprint.derivations]
    yield from _repeated(variables, "Duplicate derivation variable_name", f"{at}.derivations")

    aliases = {table.alias for table in blueprint.tables}
    for i, mapping in enumerate(blueprint.mappings):
        yield from _in_mapping(mapping, aliases, f"{at}.mappings[{i}].source_value")
    yield from _in_filters(blueprint.pre_filters, aliases, f"{at}.pre_filters")
    yield from _in_filters(blueprint.post_filters, aliases, f"{at}.post_filters", set(targets))
    for i, derivation in enumerate(blueprint.derivations):
        yield from _in_derivation(derivation, aliases, f"{at}.derivations[{i}]")
    for i, join in enumerate(blueprint.joins):
        here = f"{at}.sources.joins[{i}]"
        for j, condition in enumerate(join.conditions):
            yield from _in_condition(condition, aliases, f"{here}.conditions[{j}]")
        yield from _in_filters(join.pre_filters, {join.table.alias}, f"{here}.pre_filters")


def _in_mapping(mapping: Mapping, aliases: set[str], at: str) -> Iterator[ErrorDetail]:
    if mapping.source_type == "EXPRESSION":
        yield from _in_text(mapping.source_value, aliases, at)
        return
    yield from _in_reference(mapping.source_value, aliases, at)
    derived = mapping.source_value.startswith(names.DERIVATION_ALIAS + ".")
    if mapping.source_type == "DERIVED" and not derived:
        yield ErrorDetail(f"'{mapping.source_value}' is no computed column, which DERIVED asks for", at)


def _in_derivation(derivation: Derivation, aliases: set[str], at: str) -> Iterator[ErrorDetail]:
    if isinstance(derivation, ExpressionDerivation):
        yield from _in_text(derivation.expression, aliases, f"{at}.expression")
    elif isinstance(derivation, RegexpReplaceDerivation):
        yield from _in_reference(derivation.source, aliases, f"{at}.source")
    else:
        for i, branch in enumerate(derivation.branches):
            yield from _in_condition(branch.when, aliases, f"{at}.branches[{i}].when")


def _in_filters(
    filters: tuple[Filter, ...], aliases: set[str], at: str, targets: set[str] | None = None
) -> Iterator[ErrorDetail]:
    for i, item in enumerate(filters):
        if not isinstance(item, ExpressionFilter):
            yield from _in_condition(item, aliases, f"{at}[{i}]", targets)


def _in_condition(
    item: Condition, aliases: set[str], at: str, targets: set[str] | None = None
) -> Iterator[ErrorDetail]:
    if isinstance(item, ConditionGroup):
        for i, child in enumerate(item.conditions):
            yield from _in_condition(child, aliases, f"{at}.conditions[{i}]", targets)
        return
    try:
        operator = normalize_operator(item.operator)
    except ConfigValidationError as error:
        yield ErrorDetail(error.message, f"{at}.operator")
        return
    if operator in NULL_TESTS:
        return
    if item.right is None:
        yield ErrorDetail(f"{operator} has nothing on its right", f"{at}.right")
    if item.right_type not in ("literal", "column"):
        yield ErrorDetail(f"{operator} needs a right_type: literal or column", f"{at}.right_type")
    yield from _in_reference(item.left, aliases, f"{at}.left", targets)
    if item.right_type == "column" and isinstance(item.right, str):
        yield from _in_reference(item.right, aliases, f"{at}.right", targets)
    if item.right_type == "literal" and operator in LISTS and not isinstance(item.right, list):
        yield ErrorDetail(f"{operator} compares with a list of constants", f"{at}.right")


def _in_reference(
    reference: str, aliases: set[str], at: str, targets: set[str] | None = None
) -> Iterator[ErrorDetail]:
    if targets and reference in targets:
        return
    if not names.is_config_column_reference(reference):
        yield ErrorDetail(f"'{reference}' does not have the form alias.column", at)
        return
    alias, _ = names.parse_qualified_column(reference)
    if alias not in aliases | {names.DERIVATION_ALIAS}:
        yield ErrorDetail(f"No table has the alias of '{reference}'", at)


def _in_text(text: str, aliases: set[str], at: str) -> Iterator[ErrorDetail]:
    for word, attribute in dotted_names(text):
        # A physical name (alias__column) may be followed by a method.
        if "__" not in word:
            yield from _in_reference(f"{word}.{attribute}", aliases, at)


def _repeated(items: list[Any], message: str, at: str) -> Iterator[ErrorDetail]:
    seen = set()
    for item in items:
        if item in seen:
            yield ErrorDetail(f"{message}: {item}", at)
        seen.add(item)
