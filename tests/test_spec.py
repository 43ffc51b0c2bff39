"""What a configuration may say (gate G0)."""

from __future__ import annotations

import copy
import json

import pytest

import tablewright
from tablewright.errors import ConfigValidationError
from tablewright.spec import CaseDerivation, ConditionGroup, ExpressionFilter, load, load_file
from tests.samples import predicate, sales_config


@pytest.fixture
def config(tmp_path):
    return sales_config(tmp_path)


def at(config, path):
    for part in path[:-1]:
        config = config[part]
    return config, path[-1]


BP = ("blueprints", 0)
MISSING = object()


def changed(config, path, value):
    config = copy.deepcopy(config)
    owner, last = at(config, path)
    if value is MISSING:
        del owner[last]
    else:
        owner[last] = value
    return config


def test_the_sample_loads(config):
    pipeline = load(config)
    blueprint = pipeline.blueprint()
    assert [table.alias for table in blueprint.tables] == ["ord", "prod", "reg"]
    assert isinstance(blueprint.derivations[2], CaseDerivation)
    assert blueprint.post_filters == (ExpressionFilter("line_amount > 0"),)
    assert pipeline.source_files() == {"sales_orders.csv", "products.csv", "regions.csv"}
    assert pipeline.output_files() == ["sales_enriched_export.csv"]
    assert load(pipeline) is pipeline


def test_files(config, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"$schema": "x", **config}))
    assert load_file(str(path)) == load(config)
    for name, text in (("config.yaml", "{}"), ("bad.json", "{"), ("list.json", "[]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigValidationError):
            load_file(str(tmp_path / name))
    with pytest.raises(ConfigValidationError):
        load_file(str(tmp_path / "none.json"))


def test_groups_and_aliases(config):
    group = {"logic": "OR", "conditions": [predicate("ord.qty", "IS NULL"), predicate("ord.qty", ">", 1)]}
    blueprint = load(changed(config, (*BP, "pre_filters"), [group])).blueprint()
    assert isinstance(blueprint.pre_filters[0], ConditionGroup)
    legacy = changed(config, ("connections", "files", "type"), "LOCAL_CSV_DIRECTORY")
    assert load(legacy).connections["files"].type == "LOCAL_FILE_DIRECTORY"


JOIN = (*BP, "sources", "joins", 0)
BROKEN = [
    (("blueprints",), [], "at least 1"),
    (("connections",), {}, "at least one"),
    (("connections", "files", "type"), "SFTP", "must be one of"),
    (("connections", "files", "file_options", "surprise"), 1, "unknown field"),
    (("connections", "files", "file_options", "max_file_size_mb"), 0, "whole number"),
    (("migration_id",), MISSING, "is required"),
    (("client_id",), "", "non-empty"),
    ((*BP, "surprise"), 1, "unknown field"),
    ((*BP, "sequence_order"), 0, "whole number"),
    ((*BP, "mappings"), [], "at least 1"),
    ((*BP, "target", "connection_ref"), "other", "No connection is called"),
    ((*BP, "sources", "root_table", "connection_ref"), "other", "No connection is called"),
    ((*JOIN, "connection_ref"), "other", "No connection is called"),
    ((*BP, "sources", "root_table", "alias"), "prod", "Duplicate alias"),
    ((*BP, "sources", "root_table", "alias"), "1st", "cannot be an alias"),
    ((*JOIN, "join_type"), "CROSS", "must be one of"),
    ((*JOIN, "conditions"), [], "at least 1"),
    ((*JOIN, "conditions", 0, "right"), "zzz.product_sku", "No table has the alias"),
    ((*JOIN, "pre_filters"), [predicate("ord.qty", ">", 1)], "No table has the alias"),
    ((*BP, "mappings", 0, "target_column"), "category", "Duplicate target_column"),
    ((*BP, "mappings", 0, "source_value"), "order_id", "does not have the form"),
    ((*BP, "mappings", 0, "source_value"), "zzz.order_id", "No table has the alias"),
    ((*BP, "mappings", 0, "cast_to"), "bool", "must be one of"),
    ((*BP, "mappings", 0, "source_type"), "MAGIC", "must be one of"),
    ((*BP, "mappings", 0, "is_nullable"), "no", "true or false"),
    ((*BP, "mappings", 0, "is_nullable"), MISSING, "is required"),
    ((*BP, "mappings", 5, "source_value"), "ord.qty", "is no computed column"),
    ((*BP, "mappings", 10, "source_value"), "zzz.qty + 1", "No table has the alias"),
    ((*BP, "pre_filters", 0, "operator"), "~", "No such operator"),
    ((*BP, "pre_filters", 0, "right"), None, "nothing on its right"),
    ((*BP, "pre_filters", 0, "right_type"), MISSING, "right_type"),
    ((*BP, "pre_filters", 0), predicate("ord.qty", "IN", 3), "list of constants"),
    ((*BP, "pre_filters", 0), {"logic": "AND", "conditions": []}, "at least 1"),
    ((*BP, "pre_filters", 0), {"logic": "XOR", "conditions": [predicate("ord.qty", ">", 1)]}, "must be one of"),
    ((*BP, "pre_filters", 0), {"type": "sql", "value": "x"}, "must be one of"),
    ((*BP, "pre_filters", 0, "left"), "status", "does not have the form"),
    ((*BP, "derivations", 0, "variable_name"), "digits", "Duplicate derivation"),
    ((*BP, "derivations", 0, "expression"), "zzz.qty * 2", "No table has the alias"),
    ((*BP, "derivations", 1, "source"), "contact_phone", "does not have the form"),
    ((*BP, "derivations", 2, "branches"), [], "at least 1"),
    ((*BP, "derivations", 2, "branches", 0, "when", "left"), "zzz.order_status", "No table has the alias"),
    ((*BP, "derivations", 2, "branches", 0, "then"), MISSING, "is required"),
    ((*BP, "derivations", 2, "transform_type"), "LOOKUP", "must be one of"),
    ((*BP, "post_filters"), [predicate("nothing", "==", 1)], "does not have the form"),
]


@pytest.mark.parametrize(("path", "value", "message"), BROKEN, ids=lambda v: str(v)[:50])
def test_findings(config, path, value, message):
    with pytest.raises(ConfigValidationError) as caught:
        load(changed(config, path, value))
    assert caught.value.gate == "G0"
    assert any(message in f"{d.message}" for d in caught.value.details), caught.value.details


def test_several_blueprints(config):
    twice = copy.deepcopy(config)
    twice["blueprints"].append(copy.deepcopy(twice["blueprints"][0]))
    with pytest.raises(ConfigValidationError) as caught:
        load(twice)
    messages = " ".join(d.message for d in caught.value.details)
    assert "Duplicate blueprint_id" in messages and "Duplicate sequence_order" in messages
    twice["blueprints"][1] |= {"blueprint_id": "other", "sequence_order": 7}
    pipeline = load(twice)
    assert pipeline.blueprint("other").sequence_order == 7
    with pytest.raises(ConfigValidationError):
        pipeline.blueprint("none")
    with pytest.raises(ConfigValidationError):
        pipeline.blueprint()


def test_all_findings_come_together(config):
    config = changed(config, (*BP, "mappings", 0, "source_value"), "zzz.a")
    config = changed(config, (*BP, "pre_filters", 0, "operator"), "~")
    with pytest.raises(ConfigValidationError) as caught:
        load(config)
    assert len(caught.value.details) == 2
    assert all(d.field.startswith("blueprints[0].") for d in caught.value.details)


def test_superset(config):
    """A target column may stand by its own name in post-filters, text by its accessors anywhere."""
    config = changed(config, (*BP, "post_filters"), [predicate("line_amount", ">", 0)])
    config = changed(config, (*BP, "mappings", 10, "source_value"), "ord__customer_name.str.upper()")
    load(config)


def test_nonsense_is_refused():
    for nonsense in ([], "text", {}, None):
        with pytest.raises(ConfigValidationError):
            tablewright.load(nonsense)
