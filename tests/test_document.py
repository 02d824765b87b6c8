"""Documents: a sound one, and the same one with one part spoilt at a time."""

import copy
import math

import pytest

from mathframe import MathSchema, ValidationError
from mathframe.document import read_document

BAKERY = {
    "dimensions": {"day": {"dtype": "int"}, "bread": {"values": ["rye", "wheat"]}},
    "parameters": {"flour": {"dims": ["bread"]}, "sold": {"dims": ["day", "bread"]}, "open": {"dims": ["day"], "dtype": "bool"}},
    "variables": {
        "baked": {"foreach": ["day", "bread"], "where": "open", "bounds": {"lower": 1, "upper": "sold"}, "integer": True},
        "spare": {"foreach": ["day"]},
    },
    "constraints": {"enough": {"foreach": ["day", "bread"], "equations": [{"expression": "baked >= sold", "where": "sold > 0"}]}},
    "objectives": {"profit": {"sense": "maximize", "equations": [{"expression": "baked * flour"}]}},
}


def spoilt(path, value):
    """The document with one part changed, or without it where the value is ``...``."""
    document = copy.deepcopy(BAKERY)
    *way, last = path.split("/")
    part = document
    for key in way:
        part = part[int(key) if key.isdigit() else key]
    if value is ...:
        del part[last]
    else:
        part[last] = value
    return document


def test_sound():
    s = MathSchema.model_validate(BAKERY)
    assert s.parameters["sold"].dims == ["day", "bread"] and s.constraints["enough"].equations[0].where == "sold > 0"
    baked, spare = s.variables["baked"].bounds, s.variables["spare"].bounds
    assert (baked.lower, baked.upper) == (1, "sold") and (spare.lower, spare.upper) == (0, math.inf)
    assert not any([(empty := MathSchema.model_validate({})).variables, empty.parameters, empty.objectives])


@pytest.mark.parametrize(
    "path, value, message",
    [
        ("parameters/flour/dims", ["grain"], "undeclared dimension 'grain'"),
        ("variables/spare/foreach", ["week"], "undeclared dimension 'week'"),
        ("constraints/enough/foreach", ["day", "oven"], "undeclared dimension 'oven'"),
        ("variables/baked/binary", True, "both binary and integer"),
        ("objectives/profit/sense", "most", "minimize|maximize"),
        ("variables/baked/bounds", {"upper": "ovens"}, "undeclared parameter 'ovens'"),
        ("parameters/open/dims", ..., "'dims' is required"),
        ("dimensions/day/dtype", "bool", "dtype must be"),
        ("parameters/open/dtype", "datetime", "dtype must be"),
        ("constraints/enough/equations", [], "at least one equation"),
        ("variables/spare/where", False, "must be text"),
        ("objectives/profit/equations/0/expression", 5, "must be text"),
        ("variables", None, "must be a mapping"),
    ],
)
def test_spoilt(path, value, message):
    document = spoilt(path, value) if path != "objectives/profit/equations/0/expression" else spoilt("objectives/profit/equations", [{"expression": value}])
    with pytest.raises(ValidationError) as error:
        MathSchema.model_validate(document)
    assert message in str(error.value)


def test_every_mistake_is_told():
    document = spoilt("parameters/flour/dims", ["grain"])
    document["variables"]["spare"]["foreach"] = ["week"]
    with pytest.raises(ValidationError) as error:
        MathSchema.model_validate(document)
    assert "'grain'" in str(error.value) and "'week'" in str(error.value)


def test_numbers_and_unknown_keys():
    s = MathSchema.model_validate(spoilt("variables/spare", {"foreach": ["day"], "colour": "red", "bounds": {"lower": True, "upper": 9}}))
    assert s.variables["spare"].bounds.lower == 1.0 and s.variables["spare"].bounds.upper == 9


def test_files(tmp_path):
    path = tmp_path / "bakery.yaml"
    path.write_text("dimensions:\n  bread:\n    values: [rye, wheat]\n")
    assert read_document(path) == read_document(path.read_text()) == {"dimensions": {"bread": {"values": ["rye", "wheat"]}}}
    path.write_text("")
    assert read_document(str(path)) == {} == read_document({})
