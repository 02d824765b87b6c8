from mathframe import Model
from mathframe.export import lp_lines, write_lp


def test_lp(spark, tmp_path):
    document = {
        "dimensions": {"x": {"values": [0, 1]}},
        "variables": {"v": {"foreach": ["x"], "bounds": {"upper": 4}}, "b": {"foreach": [], "binary": True}},
        "constraints": {"c": {"foreach": ["x"], "equations": [{"expression": "v - 2 * b >= 1"}]}},
        "objectives": {"o": {"sense": "maximize", "equations": [{"expression": "v"}]}},
    }
    m = Model.from_yaml(spark, document)
    lines = [r.text for r in lp_lines(m).orderBy("section", "place").collect()]
    assert lines == ["Maximize", " + 1 x0".replace("1 ", "1.0000000000000000 "), " + 1.0000000000000000 x1", "Subject To", " c0: + 1.0000000000000000 x0 - 2.0000000000000000 x2 >= 1.0000000000000000", " c1: + 1.0000000000000000 x1 - 2.0000000000000000 x2 >= 1.0000000000000000", "Bounds", " 0.0000000000000000 <= x0 <= 4.0000000000000000", " 0.0000000000000000 <= x1 <= 4.0000000000000000", " 0.0000000000000000 <= x2 <= 1.0000000000000000", "General", "Binary", " x2", "End"]
    write_lp(m, str(tmp_path / "lp"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lp")).collect()][0] in lines


def test_rows_without_terms_and_constants(spark):
    document = {
        "dimensions": {"x": {"values": [0, 1]}},
        "variables": {"v": {"foreach": ["x"], "where": "x > 0"}},
        "constraints": {"c": {"foreach": ["x"], "equations": [{"expression": "v == 5"}]}},
        "objectives": {"o": {"equations": [{"expression": "v - 2"}]}},
    }
    lines = [r.text for r in lp_lines(Model.from_yaml(spark, document)).orderBy("section", "place").collect()]
    assert " c0: 0 x0 = 5.0000000000000000" in lines and lines[1:3] == [" + 1.0000000000000000 x1", " - 4.0000000000000000"]
