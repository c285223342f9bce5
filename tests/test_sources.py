import json

import pytest

from concord.operators.verbs import canon
from concord.sources import read, write_json
from concord.sources.readers import relaxed


@pytest.mark.parametrize(
    "name,body,want",
    [
        ("a.json", '{"port": 80, "tags": ["x"]}', {"port": 80, "tags": ["x"]}),
        ("a.json5", "// c\n{port: 80, 'tags': ['x',], /* y */}", {"port": 80, "tags": ["x"]}),
        ("a.jsonic", "port: 0x50, host: example", {"port": 80, "host": "example"}),
        ("a.toml", 'port = 80\nday = 2024-01-02\n[s]\nk = "v"', {"port": 80, "day": "2024-01-02", "s": {"k": "v"}}),
        ("a.ini", "port = 80\n[s]\nk = v", {"port": "80", "s": {"k": "v"}}),
    ],
)
def test_readers(spark, tmp_path, name, body, want):
    (tmp_path / name).write_text(body)
    assert json.loads(read(spark, str(tmp_path / name)).selectExpr("to_json(value) AS j").first()["j"]) == want


def test_text_and_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("two\nlines")
    assert read(spark, str(tmp_path / "a.txt")).first()["value"] == "two\nlines"
    with pytest.raises(ValueError, match="include_extension"):
        read(spark, "a.csv")


def test_relaxed_keeps_strict():
    for x in ('{"a":[1,2.5,"x"],"b":null}', "[]", '"a"'):
        assert json.loads(relaxed(x)) == json.loads(x)


def test_json_out(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é")], "b long, a string, c string")
    write_json(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()["value"] == '{"a":null,"b":1,"c":"é"}' == df.select(canon(df)).first()[0]
