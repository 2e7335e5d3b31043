import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import codec

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text() | st.sampled_from(["", "~", "+1", "T-3", "- a", "{}", "a,b", "null", "1e5", " x", "$a", "%", "@from json", "_root", "a b", "\x0b"]),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=6) | st.sampled_from(["_root", "_value", "id", "a b", "x|y", "@from"]), v, max_size=4),
    max_leaves=20,
)


@settings(max_examples=1500, deadline=None)
@given(VALUES)
def test_any_value_comes_back(value):
    assert codec.decode(codec.encode(value)) == value


@settings(max_examples=300, deadline=None)
@given(st.lists(st.fixed_dictionaries({"id": st.integers(), "name": st.text(max_size=8), "on": st.booleans() | st.none()}), min_size=1, max_size=6))
def test_uniform_records_are_a_table(rows):
    text = codec.encode({"users": rows})
    assert text.split("\n")[1] == f"users [{len(rows)}]{{{'|'.join(rows[0])}}}:"
    assert codec.decode(text) == {"users": rows}


def test_layout():
    value = {"users": [{"name": "Alice", "role": "dev ops"}, {"name": "Bob", "role": None}], "tags": ["a", "1", 1], "deep": {"x": {}, "y": []}, "mixed": [1, {"a": {"b": 2}, "c": 3}, [{}]]}
    assert codec.encode(value) == "\n".join(
        ["@from json", "users [2]{name|role}:", '  Alice|"dev ops"', "  Bob|null", 'tags [3]: a,"1",1', "deep", "  x {}", "  y [0]: ", "mixed [3]:", "  - _value: 1", "  - a", "      b: 2", "    c: 3", "  - _value [1]:", "      - {}"]
    )
    assert codec.decode(codec.encode(value)) == value


def test_numbers():
    assert [codec.number(x) for x in (599.0, 1e21, 1.5e-7, -0.0, 0.1, 1e-6, 123456789012345680.0, 2**70)] == ["599", "1e+21", "1.5e-7", "0", "0.1", "0.000001", "123456789012345680", str(2**70)]


@pytest.mark.parametrize("text", ["", "plain", "@from json\n    a: 1", "@from json\nt [2]{a|b}:\n  1|2", "@from json\nt [2]: 1", "@from json\nt [1]{a|b}:\n  1", "@from json\nt [1]:\n  a: 1"])
def test_broken_texts_are_refused(text):
    with pytest.raises(ValueError):
        codec.decode(text)


def test_columns(spark):
    texts = ['{"a":[{"b":1},{"b":2}]}', "[1,2", "NaN", "[1e999]", None, "", '"x"', '{"k":1,"k":2}', "[" * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", codec.compact(F.col("t")).alias("c"))
    rows = df.select("i", "t", "c", codec.expand(F.col("c")).alias("e")).orderBy("i").collect()
    assert rows[0].c == "@from json\na [2]{b}:\n  1\n  2" and rows[0].e == texts[0]
    assert [r.c for r in rows[1:6]] == texts[1:6] and rows[8].c == texts[8]
    assert rows[6].e == '"x"' and json.loads(rows[7].e) == {"k": 2}
