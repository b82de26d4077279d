"""The functions as SQL sees them."""

import pytest

from hotleaf.functions import sql


@pytest.fixture(scope="module")
def run(spark):
    sql.register(spark)
    return lambda text: spark.sql(f"SELECT {text}").first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("""doc_canonical('{"b":1.0,"a":[1e2]}')""", '{"a": [100], "b": 1.0}'),
        ("doc_key('1.50')", "1.5"),
        ("doc_typeof('[1]')", "array"),
        ("""doc_text('"x"')""", "x"),
        ("""doc_field('{"a":[1,2]}', array('a', '-1'))""", "2"),
        ("""doc_field('{"a":1}', array('b'))""", None),
        ("""doc_object_field('{"a":[1]}', array('a', '0'))""", None),
        ("""doc_set('{"a":1}', array('b'), '[2]', true)""", '{"a": 1, "b": [2]}'),
        ("""doc_delete('{"a":1,"b":2}', array('a'))""", '{"b": 2}'),
        ("""doc_increment('{"a":1.5}', array('a'), CAST(0.25 AS DECIMAL(10,2)))""", '{"a": 1.75}'),
        ("""doc_patch('{"a":1}', '[{"op":"add","path":"/b","value":2}]')""", '{"a": 1, "b": 2}'),
        ("""doc_merge('{"a":1}', '{"a":null,"c":3}')""", '{"c": 3}'),
        ("""doc_pack('{"a":1,"b":2}', '[["a"]]').slots[0]""", "1"),
        ("""doc_restore(doc_pack('{"a":1,"b":2}', '[["a"]]').cold, doc_slots('{"a":1,"b":2}', '[["a"]]'))""", '{"a": 1, "b": 2}'),
        ("""doc_restore_as(doc_pack('{"a":1}', '[["a"]]').cold, array('5'), '[["a"]]')""", '{"a": 5}'),
        ("""doc_template(doc_pack('{"a":1}', '[["a"]]').cold)""", '{"a": null}'),
        ("""doc_paths(doc_pack('{"a":1}', '[["a",0]]').cold)""", '[["a", 0]]'),
        ("""doc_valid_paths('[["a"],["b",0]]')""", True),
        ("doc_valid_path(array('a'))", True),
        ("""doc_candidates('[["a",0],["a","0"]]', array('a', '0'))""", [0, 1]),
        ("""doc_route('[["a"]]', array('a', 'b'), array('{}'))""", 0),
        ("doc_canonical(NULL)", None),
    ],
)
def test_function(run, text, want):
    assert run(text) == want


@pytest.mark.parametrize("text", ["doc_canonical('{')", """doc_valid_paths('[["a"],["a"]]')""", """doc_restore_as(doc_pack('{"a":1}', '[["a"]]').cold, array('5'), '[["b"]]')"""])
def test_errors_end_the_query(run, text):
    with pytest.raises(Exception, match=r"22P02|22023|XX001"):
        run(text)
