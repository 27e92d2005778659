import json

import pytest

from lakeloom.operators import nested

SCHEMA = "raw_id bigint, payload string, occ string, body int"


def paths(payload):
    nodes, out = nested.shred_payload(payload) or [], {}
    for i, n in enumerate(nodes):
        up = out.get(n["parent"])
        out[i] = up if not n["section"] else str(n["ordinal"]) if up is None else f"{up}/{n['ordinal']}"
    return sorted({out[i] for i, n in enumerate(nodes) if n["section"]})


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ({"sections": [{"heading": "a"}, None, {"children": {"heading": "b", "sections": [{}, {}]}}]}, ["0", "2", "2/0", "2/0/0", "2/0/1"]),
        ({"page": {"body": {"sections": {"h": 1}}}}, ["0"]),
        ({"sections": json.dumps([{"children": json.dumps({"x": 1})}])}, ["0", "0/0"]),
        ({"sections": [[{"sections": [{}]}]]}, ["0"]),
        ({"sections": [json.dumps({"children": []})]}, ["0"]),
        ({"outline": [{"heading": 1}]}, []),
        ([{"sections": [1, "x", {}]}], ["2"]),
        ("just text", []),
        (None, []),
    ],
)
def test_paths(payload, expected):
    assert paths(json.dumps(payload)) == expected


@pytest.mark.parametrize("bad", [None, "", "<html>", '{"sections": [{}]', '{"sections": [{"a": NaN}]}', '{"a": 1} x'])
def test_no_json(bad):
    assert not nested.shred_payload(bad)


def test_twice_encoded_and_deep():
    assert paths(json.dumps(json.dumps({"sections": [{}]}))) == ["0"]
    deep = '{"sections":[' * 300 + "{}" + "]}" * 300
    assert len(paths(deep)) == 300
    assert len(nested.shred_payload('{"a":' * 150_000 + "1" + "}" * 150_000)) == 150_000
    assert len(nested.shred_payload('{"a":' + "[" * 150_000 + "1" + "]" * 150_000 + "}")) == 1


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, false, null, "x\\n\\u00e6"], "b": {}, "c": []}', "[]", ' {"a" : {"b":[ {} , [ ] ]} } ', "12", '"x"'])
def test_deep_parser_equals_the_usual_one(text):
    assert nested._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a" 1}', '{"a":1,}', "{1:2}", "[1] 2", "nul", "01", "[1}"])
def test_deep_parser_rejects(bad):
    with pytest.raises(ValueError):
        nested._parse_deep(bad)


def test_long_numbers_are_numbers():
    n = "7" * 5000
    a, b = (nested.shred_payload('{"a": %s}' % x)[0]["hash"] for x in (n, f'"{n}"'))
    assert a != b and nested.shred_payload('{"a": %s}' % n)[0]["body"] == '{"a":%s}' % n


def test_tables(spark):
    inner = {"heading": "same", "content": ["x", "y"], "links": [{"href": "/a", "text": "t"}]}
    one = {"link": "https://a", "title": "T", "sections": [inner, {"heading": {"text": "up", "level": 2}, "children": [inner]}]}
    rows = [(1, json.dumps(one), "clash", 1), (1, json.dumps(one), None, None), (2, None, "c", 2), (3, "{", "c", 3), (None, '{"sections": {}}', None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    all_ = nested.shredded(df)
    s = nested.nested_sections(all_).collect()
    got = {(r.raw_id, r.section_path, r.parent_path, r.heading, r.content) for r in s}
    assert got == {(1, "0", None, "same", "x\ny"), (1, "1", None, "up", None), (1, "1/0", "1", "same", "x\ny"), (None, "0", None, None, None)}
    assert len({r.object_hash for r in s if r.heading == "same"}) == 1
    bridge, objects = all_.bridge, all_.objects
    assert {r.object_hash for r in bridge.collect()} == {r.object_hash for r in objects.collect()}
    assert {(r.href, r.section_path) for r in nested.nested_links(all_).collect()} == {("/a", "0"), ("/a", "1/0")}
    # every document is rebuilt from its objects and bridge rows
    body = {r.object_hash: r.body for r in objects.collect()}

    def rebuild(h):
        def fill(v):
            if isinstance(v, dict):
                return rebuild(v["$ref"]) if set(v) == {"$ref"} else {k: fill(x) for k, x in v.items()}
            return [fill(x) for x in v] if isinstance(v, list) else v

        return {k: fill(v) for k, v in json.loads(body[h]).items()}

    root = next(r.document_hash for r in all_.deliveries.collect() if r.raw_id == 1)
    assert rebuild(root) == one
    d = {r.raw_id: r for r in nested.nested_documents(all_).collect()}
    assert (d[1].title, d[1].link, d[1].n_objects, d[1].n_sections) == ("T", "https://a", 7, 3)


def test_deliveries(spark):
    """Equal deliveries count once; unlike ones of one record keep their own parents."""
    a, b = {"title": "a", "sections": [{"children": [{"heading": "x"}]}]}, {"title": "b", "page": {"sections": [{}, {"children": {"heading": "y"}}]}}
    rows = [(1, json.dumps(a), None, 0), (1, json.dumps(a), None, 1), (1, json.dumps(b), None, 2), (2, json.dumps(a, indent=1), None, 3)]
    all_ = nested.shredded(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.raw_id, r.title, r.n_objects) for r in nested.nested_documents(all_).collect()) == [(1, "a", 3), (1, "b", 5), (2, "a", 3)]
    assert {(r.raw_id, r.section_path, r.parent_path, r.heading) for r in nested.nested_sections(all_).filter("heading is not null").collect()} == {(1, "0/0", "0", "x"), (1, "1/0", "1", "y"), (2, "0/0", "0", "x")}
    assert all_.bridge.count() == 8 and len({r.document_hash for r in all_.deliveries.collect()}) == 2


def test_empty(spark):
    all_ = nested.shredded(spark.createDataFrame([], SCHEMA))
    for f in (nested.nested_sections, nested.nested_links, nested.nested_documents, nested.section_paths, lambda x: x.bridge, lambda x: x.objects):
        assert f(all_).count() == 0
