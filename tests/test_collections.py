import copy
import datetime as dt
import pickle

import pytest

from weftline.collections import IndexedDict, Options, load_json
from weftline.errors import InvalidOperationError


def test_positions():
    d = IndexedDict([("a", 1), ("b", 2), ("c", 3)])
    assert d.index_of_key("b") == 1 and d.get_key_by_index(2) == "c" and d.get_value_by_index(-1) == 3 and d.get_item_by_index(0) == ("a", 1)
    d.set_value_by_index(1, 5)
    assert d.pop_by_index(0) == ("a", 1) and list(d.items()) == [("b", 5), ("c", 3)] and d.index_of_key("c") == 1
    d.move_to_end("b")
    assert d.index_of_key("b") == 1
    with pytest.raises(KeyError):
        d.index_of_key("x")
    with pytest.raises(IndexError):
        d.get_key_by_index(9)


def test_frozen():
    d = IndexedDict(a=1)
    d.set_readonly()
    assert d.readonly
    for change in (lambda: d.__setitem__("b", 1), lambda: d.__delitem__("a"), d.clear, lambda: d.pop("a"), d.popitem, lambda: d.move_to_end("a"), lambda: d.set_value_by_index(0, 1), lambda: d.pop_by_index(0), lambda: d.update(b=1), lambda: d.setdefault("b", 1)):
        with pytest.raises(InvalidOperationError):
            change()
    for other in (d.copy(), copy.copy(d), copy.deepcopy(d)):
        other["b"] = 2
        assert not other.readonly and list(other) == ["a", "b"]
    assert dict(d) == {"a": 1}


def test_equality():
    a, b = IndexedDict([("a", 1), ("b", 2)]), IndexedDict([("b", 2), ("a", 1)])
    assert a.equals(b, with_order=False) and not a.equals(b, with_order=True) and pickle.loads(pickle.dumps(a)).equals(a, True)


def test_options():
    o = Options({"a": "1", "b": "yes", "t": "1h", "n": None})
    assert o.get("a", 0) == 1 and o.get("b", False) is True and o.get("x", 5) == 5 and o.get("t", dt.timedelta()) == dt.timedelta(hours=1)
    assert o.get_or_none("x", int) is None and o.get_or_none("a", int) == 1 and o.get_or_throw("a", float) == 1.0 and o[0] == "1"
    with pytest.raises(ValueError):
        o.get("a", None)
    with pytest.raises(KeyError):
        o.get_or_throw("x", int)
    with pytest.raises(TypeError):
        o.get("a", False) and o.get("t", False)
    with pytest.raises(ValueError):
        o[3] = 1


def test_options_update():
    deep = {"x": [1]}
    o = Options(deep)
    o["x"].append(2)
    assert deep == {"x": [1]}
    o.update({"x": 3, "y": 4}, Options.IGNORE)
    assert o["x"] == [1, 2] and o["y"] == 4
    o.update([("x", 5)])
    assert o["x"] == 5 and Options(None) == {}
    with pytest.raises(KeyError):
        o.update({"x": 1}, Options.THROW)
    with pytest.raises(ValueError):
        o.update({"x": 1}, 9)
    assert load_json(o.to_json()) == {"x": 5, "y": 4} and "\n" in o.to_json(indent=True)


def test_json_without_repeats():
    assert load_json('{"a": {"b": 1}}') == {"a": {"b": 1}}
    for bad in ('{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}'):
        with pytest.raises(KeyError):
            load_json(bad)
