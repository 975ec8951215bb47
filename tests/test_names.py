import pytest

from weftline.functions import names


@pytest.mark.parametrize("name,plain", [("a", True), ("_a1", True), ("__", False), ("1a", False), ("", False), ("é", False), ("a b", False), (None, False)])
def test_plain_names(name, plain):
    assert names.is_plain_name(name) is plain
    if not plain:
        with pytest.raises(ValueError):
            names.assert_plain_name(name)


@pytest.mark.parametrize("name", ["a", "", "`", "a b", "a`b", "中", "123", "_", '"'])
def test_quotes_round_trip(name):
    assert names.unquote_name(names.quote_name(name)) == name


def test_unquoted_names_are_trimmed_and_not_empty():
    assert names.unquote_name("  x ") == "x"
    with pytest.raises(ValueError):
        names.unquote_name("  ")


def test_open_quote_is_refused():
    with pytest.raises(SyntaxError):
        list(names.search_unquoted("a`b", ","))
    with pytest.raises(SyntaxError):
        names.end_of_quoted("`ab", 0)


def test_quote_aware_scans():
    assert list(names.search_unquoted("a,`b,c`,d", ",")) == [(1, ","), (7, ",")]
    assert names.replace_unquoted("x`x`x", "x", "yy") == "yy`x`yy"
    assert names.end_of_quoted("`a``b`c", 0) == 6
    assert list(names.split_unquoted("a,b,c", ",", 1)) == ["a", "b,c"]


@pytest.mark.parametrize("mode,expected", [("keep", ["a", "", "b,c"]), ("ignore", ["a", "b,c"])])
def test_split_names(mode, expected):
    assert list(names.split_names("a, ,`b,c`", on_empty=mode)) == expected


def test_split_names_refuses_empty_parts_and_modes():
    with pytest.raises(ValueError):
        list(names.split_names("a,,b", on_empty="throw"))
    with pytest.raises(ValueError):
        list(names.split_names("a", on_empty="other"))


def test_normalize_names():
    assert names.normalize_names(["ok"]) == {}
    made = names.normalize_names(["a", "+b", "-b", "_b", None, "", "1x"])
    assert "a" not in made and "_b" not in made
    assert made["+b"] == "_b_1" and made["-b"] == "_b_2" and made["1x"] == "_1x"
    final = ["a", "_b", *made.values()]
    assert len(set(final)) == 7 and all(map(names.is_plain_name, final))
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            names.normalize_names(bad)
