import pytest

from quern.functions import markup
from quern.plans import markup_moves

X = 'xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml"'


def doc(inner, maps='xmlns:a="clr-namespace:A.B"', cls="Root.Main"):
    return f'<Window x:Class="{cls}" {X} {maps}>{inner}</Window>'


def alias_of(body, ns):
    return [f.alias for f in markup.fragments(body) if f.kind == "mapping" and f.ns == ns]


@pytest.mark.parametrize(
    "inner",
    ["<a:Class1/>", "<a:Class1></a:Class1>", '<p Tag="{x:Type a:Class1}"/>', '<p Tag="{x:Static a:Class1.Field}"/>', '<p x:TypeArguments="a:Class1"/>', '<p a:Class1.Row="1"/>', '<p Value="{a:Class1 X=1}"/>', "<a : Class1/>"],
)
def test_references_move(inner):
    new = markup.move_class(doc(inner), "A.B", "Class1", "X.Y")
    (alias,) = alias_of(new, "X.Y")
    assert not alias_of(new, "A.B")
    assert f"{alias}:Class1" in new
    assert "a:Class1" not in new.replace(f"{alias}:Class1", "")


def test_root_class_moves():
    assert 'x:Class="X.Main"' in markup.move_class(doc("", cls="A.B.Main"), "A.B", "Main", "X")


def test_other_classes_keep_the_mapping():
    new = markup.move_class(doc("<a:Class1/><a:Class2/>"), "A.B", "Class1", "X.Y")
    assert alias_of(new, "A.B") == ["a"]
    assert "<a:Class2/>" in new


def test_two_moves_share_one_mapping():
    new = markup.move_class(markup.move_class(doc("<a:Class1/><a:Class2/>"), "A.B", "Class1", "X.Y"), "A.B", "Class2", "X.Y")
    assert len(alias_of(new, "X.Y")) == 1
    assert not alias_of(new, "A.B")


def test_a_mapping_of_another_assembly_is_not_reused():
    maps = 'xmlns:a="clr-namespace:A.B;assembly=One" xmlns:b="clr-namespace:X.Y;assembly=Two"'
    new = markup.move_class(doc("<a:Class1/><b:Other/>", maps), "A.B", "Class1", "X.Y")
    assert len(alias_of(new, "X.Y")) == 2
    assert "X.Y;assembly=One" in new


def test_an_existing_mapping_is_reused():
    maps = 'xmlns:a="clr-namespace:A.B" xmlns:b="clr-namespace:X.Y"'
    assert "<b:Class1/>" in markup.move_class(doc("<a:Class1/>", maps), "A.B", "Class1", "X.Y")


def test_comments_are_untouched_but_keep_their_mapping():
    new = markup.move_class(doc("<!-- <a:Class1/> --><a:Class1/>"), "A.B", "Class1", "X.Y")
    assert "<!-- <a:Class1/> -->" in new
    assert alias_of(new, "A.B") == ["a"]


def test_using_form_stays():
    assert "using:X.Y" in markup.move_class(doc("<a:Class1/>", 'xmlns:a="using:A.B"'), "A.B", "Class1", "X.Y")


def test_extension_suffix():
    assert "a:Upper" not in markup.move_class(doc('<p V="{ a:Upper}"/>'), "A.B", "UpperExtension", "X.Y")


def test_names_are_unicode():
    assert any(f.alias == "né" for f in markup.fragments(doc("<né:X/>")))


def test_nothing_to_move_changes_nothing():
    body = doc("<a:Class1/>")
    assert markup.move_class(body, "A.B", "Class9", "X.Y") == body
    assert markup.move_class(body, "Z", "Class1", "X.Y") == body


def test_moves_as_relations(spark):
    bodies = spark.createDataFrame([("m.xaml", "UTF-8", doc("<a:Class1/>")), ("n.xaml", "UTF-8", doc("")), ("e.xaml", "UTF-8", "")], "path string, encoding string, body string")
    moved = spark.createDataFrame([("A.B", "Class1", "X.Y")], "source_ns string, class_name string, target_ns string")
    got = {r["path"]: r["body"] for r in markup_moves.move(bodies, moved).collect()}
    assert got == {"m.xaml": markup.move_class(doc("<a:Class1/>"), "A.B", "Class1", "X.Y", "m.xaml")}


def test_root_class_moves_as_relations(spark):
    bodies = spark.createDataFrame([("M.xaml", "UTF-8", doc("<a:Class1/>")), ("n.xaml", "UTF-8", doc("")), ("e.xaml", "UTF-8", "")], "path string, encoding string, body string")
    moved = spark.createDataFrame([("A.B", "Class1", "X.Y"), ("Root", "Main", "Other")], "source_ns string, class_name string, target_ns string")
    roots = spark.createDataFrame([("m.xaml", "Z.W"), ("e.xaml", "Z.W")], "path string, target_ns string")
    got = {r["path"]: r["body"] for r in markup_moves.move(bodies, moved, roots=roots).collect()}
    assert got.keys() == {"M.xaml", "n.xaml"}
    assert 'x:Class="Z.W.Main"' in got["M.xaml"] and "clr-namespace:X.Y" in got["M.xaml"]  # its own target wins over the code's
    assert 'x:Class="Other.Main"' in got["n.xaml"]
    alone = {r["path"]: r["body"] for r in markup_moves.move(bodies, moved.limit(0), roots=roots).collect()}
    assert alone == {"M.xaml": doc("<a:Class1/>", cls="Z.W.Main")}
