from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quern import sample
from quern.model import Settings
from quern.operators import ordered, state
from quern.plans import planner, session
from quern.sources.tables import decode_bodies, encode_bodies, parse_settings, read_facts, render_settings, write_facts

WANT = {
    r"MyApp\Sub\Deep\Class1.cs": "MyApp.Sub.Deep", r"MyApp\Impl\Details\Class2.cs": "none", r"Linked\Class3.cs": "TargetNamespaceUnknown", r"MyApp\Sys.cs": "none", r"Lib\Util\Helper.cs": "Lib.Util",
    r"Shared\Both.cs": "CompiledBySeveralProjects", r"MyApp\Views\Main.xaml": "MyApp.Views", r"MyApp\Views\Main.xaml.cs": "MyApp.Views", r"Multi\Cond.cs": "NamespaceStateContradictory", r"Multi\Rest.cs": "Multi",
    r"MyApp\readme.txt": "NotAProcessableDocument", r"MyApp\Folder1\A.cs": "MyApp.Folder1", r"MyApp\Folder1\B.cs": "TypeNameConflict", r"MyApp\Folder1\Ok.cs": "MyApp.Folder1", r"MyApp\Shared.xaml": "XamlCodeBehindMultiProject",
    r"MyApp\Shared.xaml.cs": "CompiledBySeveralProjects", r"MyApp\Existing.cs": "none", r"MyApp\Clash.cs": "TypeNameConflict", r"MyApp\Gen\Part.cs": "MyApp", r"MyApp.Tests\Use.cs": "none", "Stray.cs": "NoProject",
}


def test_scan_of_the_sample(spark):
    f = sample.facts(spark)
    got = {r["path"].removeprefix(sample.S): r["block_kind"] or r["target_ns"] or r["outcome"] for r in planner.scan(f["candidate"], f, sample.SETTINGS).collect()}
    assert got == WANT


def test_markup_that_would_not_change_is_none(spark):
    f = sample.facts(spark)
    f.tables["body"] = f["body"].withColumn("body", F.replace("body", F.lit("Old.Views.Main"), F.lit("MyApp.Views.Main")))
    got = {r["path"]: r["outcome"] for r in planner.scan(f["candidate"], f, sample.SETTINGS).collect()}
    assert got[sample.S + r"MyApp\Views\Main.xaml"] == "none"


def test_session_rewrites_texts(spark):
    out = session.run(sample.facts(spark), sample.SETTINGS)
    bodies = {r["path"].removeprefix(sample.S): r["body"] for r in out.bodies.collect()}
    assert out.exit_code == session.ERROR
    assert bodies[r"MyApp\Sub\Deep\Class1.cs"] == sample.CLASS1.replace("namespace    /**/  A.B", "namespace    /**/  MyApp.Sub.Deep").replace("using System;", "using System;\r\nusing A.B;")
    use = bodies[r"MyApp.Tests\Use.cs"]
    assert "using A.B;\r\nusing MyApp.Sub.Deep;\r\n" in use
    assert "MyApp.Sub.Deep.Class1 b; object c = MyApp.Sub.Deep.Class1.Nested();" in use
    assert "<!-- <old:Class1/> -->" in bodies[r"MyApp\Views\Main.xaml"]


def test_root_class_moves_without_its_code(spark):
    """The code behind is where it should be already; the markup of another project file has none."""
    f = sample.facts(spark)
    f.tables["namespace_decl"] = f["namespace_decl"].where(~F.col("path").endswith("Main.xaml.cs"))
    f.tables["solution_file"] = f["solution_file"].unionByName(spark.createDataFrame([(sample.S + "MyApp\\Alone.xaml", "MyApp", sample.APP, 1, 0, 99)], f["solution_file"].schema))
    alone = '<Page x:Class="Old.Alone" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml" xmlns:l="clr-namespace:Old;assembly=Q"><l:Alone/></Page>'
    f.tables["body"] = f["body"].unionByName(spark.createDataFrame([((sample.S + "MyApp\\Alone.xaml").upper(), "UTF-8", alone)], f["body"].schema))
    out = session.run(f, sample.SETTINGS)
    assert {r["path"].removeprefix(sample.S): (r["outcome"], r["target_ns"]) for r in out.scan.where("is_xaml and outcome = 'plan'").collect()} == {r"MyApp\Views\Main.xaml": ("plan", "MyApp.Views"), r"MyApp\Alone.xaml": ("plan", "MyApp")}
    bodies = {r["path"].removeprefix(sample.S): r["body"] for r in out.bodies.collect()}
    main = bodies[r"MyApp\Views\Main.xaml"]
    assert 'x:Class="MyApp.Views.Main"' in main and "clr-namespace:MyApp.Sub.Deep;assembly=MyApp" in main  # the code moves are made too
    moved = bodies[(sample.S + "MyApp\\Alone.xaml").upper()]
    assert 'x:Class="MyApp.Alone"' in moved and '"clr-namespace:MyApp;assembly=Q"' in moved and "clr-namespace:Old;" not in moved and "<l:Alone" not in moved


def test_using_of_a_namespace_that_only_another_project_fills(spark):
    """Class1 leaves Legacy for the project's folder; App sees no other type of it, Near sees Lib's, which stays."""
    from quern.model import SCHEMAS, Facts

    app, lib, near = "c:\\s\\App\\App.csproj", "c:\\s\\Lib\\Lib.csproj", "c:\\s\\Near\\Near.csproj"
    files = [("c:\\s\\App\\Class1.cs", "app", app), ("c:\\s\\App\\Use.cs", "app", app), ("c:\\s\\Lib\\Class2.cs", "lib", lib), ("c:\\s\\Near\\Use.cs", "near", near)]
    types = [(files[0][0], "app", "Legacy", "Class1"), (files[1][0], "app", "App", "Use"), (files[2][0], "lib", "Legacy", "Class2"), (files[3][0], "near", "Near", "Use")]
    ref = lambda at, name: (at, 40, 6, name, f"Legacy.{name}", "Legacy", "NamedType", "other", "App", None, None, None, False, None, False)
    rows = {
        "solution_file": [(p, i, f, 0, 0, k) for k, (p, i, f) in enumerate(files)], "document": [(p, i, i, f, "C#", True) for p, i, f in files],
        "default_ns": [(app, "App", 1), (lib, "Legacy", 1), (near, "Near", 1)], "namespace_decl": [(p, i, 1, [ns], False, 10, len(ns), 1) for p, i, ns, _ in types],
        "type_decl_part": [(p, i, ns, name, f"{ns}.{name}", None, "class", 1, False, 1) for p, i, ns, name in types],
        "using_clause": [(files[1][0], "Legacy", None, False, False, 0, 13), (files[3][0], "Legacy", None, False, False, 0, 13)],
        "name_ref": [ref(files[1][0], "Class1"), ref(files[3][0], "Class1"), ref(files[3][0], "Class2")],
    }
    facts = Facts(spark, {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()})
    found = spark.createDataFrame([(1, files[0][0], "plan", "App", False)], "seq long, path string, outcome string, target_ns string, is_xaml boolean")
    edits, _ = session.all_edits(found, facts, Settings())
    got = {(r["path"], r["kind"], r["text"]) for r in edits.collect()}
    assert got == {(files[0][0], "move_namespace", "App"), (files[3][0], "add_using", "App"), (files[1][0], "add_using", "App"), (files[1][0], "delete_using", "")}


def test_errors_and_unmatched_roots_stop_a_run(spark):
    f = sample.facts(spark)
    f.tables["diagnostic"] = spark.createDataFrame([("MyApp", "Error", "CS0103")], "project_name string, severity string, message string")
    out = session.run(f, sample.SETTINGS)
    assert (out.scan, out.exit_code, out.said) == (None, session.ERROR, ["MyApp: CS0103", "1 error(s)"])
    assert session.run(f, replace(sample.SETTINGS, force=True, dry_run=True)).scan is not None
    g = sample.facts(spark)
    g.tables["path_root"] = spark.createDataFrame([("c:\\solution\\My",)], "root string")
    out = session.run(g, sample.SETTINGS)
    assert out.said == ["warning: c:\\solution\\My contains no file of this solution."]
    assert out.scan.count() == 0 and out.exit_code == session.SUCCESS


@pytest.mark.parametrize(("plan", "block", "check", "code"), [(0, 0, False, 0), (3, 0, False, 0), (3, 0, True, 2), (0, 0, True, 0), (3, 1, True, 1), (0, 1, False, 1)])
def test_exit_codes(plan, block, check, code):
    assert session.exit_code(plan, block, Settings(check_only=check)) == code


def test_reservation_in_turn(spark):
    claims = spark.createDataFrame([("a", 1, 0, "k1"), ("b", 2, 0, "k1"), ("b", 2, 1, "k2"), ("c", 3, 0, "k2"), ("d", 4, 0, "k3"), ("e", 5, 0, "taken")], "owner string, seq long, pos int, key string")
    won, lost = ordered.reserve(claims, spark.createDataFrame([("taken",)], "key string"))
    assert {r["owner"] for r in won.collect()} == {"a", "c", "d"}  # b is refused, so it reserves nothing and c is free
    assert {(r["owner"], r["key"]) for r in lost.collect()} == {("b", "k1"), ("e", "taken")}


def test_reservation_matches_turn_by_turn(spark):
    import random

    rng = random.Random(3)
    rows = [(f"o{i}", i, p, f"k{rng.randint(0, 12)}") for i in range(60) for p in range(rng.randint(1, 3))]
    taken, won = {"k0"}, set()
    for i in range(60):
        keys = {r[3] for r in rows if r[1] == i}
        if not keys & taken:
            taken |= keys
            won.add(f"o{i}")
    got, _ = ordered.reserve(spark.createDataFrame(rows, "owner string, seq long, pos int, key string"), spark.createDataFrame([("k0",)], "key string"))
    assert {r["owner"] for r in got.collect()} == won


def test_emptied_namespaces(spark):
    types = spark.createDataFrame([("a.cs", "A.B", "A.B.First"), ("c.cs", "Other.C", "Other.C.Second"), ("p1.cs", "P", "P.T"), ("p2.cs", "P", "P.T"), ("g.cs", "G", "G.M"), ("x\\obj\\g.cs", "G", "G.M")], "path string, ns string, full_name string").withColumns({"ord": F.lit(1), "project_id": F.lit("p")})
    moves = spark.createDataFrame([("a.cs", "A.B", "A.B.First", "X.Y"), ("c.cs", "Other.C", "Other.C.Second", "A.B"), ("p1.cs", "P", "P.T", "X"), ("g.cs", "G", "G.M", "X")], "path string, ns string, full_name string, target_ns string")
    assert {r["ns"] for r in state.emptied(types, moves).collect()} == {"Other.C", "G"}


def test_null_rules_differ(spark):
    rows = spark.createDataFrame([("f", "N", True), ("f", "N", None), ("g", "N", False), ("g", "N", None)], "path string, ns string, alive boolean")
    assert state.contradictory(rows).count() == 0
    assert {r["path"] for r in state.alive_anywhere(rows).collect()} == {"f", "g"}


def test_greedy_spans_and_text(spark):
    d = spark.createDataFrame([("Outer.Inner x", [(0, 11, "N.Outer.Inner"), (0, 5, "N.Outer"), (6, 5, "late"), (12, 1, "y"), (13, 0, "!")])], "body string, s array<struct<start:int,len:int,text:string>>")
    assert d.select(ordered.apply_spans(F.col("body"), ordered.greedy_spans(F.col("s")))).first()[0] == "N.Outer.Inner y!"


def test_bodies_keep_their_encoding(spark):
    raw = {"a": b"\xef\xbb\xbf<a/>\r\n", "b": "<b é/>\n".encode(), "c": b"\xff\xfe" + "<c/>".encode("utf-16-le"), "d": b"\xfe\xff" + "<d/>".encode("utf-16-be"), "e": b"\xff\xfe\0\0" + "<e é🙂/>".encode("utf-32-le"), "f": b"", "g": b"\xff\xfe\0\0"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "path string, content binary")
    bodies = decode_bodies(files)
    assert {r["path"]: r["body"] for r in bodies.collect()} == {"a": "<a/>\r\n", "b": "<b é/>\n", "c": "<c/>", "d": "<d/>", "e": "<e é🙂/>", "f": "", "g": ""}
    assert {r["path"]: bytes(r["content"]) for r in encode_bodies(bodies).collect()} == raw


def test_settings_round_trip():
    assert parse_settings(None, "c:\\s") == ()
    assert parse_settings(render_settings(["A\\B", "c:\\s\\A\\B\\", "C:/X"]), "c:\\s") == ("C:\\S\\A\\B", "C:\\X")


def test_facts_round_trip(spark, tmp_path):
    write_facts(sample.facts(spark), f"file://{tmp_path}")
    f = read_facts(spark, f"file://{tmp_path}")
    assert f["namespace_decl"].count() == len(sample.TABLES["namespace_decl"])
    assert planner.plan(f["candidate"], f, sample.SETTINGS).count() == len(WANT)


def test_command_line(spark, tmp_path, capsys):
    from quern import cli

    write_facts(sample.facts(spark), f"file://{tmp_path}/facts")
    (tmp_path / "s.xml").write_text(render_settings(["MyApp\\Impl"]))
    args = [f"file://{tmp_path}/facts", "--settings", f"file://{tmp_path}/s.xml", "--solution-folder", "c:\\solution"]
    assert cli.main([*args, "--dry-run", "-v"]) == session.ERROR
    said = capsys.readouterr().out
    assert "Class1.cs -> MyApp.Sub.Deep" in said and "Stray" not in said
    assert cli.main([*args, "--check", "-p", "c:\\solution\\MyApp\\Sub"]) == session.ADJUSTMENT_REQUIRED
    assert cli.main([*args, "-p", "c:\\solution\\MyApp\\Sub", "--out", f"file://{tmp_path}/out"]) == session.SUCCESS
    out = {r["path"].rpartition("\\")[2]: bytes(r["content"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert out["Use.cs"].startswith(b"\xef\xbb\xbfusing System;")
    assert b"MyApp.Sub.Deep" in out["Class1.cs"]


def test_reservation_in_the_stated_order(spark):
    """Two files place the same type; the first of the solution's order keeps it, whatever the hashes or names of the paths."""
    from quern.model import SCHEMAS, Facts

    app = "c:\\s\\App\\App.csproj"
    for first, second in (("A", "B"), ("B", "A")):
        files = [f"c:\\s\\App\\Sub\\{first}.cs", f"c:\\s\\App\\Sub\\{second}.cs"]
        rows = {
            "solution_file": [(p, "App", app, 0, 0, k) for k, p in enumerate(files)], "document": [(p, "app", "App", app, "C#", True) for p in files], "default_ns": [(app, "App", 1)],
            "namespace_decl": [(p, "app", 1, [f"Old{k}"], False, 10, 4, 1) for k, p in enumerate(files)], "type_decl_part": [(p, "app", f"Old{k}", "Same", f"Old{k}.Same", None, "class", 1, False, 1) for k, p in enumerate(files)],
        }
        facts = Facts(spark, {name: spark.createDataFrame(r, SCHEMAS[name]) for name, r in rows.items()})
        got = {r["path"]: r["outcome"] for r in planner.scan(session.candidates(facts), facts, Settings()).collect()}
        assert got == {files[0]: "plan", files[1]: "block"}


def test_alive_outside_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    paths = [f"f{k}.cs" for k in range(6)] + ["F1.cs", "f9.g.cs", "x\\obj\\f8.cs"]
    rows = [(rng.choice(paths + [None]), rng.choice("pq"), ns := rng.choice(("A", "B", "C")), f"{ns}.T{rng.randint(0, 3)}", rng.random() < 0.1) for _ in range(40)]
    asked = [(p, pid, ns) for p in paths for pid in "pq" for ns in "ABCD"]
    upper = lambda p: None if p is None else p.upper()
    own = {(upper(p), pid, full) for p, pid, _, full, _ in rows if p}
    want = {}
    for p, pid, ns in asked:
        hits = [fixed or at is not None and upper(at) != upper(p) and not ((at.endswith(".g.cs") or "\\obj\\" in at) and (upper(p), pid, full) in own) for at, i, n, full, fixed in rows if (i, n) == (pid, ns)]
        want[p, pid, ns] = any(hits)
    types = spark.createDataFrame(rows, "path string, project_id string, ns string, full_name string, from_metadata boolean")
    got = state.alive_outside(spark.createDataFrame(asked, "path string, project_id string, ns string"), types)
    assert {(r["path"], r["project_id"], r["ns"]): r["alive"] for r in got.collect()} == want


def test_first_and_last_put_nulls_first(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 3, "w")], "k string, o int, v string")
    assert {tuple(r) for r in ordered.first_wins(rows, ["k"], ["o"]).collect()} == {("a", None, "x"), (None, 3, "w")}
    assert {tuple(r) for r in ordered.last_wins(rows, ["k"], ["o"]).collect()} == {("a", 2, "z"), (None, 3, "w")}


def test_nested_types_of_moved_ones_are_followed(spark):
    """Any depth, and no type that only begins with the same letters."""
    f = sample.facts(spark)
    more = [("A.B.Class1.Nested.Deep", "A.B", "Deep", "A.B.Class1.Nested"), ("A.B.Class10.Other", "A.B", "Other", "A.B.Class10")]
    parts = spark.createDataFrame([(sample.S + "MyApp\\Sub\\Deep\\Class1.cs", "myapp", ns, name, full, outer, "class", 1, False, 9) for full, ns, name, outer in more], f["type_decl_part"].schema)
    f.tables["type_decl_part"] = f["type_decl_part"].unionByName(parts)
    refs = spark.createDataFrame([(sample.S + "MyApp.Tests\\Use.cs", 1000 + k, 4, name, full, ns, "NamedType", "other", "MyApp.Tests", None, None, None, False, None, False) for k, (full, ns, name, _) in enumerate(more)], f["name_ref"].schema)
    f.tables["name_ref"] = refs
    found = spark.createDataFrame([(1, sample.S + "MyApp\\Sub\\Deep\\Class1.cs", "plan", "MyApp.Sub.Deep", False)], "seq long, path string, outcome string, target_ns string, is_xaml boolean")
    rows, _ = session.all_edits(found, f, sample.SETTINGS)
    assert [(r["at"], r["text"]) for r in rows.where("kind = 'add_using' and path like '%Use.cs'").collect()] == [(1000, "MyApp.Sub.Deep")]


def test_scan_of_a_generated_solution_turn_by_turn(spark):
    from pathlib import Path

    from quern import synthetic

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    f = synthetic.facts(spark, folder)
    plans = planner.plan(f["candidate"], f, sample.SETTINGS)
    moving = planner.moving_types(plans, f).orderBy("seq", "pos").collect()
    taken = {(r["ns"], r["type_name"]) for r in state.simple_names(f["type_decl_part"]).collect()}
    want = {r["path"]: r["outcome"] for r in plans.collect()}
    keys: dict = {}
    for r in moving:
        keys.setdefault(r["path"], []).append((r["target_ns"], r["type_name"]))
    for path, mine in keys.items():  # in order of seq
        if taken & set(mine):
            want[path] = "block"
        else:
            taken |= set(mine)
    for r in plans.where("is_xaml and outcome = 'plan'").collect():
        want[r["path"]] = "none"  # without a body there is nothing to move
    got = {r["path"]: r["outcome"] for r in planner.scan(f["candidate"], f, sample.SETTINGS).collect()}
    assert got == want
    assert list(want.values()).count("block") > list(r["outcome"] for r in plans.collect()).count("block")


def test_cancelling_is_an_outcome(spark):
    out = session.run(sample.facts(spark), sample.SETTINGS, cancelled=lambda: True)
    assert (out.edits, out.bodies, out.exit_code, out.said[-1]) == (None, None, session.ERROR, "cancelled")
    assert out.scan.count() == 20


def test_a_failure_names_its_file(spark, monkeypatch):
    from quern.functions import markup
    from quern.model import FileProcessError

    with pytest.raises(FileProcessError) as e:
        markup.of_file("c:\\a b.xaml", int, "x")
    found = FileProcessError.found_in(f"org.apache...: Traceback\n{e.value}\n at x")
    assert found.path == "c:\\a b.xaml" and "ValueError" in found.why

    def fail(batches):
        raise FileProcessError("c:\\x.xaml", "broken")
        yield

    def broken_scan(*_):
        spark.range(1).mapInArrow(fail, "id long").collect()

    monkeypatch.setattr(planner, "scan", broken_scan)
    with pytest.raises(FileProcessError) as e:
        session.run(sample.facts(spark), sample.SETTINGS)
    assert e.value.path == "c:\\x.xaml"
