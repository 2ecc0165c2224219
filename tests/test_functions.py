import pytest
from pyspark.sql import functions as F

from quern.functions import names, paths

APP = r"c:\solution\MyApp\MyApp.csproj"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "skipped", "chain"),
    [
        (r"c:\solution\MyApp\Class1.cs", [], []),
        (r"c:\solution\MyApp\Sub\Deep\Class1.cs", [], ["Sub", "Deep"]),
        (r"c:\solution\MyApp\Impl\Details\Class1.cs", [r"MyApp\Impl"], ["Details"]),
        (r"c:\solution\MyApp\Impl\Details\Class1.cs", [r"MyApp\Impl", r"MyApp\Impl\Details"], []),
        (r"c:\solution\Other\Class1.cs", [], None),
        (r"c:\solution\MyApp.Tests\Sub\Class1.cs", [], None),
        (r"c:\solution\MyAppX\Class1.cs", [], None),
        (r"C:\solution\MyApp\Sub\Class1.cs", [], ["Sub"]),
        (r"c:/solution/MyApp/Sub/Class1.cs", [], ["Sub"]),
    ],
)
def test_folder_chain(spark, path, skipped, chain):
    keys = tuple(paths.canonical(s, r"c:\solution") for s in skipped)
    assert one(spark, paths.folder_chain(F.col("p"), F.col("q"), keys), p=path, q=APP) == chain


@pytest.mark.parametrize("entry", [r"Project\A\B", "Project/A/B", r"c:\solution\Project\A\..\A\B", "Project\\A\\B\\"])
def test_skipped_folder_is_one_key(entry):
    assert paths.canonical(entry, "c:\\solution\\") == r"C:\SOLUTION\PROJECT\A\B"


@pytest.mark.parametrize(
    ("ns", "pattern", "replacement", "want"),
    [
        ("OldRoot.Folder1.Folder2", "^[^.]+", "NewRoot", "NewRoot.Folder1.Folder2"),
        ("Old.Folder1.Folder2", r"^Old\.(.+)$", "New.$1", "New.Folder1.Folder2"),
        ("Old.Middle.Old", "Old", "New", "New.Middle.New"),
        ("A.B.C", "[unclosed", "NewRoot", "A.B.C"),
        ("Root.Folder1", r"\.Folder1", "", "Root.Folder1"),
        ("A.B", "", "X", "A.B"),
        ("A.B", "A", "$9", "$9.B"),
        ("A.B", "(A)", "$1$1", "AA.B"),
        ("A.B", "A", "x\\y$$z$&", "x\\y$zA.B"),
    ],
)
def test_rename(spark, ns, pattern, replacement, want):
    assert one(spark, names.rename(F.col("n"), pattern, replacement), n=ns) == want


@pytest.mark.parametrize(("name", "want"), [("Shop.Common", "Shop"), ("Big.Shop.Common", "Big.Shop"), ("Shop", "Shop"), (".Common", ".Common")])
def test_default_fallback(spark, name, want):
    assert one(spark, names.default_fallback(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    ("parts", "scoped", "want"),
    [
        (["A.B"], False, ("A.B", "X.Y", True)),
        (["A.B"], True, ("A.B", "X.Y", True)),
        (["A.B", "Inner"], False, ("A.B.Inner", "X.Y.Inner", False)),
        (["X.Y"], False, None),
        (["X.Y"], True, None),
    ],
)
def test_transition(spark, parts, scoped, want):
    got = one(spark, names.transition(F.col("p"), F.col("s"), F.lit("X.Y")), p=parts, s=scoped)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("name", "want"), [("global::A.B", "A.B"), ("A . B", "A.B"), (" global :: A\t.\nB", "A.B"), (None, "")])
def test_normal_using(spark, name, want):
    assert one(spark, names.normal_using(F.col("n")), n=name) == want


@pytest.mark.parametrize(("ns", "want"), [("System", True), ("System.Text", True), ("SystemTools.Net", False), ("Microsoft.Win32", True), ("MicrosoftLike.Parts", False)])
def test_special(spark, ns, want):
    assert one(spark, names.is_special(F.col("n")), n=ns) is want


@pytest.mark.parametrize(
    ("target", "name", "scope", "want"),
    [("My.Exp", "Exp", "My", True), ("Exp.Inner", "Exp", "", True), ("My.Exp", "Exp", "Other", False), ("My.Exp", "Exp", "My.Deep.Scope", True), ("My.Expert", "Exp", "My", False)],
)
def test_shadowed(spark, target, name, scope, want):
    assert one(spark, names.is_shadowed(F.col("t"), F.col("n"), F.col("s")), t=target, n=name, s=scope) is want


@pytest.mark.parametrize(
    ("path", "folder", "want"),
    [(r"c:\s\App\obj\x.cs", r"c:\s\App", True), (r"c:\s\App\Bin\x.cs", r"c:\s\App", True), (r"c:\bin\App\x.cs", r"c:\bin\App", False), (r"c:\s\App.Tests\obj\x.cs", r"c:\s\App", False), (r"c:\s\App\object\x.cs", r"c:\s\App", False)],
)
def test_build_output(spark, path, folder, want):
    assert one(spark, paths.is_build_output(F.col("p"), F.col("f")), p=path, f=folder) is want


@pytest.mark.parametrize(("path", "want"), [("A.g.cs", True), ("A.G.I.CS", True), ("a.Designer.cs", True), (r"c:\x\obj\a.cs", True), ("c:/x/obj/a.cs", True), ("a.cs", False), (None, False)])
def test_generated(spark, path, want):
    assert one(spark, paths.is_generated(F.col("p")), p=path) is want
