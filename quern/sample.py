"""A small solution as facts: every decision the engine makes occurs in it once.

The rows serve the flagship query, the tests and, as VALUES lists, the DuckDB side of the
correctness checks, so both engines start from the same facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.functions.paths import canonical
from quern.model import SCHEMAS, Facts, Settings

S = "c:\\solution\\"
APP, TESTS, LIB, MULTI = (S + x for x in ("MyApp\\MyApp.csproj", "MyApp.Tests\\MyApp.Tests.csproj", "Lib\\Lib.Shared.csproj", "Multi\\Multi.csproj"))
SETTINGS = Settings(skipped=(canonical("MyApp\\Impl", S), canonical("MyApp/Views/../Gen/", S)))

_FILES = [
    (S + "MyApp\\Sub\\Deep\\Class1.cs", APP), (S + "MyApp\\Impl\\Details\\Class2.cs", APP), (S + "Linked\\Class3.cs", APP), (S + "MyApp\\Sys.cs", APP), (S + "Lib\\Util\\Helper.cs", LIB),
    (S + "Shared\\Both.cs", APP), (S + "Shared\\Both.cs", TESTS), (S + "MyApp\\Views\\Main.xaml", APP), (S + "MyApp\\Views\\Main.xaml.cs", APP), (S + "Multi\\Cond.cs", MULTI), (S + "Multi\\Rest.cs", MULTI),
    (S + "MyApp\\readme.txt", APP), (S + "MyApp\\Folder1\\A.cs", APP), (S + "MyApp\\Folder1\\B.cs", APP), (S + "MyApp\\Folder1\\Ok.cs", APP), (S + "MyApp\\Shared.xaml", APP), (S + "MyApp\\Shared.xaml.cs", APP), (S + "MyApp\\Shared.xaml.cs", TESTS),
    (S + "MyApp\\obj\\Debug\\Temp.g.cs", APP), (S + "MyApp\\Existing.cs", APP), (S + "MyApp\\Clash.cs", APP), (S + "MyApp\\Gen\\Part.cs", APP), (S + "MyApp.Tests\\Use.cs", TESTS), (S + "MYAPP\\Sub\\deep\\CLASS1.CS", TESTS),
]
_NAMES = {APP: "MyApp", TESTS: "MyApp.Tests", LIB: "Lib.Shared", MULTI: "Multi (net48)"}
_CODE = [f for f in _FILES if f[0].lower().endswith(".cs") and "\\obj\\" not in f[0] and f[0].isascii()]


def _documents() -> list[tuple]:
    out = []
    for path, project in _FILES[:-1]:
        if path.lower().endswith(".cs"):
            ids = ("multi48", "multi8") if project == MULTI else (_NAMES[project].lower(),)
            out += [(path, i, _NAMES[project], project, "C#", True) for i in ids]
    return out


_DECLS = [
    (S + "MyApp\\Sub\\Deep\\Class1.cs", "myapp", 1, ["A.B"], False, 48, 3, 1), (S + "MyApp\\Impl\\Details\\Class2.cs", "myapp", 1, ["MyApp.Details"], True, 10, 13, 1), (S + "Linked\\Class3.cs", "myapp", 1, ["A.B"], True, 10, 3, 1),
    (S + "MyApp\\Sys.cs", "myapp", 1, ["System.Runtime.CompilerServices"], False, 10, 31, 1), (S + "Lib\\Util\\Helper.cs", "lib.shared", 1, ["Old.Util"], False, 10, 8, 1), (S + "Lib\\Util\\Helper.cs", "lib.shared", 2, ["Old.Util", "Inner"], False, 40, 5, 2),
    (S + "Shared\\Both.cs", "myapp", 1, ["Shared.Code"], False, 10, 11, 1), (S + "Shared\\Both.cs", "myapp.tests", 1, ["Shared.Code"], False, 10, 11, 1), (S + "MyApp\\Views\\Main.xaml.cs", "myapp", 1, ["Old.Views"], False, 10, 9, 1),
    (S + "Multi\\Cond.cs", "multi48", 1, ["Old.Multi"], False, 10, 9, 1), (S + "Multi\\Cond.cs", "multi8", 1, ["Old.Multi"], False, 10, 9, 1), (S + "Multi\\Rest.cs", "multi8", 1, ["Old.Multi"], False, 10, 9, 1),
    (S + "MyApp\\Folder1\\A.cs", "myapp", 1, ["Old1"], False, 10, 4, 1), (S + "MyApp\\Folder1\\B.cs", "myapp", 1, ["Old2"], False, 10, 4, 1), (S + "MyApp\\Folder1\\Ok.cs", "myapp", 1, ["Old3"], False, 10, 4, 1),
    (S + "MyApp\\Existing.cs", "myapp", 1, ["MyApp"], True, 10, 5, 1), (S + "MyApp\\Clash.cs", "myapp", 1, ["Other"], False, 10, 5, 1), (S + "MyApp\\Gen\\Part.cs", "myapp", 1, ["A.C"], False, 10, 3, 1), (S + "MyApp.Tests\\Use.cs", "myapp.tests", 1, ["MyApp.Tests"], False, 60, 11, 1),
]


def _types() -> list[tuple]:
    named = [
        ("MyApp\\Sub\\Deep\\Class1.cs", "myapp", "A.B", "Class1", None, "class", 1, 1), ("MyApp\\Sub\\Deep\\Class1.cs", "myapp", "A.B", "Nested", "A.B.Class1", "class", 1, 2), ("MyApp\\Impl\\Details\\Class2.cs", "myapp", "MyApp.Details", "Class2", None, "class", 1, 1),
        ("Linked\\Class3.cs", "myapp", "A.B", "Class3", None, "struct", 1, 1), ("MyApp\\Sys.cs", "myapp", "System.Runtime.CompilerServices", "NullableAttribute", None, "class", 1, 1), ("Lib\\Util\\Helper.cs", "lib.shared", "Old.Util", "Helper", None, "class", 1, 1),
        ("Lib\\Util\\Helper.cs", "lib.shared", "Old.Util.Inner", "Deep", None, "enum", 2, 2), ("Shared\\Both.cs", "myapp", "Shared.Code", "Both", None, "class", 1, 1), ("Shared\\Both.cs", "myapp.tests", "Shared.Code", "Both", None, "class", 1, 1),
        ("MyApp\\Views\\Main.xaml.cs", "myapp", "Old.Views", "Main", None, "class", 1, 1), ("MyApp\\obj\\Debug\\Main.g.cs", "myapp", "Old.Views", "Main", None, "class", 1, 1), ("Multi\\Cond.cs", "multi48", "Old.Multi", "Cond", None, "class", 1, 1), ("Multi\\Cond.cs", "multi8", "Old.Multi", "Cond", None, "class", 1, 1),
        ("Multi\\Rest.cs", "multi8", "Old.Multi", "Rest", None, "class", 1, 1), ("MyApp\\Folder1\\A.cs", "myapp", "Old1", "Foo", None, "class", 1, 1), ("MyApp\\Folder1\\B.cs", "myapp", "Old2", "Foo", None, "delegate", 1, 1), ("MyApp\\Folder1\\Ok.cs", "myapp", "Old3", "Ok", None, "class", 1, 1),
        ("MyApp\\Existing.cs", "myapp", "MyApp", "Taken", None, "class", 1, 1), ("MyApp\\Clash.cs", "myapp", "Other", "Taken", None, "class", 1, 1), ("MyApp\\Gen\\Part.cs", "myapp", "A.C", "Part", None, "class", 1, 1), ("MyApp.Tests\\Use.cs", "myapp.tests", "MyApp.Tests", "Use", None, "class", 1, 1),
    ]
    return [(S + p, pid, ns, name, (outer or ns) + "." + name, outer, kind, decl, False, o) for p, pid, ns, name, outer, kind, decl, o in named]


CLASS1 = "// Copyright\r\nusing System;\r\n\r\nnamespace    /**/  A.B\r\n{\r\n    public class Class1 { public class Nested { } }\r\n}\r\n"
USE = "using System;\r\nusing A.B;\r\n\r\n/* the old names */  namespace MyApp.Tests\r\n{\r\n    class Use { Class1 a; A.B.Class1 b; object c = A.B.Class1.Nested(); }\r\n}\r\n"
MAIN = '<Window x:Class="Old.Views.Main" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml"\n        xmlns:old="clr-namespace:A.B;assembly=MyApp" xmlns:gone="clr-namespace:Never.Used">\n  <!-- <old:Class1/> -->\n  <old:Class1 Tag="{x:Type old:Class1}"></old:Class1>\n</Window>\n'

TABLES: dict[str, list[tuple]] = {
    "solution_file": [(path, _NAMES[project], project, 0 if path.lower().endswith(".cs") else 1, [APP, TESTS, LIB, MULTI].index(project), i) for i, (path, project) in enumerate(_FILES)],
    "document": _documents(),
    "default_ns": [(APP, None, 1), (APP, "MyApp", 2), (TESTS, "MyApp.Tests", 1), (LIB, "", 1), (MULTI, "Multi", 1)],
    "namespace_decl": _DECLS,
    "type_decl_part": _types(),
    "using_clause": [
        (S + "MyApp.Tests\\Use.cs", "System", None, False, False, 0, 13), (S + "MyApp.Tests\\Use.cs", "A . B", None, False, False, 15, 10), (S + "MyApp\\Sub\\Deep\\Class1.cs", "System", None, False, False, 14, 13),
        (S + "Lib\\Util\\Helper.cs", "global::Old1", None, False, False, 0, 19), (S + "Lib\\Util\\Helper.cs", "Old3.Ok", "Alias", False, False, 20, 20), (S + "Lib\\Util\\Helper.cs", "Old3", None, True, False, 45, 20),
    ],
    "name_ref": [
        (S + "MyApp.Tests\\Use.cs", USE.index("Class1 a"), 6, "Class1", "A.B.Class1", "A.B", "NamedType", "other", "MyApp.Tests", None, None, None, False, None, False),
        (S + "MyApp.Tests\\Use.cs", USE.index("A.B.Class1 b") + 4, 6, "Class1", "A.B.Class1", "A.B", "NamedType", "qualified", "MyApp.Tests", USE.index("A.B.Class1 b"), 10, "Class1", True, 1, False),
        (S + "MyApp.Tests\\Use.cs", USE.index("A.B.Class1.Nested()") + 4, 6, "Class1", "A.B.Class1", "A.B", "NamedType", "member", "MyApp.Tests", USE.index("A.B.Class1.Nested()"), 17, "Class1.Nested", False, 2, False),
        (S + "MyApp.Tests\\Use.cs", USE.index("A.B.Class1.Nested()") + 4, 6, "Class1", "A.B.Class1", "A.B", "NamedType", "member", "MyApp.Tests", USE.index("A.B.Class1.Nested()"), 17, "Class1.Nested", False, 2, False),
        (S + "Lib\\Util\\Helper.cs", 70, 4, "Size", "A.C.Part", "A.C", "Property", "member", "Old.Util", 66, 8, "Size", False, 1, False),
        (S + "Lib\\Util\\Helper.cs", 90, 4, "Part", "A.C.Part", "A.C", "NamedType", "cref", "Old.Util", 86, 3, None, True, None, True),
        (S + "Lib\\Util\\Helper.cs", 120, 2, "Ok", "Old3.Ok", "Old3", "NamedType", "other", "MyApp.Folder1.X", None, None, None, False, None, False),
    ],
    "visible_name": [(S + "Lib\\Util\\Helper.cs", 90, "MyApp", False, "Old.Util.MyApp"), (S + "MyApp.Tests\\Use.cs", USE.index("A.B.Class1 b") + 4, "MyApp", True, "MyApp")],
    "body": [(S + "MyApp\\Sub\\Deep\\Class1.cs", "UTF-8", CLASS1), (S + "MyApp.Tests\\Use.cs", "UTF-8-BOM", USE), (S + "MyApp\\Views\\Main.xaml", "UTF-8", MAIN)],
    "candidate": [(i + 1, p) for i, p in enumerate(dict.fromkeys([*(f[0] for f in _FILES[:-1] if "\\obj\\" not in f[0]), S + "Stray.cs"]))],
    "path_root": [],
    "diagnostic": [("MyApp", "Warning", "unused variable")],
}
TABLES["namespace_decl"][0] = (*TABLES["namespace_decl"][0][:5], CLASS1.index("A.B"), 3, 1)
TABLES["namespace_decl"][-1] = (*TABLES["namespace_decl"][-1][:5], USE.index("MyApp.Tests"), 11, 1)


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(TABLES[name], SCHEMAS[name])


def facts(spark: SparkSession) -> Facts:
    return Facts(spark, {name: table(spark, name) for name in TABLES})


_TYPES = {"STRING": "VARCHAR", "INT": "INTEGER", "BIGINT": "BIGINT", "BOOLEAN": "BOOLEAN", "ARRAY<STRING>": "VARCHAR[]"}


def duck_type(spark_type: str) -> str:
    return _TYPES[spark_type]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], schema: str) -> str:
    """A DuckDB relation of literal rows."""
    columns = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) or "(" + ", ".join(["NULL"] * len(columns)) + ")"
    casts = ", ".join(f"{n}::{_TYPES[t]} AS {n}" for n, t in columns)
    names = ", ".join(n for n, _ in columns)
    return f"(SELECT {casts} FROM (VALUES {body}) AS v({names}){'' if rows else ' WHERE false'})"


def relation(name: str) -> str:
    return values(TABLES[name], SCHEMAS[name])
