"""All queries of the engine itself, by name, with their DuckDB SQL.

Names begin with the kind of data: ``ns_`` queries run over the sample solution's facts (the
same rows on both sides), ``sx_`` queries over a solution generated from the driver's tables, at
their scale; ``tb_`` queries apply the engine's operators to those tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import sample, synthetic
from quern.functions import markup, names, paths
from quern.operators import ordered, ownership, state, trees
from quern.model import Facts
from quern.plans import edits, markup_moves, planner, references, session
from quern.sources.tables import decode_bodies, encode_bodies, parse_settings, render_settings, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(spark: SparkSession, where: str) -> Facts:
    """Those of the sample solution, or of the solution generated from the tables of a folder."""
    return synthetic.facts(spark, where.folder) if isinstance(where, synthetic.Solution) else sample.facts(spark)


def _table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return _facts(spark, where)[name]


def flagship(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    facts = _facts(spark, sf_dir)
    return planner.plan(facts["candidate"], facts, sample.SETTINGS)


# ---- SQL building blocks -------------------------------------------------------------------------
R = sample.relation
SKIPPED = "[" + ", ".join(f"'{s}'" for s in sample.SETTINGS.skipped) + "]"


def key(x: str) -> str:
    return f"upper(replace({x}, '/', '\\'))"


def folder(x: str) -> str:
    return f"regexp_replace(replace({x}, '/', '\\'), '\\\\?[^\\\\]*$', '')"


def generated(x: str) -> str:
    return f"coalesce(regexp_matches(lower(replace({x}, '/', '\\')), '(\\.g\\.cs|\\.g\\.i\\.cs|\\.designer\\.cs|\\.generated\\.cs)$|\\\\obj\\\\'), false)"


def nested(a: str, b: str) -> str:
    return f"({a} = {b} OR starts_with({a}, {b} || '.'))"


def special(x: str) -> str:
    return f"split_part({x}, '.', 1) IN ('System', 'Microsoft')"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '[\\s\\p{{Z}}]', '', 'g'), '^global::', '')"


FILE_PROJECT = f"""(
  SELECT path_key, path, CASE WHEN instr(project_name, ' (') > 1 THEN substr(project_name, 1, instr(project_name, ' (') - 1) ELSE project_name END AS project_name, project_file
  FROM (SELECT *, {key('path')} AS path_key, row_number() OVER (PARTITION BY {key('path')} ORDER BY priority, project_ord, project_file) AS r FROM {R('solution_file')}
        WHERE NOT (starts_with({key('path')}, {key(folder('project_file'))} || '\\') AND len(list_filter(string_split(substr({key('path')}, length({folder('project_file')}) + 2), '\\'), lambda x: x IN ('BIN', 'OBJ'))) > 0))
  WHERE r = 1)"""
DEFAULT_NS = f"""(
  SELECT DISTINCT f.project_file, f.project_name, coalesce(s.stated, regexp_replace(f.project_name, '^(.+)\\.[^.]*$', '\\1')) AS default_ns
  FROM {FILE_PROJECT} f LEFT JOIN (SELECT project_file, arg_min(default_ns, ord) AS stated FROM {R('default_ns')} WHERE coalesce(default_ns, '') <> '' GROUP BY 1) s USING (project_file))"""
TARGETS = f"""(
  SELECT seq, path, path_key, project_file, chain, array_to_string([default_ns] || chain, '.') AS target_ns
  FROM (
    SELECT *, CASE WHEN {key(folder('path'))} = {key(folder('project_file'))} THEN []::VARCHAR[]
      WHEN starts_with({key(folder('path'))}, {key(folder('project_file'))} || '\\') THEN
        list_filter(string_split(substr({folder('path')}, length({folder('project_file')}) + 2), '\\'),
          lambda x, i: NOT list_contains({SKIPPED}, {key(folder('project_file'))} || '\\' || array_to_string(list_slice(string_split(upper(substr({folder('path')}, length({folder('project_file')}) + 2)), '\\'), 1, i), '\\'))) END AS chain
    FROM (SELECT seq, path, {key('path')} AS path_key FROM {R('candidate')}) c LEFT JOIN (SELECT path_key, project_file FROM {FILE_PROJECT}) USING (path_key) LEFT JOIN (SELECT project_file, default_ns FROM {DEFAULT_NS}) USING (project_file)))"""
TRANSITION = "CASE WHEN file_scoped THEN target_ns ELSE array_to_string([target_ns] || parts[2:], '.') END"
TRANSITIONS = f"""(
  SELECT DISTINCT path_key, original, modified, is_root FROM (
    SELECT {key('d.path')} AS path_key, array_to_string(parts, '.') AS original, {TRANSITION} AS modified, len(parts) = 1 AS is_root
    FROM {R('namespace_decl')} d JOIN {TARGETS} t ON {key('d.path')} = t.path_key WHERE target_ns IS NOT NULL)
  WHERE original <> modified AND NOT {special('original')})"""
SHARED = f"(SELECT path_key FROM (SELECT {key('path')} AS path_key, upper(coalesce(project_file, project_name)) AS p FROM {R('document')} WHERE path IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT p) > 1)"
ASKED = f"(SELECT DISTINCT d.path, d.project_id, m.original AS ns FROM {TRANSITIONS} m JOIN {R('document')} d ON {key('d.path')} = m.path_key)"
ALIVE = f"""(
  SELECT q.path, q.project_id, q.ns, coalesce(bool_or(t.from_metadata OR ({key('t.path')} <> {key('q.path')} AND NOT ({generated('t.path')} AND o.full_name IS NOT NULL))), false) AS alive
  FROM {ASKED} q LEFT JOIN {R('type_decl_part')} t ON t.project_id = q.project_id AND t.ns = q.ns
  LEFT JOIN (SELECT DISTINCT {key('path')} AS k, project_id, full_name FROM {R('type_decl_part')}) o ON o.k = {key('q.path')} AND o.project_id = q.project_id AND o.full_name = t.full_name
  GROUP BY 1, 2, 3)"""
TORN = f"(SELECT path, ns FROM {ALIVE} GROUP BY 1, 2 HAVING bool_or(alive) AND NOT bool_and(alive))"


def _message(kind: str) -> str:
    from quern.model import BLOCKS

    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in BLOCKS.items()) + " END"


PLAN = f"""(
  SELECT seq, path, CASE WHEN k IS NULL THEN 'plan' WHEN k = '' THEN 'none' ELSE 'block' END AS outcome, CASE WHEN k IS NULL THEN target_ns END AS target_ns, is_xaml,
         nullif(k, '') AS block_kind, {_message("nullif(k, '')")} AS message
  FROM (
    SELECT t.*, x.is_xaml, CASE WHEN t.project_file IS NULL THEN 'NoProject' WHEN s.path_key IS NOT NULL AND x.is_xaml THEN 'XamlCodeBehindMultiProject' WHEN s.path_key IS NOT NULL THEN 'CompiledBySeveralProjects'
      WHEN coalesce(t.target_ns, '') = '' THEN 'TargetNamespaceUnknown' WHEN x.is_xaml THEN NULL WHEN d.path_key IS NULL THEN 'NotAProcessableDocument' WHEN m.path_key IS NULL THEN '' WHEN c.path_key IS NOT NULL THEN 'NamespaceStateContradictory' END AS k
    FROM {TARGETS} t JOIN (SELECT seq, regexp_matches(lower(path), '\\.a?xaml$') AS is_xaml FROM {R('candidate')}) x USING (seq)
    LEFT JOIN {SHARED} s ON s.path_key = CASE WHEN x.is_xaml THEN t.path_key || '.CS' ELSE t.path_key END
    LEFT JOIN (SELECT DISTINCT {key('path')} AS path_key FROM {R('document')} WHERE language = 'C#' AND supports_compilation) d ON d.path_key = t.path_key
    LEFT JOIN (SELECT DISTINCT path_key FROM {TRANSITIONS}) m ON m.path_key = t.path_key
    LEFT JOIN (SELECT DISTINCT {key('path')} AS path_key FROM {TORN}) c ON c.path_key = t.path_key))"""
MOVING = f"""(
  SELECT seq, path, ns, full_name, type_name, modified AS target_ns, min(ord) AS pos FROM (
    SELECT p.seq, p.path, t.ns, t.full_name, t.type_name, t.ord, {TRANSITION.replace('target_ns', 'p.target_ns')} AS modified, array_to_string(parts, '.') AS original
    FROM {R('type_decl_part')} t JOIN {R('namespace_decl')} d ON {key('t.path')} = {key('d.path')} AND t.project_id = d.project_id AND t.decl_id = d.decl_id
    JOIN (SELECT * FROM {PLAN} WHERE outcome = 'plan' AND NOT is_xaml) p ON {key('p.path')} = {key('t.path')}
    WHERE t.containing_type IS NULL AND t.ns <> p.target_ns AND NOT {special('t.ns')})
  WHERE original <> modified GROUP BY ALL)"""
SIMPLE = f"(SELECT DISTINCT ns, type_name FROM {R('type_decl_part')} WHERE containing_type IS NULL)"
#: Turn by turn: the files in order, with the list of keys that are taken so far.
SCAN = f"""(
  WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {MOVING}), files AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM (SELECT seq, path, list(target_ns || '|' || type_name ORDER BY pos) AS keys FROM m GROUP BY seq, path)),
  turn(i, path, hit, taken) AS (
    SELECT 0::BIGINT, ''::VARCHAR, NULL::VARCHAR, (SELECT list(ns || '|' || type_name) FROM {SIMPLE})
    UNION ALL
    SELECT f.i, f.path, list_filter(f.keys, lambda k: list_contains(t.taken, k))[1], CASE WHEN list_has_any(f.keys, t.taken) THEN t.taken ELSE t.taken || f.keys END FROM turn t JOIN files f ON f.i = t.i + 1),
  roots AS (SELECT {key('path')} AS k, regexp_extract(body, 'x:Class\\s?=\\s?"([\\w.]+)\\.\\w+"', 1) AS root_ns FROM {R('body')} WHERE regexp_matches(body, 'x:Class\\s?=\\s?"'))
  SELECT seq, path, CASE WHEN still THEN 'none' WHEN hit IS NOT NULL THEN 'block' ELSE outcome END AS outcome, CASE WHEN NOT still AND hit IS NULL THEN target_ns END AS target_ns, is_xaml,
         CASE WHEN hit IS NOT NULL THEN 'TypeNameConflict' ELSE block_kind END AS block_kind,
         CASE WHEN hit IS NOT NULL THEN '''' || split_part(hit, '|', 1) || ''' already contains a type ''' || split_part(hit, '|', 2) || '''' ELSE message END AS message
  FROM (SELECT p.*, t.hit, p.is_xaml AND p.outcome = 'plan' AND (r.root_ns IS NULL OR r.root_ns = p.target_ns) AS still FROM {PLAN} p LEFT JOIN turn t ON t.path = p.path AND t.hit IS NOT NULL LEFT JOIN roots r ON r.k = {key('p.path')}))"""


# ---- ownership and targets -----------------------------------------------------------------------
@query(f"SELECT path, project_name, project_file FROM {FILE_PROJECT}")
def ns_file_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First project of each file wins, build output is left out."""
    return ownership.file_projects(_table(spark, sf_dir, "solution_file")).select("path", "project_name", "project_file")


@query(f"""SELECT path, project_file FROM (SELECT f.path, p.project_file, row_number() OVER (PARTITION BY f.path ORDER BY length({folder('p.project_file')}) DESC, p.project_ord, p.project_file) AS r
  FROM (SELECT DISTINCT path FROM {R('candidate')}) f JOIN (SELECT DISTINCT project_file, project_ord FROM {R('solution_file')}) p ON {key(folder('f.path'))} = {key(folder('p.project_file'))} OR starts_with({key('f.path')}, {key(folder('p.project_file'))} || '\\')) WHERE r = 1""")
def ns_deepest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest containing project folder, as an equi-join on ancestors."""
    projects = _table(spark, sf_dir, "solution_file").select("project_file", "project_ord").distinct()
    return ownership.deepest_project(_table(spark, sf_dir, "candidate").select("path").distinct(), projects)


@query(f"SELECT project_file, project_name, default_ns FROM {DEFAULT_NS}")
def ns_default_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stated namespace, else the name without its last part."""
    return ownership.default_namespaces(ownership.file_projects(_table(spark, sf_dir, "solution_file")), _table(spark, sf_dir, "default_ns"))


@query(f"SELECT seq, path, array_to_string(chain, '|') AS chain, target_ns FROM {TARGETS}")
def ns_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder chain and target namespace; null and empty chains differ."""
    f = _facts(spark, sf_dir)
    return planner.targets(f["candidate"], f, sample.SETTINGS).select("seq", "path", F.array_join("chain", "|").alias("chain"), "target_ns")


@query(f"SELECT path_key, original, modified, is_root FROM {TRANSITIONS}")
def ns_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each declaration becomes."""
    f = _facts(spark, sf_dir)
    return planner.transitions(f["namespace_decl"], planner.targets(f["candidate"], f, sample.SETTINGS)).drop("ord")


@query(f"SELECT path_key FROM {SHARED}")
def ns_shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: files of several project files; frameworks of one project count once."""
    return ownership.shared_files(_table(spark, sf_dir, "document"))


def _alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _facts(spark, sf_dir)
    moves = planner.transitions(f["namespace_decl"], planner.targets(f["candidate"], f, sample.SETTINGS))
    asked = moves.select("path_key", F.col("original").alias("ns")).join(f["document"].withColumn("path_key", paths.path_key(F.col("path"))), "path_key").select("path", "project_id", "ns")
    return state.alive_outside(asked, f["type_decl_part"])


@query(f"SELECT path, project_id, ns, alive FROM {ALIVE}")
def ns_alive_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per compilation, is a namespace filled outside the file."""
    return _alive(spark, sf_dir)


@query(f"SELECT path, ns FROM {ALIVE} GROUP BY 1, 2 HAVING bool_or(coalesce(alive, true))")
def ns_alive_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: in any compilation; unknown counts as alive."""
    return state.alive_anywhere(_alive(spark, sf_dir))


@query(f"SELECT path, ns FROM {TORN}")
def ns_contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: compilations that disagree."""
    return state.contradictory(_alive(spark, sf_dir))


# ---- plan and scan -------------------------------------------------------------------------------
@query(f"SELECT seq, path, outcome, target_ns, is_xaml, block_kind, message FROM {PLAN}")
def ns_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of decisions."""
    return flagship(spark, sf_dir)


@query(f"SELECT seq, path, ns, full_name, type_name, target_ns, pos FROM {MOVING}")
def ns_moving_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 P10: top-level types that planned files move."""
    f = _facts(spark, sf_dir)
    return planner.moving_types(planner.plan(f["candidate"], f, sample.SETTINGS), f)


@query(f"SELECT ns, type_name FROM {SIMPLE}")
def ns_simple_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level names per namespace."""
    return state.simple_names(_table(spark, sf_dir, "type_decl_part"))


@query(f"SELECT DISTINCT m.path, m.target_ns, m.type_name FROM {MOVING} m JOIN {SIMPLE} s ON s.ns = m.target_ns AND s.type_name = m.type_name")
def ns_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving types whose name the target already has."""
    f = _facts(spark, sf_dir)
    moving = planner.moving_types(planner.plan(f["candidate"], f, sample.SETTINGS), f)
    return moving.join(state.simple_names(f["type_decl_part"]).withColumnRenamed("ns", "target_ns"), ["target_ns", "type_name"], "left_semi").select("path", "target_ns", "type_name").distinct()


@query(f"SELECT * FROM {SCAN}")
def ns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan after conflicts and reservation in turn."""
    f = _facts(spark, sf_dir)
    return planner.scan(f["candidate"], f, sample.SETTINGS)


@query(f"SELECT CASE WHEN outcome = 'block' THEN block_kind ELSE outcome END AS what, count(*) AS n, min(path) AS first_path FROM {SCAN} GROUP BY 1")
def ns_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a scan."""
    f = _facts(spark, sf_dir)
    found = planner.scan(f["candidate"], f, sample.SETTINGS)
    return found.groupBy(F.when(F.col("outcome") == "block", F.col("block_kind")).otherwise(F.col("outcome")).alias("what")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query(f"""SELECT folder, CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) END AS common, count(*) AS n, array_to_string(list(name ORDER BY name), '|') AS files
  FROM (SELECT {folder('path')} AS folder, regexp_extract(path, '[^\\\\]*$') AS name, outcome FROM {SCAN}) GROUP BY 1""")
def ns_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by folder, and what they have in common."""
    f = _facts(spark, sf_dir)
    found = planner.scan(f["candidate"], f, sample.SETTINGS).select(paths.folder_of(F.col("path")).alias("folder"), paths.file_name(F.col("path")).alias("name"), "outcome")
    return found.groupBy("folder").agg(F.when(F.countDistinct("outcome") == 1, F.min("outcome")).alias("common"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("files"))


# ---- namespace state -----------------------------------------------------------------------------
_BY_FULL = f"(SELECT full_name, ns FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY ord DESC, project_id DESC, path DESC) AS r FROM {R('type_decl_part')}) WHERE r = 1)"


@query(f"SELECT ns, array_to_string(list_sort(list(DISTINCT full_name)), '|') AS types FROM {_BY_FULL} GROUP BY 1")
def ns_types_per_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last project wins, types by namespace."""
    return state.types_per_namespace(_table(spark, sf_dir, "type_decl_part")).select("ns", F.array_join("types", "|").alias("types"))


_MOVES = [
    ("a.cs", "A.B", "A.B.First", "X.Y"), ("c.cs", "Other.C", "Other.C.Second", "A.B"), ("p1.cs", "P", "P.Part", "X"), ("q.cs", "Q", "Q.Only", "X"), ("r.cs", "R", "R.One", "X"), ("g.cs", "G", "G.Main", "X"),
]
_MOVE_TYPES = [("a.cs", "A.B", "A.B.First"), ("c.cs", "Other.C", "Other.C.Second"), ("p1.cs", "P", "P.Part"), ("p2.cs", "P", "P.Part"), ("q.cs", "Q", "Q.Only"), ("r.cs", "R", "R.One"), ("r2.cs", "R", "R.Two"), ("g.cs", "G", "G.Main"), ("obj\\g.g.cs", "G", "G.Main")]
_MOVE_SCHEMA, _MOVE_TYPE_SCHEMA = "path STRING, ns STRING, full_name STRING, target_ns STRING", "path STRING, ns STRING, full_name STRING"


@query(f"SELECT full_name FROM {sample.values(_MOVE_TYPES, _MOVE_TYPE_SCHEMA)} WHERE NOT {generated('path')} GROUP BY 1 HAVING count(DISTINCT {key('path')}) > 1")
def ns_partial_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types declared by hand in several files."""
    return state.partial_types(spark.createDataFrame(_MOVE_TYPES, _MOVE_TYPE_SCHEMA))


def _emptied_of(moves: str, types: str) -> str:
    return f"""(
  WITH moves AS {moves}, types AS {types},
  hand AS (SELECT DISTINCT full_name, {key('path')} AS k FROM types WHERE NOT {generated('path')}),
  stay AS (SELECT DISTINCT full_name FROM hand h WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.full_name = h.full_name AND {key('m.path')} = h.k)),
  removed AS (SELECT DISTINCT full_name, ns FROM moves WHERE full_name NOT IN (SELECT full_name FROM stay)),
  after AS (SELECT DISTINCT ns FROM types WHERE (full_name, ns) NOT IN (SELECT full_name, ns FROM removed) UNION SELECT target_ns FROM moves)
  SELECT DISTINCT ns FROM removed WHERE ns NOT IN (SELECT ns FROM after))"""


_EMPTIED = _emptied_of(sample.values(_MOVES, _MOVE_SCHEMA), sample.values(_MOVE_TYPES, _MOVE_TYPE_SCHEMA))


def _emptied(spark: SparkSession) -> DataFrame:
    types = spark.createDataFrame(_MOVE_TYPES, _MOVE_TYPE_SCHEMA).withColumns({"ord": F.lit(1), "project_id": F.lit("p")})
    return state.emptied(types, spark.createDataFrame(_MOVES, _MOVE_SCHEMA))


@query(f"SELECT ns FROM {_EMPTIED}")
def ns_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptied and not refilled; partial types keep a namespace, generated parts do not."""
    return _emptied(spark)


_USINGS = [("u.cs", "global::Q", None, False, False, 0, 10), ("u.cs", "Other . C", None, False, False, 11, 10), ("u.cs", "A.B", None, False, False, 22, 10), ("u.cs", "Q", "Alias", False, False, 33, 10), ("v.cs", "G", None, True, True, 0, 5), ("v.cs", "T.Gone", None, False, False, 6, 5), ("w.cs", "T.Gone", None, False, False, 6, 5)]
_USING_SCHEMA = "path STRING, name STRING, alias STRING, is_static BOOLEAN, in_namespace BOOLEAN, start INT, len INT"
_DIRECT = [("v.cs", "T.Gone", False), ("v.cs", "T.Gone", False), ("w.cs", "T.Gone", False), ("w.cs", "T.Gone", True)]
_GONE = f"(SELECT DISTINCT u.path, 'T.Gone' AS ns FROM {sample.values(_USINGS, _USING_SCHEMA)} u WHERE {norm('u.name')} = 'T.Gone' AND u.path IN (SELECT path FROM {sample.values(_DIRECT, 'path STRING, ns STRING, has_direct_type BOOLEAN')} GROUP BY path HAVING NOT bool_or(has_direct_type)))"


def _gone(spark: SparkSession) -> DataFrame:
    touched = spark.createDataFrame([("T.Gone",), ("A.B",)], "ns string")
    return state.gone_for_file(spark.createDataFrame(_USINGS, _USING_SCHEMA), touched, spark.createDataFrame(_DIRECT, "path string, ns string, has_direct_type boolean"))


@query(f"SELECT path, ns FROM {_GONE}")
def ns_gone_for_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No direct type in any compilation of the file."""
    return _gone(spark)


@query(f"SELECT path, start AS span_start, len AS span_len FROM {sample.values(_USINGS, _USING_SCHEMA)} u WHERE {norm('name')} IN (SELECT ns FROM {_EMPTIED}) OR (path, {norm('name')}) IN (SELECT path, ns FROM {_GONE})")
def ns_dead_usings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of emptied namespaces."""
    return state.dead_usings(spark.createDataFrame(_USINGS, _USING_SCHEMA), _emptied(spark), _gone(spark)).select("path", "span_start", "span_len")


# ---- references and edits ------------------------------------------------------------------------
_MOVED = [("A.B.Class1", "A.B", "Class1", "MyApp.Sub.Deep"), ("A.C.Part", "A.C", "Part", "MyApp"), ("Old3.Ok", "Old3", "Ok", "MyApp.Folder1.X.Ok")]
_MOVED_SCHEMA = "type_full STRING, source_ns STRING, class_name STRING, target_ns STRING"
_REFS = f"""(
  SELECT path, CASE WHEN new IS NULL THEN 'add_using' ELSE 'replace_text' END AS kind, CASE WHEN new IS NOT NULL THEN CASE WHEN parent_kind = 'other' THEN start ELSE outer_start END END AS span_start,
         CASE WHEN new IS NOT NULL THEN CASE WHEN parent_kind = 'other' THEN len ELSE outer_len END END AS span_len, coalesce(new, target_ns) AS text, start AS "at"
  FROM (SELECT *, CASE WHEN parent_kind = 'cref' THEN CASE WHEN container_is_namespace THEN t END
      WHEN parent_kind = 'qualified' THEN CASE WHEN container_is_namespace OR (chain_pos = 0 AND shadowed) THEN t || '.' || tail END
      WHEN parent_kind = 'member' THEN CASE WHEN symbol_kind NOT IN ('Property', 'Field', 'Method') AND chain_pos >= 0 AND (chain_pos > 0 OR shadowed) THEN t || '.' || tail END
      WHEN shadowed AND text = class_name THEN t || '.' || text END AS new
    FROM (SELECT DISTINCT r.*, m.class_name, m.target_ns, CASE WHEN r.is_global OR EXISTS (SELECT 1 FROM {R('visible_name')} v WHERE v.path = r.path AND v.start = r.start AND v.name = split_part(m.target_ns, '.', 1) AND NOT (v.is_namespace AND v.full_name = v.name)) THEN 'global::' ELSE '' END || m.target_ns AS t,
        len(list_filter(list_transform(range(0, len(string_split(scope_ns, '.')) + 1), lambda i: CASE WHEN i = 0 THEN class_name ELSE array_to_string(string_split(scope_ns, '.')[1:i], '.') || '.' || class_name END), lambda c: m.target_ns = c OR starts_with(m.target_ns, c || '.'))) > 0 AS shadowed
      FROM {R('name_ref')} r JOIN {sample.values(_MOVED, _MOVED_SCHEMA)} m USING (type_full) WHERE coalesce(symbol_ns, '') <> m.target_ns)))"""


def _reference_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.reference_edits(_table(spark, sf_dir, "name_ref"), _table(spark, sf_dir, "visible_name"), spark.createDataFrame(_MOVED, _MOVED_SCHEMA))


@query(f'SELECT path, kind, span_start, span_len, text, "at" FROM {_REFS}')
def ns_reference_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 Q11 Q11a Q11b Q11c Q11d J12 J16 J17 A12 F11 F17 F18 P17 W6: the ladder of references."""
    return _reference_edits(spark, sf_dir)


@query(f'SELECT path, kind, span_start, span_len, text, min("at") AS "at" FROM {_REFS} GROUP BY path, kind, span_start, span_len, text')
def ns_edit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal edits once, in order of insertion."""
    return edits.edit_set(_reference_edits(spark, sf_dir))


_SELF = [("a.cs", 10, "Old"), ("a.cs", 20, "Old.Part"), ("a.cs", 30, "New"), ("a.cs", 40, "Other"), ("b.cs", 10, "Old")]
_SELF_DECL = [("a.cs", "Old.Part", "New.Part")]


@query(f"""SELECT DISTINCT r.path, r.start AS "at", r.symbol_ns AS text FROM {sample.values(_SELF, 'path STRING, start INT, symbol_ns STRING')} r JOIN {sample.values(_SELF_DECL, 'path STRING, original STRING, modified STRING')} d USING (path)
  WHERE {nested('d.original', 'r.symbol_ns')} AND NOT {nested('d.modified', 'r.symbol_ns')}""")
def ns_self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found through the old enclosing namespace only."""
    refs = spark.createDataFrame(_SELF, "path string, start int, symbol_ns string").withColumn("scope_ns", F.lit("Old.Part"))
    return references.self_reference_edits(refs, spark.createDataFrame(_SELF_DECL, "path string, original string, modified string")).select("path", "at", "text")


_SPANS = [("f", 4, 9, "N.Outer.Inner"), ("f", 4, 3, "N.Outer"), ("f", 10, 5, "late"), ("f", 13, 2, "ok"), ("g", 0, 0, "head "), ("g", 0, 1, "A"), ("g", 2, 1, "C")]
_SPAN_SCHEMA = "path STRING, start INT, len INT, text STRING"
_GREEDY = f"""(SELECT path, unnest(list_reduce(list_prepend({{'kept': []::STRUCT(start INTEGER, len INTEGER, text VARCHAR)[], 'fin': -1::INTEGER}}, list_transform(spans, lambda s: {{'kept': [s], 'fin': s.start + s.len}})),
   lambda a, x: CASE WHEN x.kept[1].start < a.fin THEN a ELSE {{'kept': a.kept || x.kept, 'fin': x.fin}} END).kept) AS s
   FROM (SELECT path, list({{'start': start, 'len': len, 'text': text}} ORDER BY start, len DESC) AS spans FROM {sample.values(_SPANS, _SPAN_SCHEMA)} GROUP BY 1))"""


@query(f"SELECT path, s.start AS start, s.len AS len, s.text AS text FROM {_GREEDY}")
def ns_greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin inside an accepted one are dropped."""
    spans = spark.createDataFrame(_SPANS, _SPAN_SCHEMA).groupBy("path").agg(F.collect_list(F.struct("start", "len", "text")).alias("s"))
    return spans.select("path", F.explode(ordered.greedy_spans(F.col("s"))).alias("x")).select("path", "x.*")


@query()
def ns_new_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts after a whole session."""
    return session.run(_facts(spark, sf_dir), sample.SETTINGS).bodies


@query()
def ns_session_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9 Q18: all edits of a session as rows."""
    f = _facts(spark, sf_dir)
    return session.all_edits(written(planner.scan(session.candidates(f), f, sample.SETTINGS), "scan"), f, sample.SETTINGS)[0]


_ROOTS = [("c:\\solution\\MyApp",), ("C:/solution/Lib/Util/Helper.cs",), ("c:\\solution\\My",)]


@query(f"SELECT DISTINCT path FROM {R('candidate')} WHERE {key('path')} LIKE 'C:\\SOLUTION\\MYAPP\\%' OR {key('path')} = 'C:\\SOLUTION\\LIB\\UTIL\\HELPER.CS'")
def ns_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots match up to folder borders."""
    return ownership.below_roots(_table(spark, sf_dir, "candidate").select("path"), spark.createDataFrame(_ROOTS, "root string")).distinct()


@query(f"SELECT root FROM {sample.values(_ROOTS, 'root STRING')} r WHERE NOT EXISTS (SELECT 1 FROM {R('candidate')} c WHERE {key('c.path')} = {key('r.root')} OR starts_with({key('c.path')}, {key('r.root')} || '\\'))")
def ns_unmatched_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots without files."""
    return ownership.unmatched_roots(_table(spark, sf_dir, "candidate").select("path"), spark.createDataFrame(_ROOTS, "root string"))


_NAMES = [("MyApp.Deep",), ("Big.Shop.Common",), ("MyApp",), (".Common",), ("System.X",), ("SystemTools.Net",), ("Microsoft",), ("global:: A . B",), ("A.B (net48)",), ("OldRoot.Folder1.Folder2",), ("",)]


@query(f"""SELECT name, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS fallback, {special('name')} AS special, {norm('name')} AS norm, CASE WHEN instr(name, ' (') > 1 THEN substr(name, 1, instr(name, ' (') - 1) ELSE name END AS project,
  regexp_replace(name, '^[^.]+', 'NewRoot', 'g') AS renamed, name AS broken, name AS off, CASE WHEN starts_with(name, 'MyApp.') THEN 'X.Y.' || substr(name, 7) ELSE name END AS moved, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS ns, regexp_extract(name, '([^.]*)$', 1) AS simple,
  starts_with(name, 'global::') AS is_global, regexp_matches(lower(name), '\\.a?xaml$') AS is_xaml FROM {sample.values(_NAMES, 'name STRING')}""")
def ns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name functions side by side."""
    n = F.col("name")
    ns, simple = names.split_last_dot(n)
    return spark.createDataFrame(_NAMES, "name string").select(
        "name", names.default_fallback(n).alias("fallback"), names.is_special(n).alias("special"), names.normal_using(n).alias("norm"), names.without_framework(n).alias("project"), names.rename(n, "^[^.]+", "NewRoot").alias("renamed"),
        names.rename(n, "[unclosed", "NewRoot").alias("broken"), names.rename(n, "\\.Folder1", "").alias("off"), names.moved_name(n, F.lit("MyApp"), F.lit("X.Y")).alias("moved"), ns.alias("ns"), simple.alias("simple"), n.startswith("global::").alias("is_global"), paths.is_xaml(n).alias("is_xaml"),
    )


@query()
def ns_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped folders, written and read again."""
    keys = parse_settings(render_settings(["MyApp\\Impl", "c:/solution/MyApp/Gen/", "MyApp\\A\\..\\B"]), sample.S)
    return spark.createDataFrame([(k,) for k in keys], "folder string")


# ---- small relations -----------------------------------------------------------------------------
@query(f"SELECT full_name, ns = 'Old.Util' AS direct FROM {R('type_decl_part')} WHERE {nested('ns', "'Old.Util'")}")
def ns_subtree_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a namespace, and of all below it."""
    return _table(spark, sf_dir, "type_decl_part").where(names.nested_in(F.col("ns"), F.lit("Old.Util"))).select("full_name", (F.col("ns") == "Old.Util").alias("direct"))


@query(f"SELECT path, {norm('name')} AS ns, NOT in_namespace AS own FROM {R('using_clause')} WHERE alias IS NULL AND NOT is_static")
def ns_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clauses that import a namespace; ``own`` ones belong to the file and not to a namespace in it."""
    return _table(spark, sf_dir, "using_clause").where("alias is null and not is_static").select("path", names.normal_using(F.col("name")).alias("ns"), (~F.col("in_namespace")).alias("own"))


_ASKED = [("Old",), ("Old.Util",), ("Old.Util.Inner",), ("Old.Ut",), ("MyApp",), ("Nowhere",)]


@query(f"SELECT a.ns, EXISTS (SELECT 1 FROM {R('type_decl_part')} t WHERE {nested('t.ns', 'a.ns')}) AS found FROM {sample.values(_ASKED, 'ns STRING')} a")
def ns_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which namespaces exist. Types' namespaces are exploded into their prefixes, so it is an equi-join."""
    there = _table(spark, sf_dir, "type_decl_part").select(F.explode(names.scope_prefixes(F.col("ns"))).alias("ns")).distinct().withColumn("found", F.lit(True))
    return spark.createDataFrame(_ASKED, "ns string").join(there, "ns", "left").select("ns", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"SELECT path, arg_min(name, start) AS first_name, arg_max(name, start) AS last_name, max(start + len) AS last_end FROM {R('using_clause')} GROUP BY 1")
def ns_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last clause of a file, and where new ones go."""
    return _table(spark, sf_dir, "using_clause").groupBy("path").agg(F.min_by("name", "start").alias("first_name"), F.max_by("name", "start").alias("last_name"), F.max(F.col("start") + F.col("len")).alias("last_end"))


@query(f"SELECT path, encoding, body FROM {R('body')}")
def ns_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies written in their encodings and read back."""
    return decode_bodies(encode_bodies(_table(spark, sf_dir, "body")))


# ---- trees -------------------------------------------------------------------------------------
_NODES = [
    ("f.cs", 1, None, "unit", 0), ("f.cs", 2, 1, "ns", 5), ("f.cs", 3, 2, "ns", 20), ("f.cs", 4, 3, "class", 30), ("f.cs", 5, 4, "access", 40), ("f.cs", 6, 5, "access", 40), ("f.cs", 7, 6, "access", 40), ("f.cs", 8, 7, "name", 40),
    ("f.cs", 9, 2, "class", 10), ("f.cs", 10, 9, "name", 12), ("g.cs", 1, None, "unit", 0), ("g.cs", 2, 1, "class", 3), ("g.cs", 3, 2, "class", 9),
]
_NODE_SCHEMA = "path STRING, node INT, parent INT, kind STRING, start INT"
_NS_NAMES = [("f.cs", 2, "A.B"), ("f.cs", 3, "Inner")]
_UP = f"""nodes AS {sample.values(_NODES, _NODE_SCHEMA)}, up(path, node, ancestor, parent, kind, distance) AS (
  SELECT path, node, node, parent, kind, 0 FROM nodes UNION ALL SELECT u.path, u.node, n.node, n.parent, n.kind, u.distance + 1 FROM up u JOIN nodes n ON n.path = u.path AND n.node = u.parent)"""


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NODES, _NODE_SCHEMA)


@query(f"""WITH RECURSIVE {_UP}, run AS (SELECT u.*, n.kind AS own FROM up u JOIN nodes n ON n.path = u.path AND n.node = u.node), stop AS (SELECT path, node, min(distance) AS s FROM run WHERE kind <> own GROUP BY 1, 2)
  SELECT r.path, r.node, arg_max(r.ancestor, r.distance) AS top FROM run r LEFT JOIN stop s ON s.path = r.path AND s.node = r.node WHERE s.s IS NULL OR r.distance < s.s GROUP BY 1, 2""")
def ns_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost node of an unbroken run of one kind."""
    return trees.outermost_same_kind(_nodes(spark))


@query(f"WITH RECURSIVE {_UP} SELECT u.path, u.ancestor AS node, arg_min(n.node, u.distance * 1000 + n.start) AS found FROM up u JOIN nodes n ON n.path = u.path AND n.node = u.node WHERE u.distance > 0 AND n.kind = 'class' GROUP BY 1, 2")
def ns_first_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth first, the first descendant of a kind."""
    return trees.first_below(_nodes(spark), "class")


@query(f"WITH RECURSIVE {_UP} SELECT u.path, u.ancestor AS node, n.node AS found FROM up u JOIN nodes n ON n.path = u.path AND n.node = u.node WHERE u.distance > 0 AND n.kind = 'name'")
def ns_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of a kind."""
    return trees.below(_nodes(spark), "name")


@query(f"""WITH RECURSIVE {_UP}, named AS {sample.values(_NS_NAMES, 'path STRING, node INT, name STRING')} SELECT u.path, u.node, string_agg(m.name, '.' ORDER BY u.distance DESC) AS full_name FROM up u JOIN named m ON m.path = u.path AND m.node = u.ancestor
  WHERE (u.path, u.node) IN (SELECT path, node FROM named) GROUP BY 1, 2""")
def ns_declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names of nested declarations."""
    return trees.declared_names(_nodes(spark), spark.createDataFrame(_NS_NAMES, "path string, node int, name string"))


_ERRORS = [("A", "Error", "e2"), ("A", "Warning", "w"), ("B", "Error", "e1"), ("A", "Error", "e1"), ("A", "Hidden", "h")]


@query(f"SELECT project_name, message FROM {sample.values(_ERRORS, 'project_name STRING, severity STRING, message STRING')} WHERE severity = 'Error' ORDER BY 1, 2 LIMIT 10")
def ns_compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten errors."""
    return spark.createDataFrame(_ERRORS, "project_name string, severity string, message string").where("severity = 'Error'").orderBy("project_name", "message").limit(10).select("project_name", "message")


@query(f"SELECT seq, CASE WHEN seq % 2 = 0 THEN seq || '/' || n || ' Performing cleanup ' || path ELSE seq || '/' || n || ': ' || path END AS line FROM {R('candidate')}, (SELECT count(*) AS n FROM {R('candidate')})")
def ns_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of both stages."""
    files = _table(spark, sf_dir, "candidate")
    n = files.count()
    return files.select("seq", F.when(F.col("seq") % 2 == 0, F.format_string("%d/%d Performing cleanup %s", "seq", F.lit(n), "path")).otherwise(F.format_string("%d/%d: %s", "seq", F.lit(n), "path")).alias("line"))


# ---- markup --------------------------------------------------------------------------------------
@query(f"""SELECT path, len(regexp_extract_all(body, '(?s)<!--.*?-->')) AS n_comments, regexp_extract(body, 'xmlns:(\\w+)="http://schemas.microsoft.com/winfx/2006/xaml"', 1) AS language_alias,
  regexp_extract(body, 'x:Class\\s?=\\s?"([\\w.]+)\\.\\w+"', 1) AS root_ns, regexp_extract(body, 'x:Class\\s?=\\s?"[\\w.]+\\.(\\w+)"', 1) AS root_name, len(regexp_extract_all(body, 'xmlns\\s*:\\s*(\\w+)\\s*=\\s*"(clr-namespace|using):')) AS n_mappings,
  len(regexp_extract_all(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '<\\s?/?\\s?\\w+\\s?:\\s?\\w+')) AS n_tags, len(regexp_extract_all(body, '\\{{\\s?x:(Type|Static)\\s+\\w+\\s?:\\s?\\w+')) AS n_extensions FROM {R('body')} WHERE path LIKE '%.xaml'""")
def ns_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's fragments say."""
    b = _table(spark, sf_dir, "body").where("path like '%.xaml'")
    f = markup.scan(b)
    comments = markup.matches(b, markup.COMMENT).groupBy("path").agg(F.count("*").alias("n_comments"))
    root = planner.root_classes(f).select("path", F.col("ns").alias("root_ns"), F.col("name").alias("root_name"))
    n = f.groupBy("path").agg(F.max(F.when(F.col("kind") == "language", F.col("alias"))).alias("language_alias"), *[F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in (("mapping", "n_mappings"), ("tag", "n_tags"), ("extension", "n_extensions"))])
    return n.join(comments, "path").join(root, "path").select("path", "n_comments", "language_alias", "root_ns", "root_name", "n_mappings", "n_tags", "n_extensions")


@query()
def ns_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fragments with positions."""
    return markup.scan(_table(spark, sf_dir, "body"))


@query(f"""SELECT DISTINCT 'c:\\solution\\MyApp\\Views\\Main.xaml' AS path, source_ns, class_name, target_ns FROM {sample.values([("A.B.Class1", "A.B", "Class1", "X"), ("Old.Views.Main", "Old.Views", "Main", "Y"), ("Z.No", "Z", "No", "Y")], _MOVED_SCHEMA)}
  WHERE EXISTS (SELECT 1 FROM {R('body')} b WHERE path LIKE '%.xaml' AND (contains(body, 'clr-namespace:' || source_ns || ';') AND contains(body, ':' || class_name) OR contains(body, 'x:Class="' || source_ns || '.' || class_name || '"')))""")
def ns_markup_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents refer to which moved types, by equi-joins."""
    moved = spark.createDataFrame([("A.B.Class1", "A.B", "Class1", "X"), ("Old.Views.Main", "Old.Views", "Main", "Y"), ("Z.No", "Z", "No", "Y")], _MOVED_SCHEMA)
    return markup_moves.affected(markup.scan(_table(spark, sf_dir, "body")), moved).select("path", "source_ns", "class_name", "target_ns")


@query()
def ns_markup_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after two types have moved."""
    moved = spark.createDataFrame([("A.B.Class1", "A.B", "Class1", "X.New"), ("Old.Views.Main", "Old.Views", "Main", "Y")], _MOVED_SCHEMA)
    return markup_moves.move(_table(spark, sf_dir, "body"), moved)


# ---- the same operators on the driver's tables ---------------------------------------------------
@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x, i: i > 1 AND x <> ''), '.') AS chain FROM pages")
def tb_url_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on URLs: the host as project folder, path segments as the chain."""
    # a URL's segments are folders here, so a file name is put after them
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+", "/")
    file = F.concat(F.rtrim(url, F.lit("/")), F.lit("/x"))
    project = F.concat(F.substring_index(url, "/", 1), F.lit("/p"))
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(paths.folder_chain(file, project), ".").alias("chain"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def tb_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user."""
    return ordered.first_wins(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def tb_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10's rule: the last event of each user."""
    return ordered.last_wins(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'O') AND NOT bool_and(l_linestatus = 'O')")
def tb_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: orders whose lines disagree."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.lit("").alias("ns"), (F.col("l_linestatus") == "O").alias("alive"))
    return state.contradictory(lines).select(F.col("path").alias("l_orderkey"))


@query("SELECT page_id AS path, strlen(c[1]) AS start_bytes, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS n FROM (SELECT page_id, html, string_split_regex(html, '(?s)<!--.*?-->') AS c FROM pages) WHERE len(c) > 1")
def tb_comment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of pages, with the place of the first."""
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("body"))
    found = markup.matches(pages, markup.COMMENT).groupBy("path").agg(F.min("start").alias("s"), F.count("*").alias("n"))
    return found.join(pages, "path").select("path", F.octet_length(F.substring("body", F.lit(1), F.col("s"))).alias("start_bytes"), "n")


_DAY = "date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)::INTEGER"


@query(f"""SELECT o_custkey, unnest(list_reduce(list_prepend({{'kept': []::STRUCT(start INTEGER, len INTEGER, text VARCHAR)[], 'fin': -1::INTEGER}}, list_transform(spans, lambda s: {{'kept': [s], 'fin': s.start + s.len}})),
   lambda a, x: CASE WHEN x.kept[1].start < a.fin THEN a ELSE {{'kept': a.kept || x.kept, 'fin': x.fin}} END).kept, recursive := true)
   FROM (SELECT o_custkey, list({{'start': s, 'len': l, 'text': t}} ORDER BY s, l DESC) AS spans FROM (SELECT o_custkey, {_DAY} AS s, (20 + o_orderkey % 40)::INTEGER AS l, min(o_orderkey)::VARCHAR AS t FROM orders GROUP BY 1, 2, 3) GROUP BY 1)""")
def tb_greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as spans of days, overlaps dropped greedily."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("start"), (20 + F.col("o_orderkey") % 40).cast("int").alias("len"), "o_orderkey")
    once = o.groupBy("o_custkey", "start", "len").agg(F.min("o_orderkey").cast("string").alias("text"))
    spans = once.groupBy("o_custkey").agg(F.collect_list(F.struct("start", "len", "text")).alias("s"))
    return spans.select("o_custkey", F.explode(ordered.greedy_spans(F.col("s"))).alias("x")).select("o_custkey", "x.*")


@query("""SELECT page_id, prefix FROM (SELECT p.page_id, f.prefix, row_number() OVER (PARTITION BY p.page_id ORDER BY length(f.prefix) DESC, f.prefix) AS r
  FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) p JOIN (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS prefix FROM pages) f ON p.url = f.prefix OR starts_with(p.url, f.prefix || '/')) WHERE r = 1""")
def tb_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest known folder above each URL, by the join of files with project folders."""
    url = F.regexp_replace("url", "[?#].*$", "")
    pages = _t(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    folders = pages.select(F.regexp_replace("url", "/[^/]*$", "").alias("prefix")).distinct()
    # a URL lies below itself too: one more part makes it a folder
    projects = folders.select(F.concat("prefix", F.lit("/p")).alias("project_file"), F.lit(0).alias("project_ord"))
    found = ownership.deepest_project(pages.select(F.concat("url", F.lit("/x")).alias("path")).distinct(), projects)
    return pages.withColumn("path", F.concat("url", F.lit("/x"))).join(found, "path").select("page_id", F.regexp_replace("project_file", "/p$", "").alias("prefix"))


# ---- the same queries on a generated solution, one file an order -----------------------------------
def _at_volume(sql: str) -> str:
    for name in sample.TABLES:
        sql = sql.replace(sample.relation(name), synthetic.relation(name))
    return sql


def _generated(of: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(spark, synthetic.Solution(sf_dir))

    name = of.__name__.replace("ns_", "sx_")
    run.__name__, run.__doc__ = name, f"{of.__doc__} Over the solution that the tables give."
    query(_at_volume(_SQL[of.__name__]) if of.__name__ in _SQL else None)(run)


for _of in (
    ns_file_projects, ns_deepest_project, ns_default_namespaces, ns_targets, ns_transitions, ns_shared_files, ns_alive_outside, ns_alive_anywhere, ns_contradictory, ns_plan,
    ns_moving_types, ns_simple_names, ns_type_conflicts, ns_types_per_namespace, ns_imports,
):
    _generated(_of)


def _moves(spark: SparkSession, sf_dir: str) -> tuple[Facts, DataFrame]:
    f = synthetic.facts(spark, sf_dir)
    return f, planner.moving_types(written(planner.plan(f["candidate"], f, sample.SETTINGS), "plans"), f)


_SX_EMPTIED = _emptied_of(f"(SELECT DISTINCT path, ns, full_name, target_ns FROM {_at_volume(MOVING)})", _at_volume(f"(SELECT path, ns, full_name FROM {R('type_decl_part')})"))


@query(f"SELECT ns FROM {_SX_EMPTIED}")
def sx_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that the planned moves empty, over the solution that the tables give."""
    f, moves = _moves(spark, sf_dir)
    return state.emptied(f["type_decl_part"], moves)


@query(f"SELECT path, start AS span_start, len AS span_len FROM {_at_volume(R('using_clause'))} u WHERE {norm('name')} IN (SELECT ns FROM {_SX_EMPTIED})")
def sx_dead_usings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of emptied namespaces, over the solution that the tables give."""
    f, moves = _moves(spark, sf_dir)
    return state.dead_usings(f["using_clause"], state.emptied(f["type_decl_part"], moves)).select("path", "span_start", "span_len")


@query()
def sx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan, over the solution that the tables give. Turn by turn SQL is too slow here; tests compare it with a plain loop."""
    f = synthetic.facts(spark, sf_dir)
    return planner.scan(f["candidate"], f, sample.SETTINGS)
