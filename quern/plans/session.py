"""A whole run: candidates, scan, edits, new bodies, cleanup, and the exit code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import normal_using, scope_prefixes
from quern.functions.paths import path_key
from quern.model import Facts, FileProcessError, Settings
from quern.operators.ownership import below_roots, file_projects, unmatched_roots
from quern.operators.state import alive_anywhere, alive_outside, dead_usings, direct_types, emptied, gone_for_file
from quern.plans import edits, markup_moves, planner, references
from quern.sources.tables import written

#: What a run returns to the shell.
SUCCESS, ERROR, ADJUSTMENT_REQUIRED = 0, 1, 2


@dataclass
class Outcome:
    scan: DataFrame | None
    edits: DataFrame | None
    bodies: DataFrame | None
    exit_code: int
    said: list[str]


def candidates(facts: Facts, project_file: str | None = None) -> DataFrame:
    """(seq, path) of the solution's files below the asked roots, of one project if one is named.

    They come by project, then in the order that the solution states (``ord``), then by path; of two files that
    would place the same type name, the first one keeps it.
    """
    files = file_projects(facts["solution_file"])
    if project_file is not None:
        files = files.where(path_key(F.col("project_file")) == path_key(F.lit(project_file)))
    # numbers grow along a sort by ranges, so no task numbers all files; they are written, since later steps must see the same ones
    asked = below_roots(files.select("path", "project_ord", "ord"), facts["path_root"]).orderBy("project_ord", "ord", path_key(F.col("path")))
    return written(asked.select(F.monotonically_increasing_id().alias("seq"), "path"), "candidates")


def exit_code(n_plan: int, n_block: int, settings: Settings) -> int:
    """Blocked files win over the finding of a check; they do not keep others from being adjusted."""
    if n_block:
        return ERROR
    return ADJUSTMENT_REQUIRED if settings.check_only and n_plan else SUCCESS


def compile_errors(diagnostic: DataFrame, shown: int = 10) -> tuple[int, list[str]]:
    """How many errors there are, and the first few."""
    errors = diagnostic.where("severity = 'Error'")
    return errors.count(), [f"{r['project_name']}: {r['message']}" for r in errors.orderBy("project_name", "message").limit(shown).collect()]


def all_edits(found: DataFrame, facts: Facts, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(edit rows with spans to apply, moved types) of the planned code files of a scan."""
    plans = found.where("outcome = 'plan'")
    target = plans.where("not is_xaml").select("seq", "path", path_key(F.col("path")).alias("path_key"), "target_ns")
    moves = written(planner.transitions(facts["namespace_decl"], target).join(target.select("path_key", "path"), "path_key"), "moves")
    types = written(planner.moving_types(plans, facts), "moving-types")
    moved = types.select(F.col("full_name").alias("type_full"), F.col("ns").alias("source_ns"), F.col("type_name").alias("class_name"), "target_ns").distinct()
    # references also follow the types nested in moved ones, at any depth
    inner = facts["type_decl_part"].where("containing_type is not null").select(F.col("full_name").alias("inner_full"), F.col("ns").alias("source_ns"), F.col("type_name").alias("inner_name")).distinct()
    around = inner.withColumn("type_full", F.explode(scope_prefixes(F.col("inner_full")))).where("type_full <> inner_full")
    nested = around.join(moved, ["source_ns", "type_full"]).select(F.col("inner_full").alias("type_full"), "source_ns", F.col("inner_name").alias("class_name"), "target_ns")
    ref = references.reference_edits(facts["name_ref"], facts["visible_name"], moved.unionByName(nested))
    own = references.self_reference_edits(facts["name_ref"], moves)
    docs = facts["document"].select(path_key(F.col("path")).alias("path_key"), "project_id")
    asked = moves.where("is_root").select("path_key", "path", F.col("original").alias("ns")).join(docs, "path_key").select("path", "project_id", "ns")
    old = alive_anywhere(alive_outside(asked, facts["type_decl_part"])).select("path", F.lit("add_using").alias("kind"), F.lit(None).cast("int").alias("span_start"), F.lit(None).cast("int").alias("span_len"), F.col("ns").alias("text"), F.lit(0).alias("at"))
    rows = written(edits.edit_set(ref.unionByName(own).unionByName(old)), "edits")
    names = edits.rename_spans(facts["namespace_decl"], moves).select("path", F.lit("move_namespace").alias("kind"), F.col("start").alias("span_start"), F.col("len").alias("span_len"), "text", F.col("start").alias("at"))
    # clauses written by this run are cleaned up like those that were there
    added = rows.where("kind = 'add_using'").select("path", F.col("text").alias("name"))
    clauses = facts["using_clause"].select("path", "name").unionByName(added).distinct()
    direct = direct_types(clauses.select("path", normal_using(F.col("name")).alias("ns")), facts["document"], facts["type_decl_part"], types, facts["name_ref"])
    gone = gone_for_file(clauses, types, direct)
    empty = emptied(facts["type_decl_part"], types)
    lost = added.join(empty.select(F.col("ns").alias("name")), "name", "left_semi").select("path", "name").unionByName(added.join(gone.withColumnRenamed("ns", "name"), ["path", "name"], "left_semi").select("path", "name")).distinct()
    rows = rows.join(lost.select("path", F.col("name").alias("text"), F.lit("add_using").alias("kind")), ["path", "text", "kind"], "left_anti").select(*rows.columns)
    dead = dead_usings(facts["using_clause"], empty, gone).select("path", "kind", "span_start", "span_len", "text", F.col("span_start").alias("at"))
    return rows.unionByName(names).unionByName(dead), moved


def run(facts: Facts, settings: Settings, project_file: str | None = None, cancelled: Callable[[], bool] = lambda: False) -> Outcome:
    """The answer as relations; bodies are not written here (see quern.sources.tables.encode_bodies).

    A solution with errors stops the run unless it is forced; a root that no file matches is only reported.
    A failure while planning names its file and ends the run (FileProcessError); a blocked file does not.
    Cancelling is an outcome, asked for between steps: what has been found is kept, the exit code is ERROR.
    """
    errors, shown = compile_errors(facts["diagnostic"])
    if errors and not settings.force:
        return Outcome(None, None, None, ERROR, [*shown, f"{errors} error(s)"])
    said = [f"warning: {r['root']} contains no file of this solution." for r in unmatched_roots(file_projects(facts["solution_file"]).select("path"), facts["path_root"]).collect()]  # of the roots asked for
    try:
        found = written(planner.scan(candidates(facts, project_file), facts, settings), "scan")
    except PySparkException as e:
        if (file_error := FileProcessError.found_in(str(e))) is None:
            raise
        raise file_error from e
    if cancelled():
        return Outcome(found, None, None, ERROR, [*said, "cancelled"])
    counts = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count("*").alias("n")).toLocalIterator()}  # three rows
    code = exit_code(counts.get("plan", 0), counts.get("block", 0), settings)
    if settings.dry_run or settings.check_only or not counts.get("plan", 0):
        return Outcome(found, None, None, code, said)
    rows, moved = all_edits(found, facts, settings)
    if cancelled():
        return Outcome(found, rows, None, ERROR, [*said, "cancelled"])
    spans = rows.where("span_start is not null").select("path", F.col("span_start").alias("start"), F.col("span_len").alias("len"), "text")
    fresh = edits.using_spans(edits.new_usings(rows, facts["using_clause"]), facts["using_clause"], facts["body"])
    code_bodies = edits.apply(facts["body"], spans.unionByName(fresh))
    roots = found.where("outcome = 'plan' and is_xaml").select("path", "target_ns")
    return Outcome(found, rows, code_bodies.unionByName(markup_moves.move(facts["body"], moved, roots=roots)), code, said)
