"""From facts to decisions: targets, transitions, the plan of each file, the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import markup
from quern.functions.names import compose, is_special, transition, type_conflict
from quern.functions.paths import folder_chain, is_xaml, path_key
from quern.model import BLOCKS, Facts, Settings
from quern.operators.ordered import first_wins, reserve
from quern.operators.ownership import default_namespaces, file_projects, in_scope, shared_files
from quern.operators.state import alive_outside, contradictory, simple_names
from quern.sources.tables import written


def message_of(kind: Column) -> Column:
    out = F
    for name, text in BLOCKS.items():
        out = out.when(kind == name, F.lit(text))
    return out.otherwise(F.lit("The file cannot be adjusted."))


def targets(candidates: DataFrame, facts: Facts, settings: Settings) -> DataFrame:
    """(seq, path, path_key, project_file, chain, target_ns): null where the file has no project or lies outside its folder."""
    owner = file_projects(facts["solution_file"]).select("path_key", "project_name", "project_file")
    spaces = default_namespaces(owner, facts["default_ns"]).drop("project_name")
    out = candidates.withColumn("path_key", path_key(F.col("path"))).join(owner, "path_key", "left").join(spaces, "project_file", "left")
    chain = folder_chain(F.col("path"), F.col("project_file"), settings.skipped)
    return out.withColumn("chain", chain).select("seq", "path", "path_key", "project_file", "chain", compose(F.col("default_ns"), F.col("chain"), settings.pattern, settings.replacement).alias("target_ns"))


def transitions(decls: DataFrame, target: DataFrame) -> DataFrame:
    """(path_key, original, modified, is_root, ord): all declarations of a file over its compilations, distinct, the first kept."""
    d = decls.withColumn("path_key", path_key(F.col("path"))).drop("path").join(target.where("target_ns is not null").select("path_key", "target_ns"), "path_key")
    t = d.withColumn("t", transition(F.col("parts"), F.col("file_scoped"), F.col("target_ns"))).where("t is not null")
    t = t.select("path_key", "t.*", F.struct("project_id", F.col("file_scoped").cast("int").alias("late"), "ord").alias("o"))
    t = t.where(~is_special(F.col("original")))
    return t.groupBy("path_key", "original", "modified", "is_root").agg(F.min("o").alias("ord"))


def plan(candidates: DataFrame, facts: Facts, settings: Settings) -> DataFrame:
    """(seq, path, outcome, target_ns, is_xaml, block_kind, message): outcome is plan, block or none.

    The order of the questions is the contract: no project, several projects (of the code behind, for markup),
    unknown target, then for code: no document, nothing to move, disagreement.
    """
    t = targets(candidates, facts, settings)
    moves = transitions(facts["namespace_decl"], t)
    docs = facts["document"].withColumn("path_key", path_key(F.col("path")))
    shared = shared_files(facts["document"])
    first_doc = first_wins(docs, ["path_key"], ["project_id"])
    processable = in_scope(first_doc).select("path_key").withColumn("processable", F.lit(True))
    asked = moves.select("path_key", F.col("original").alias("ns")).distinct().join(docs.select("path_key", "project_id", "path"), "path_key").select("path", "project_id", "ns")
    torn = contradictory(alive_outside(asked, facts["type_decl_part"])).select(path_key(F.col("path")).alias("path_key")).distinct()
    code_key = F.when(is_xaml(F.col("path")), F.concat("path_key", F.lit(".CS"))).otherwise(F.col("path_key"))
    out = (
        t.withColumn("is_xaml", is_xaml(F.col("path"))).withColumn("code_key", code_key)
        .join(shared.select(F.col("path_key").alias("code_key"), F.lit(True).alias("several")), "code_key", "left")
        .join(processable, "path_key", "left")
        .join(moves.select("path_key").distinct().withColumn("moves", F.lit(True)), "path_key", "left")
        .join(torn.withColumn("torn", F.lit(True)), "path_key", "left")
    )
    kind = (
        F.when(F.col("project_file").isNull(), "NoProject")
        .when(F.col("several") & F.col("is_xaml"), "XamlCodeBehindMultiProject")
        .when(F.col("several"), "CompiledBySeveralProjects")
        .when(F.coalesce("target_ns", F.lit("")) == "", "TargetNamespaceUnknown")
        .when(F.col("is_xaml"), F.lit(None))
        .when(F.col("processable").isNull(), "NotAProcessableDocument")
        .when(F.col("moves").isNull(), "")
        .when(F.col("torn"), "NamespaceStateContradictory")
    )
    out = out.withColumn("k", kind)
    return out.select(
        "seq", "path", F.when(F.col("k").isNull(), "plan").when(F.col("k") == "", "none").otherwise("block").alias("outcome"), F.when(F.col("k").isNull(), F.col("target_ns")).alias("target_ns"),
        "is_xaml", F.when(F.col("k") != "", F.col("k")).alias("block_kind"), F.when(F.col("k") != "", message_of(F.col("k"))).alias("message"),
    )


def moving_types(plans: DataFrame, facts: Facts) -> DataFrame:
    """(seq, path, ns, full_name, type_name, target_ns, pos) of the top-level types that planned files would move.

    The transition is that of the declaration a type is written in, never that of a namespace name.
    """
    p = plans.where("outcome = 'plan' and not is_xaml").select("seq", "path", "target_ns", path_key(F.col("path")).alias("k"))
    d = facts["namespace_decl"].select(path_key(F.col("path")).alias("k"), "project_id", "decl_id", "parts", "file_scoped")
    t = facts["type_decl_part"].where("containing_type is null").select(path_key(F.col("path")).alias("k"), "project_id", "ns", "type_name", "full_name", "decl_id", "ord")
    j = t.join(d, ["k", "project_id", "decl_id"]).join(p, "k").where((F.col("ns") != F.col("target_ns")) & ~is_special(F.col("ns")))
    j = j.withColumn("t", transition(F.col("parts"), F.col("file_scoped"), F.col("target_ns"))).where("t is not null")
    return j.groupBy("seq", "path", "ns", "full_name", "type_name", F.col("t.modified").alias("target_ns")).agg(F.min("ord").alias("pos"))


def root_classes(fragments: DataFrame) -> DataFrame:
    """(path, ns, name) of the first class fragment of each document."""
    return fragments.where("kind = 'class'").groupBy("path").agg(F.min_by(F.struct("ns", "name"), "start").alias("c")).select("path", "c.ns", "c.name")


def scan(candidates: DataFrame, facts: Facts, settings: Settings, fragments: DataFrame | None = None) -> DataFrame:
    """The plan with conflicts resolved: markup that would not change becomes none, and a file
    that would place a type where one of that name is, or is about to be, is blocked."""
    plans = written(plan(candidates, facts, settings), "plans")  # used three times below
    fragments = markup.scan(facts["body"]) if fragments is None else fragments
    roots = root_classes(fragments).select(path_key(F.col("path")).alias("k"), F.col("ns").alias("root_ns"))
    moving = moving_types(plans, facts)
    claims = moving.select(F.col("path").alias("owner"), "seq", F.col("target_ns").alias("ns"), "type_name", "pos")
    _, refused = reserve(claims, simple_names(facts["type_decl_part"]))
    out = plans.withColumn("k", path_key(F.col("path"))).join(roots, "k", "left").join(refused.select(F.col("owner").alias("path"), F.col("ns").alias("c_ns"), F.col("type_name").alias("c_name")), "path", "left")
    still = F.col("is_xaml") & (F.col("outcome") == "plan") & (F.col("root_ns").isNull() | (F.col("root_ns") == F.col("target_ns")))
    hit = F.col("c_name").isNotNull()
    return out.select(
        "seq", "path", F.when(still, "none").when(hit, "block").otherwise(F.col("outcome")).alias("outcome"), F.when(~still & ~hit, F.col("target_ns")).alias("target_ns"),
        "is_xaml", F.when(hit, "TypeNameConflict").otherwise(F.col("block_kind")).alias("block_kind"), F.when(hit, type_conflict(F.col("c_ns"), F.col("c_name"))).otherwise(F.col("message")).alias("message"),
    )
