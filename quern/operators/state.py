"""What is left of namespaces: alive, contradictory, emptied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import moved_name, normal_using
from quern.functions.paths import is_generated, path_key
from quern.operators.ordered import last_wins


def simple_names(types: DataFrame) -> DataFrame:
    """Distinct (ns, type_name) of top-level types over all projects."""
    return types.where("containing_type is null").select("ns", "type_name").distinct()


def types_by_full_name(types: DataFrame) -> DataFrame:
    """One row per full name, the last project's."""
    return last_wins(types, ["full_name"], ["ord", "project_id", "path"]).select("full_name", "ns")


def types_per_namespace(types: DataFrame) -> DataFrame:
    return types_by_full_name(types).groupBy("ns").agg(F.array_sort(F.collect_set("full_name")).alias("types"))


def partial_types(types: DataFrame) -> DataFrame:
    """full_name of types declared in several files that are not generated."""
    hand = types.where(F.col("path").isNotNull() & ~is_generated(F.col("path"))).select("full_name", path_key(F.col("path")).alias("k"))
    return hand.groupBy("full_name").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("full_name")


def alive_outside(questions: DataFrame, types: DataFrame) -> DataFrame:
    """(path, project_id, ns, alive) for each (path, project_id, ns): is the namespace filled outside the file in that compilation?

    Metadata types count; so does a declaration in another file, unless it is the generated part
    of a type that the file declares too.
    """
    q = questions.select("path", "project_id", "ns").distinct().withColumn("own_key", path_key(F.col("path")))
    place = ["project_id", "ns"]
    part = types.select(*place, "full_name", path_key(F.col("path")).alias("k"), F.coalesce("from_metadata", F.lit(False)).alias("fixed"), (F.col("path").isNotNull() & is_generated(F.col("path"))).alias("made"))
    # of the files that fill a namespace by hand only the least and the largest matter: one of them is another file, or none is
    by_hand = F.when(~F.col("made"), F.col("k"))
    filled = part.groupBy(*place).agg(F.bool_or("fixed").alias("fixed"), F.min(by_hand).alias("a"), F.max(by_hand).alias("z"))
    # a generated part counts unless its type is declared in the file too, which is so if there are more such types than the file declares
    made = part.where("made").select(*place, "full_name").distinct()
    n_made = made.groupBy(*place).agg(F.count("*").alias("n_made"))
    own = part.where("k is not null").select(*place, "full_name", F.col("k").alias("own_key")).distinct()
    n_mine = own.join(made, [*place, "full_name"]).groupBy(*place, "own_key").agg(F.count("*").alias("n_mine"))
    j = q.join(filled, place, "left").join(n_made, place, "left").join(n_mine, [*place, "own_key"], "left")
    none = F.lit(False)
    alive = F.coalesce("fixed", none) | F.coalesce((F.col("a") != F.col("own_key")) | (F.col("z") != F.col("own_key")), none) | F.coalesce(F.col("n_made") > F.coalesce("n_mine", F.lit(0)), none)
    return j.select("path", "project_id", "ns", alive.alias("alive"))


def contradictory(alive: DataFrame) -> DataFrame:
    """(path, ns) about which the compilations of a file disagree; unknown (null) ones do not count."""
    return alive.groupBy("path", "ns").agg(F.bool_or("alive").alias("any"), F.bool_and("alive").alias("every")).where("any and not every").select("path", "ns")


def alive_anywhere(alive: DataFrame) -> DataFrame:
    """(path, ns) alive outside the file in some compilation; an unknown one counts as alive."""
    return alive.groupBy("path", "ns").agg(F.bool_or(F.coalesce("alive", F.lit(True))).alias("alive")).where("alive").select("path", "ns")


def removed(types: DataFrame, moves: DataFrame) -> DataFrame:
    """(full_name, ns) of the types that leave their namespace: all files that declare them by hand have moved them."""
    hand = types.where(F.col("path").isNotNull() & ~is_generated(F.col("path"))).select("full_name", path_key(F.col("path")).alias("k")).distinct()
    moved = moves.select("full_name", "ns", path_key(F.col("path")).alias("k")).distinct()
    stay = hand.join(moved, ["full_name", "k"], "left_anti").select("full_name").distinct()
    return moved.select("full_name", "ns").distinct().join(stay, "full_name", "left_anti")


def emptied(types: DataFrame, moves: DataFrame) -> DataFrame:
    """Namespaces that held types before, lost some and hold none after a batch of moves.

    moves: (path, ns, full_name, target_ns), one row per moved declaration.  A type leaves its old
    namespace when all files that declare it by hand have moved it; it arrives in the new
    one with the first.  Set algebra over before, removed and added: no state, no order.
    """
    gone = removed(types, moves)
    before = types_by_full_name(types).select("ns", "full_name")
    added = moves.select(F.col("target_ns").alias("ns"), moved_name(F.col("full_name"), F.col("ns"), F.col("target_ns")).alias("full_name"))
    after = before.join(gone, ["ns", "full_name"], "left_anti").unionByName(added).select("ns").distinct()
    lost = before.join(gone, ["ns", "full_name"], "left_semi").select("ns").distinct()
    return lost.join(after, "ns", "left_anti")


def direct_types(asked: DataFrame, document: DataFrame, types: DataFrame, moves: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, ns, has_direct_type) for each asked (path, ns) of a touched namespace, one row per compilation of the file, after the moves.

    A compilation sees the types that it has rows of, and those of the compilations it refers to: its files name a
    type of theirs that it does not have itself.  If none of these had the namespace before, it is not known how
    the clause is resolved, and it counts as filled.
    """
    touched = moves.select("ns").distinct()
    named = moves.select("full_name", "ns", "target_ns", path_key(F.col("path")).alias("k")).distinct()
    docs = document.where("path is not null").select(path_key(F.col("path")).alias("k"), "project_id").distinct()
    top = types.where("containing_type is null").select("project_id", "ns", "full_name", path_key(F.col("path")).alias("k"), F.coalesce(is_generated(F.col("path")), F.lit(False)).alias("made"), F.coalesce("from_metadata", F.lit(False)).alias("fixed"))
    inside = top.join(touched, "ns", "left_semi")
    left = inside.join(named.select("full_name", "ns", "k").distinct().withColumn("went", F.lit(True)), ["full_name", "ns", "k"], "left").join(removed(types, moves).withColumn("all_went", F.lit(True)), ["full_name", "ns"], "left")
    stays = left.where(F.col("fixed") | ~(F.coalesce("went", F.lit(False)) | (F.col("made") & F.coalesce("all_went", F.lit(False))))).select("project_id", "ns")
    come = top.join(named, ["full_name", "ns", "k"]).select("project_id", F.col("target_ns").alias("ns"))
    used = refs.select(path_key(F.col("path")).alias("k"), "type_full").distinct().join(docs, "k").select("project_id", F.col("type_full").alias("full_name")).distinct()
    own = types.select("project_id", "full_name").distinct()
    far = used.join(own, ["project_id", "full_name"], "left_anti").join(own.withColumnRenamed("project_id", "seen_id"), "full_name").select("project_id", "seen_id")
    sees = far.unionByName(docs.select("project_id", F.col("project_id").alias("seen_id"))).distinct()

    def seen(rows: DataFrame, name: str) -> DataFrame:
        return sees.join(rows.select(F.col("project_id").alias("seen_id"), "ns").distinct(), "seen_id").select("project_id", "ns").distinct().withColumn(name, F.lit(True))

    q = asked.select("path", "ns", path_key(F.col("path")).alias("k")).distinct().join(touched, "ns", "left_semi").join(docs, "k")
    q = q.join(seen(inside, "known"), ["project_id", "ns"], "left").join(seen(stays.unionByName(come), "filled"), ["project_id", "ns"], "left")
    return q.select("path", "ns", (F.col("filled").isNotNull() | F.col("known").isNull()).alias("has_direct_type"))


def gone_for_file(using: DataFrame, touched: DataFrame, direct: DataFrame) -> DataFrame:
    """(path, ns) of touched namespaces without direct types in any compilation of the file.

    direct: (path, ns, has_direct_type), one row per compilation.  A file without
    compilations loses nothing.
    """
    asked = using.select("path", normal_using(F.col("name")).alias("ns")).distinct().join(touched.select("ns").distinct(), "ns", "left_semi")
    filled = direct.groupBy("path", "ns").agg(F.max(F.col("has_direct_type").cast("int")).alias("filled"))
    return asked.join(filled, ["path", "ns"]).where("filled = 0").select("path", "ns")


def dead_usings(using: DataFrame, dead: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Edits that delete using clauses of emptied namespaces: with (ns), and with (path, ns) for single files."""
    named = using.withColumn("ns", normal_using(F.col("name")))
    hit = named.join(dead.select("ns").distinct(), "ns", "left_semi")
    if gone is not None:
        hit = hit.unionByName(named.join(gone, ["path", "ns"], "left_semi").select(*hit.columns)).distinct()
    return hit.select("path", F.lit(0).alias("seq"), F.lit("delete_using").alias("kind"), F.col("start").alias("span_start"), F.col("len").alias("span_len"), F.lit("").alias("text"))
