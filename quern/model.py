"""The relations of the engine: code facts that come in, plans and edits that come out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "solution_file": "path STRING, project_name STRING, project_file STRING, priority INT, project_ord INT, ord INT",
    "document": "path STRING, project_id STRING, project_name STRING, project_file STRING, language STRING, supports_compilation BOOLEAN",
    "default_ns": "project_file STRING, default_ns STRING, ord INT",
    "namespace_decl": "path STRING, project_id STRING, decl_id INT, parts ARRAY<STRING>, file_scoped BOOLEAN, name_start INT, name_len INT, ord INT",
    "type_decl_part": "path STRING, project_id STRING, ns STRING, type_name STRING, full_name STRING, containing_type STRING, kind STRING, decl_id INT, from_metadata BOOLEAN, ord INT",
    "using_clause": "path STRING, name STRING, alias STRING, is_static BOOLEAN, in_namespace BOOLEAN, start INT, len INT",
    "name_ref": "path STRING, start INT, len INT, text STRING, type_full STRING, symbol_ns STRING, symbol_kind STRING, parent_kind STRING, scope_ns STRING, outer_start INT, outer_len INT, tail STRING, container_is_namespace BOOLEAN, chain_pos INT, is_global BOOLEAN",
    "visible_name": "path STRING, start INT, name STRING, is_namespace BOOLEAN, full_name STRING",
    "body": "path STRING, encoding STRING, body STRING",
    "moved_type": "type_full STRING, source_ns STRING, class_name STRING, target_ns STRING",
    "candidate": "seq BIGINT, path STRING",
    "path_root": "root STRING",
    "diagnostic": "project_name STRING, severity STRING, message STRING",
}
EDIT = "path STRING, seq INT, kind STRING, span_start INT, span_len INT, text STRING"
FRAGMENT = "path STRING, kind STRING, start INT, len INT, prefix STRING, alias STRING, name STRING, ns STRING, suffix STRING, form STRING, is_markup_ext BOOLEAN"

#: Why a file is blocked, and what is said about it.
BLOCKS = {
    "NoProject": "The file belongs to no project of the solution.",
    "TargetNamespaceUnknown": "The target namespace cannot be determined (the file is outside of the project folder).",
    "NotAProcessableDocument": "The file is not a processable C# document.",
    "CompiledBySeveralProjects": "Several projects compile the file; there is no single target namespace.",
    "NamespaceStateContradictory": "The target frameworks disagree whether the old namespace stays alive.",
    "XamlCodeBehindMultiProject": "The code behind of the xaml is compiled by several projects.",
    "TypeNameConflict": "The target namespace already contains a type of the same name.",
}


class FileProcessError(Exception):
    """A file that cannot be processed at all: it is named, and the run ends (a blocked file does not end it)."""

    _MARK = "cannot process the file "

    def __init__(self, path: str, why: str) -> None:
        super().__init__(path, why)
        self.path, self.why = path, why

    def __str__(self) -> str:
        return f"{self._MARK}<{self.path}>: {self.why}"

    @classmethod
    def found_in(cls, text: str) -> FileProcessError | None:
        """The one that a failed Spark job reports, since a task's exception reaches the driver as text."""
        m = re.search(cls._MARK + r"<([^>]*)>: (.*)", text)
        return cls(m[1], m[2]) if m else None


@dataclass(frozen=True)
class Settings:
    """A run's configuration: skipped folders (canonical keys), the rename, and what to do."""

    skipped: tuple[str, ...] = ()
    pattern: str = ""
    replacement: str = ""
    dry_run: bool = False
    check_only: bool = False
    force: bool = False


@dataclass
class Facts:
    """Named relations; those not given are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]
