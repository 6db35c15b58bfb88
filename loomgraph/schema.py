"""The typed tables of the index, and empty or missing ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = 1

_DDL = {
    "files": "path string, content_hash string, size bigint, line_count int, language string, last_modified bigint, indexed_at bigint",
    "symbols": "id bigint, file_path string, name string, kind string, line_start int, line_end int, signature string, is_exported int, is_default_export int, members string, doc_comment string, value string, parent_name string, visibility string, complexity double",
    "imports": "id bigint, file_path string, source string, resolved_path string, specifiers string, is_type_only int, line_number int",
    "exports": "id bigint, file_path string, name string, kind string, is_default int, re_export_source string",
    "components": "id bigint, file_path string, name string, props_type string, hooks_used string, is_default_export int",
    "dependencies": "from_path string, to_path string",
    "markers": "id bigint, file_path string, line_number int, kind string, content string",
    "css_variables": "id bigint, file_path string, name string, value string, scope string, line_number int",
    "css_classes": "id bigint, file_path string, name string, is_module int, line_number int",
    "css_keyframes": "id bigint, file_path string, name string, line_number int",
    "calls": "id bigint, file_path string, caller_name string, caller_scope string, callee_name string",
    "type_members": "id bigint, file_path string, symbol_name string, name string, type string, is_optional int, is_readonly int",
    "suppressions": "id bigint, file_path string, line_number int, recipe_id string",
    "source_fts": "file_path string, token string, pos int",
    "boundary_rules": "name string, from_glob string, to_glob string, action string",
    "meta": "key string, value string",
    "coverage": "file_path string, name string, line_start int, coverage_pct double, hit_statements bigint, total_statements bigint",
    "query_baselines": "name string, recipe_id string, sql string, row_count bigint, git_ref string, created_at bigint",
    "recipe_recency": "recipe_id string, last_run_at bigint, run_count bigint",
}

SCHEMAS: dict[str, T.StructType] = {}
for _name, _text in _DDL.items():
    SCHEMAS[_name] = T.StructType()
    for _field in _text.split(", "):
        _column, _kind = _field.split(" ")
        SCHEMAS[_name].add(_column, {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}[_kind])

#: Tables that extraction fills by file, with the column that names the file.
BY_FILE = {n: "file_path" for n, s in SCHEMAS.items() if "file_path" in s.names and n != "coverage"} | {"files": "path", "dependencies": "from_path"}
#: Kept when the index is rebuilt.
USER_TABLES = ("query_baselines", "coverage", "recipe_recency")


class Tables(Mapping[str, DataFrame]):
    """Tables by name, also as attributes; those that weren't given are empty."""

    def __init__(self, spark: SparkSession, given: Mapping[str, DataFrame]):
        self.spark, self._given = spark, dict(given)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._given:
            self._given[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self._given[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def register(self, prefix: str = "") -> None:
        """Temporary views, so that SQL can name the tables."""
        for name in self:
            self[name].createOrReplaceTempView(prefix + name)
        register_functions(self.spark)


def register_functions(spark: SparkSession) -> None:
    """first_dir(path) and glob_to_regex(glob) for SQL. Globs are those of rules, so that one runs in Python."""
    from loomgraph.functions.globs import glob_to_regex
    from loomgraph.session import ship

    ship(spark)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION first_dir(path STRING) RETURNS STRING RETURN substring_index(path, '/', 1)")
    spark.udf.register("glob_to_regex", lambda glob: None if glob is None else glob_to_regex(glob), "string")
