"""The index tables as views of the driver's star schema: orders stand for files, line items for symbols.

The same SELECT runs in Spark and in the engine that checks the results, so recipes are compared on
equal input.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import Tables


def _file(key: str) -> str:
    return f"'src/d' || CAST(({key}) % 7 AS VARCHAR(20)) || '/o' || CAST({key} AS VARCHAR(20)) || '.ts'"


def _name(key: str) -> str:
    return f"'fn' || CAST({key} AS VARCHAR(20))"


_TARGET = "((l_orderkey * 7 + l_partkey) % 4001 + 1)"

MODEL = {
    "files": f"""SELECT {_file("o_orderkey")} AS path, md5(CAST(o_orderkey AS VARCHAR(20))) AS content_hash, CAST(floor(o_totalprice) AS BIGINT) AS size,
        CAST(o_orderkey % 997 + 1 AS INT) AS line_count, o_orderstatus AS language, CAST(0 AS BIGINT) AS last_modified, CAST(0 AS BIGINT) AS indexed_at FROM orders""",
    "symbols": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_file("l_orderkey")} AS file_path, {_name("l_partkey")} AS name,
        CASE l_returnflag WHEN 'A' THEN 'function' WHEN 'N' THEN 'const' ELSE 'class' END AS kind, l_linenumber * 10 AS line_start,
        l_linenumber * 10 + CAST(floor(l_quantity) AS INT) AS line_end, {_name("l_partkey")} || '()' AS signature,
        CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_exported, 0 AS is_default_export, CAST(NULL AS VARCHAR(9)) AS members,
        CASE WHEN l_discount > 0.085 THEN '@deprecated by ' || {_name("l_suppkey")} END AS doc_comment, CAST(NULL AS VARCHAR(9)) AS value,
        CAST(NULL AS VARCHAR(9)) AS parent_name, CASE WHEN l_tax > 0.075 THEN 'internal' END AS visibility,
        CASE WHEN l_returnflag = 'A' THEN l_quantity / CAST(2 AS DOUBLE) END AS complexity FROM lineitem""",
    "coverage": f"""SELECT {_file("l_orderkey")} AS file_path, {_name("l_partkey")} AS name, l_linenumber * 10 AS line_start,
        CAST(100 AS DOUBLE) * floor(l_tax * 100) / floor(l_quantity) AS coverage_pct, CAST(floor(l_tax * 100) AS BIGINT) AS hit_statements,
        CAST(floor(l_quantity) AS BIGINT) AS total_statements FROM lineitem WHERE l_quantity > 10 AND l_partkey % 3 <> 0""",
    "calls": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_file("l_orderkey")} AS file_path, {_name("l_partkey")} AS caller_name,
        {_name("l_partkey")} AS caller_scope, {_name("((l_partkey * 7 + l_suppkey) % 5003)")} AS callee_name FROM lineitem WHERE l_linenumber <= 2""",
    "dependencies": f"SELECT DISTINCT {_file('l_orderkey')} AS from_path, {_file(_TARGET)} AS to_path FROM lineitem",
    "imports": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_file("l_orderkey")} AS file_path, './o' AS source, {_file(_TARGET)} AS resolved_path,
        CASE WHEN l_linenumber = 3 THEN '["* as ns"]' WHEN l_linenumber = 4 AND l_partkey % 50 = 0 THEN '["*"]' WHEN l_partkey % 3 = 1 THEN '[]'
        ELSE '["' || {_name("l_partkey")} || '","' || {_name("l_suppkey")} || ' as x"]' END AS specifiers,
        0 AS is_type_only, l_linenumber AS line_number FROM lineitem""",
    "exports": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_file("l_orderkey")} AS file_path, {_name("l_partkey")} AS name,
        CASE l_returnflag WHEN 'A' THEN 'value' WHEN 'N' THEN 'type' ELSE 're-export' END AS kind, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS is_default,
        CAST(NULL AS VARCHAR(9)) AS re_export_source FROM lineitem WHERE l_linestatus = 'O'""",
    "components": f"""SELECT c_custkey AS id, 'src/ui/c' || CAST(c_custkey % 40 AS VARCHAR(20)) || '.tsx' AS file_path, {_name("c_custkey")} AS name, CAST(NULL AS VARCHAR(9)) AS props_type,
        CASE c_nationkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["' || {_name("c_custkey")} || '"]' ELSE '["useA","' || {_name("c_nationkey")} || '"]' END AS hooks_used,
        0 AS is_default_export FROM customer""",
    "type_members": f"""SELECT l_orderkey * 10 + l_linenumber AS id, {_file("l_orderkey")} AS file_path, {_name("l_partkey")} AS symbol_name, 'm' || CAST(l_suppkey AS VARCHAR(20)) AS name,
        l_shipmode_or_flag AS type, 0 AS is_optional, l_linenumber % 2 AS is_readonly FROM (SELECT *, l_returnflag AS l_shipmode_or_flag FROM lineitem) AS m WHERE l_linenumber >= 2""",
    "markers": """SELECT event_id AS id, 'src/e' || CAST(user_id AS VARCHAR(20)) || '.ts' AS file_path, CAST(event_id % 100 AS INT) AS line_number, event_type AS kind, props AS content FROM events""",
    "suppressions": f"""SELECT o_orderkey AS id, {_file("o_orderkey")} AS file_path, CAST(o_orderkey % 3 * 10 AS INT) AS line_number,
        CASE WHEN o_custkey % 2 = 0 THEN 'untested-and-dead' ELSE 'unimported-exports' END AS recipe_id FROM orders WHERE o_orderkey % 5 = 0""",
    "source_fts": f"SELECT {_file('o_orderkey')} AS file_path, CASE o_orderstatus WHEN 'F' THEN 'todo' ELSE 'fine' END AS token, 0 AS pos FROM orders",
    "boundary_rules": """SELECT 'a' AS name, 'src/d1/*' AS from_glob, 'src/d[23]/*' AS to_glob, 'deny' AS action UNION ALL
        SELECT 'b', '*o?7.ts', 'src/d[^0-4]/o*', 'deny' UNION ALL SELECT 'c', '*', '*', 'allow'""",
}


def tables(spark: SparkSession, sf_dir: str, placed: tuple[str, ...] = ()) -> Tables:
    """Those named in placed have a further column _row, the place of their source's row in its files."""
    given = {}
    for name, text in MODEL.items():
        sources = sorted(set(re.findall(r"FROM (lineitem|orders|customer|events)\b", text)))
        frames = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in sources}
        if name in placed:
            frames = {s: f.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")) for s, f in frames.items()}
            text = text.replace("SELECT ", "SELECT _row, ", 1)
        given[name] = spark.sql(re.sub(r"FROM (lineitem|orders|customer|events)\b", r"FROM {\1}", text), **frames)
    return Tables(spark, given)


def with_model(sql: str) -> str:
    """The SQL with the model's tables in front of it."""
    used = [n for n in MODEL if re.search(rf"\b{n}\b", sql)]
    return "WITH " + ", ".join(f"{n} AS ({MODEL[n]})" for n in used) + " " + re.sub(r"^\s*WITH\b", ",", sql)
