"""More registered queries: readers, extractors, coverage, impact, baselines and groups, each with its SQL.

Sources that the driver's tables don't hold (coverage files, style sheets, code) are written from
their rows, so that the readers have whole tables to read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Config
from loomgraph.functions.globs import parse_owners
from loomgraph.operators import coverage, diff, impact, lookup, paths
from loomgraph.plans import model
from loomgraph.plans.catalogue import _PAGES, _page_paths, _two_sides, query, read
from loomgraph.session import shared_dir
from loomgraph.sources import coverage_files, resolve, scan
from loomgraph.sources.store import Index

# Coverage files, from line items: one file for each order


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.select(
        F.concat(F.lit("src/o"), "l_orderkey", F.lit(".ts")).alias("file"), F.col("l_orderkey").alias("o"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 7).cast("int").alias("line"),
        (F.col("l_suppkey") % 3).alias("hits"), F.col("l_linenumber").alias("n"), "l_partkey",
    )


_ITEMS = "(SELECT 'src/o' || l_orderkey || '.ts' AS file, l_orderkey AS o, CAST(l_linenumber * 10 + l_partkey % 7 AS INTEGER) AS line, l_suppkey % 3 AS hits, l_linenumber AS n, l_partkey FROM lineitem) AS i"


@query(f"SELECT file AS file_path, line, CAST(CASE WHEN l_partkey % 11 = 0 THEN 9223372036854775807 ELSE hits END AS BIGINT) AS hit_count FROM {_ITEMS} WHERE n <> 4")
def read_lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line records of coverage files; some have no number, and some more digits than a long."""
    shown = F.when(F.col("n") == 4, "-").when(F.col("l_partkey") % 11 == 0, "1" + "0" * 30).otherwise(F.col("hits").cast("string"))
    lines = _items(spark, sf_dir).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("DA:"), "line", F.lit(","), shown))), "\n").alias("da"))
    return coverage_files.from_lcov(lines.select(F.concat(F.lit("TN:\nSF:"), "file", F.lit("\nFN:1,f\n"), "da", F.lit("\nend_of_record\n")).alias("value")))


@query(f"SELECT CASE o % 2 WHEN 0 THEN file ELSE 'inner/' || file END AS file_path, line, CAST(hits AS BIGINT) AS hit_count FROM {_ITEMS} WHERE n <> 5")
def read_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement maps as JSON: the inner path wins, and statements without a count don't count."""
    rows = _items(spark, sf_dir).groupBy("file", "o").agg(F.collect_list(F.struct("line", "hits", "n")).alias("rows"))
    place = lambda r, i: F.struct(i.cast("string"), F.struct(F.struct(r["line"].alias("line")).alias("start")))
    count = lambda r, i: F.when(r["n"] != 5, F.struct(i.cast("string"), r["hits"]))
    files = rows.select("file", "o", F.map_from_entries(F.transform("rows", place)).alias("statementMap"), F.map_from_entries(F.array_compact(F.transform("rows", count))).alias("s"))
    inner = F.when(F.col("o") % 2 == 1, F.concat(F.lit("inner/"), "file"))
    return coverage_files.from_statements(files.select(F.to_json(F.create_map("file", F.struct(inner.alias("path"), "statementMap", "s"))).alias("value")))


@query("""
SELECT '/src/c' || o_custkey || '.js' AS file_path, CAST(line AS INTEGER) AS line,
  CAST(max(CASE WHEN line BETWEEN o_orderkey % 15 + 1 AND o_orderkey % 15 + 3 THEN o_orderkey % 4 ELSE 1 END) AS BIGINT) AS hit_count
FROM orders, generate_series(1, 20) AS g(line) GROUP BY ALL""")
def read_v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range dumps, one for each order: an outer range, an inner one that overwrites it, the greatest over dumps."""
    range_ = lambda a, b, n: F.struct(a.alias("startOffset"), b.alias("endOffset"), n.alias("count"))
    at = (F.col("o_orderkey") % 15 * 10).cast("int")
    ranges = F.array(range_(F.lit(0), F.lit(200), F.lit(1).cast("bigint")), range_(at, at + 30, (F.col("o_orderkey") % 4).cast("bigint")))
    script = F.struct(F.concat(F.lit("file:///src/c"), "o_custkey", F.lit(".js")).alias("url"), F.array(F.struct(F.lit("f").alias("functionName"), ranges.alias("ranges"))).alias("functions"))
    dumps = read(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(script).alias("result"))).alias("value"))
    return coverage_files.from_v8(dumps, lambda path: "ninechars\n" * 20)


_OWNED = """
WITH st AS (SELECT file_path, CAST(line_start + line_end % 9 AS INTEGER) AS line, id % 3 AS hits, row_number() OVER (ORDER BY id) AS p FROM symbols),
own AS (SELECT p, any_value(hits) AS hits, first(struct_pack(f := y.file_path, n := y.name, s := y.line_start) ORDER BY y.line_end - y.line_start, y.line_start, y.id, y.name) AS o
  FROM st JOIN symbols AS y ON y.file_path = st.file_path AND st.line BETWEEN y.line_start AND y.line_end GROUP BY p)
SELECT o.f AS file_path, o.n AS name, o.s AS line_start, CAST(100 AS DOUBLE) * count_if(hits > 0) / count(*) AS coverage_pct, count_if(hits > 0)::BIGINT AS hit_statements, count(*) AS total_statements
FROM own GROUP BY o"""


@query(model.with_model(_OWNED))
def coverage_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements counted for the innermost symbol that holds their line."""
    symbols = model.tables(spark, sf_dir).symbols
    statements = symbols.select("file_path", (F.col("line_start") + F.col("line_end") % 9).cast("int").alias("line"), (F.col("id") % 3).alias("hit_count"))
    return coverage.attribute(statements, symbols)


@query(model.with_model(f"""
WITH owned AS ({_OWNED.replace("WITH st", "WITH st", 1)}), seen AS (SELECT DISTINCT file_path FROM symbols WHERE id % 20 < 10),
fresh AS (SELECT * FROM owned WHERE file_path IN (SELECT file_path FROM seen) AND file_path IN (SELECT path FROM files))
SELECT * FROM fresh UNION ALL
SELECT * FROM coverage WHERE file_path NOT IN (SELECT file_path FROM seen) AND file_path IN (SELECT path FROM files)"""))  # fmt: skip
def coverage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage table after an ingest: files of the artifact are replaced, files that left the index go."""
    t = model.tables(spark, sf_dir)
    statements = t.symbols.select(F.concat(F.lit("/repo/./"), "file_path").alias("file_path"), (F.col("line_start") + F.col("line_end") % 9).cast("int").alias("line"), (F.col("id") % 3).alias("hit_count"), (F.col("id") % 20 < 10).alias("k"))
    seen = statements.where("k").select("file_path").distinct()
    rows = statements.drop("k").join(seen, "file_path", "left_semi").withColumn("file_path", F.regexp_replace("file_path", r"/\./", "/"))
    return coverage.upsert(t, rows, "/repo", "lcov").coverage


# Extractors


@query("""
SELECT 's' || s_suppkey || '.css' AS file_path, unnest(['css_variables', 'css_classes', 'css_classes', 'css_keyframes']) AS "table",
  unnest(['--gap' || s_suppkey, 'card' || s_suppkey, 'wide', 'fade' || s_nationkey]) AS name, unnest([CAST(2 AS INTEGER), 4, 4, 5]) AS line_number FROM supplier""")
def css_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties, classes and keyframes of style sheets, one for each supplier."""
    text = F.concat(F.lit(":root {\n  --gap"), "s_suppkey", F.lit(": 1rem;\n}\n.card"), "s_suppkey", F.lit(":hover, .wide { color: red }\n@keyframes fade"), "s_nationkey", F.lit(" { from { opacity: .5 } }\n/* .ghost {} */\n"))
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".css")).alias("path"), F.encode(text, "utf-8").alias("content"), F.lit(0).alias("modified"))
    return _facts(files, "css_variables", "css_classes", "css_keyframes")


def _facts(files: DataFrame, *tables: str) -> DataFrame:
    parsed = scan.parse_texts(files, tables=tables)

    def rows(table: str) -> Column:
        line = "line_start" if "line_start" in parsed.schema[table].dataType.elementType.names else "line_number"
        return F.transform(table, lambda r: F.struct(F.lit(table).alias("table"), r["name"].alias("name"), r[line].alias("line_number")))

    return parsed.select(F.col("path").alias("file_path"), F.explode(F.concat(*map(rows, tables))).alias("r")).select("file_path", "r.table", "r.name", "r.line_number")


@query("""
SELECT 'src/p' || p_partkey || '.ts' AS file_path, name, kind, CAST(line AS INTEGER) AS line_start, CAST(stop AS INTEGER) AS line_end, CAST(exported AS INTEGER) AS is_exported, CAST(complexity AS DOUBLE) AS complexity FROM (
  SELECT p_partkey, unnest(['fn' || p_partkey, 'LIMIT' || p_size]) AS name, unnest(['function', 'const']) AS kind, unnest([3, 6]) AS line, unnest([5, 6]) AS stop, unnest([1, 0]) AS exported, unnest([2.0, NULL]) AS complexity FROM part)""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of code files, one for each part."""
    facts = scan.explode_tables(scan.parse_texts(_code(spark, sf_dir), tables=("symbols",)))
    return facts["symbols"].select("file_path", "line_start", "line_end", "name", "kind", "is_exported", "complexity")


@query("SELECT 'src/p' || p_partkey || '.ts' AS file_path, 'fn' || p_partkey AS caller_name, 'fn' || (p_partkey + 1) AS callee_name FROM part")
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within those files."""
    return scan.explode_tables(scan.parse_texts(_code(spark, sf_dir), tables=("calls",)))["calls"].select("file_path", "caller_name", "callee_name")


@query("SELECT 'src/p' || p_partkey || '.ts' AS file_path, CAST(CASE p_partkey % 2 WHEN 0 THEN 0 ELSE 8 END AS INTEGER) AS line_number, 'rule-' || p_size AS recipe_id FROM part WHERE p_partkey % 3 <> 0")
def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives that exempt a file (line 0) or the line after them."""
    return scan.explode_tables(scan.parse_texts(_code(spark, sf_dir), tables=("suppressions",)))["suppressions"].select("file_path", "line_number", "recipe_id")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: an import, a function that calls the next part's, a constant and, mostly, a directive."""
    key, size = F.col("p_partkey"), F.col("p_size")
    directive = F.concat(F.lit("// loomgraph-disable-"), F.when(key % 2 == 0, "file").otherwise("next-line"), F.lit(" rule-"), size)
    text = F.concat(
        F.lit("import { fn"), key + 1, F.lit(' } from "./p'), key + 1, F.lit('";\n\nexport function fn'), key, F.lit("(n: number): number {\n  return n ? fn"), key + 1,
        F.lit("(n) : 0;\n}\nconst LIMIT"), size, F.lit(" = 3;\n"), F.when(key % 3 != 0, directive).otherwise("// nothing"), F.lit("\n"),
    )
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), key, F.lit(".ts")).alias("path"), F.encode(text, "utf-8").alias("content"), F.lit(0).alias("modified"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) THEN 'src/b/p' || o_custkey || '.ts'
  WHEN o_custkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) THEN 'src/b/p' || o_custkey || '/index.ts' END AS resolved_path FROM orders""")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved to files: relative ones and, by the compiler's mapping, others; a file before a folder's index."""
    part = read(spark, sf_dir, "part").select("p_partkey")
    files = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("src/b/p"), "p_partkey", F.lit(".ts")).alias("path"))
    files = files.union(part.where("p_partkey % 3 = 0").select(F.concat(F.lit("src/b/p"), "p_partkey", F.lit("/index.ts"))))
    source = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "../b/p").otherwise("~/b/p"), "o_custkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("src/a/o"), "o_orderkey", F.lit(".ts")).alias("file_path"), source.alias("source"), F.lit(None).cast("string").alias("resolved_path"))
    return resolve.resolve(orders, files, [("~/*", ["src/*"])]).select("id", "resolved_path")


# A tree of files


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"


@query("""
SELECT 'r' || n_regionkey || '/' || lower(replace(n_name, ' ', '_')) || '.md' AS path, sha256(t) AS content_hash, strlen(t) AS size, CAST(3 AS INTEGER) AS line_count, 'markdown' AS language
FROM (SELECT *, '# ' || n_name || chr(10) || 'TODO é' || chr(10) AS t FROM nation)""")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree with hash, size and lines: one for each nation, among files and folders that are left out."""
    text = F.concat(F.lit("# "), "n_name", F.lit("\nTODO é\n"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey", F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("at"), text.alias("text"))
    root = _folder(spark)
    write_files(nations.select(F.concat("at", F.lit(".md")), "text").union(nations.select(F.concat("at", F.lit(".bin")), "text")).union(nations.select(F.concat(F.lit("dist/"), "at", F.lit(".md")), "text")), root)
    return scan.parse_tree(spark, Config(root)).select("path", "content_hash", "size", "line_count", "language")


def write_files(files: DataFrame, root: str) -> None:
    """Write (path, text) as files below a folder that all executors see."""

    def run(rows) -> None:
        import os

        for path, text in rows:
            full = os.path.join(root, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(text)

    files.foreachPartition(run)


# Impact


def _reach(way: str) -> str:
    a, b = ("caller_name", "callee_name") if way == "down" else ("callee_name", "caller_name")
    return f"""SELECT '{way}' AS direction, CASE '{way}' WHEN 'down' THEN 'calls' ELSE 'called_by' END AS edge, node, min(depth) AS depth FROM (
  WITH RECURSIVE step(a, b) AS (SELECT DISTINCT {a}, {b} FROM calls), r(node, depth) AS (SELECT 'fn10', 0 UNION SELECT b, depth + 1 FROM r JOIN step ON a = node WHERE depth < 3)
  SELECT * FROM r) AS q{way} GROUP BY node HAVING min(depth) > 0"""


_SYMBOL_MATCHES = f"""SELECT CAST(depth AS INTEGER) AS depth, direction, edge, 'symbol' AS kind, node AS name, coalesce(file_path, '') AS file_path
FROM ({_reach("down")} UNION ALL {_reach("up")}) AS b LEFT JOIN (SELECT name, min(file_path) AS file_path FROM symbols GROUP BY name) AS p ON p.name = node"""


@query(model.with_model(_SYMBOL_MATCHES))
def impact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols reached over calls both ways from one, at their least depth, with a file that declares them."""
    t = model.tables(spark, sf_dir)
    return impact.matches(t, impact.resolve_target(t, "fn10"), "both", "all", 3, None)


def _files_reach(backend: str, rank: int) -> str:
    source = {"dependencies": "SELECT from_path AS a, to_path AS b FROM dependencies", "imports": "SELECT file_path AS a, resolved_path AS b FROM imports WHERE resolved_path IS NOT NULL"}[backend]
    edge = {"dependencies": "depends_on", "imports": "imports"}[backend]
    return f"""SELECT '{edge}' AS edge, {rank} AS rank, node, min(depth) AS depth FROM (
  WITH RECURSIVE step AS (SELECT DISTINCT a, b FROM ({source}) AS e), r(node, depth) AS (SELECT 'src/d3/o3.ts', 0 UNION SELECT b, depth + 1 FROM r JOIN step ON a = node WHERE depth < 2)
  SELECT * FROM r) AS q{rank} GROUP BY node HAVING min(depth) > 0"""


@query(model.with_model(f"""
SELECT CAST(min(depth) AS INTEGER) AS depth, 'down' AS direction, first(edge ORDER BY depth, rank) AS edge, 'file' AS kind, CAST(NULL AS VARCHAR) AS name, node AS file_path
FROM ({_files_reach("dependencies", 0)} UNION ALL {_files_reach("imports", 1)}) AS b GROUP BY node"""))  # fmt: skip
def impact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files reached over dependencies and imports, each once, at its least depth and by the first graph that has it."""
    t = model.tables(spark, sf_dir)
    return impact.matches(t, impact.resolve_target(t, "src/d3/o3.ts"), "down", "all", 2, None)


@query(model.with_model(f"""
SELECT 'symbol' AS target_kind, (SELECT count(DISTINCT file_path) FROM symbols WHERE name = 'fn10') AS files, count(*) AS nodes, CAST(max(depth) AS INTEGER) AS max_depth_reached, count(*) AS symbols,
  CASE WHEN max(depth) >= 3 THEN 'depth' ELSE 'exhausted' END AS terminated_by FROM ({_SYMBOL_MATCHES}) AS m"""))  # fmt: skip
def impact_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of an impact: matches, the deepest, how many of each kind, and what ended the walk."""
    found = impact.find_impact(model.tables(spark, sf_dir), "fn10", "both", "all", 3, impact.UNBOUNDED * 1000)
    s = found.summary
    row = (found.target["kind"], len(found.target["files"]), s["nodes"], s["max_depth_reached"], s["by_kind"].get("symbol", 0), s["terminated_by"])
    return spark.createDataFrame([row], "target_kind string, files bigint, nodes bigint, max_depth_reached int, symbols bigint, terminated_by string")


# Baselines, groups, lookups

_OLD, _NEW = "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


@query(f"""
SELECT 'added' AS change, * FROM ({_NEW} EXCEPT ALL {_OLD}) AS a UNION ALL SELECT 'removed', * FROM ({_OLD} EXCEPT ALL {_NEW}) AS r
UNION ALL SELECT 'baseline rows', count(*), NULL FROM ({_OLD}) AS b""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed since a saved baseline, and how many rows that has."""
    folder = _folder(spark)
    store = Index(spark, Config(folder, index_path=folder))
    old, new = _two_sides(spark, sf_dir)
    store.save_baseline("before", old, "old orders")
    manifest, base = store.baseline("before")
    added, removed = diff.diff_rows(base, new)
    count = spark.createDataFrame([("baseline rows", manifest["row_count"], None)], "change string, o_custkey bigint, o_orderstatus string")
    return added.select(F.lit("added").alias("change"), "*").unionByName(removed.select(F.lit("removed").alias("change"), "*")).unionByName(count)


@query(f"SELECT path, page_id FROM {_PAGES} WHERE path IN (SELECT 'en/' || k FROM generate_series(0, 400, 4) AS g(k))")
def changed_filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files that changed, with the paths as a list."""
    return paths.changed_filter(_page_paths(spark, sf_dir), [f"en/{k}" for k in range(0, 401, 4)])


@query(f"""
SELECT key, count(*) OVER (PARTITION BY key) AS count, path, page_id FROM (
  SELECT CASE WHEN path = '' THEN '<unknown>' WHEN regexp_matches(path, '^[a-z]+/[0-9]*7$') THEN '@seven' WHEN starts_with(path, 'de/') THEN '@german' ELSE '<no-owner>' END AS key, path, page_id FROM {_PAGES}) AS k""")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each group, with its key and size."""
    rules = parse_owners("/de/ @german\n*7 @seven\n")
    return paths.group_rows(_page_paths(spark, sf_dir), paths.by_owner(rules), paths.NO_OWNER).select("key", "count", "row.*")


@query(model.with_model("SELECT kind, count(*) AS count FROM symbols WHERE name = 'fn10' GROUP BY ALL"))
def by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a lookup by kind."""
    return lookup.by_kind(lookup.find_symbols(model.tables(spark, sf_dir).symbols, "fn10"))


@query("""
SELECT name, file_path, CASE WHEN k % 5 = 0 THEN NULL ELSE array_to_string(string_split(CASE WHEN k % 3 = 0 THEN 'x' || text ELSE text END, chr(10))[1:2], chr(10)) END AS source,
  k % 5 <> 0 AND k % 3 = 0 AS stale, k % 5 = 0 AS missing FROM (SELECT doc_id AS k, 'd' || doc_id AS file_path, 's' || doc_id AS name, text FROM documents)""")
def snippet_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source of symbols, with whether their file has changed or is gone."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text")
    matches = docs.select(F.concat(F.lit("s"), "doc_id").alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    files = docs.select("path", F.sha2("text", 256).alias("content_hash"))
    now = docs.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).alias("value"))
    return lookup.snippets(matches, files, now.withColumn("content_hash", F.sha2("value", 256))).select("name", "file_path", "source", "stale", "missing")


@query("""
SELECT 'n' || n_nationkey || '.md' AS path, sha256(t) AS content_hash, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS markers FROM (
  SELECT *, '# ' || n_name || chr(10) || 'TODO one' || chr(10) || CASE WHEN n_nationkey % 5 = 0 THEN 'FIXME two' || chr(10) ELSE '' END AS t FROM nation WHERE n_nationkey % 7 <> 3)""")
def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after a full build, and a targeted one of files that changed and files that went."""
    import os

    root = _folder(spark)
    key = F.col("n_nationkey")
    text = F.concat(F.lit("# "), "n_name", F.lit("\nTODO one\n"))
    nation = read(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("n"), key, F.lit(".md")))
    write_files(nation.select("path", text), root)
    index = Index(spark, Config(root))
    index.build("full")
    write_files(nation.where(key % 5 == 0).select("path", F.concat(text, F.lit("FIXME two\n"))), root)
    gone = [r[0] for r in nation.where(key % 7 == 3).select("path").collect()]
    for path in gone:
        os.remove(f"{root}/{path}")
    changed = [r[0] for r in nation.where(key % 5 == 0).select("path").collect()]
    index.build("files", [*changed, *gone])
    t = index.tables()
    marks = t.markers.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("markers"))
    return t.files.join(marks, "path").select("path", "content_hash", "markers")
