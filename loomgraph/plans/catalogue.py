"""Registered queries: each operator of the engine on the driver's tables, and the SQL it must equal.

Recipes run on the tables of model.py. All queries read their whole tables; a limit occurs only
where a recipe is a top-k report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.globs import parse_owners
from loomgraph.operators import coverage, diff, impact, lookup, paths
from loomgraph.plans import model
from loomgraph.plans.recipes import RECIPES
from loomgraph.schema import Tables
from loomgraph.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recipe(name: str, id: str, sql: str, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: RECIPES[id].build(model.tables(spark, sf_dir, placed=("coverage",) if id == "refactor-risk-ranking" else ()), **params)
    ORACLES[name] = model.with_model(sql)


_recipe("fan_in", "fan-in", "SELECT to_path, count(*) AS fan_in FROM dependencies GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 15")
_recipe("fan_out", "fan-out", "SELECT from_path, count(*) AS deps FROM dependencies GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10")
_recipe("fan_out_sample", "fan-out-sample", """
SELECT from_path, count(*) AS deps, array_to_string(list_sort(list(to_path))[1:5], ' | ') AS sample_targets
FROM dependencies GROUP BY from_path ORDER BY 2 DESC, 1 LIMIT 10""")  # fmt: skip
_recipe("fan_out_sample_json", "fan-out-sample-json", """
SELECT from_path, count(*) AS deps, '["' || array_to_string(list_sort(list(to_path))[1:5], '","') || '"]' AS sample_targets
FROM dependencies GROUP BY from_path ORDER BY 2 DESC, 1 LIMIT 10""")  # fmt: skip
_recipe("index_summary", "index-summary", "SELECT " + ", ".join(f"(SELECT count(*) FROM {t} AS {t[0]}) AS {t}" for t in ("files", "symbols", "imports", "components", "dependencies")))
_recipe("files_largest", "files-largest", "SELECT path, line_count, size, language FROM files AS f ORDER BY f.line_count DESC, f.path LIMIT 20")
_recipe("files_hashes", "files-hashes", "SELECT path, content_hash, language, line_count FROM files")
_recipe("barrel_files", "barrel-files", "SELECT file_path, count(*) AS exports FROM exports AS e GROUP BY ALL ORDER BY count(*) DESC, 1 LIMIT 20")
_recipe("markers_by_kind", "markers-by-kind", "SELECT kind, count(*) AS count FROM markers AS m GROUP BY ALL")
_recipe("components_by_hooks", "components-by-hooks", """
SELECT name, file_path, CAST(CASE hooks_used WHEN '[]' THEN 0 ELSE len(string_split(hooks_used, ',')) END AS INTEGER) AS hook_count
FROM components ORDER BY 3 DESC, 2, 1 LIMIT 20""")  # fmt: skip
_recipe("deprecated_symbols", "deprecated-symbols", """
SELECT name, kind, file_path, line_start, signature, doc_comment FROM symbols
WHERE contains(doc_comment, '@deprecated') ORDER BY 3, 4, 1, 2 LIMIT 50""")  # fmt: skip
_recipe("visibility_tags", "visibility-tags", """
SELECT file_path, line_start, name, kind, doc_comment, visibility, signature FROM symbols
WHERE visibility = 'internal' ORDER BY 1, 2, 3, 4, 5 NULLS FIRST LIMIT 100""")  # fmt: skip
_recipe("find_symbol_by_kind", "find-symbol-by-kind", """
SELECT name, kind, file_path, line_start, signature FROM symbols WHERE kind LIKE 'function' AND starts_with(name, 'fn10') AND ends_with(name, '7')""", kind="function", name_pattern="fn10%7")  # fmt: skip
_recipe("files_by_coverage", "files-by-coverage", """
SELECT file_path, CAST(h AS BIGINT) AS hit_statements, CAST(t AS BIGINT) AS total_statements,
  round(CAST(100 AS DOUBLE) * h / nullif(t, 0), 2) AS coverage_pct
FROM (SELECT file_path, sum(hit_statements) AS h, sum(total_statements) AS t FROM coverage GROUP BY ALL)
ORDER BY coverage_pct NULLS LAST, file_path LIMIT 100""")  # fmt: skip
_COVERED = "(SELECT s.*, coalesce(c.coverage_pct, 0) AS pct FROM symbols AS s LEFT JOIN coverage AS c USING (file_path, name, line_start)) AS x"
_recipe("worst_covered_exports", "worst-covered-exports", f"""
SELECT name, file_path, line_start, pct AS coverage_pct FROM {_COVERED}
WHERE kind = 'function' AND is_exported > 0 ORDER BY pct, 2, 3, 1 LIMIT 20""")  # fmt: skip
_recipe("high_complexity_untested", "high-complexity-untested", f"""
SELECT name, kind, file_path, line_start, line_end, complexity, round(pct, 1) AS coverage_pct FROM {_COVERED}
WHERE pct < 50 AND complexity >= 10 ORDER BY 6 DESC, 3, 1, 4, 5 LIMIT 30""")  # fmt: skip
_recipe("untested_and_dead", "untested-and-dead", f"""
SELECT name, file_path, line_start, pct AS coverage_pct FROM {_COVERED}
WHERE kind = 'function' AND is_exported > 0 AND pct = 0 AND name NOT IN (SELECT callee_name FROM calls)
  AND NOT EXISTS (FROM suppressions AS u WHERE u.file_path = x.file_path AND u.recipe_id LIKE 'untested%' AND u.line_number IN (0, x.line_start))
ORDER BY 2, 3, 1 LIMIT 100""")  # fmt: skip
_SPECS = "(SELECT resolved_path, unnest(CAST(specifiers AS JSON)::VARCHAR[]) AS spec FROM imports)"
_recipe("unimported_exports", "unimported-exports", f"""
SELECT name, kind, file_path, is_default, re_export_source FROM exports AS e
WHERE is_default < 1 AND kind <> 're-export'
  AND NOT EXISTS (FROM {_SPECS} AS i WHERE i.resolved_path = e.file_path AND i.spec IN ('*', e.name))
  AND file_path NOT IN (SELECT file_path FROM suppressions WHERE recipe_id LIKE 'unimported%' AND line_number = 0)
ORDER BY 3, 1, 2 LIMIT 50""")  # fmt: skip
_recipe("unused_type_members", "unused-type-members", f"""
SELECT symbol_name AS owner_type, name AS member, type AS member_type, is_optional, is_readonly, file_path FROM type_members AS m
WHERE EXISTS (FROM exports AS e WHERE e.file_path = m.file_path AND e.name = m.symbol_name AND is_default < 1 AND kind <> 're-export')
  AND symbol_name NOT IN (SELECT spec FROM {_SPECS}) ORDER BY 6, 1, 2, 3, 5 LIMIT 50""")  # fmt: skip
_recipe("refactor_risk_ranking", "refactor-risk-ranking", """
SELECT path AS file_path, n AS exported_count, coalesce(u, 0) AS fan_in, round(coalesce(a, 0), 1) AS avg_coverage_pct, coalesce(m, 0) AS measured_symbols,
  round((coalesce(u, 0) + 1) * (CAST(100 AS DOUBLE) - coalesce(a, 0)), 1) AS risk_score
FROM files JOIN (SELECT file_path AS path, count(*) AS n FROM symbols WHERE is_exported > 0 GROUP BY 1) USING (path)
LEFT JOIN (SELECT to_path AS path, count(*) AS u FROM dependencies GROUP BY 1) USING (path)
LEFT JOIN (SELECT file_path AS path, avg(coverage_pct) AS a, count(*) AS m FROM coverage GROUP BY 1) USING (path)
ORDER BY 6 DESC, 1 LIMIT 30""")  # fmt: skip
_recipe("components_touching_deprecated", "components-touching-deprecated", """
SELECT DISTINCT component, component_file, name AS deprecated_symbol, file_path AS deprecated_file, via FROM (
  SELECT name AS component, file_path AS component_file, unnest(CAST(hooks_used AS JSON)::VARCHAR[]) AS used, 'hook' AS via FROM components
  UNION ALL SELECT k.name, k.file_path, callee_name, 'call' FROM components AS k, calls WHERE caller_name = k.name AND calls.file_path = k.file_path) AS u
JOIN symbols ON name = used WHERE contains(doc_comment, '@deprecated') ORDER BY 2, 1, 3, 4, 5 LIMIT 50""")  # fmt: skip
_recipe("glob_boundary", "boundary-violations", """
SELECT from_path AS file_path, to_path, name AS rule_name, from_glob AS rule_from_glob, to_glob AS rule_to_glob
FROM dependencies, (SELECT name, from_glob, replace(to_glob, '[^', '[!') AS g, to_glob FROM boundary_rules WHERE action LIKE 'deny')
WHERE from_path GLOB from_glob AND to_path GLOB g""")  # fmt: skip
_recipe("rename_preview", "rename-preview", f"""
SELECT file_path, line_start, line_end, 'fn10' AS before_pattern, 'fresh' AS after_pattern, 'definition' AS location_kind, 0 AS chain_depth
FROM symbols WHERE name = 'fn10' AND kind = 'function' AND starts_with(file_path, 'src/d')
UNION ALL SELECT DISTINCT i.file_path, line_number, line_number, 'fn10', 'fresh', 'import_specifier', 0 FROM imports AS i
WHERE specifiers LIKE '%"fn10"%' AND resolved_path IN (SELECT file_path FROM symbols WHERE name = 'fn10' AND kind = 'function')""", old="fn10", new="fresh", kind="function", in_file="src/d")  # fmt: skip
_recipe("text_in_deprecated_functions", "text-in-deprecated-functions", f"""
SELECT DISTINCT name AS symbol, kind, file_path, line_start, line_end, round(pct, 1) AS coverage_pct FROM {_COVERED}
WHERE kind = 'function' AND pct < 50 AND contains(doc_comment, '@deprecated') AND file_path IN (SELECT file_path FROM source_fts WHERE token = 'todo')
ORDER BY 3, 4, 1, 5, 6 LIMIT 50""")  # fmt: skip


@query(model.with_model("SELECT " + ", ".join(f"(SELECT count(*) FROM {t} AS {t[0]}x) AS {t}" for t in ("files", "symbols", "exports", "markers", "calls", "type_members"))))
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of tables in one row."""
    return lookup.table_stats(model.tables(spark, sf_dir), ("files", "symbols", "exports", "markers", "calls", "type_members"))


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^\w+://[^/]+/([^?#]*)", 1).alias("path"), "page_id")


_PAGES = "(SELECT regexp_extract(url, '^\\w+://[^/]+/([^?#]*)', 1) AS path, page_id FROM pages) AS p"


@query(f"SELECT path, page_id FROM {_PAGES} WHERE path IN (SELECT 'en/' || doc_id FROM documents WHERE doc_id % 3 = 0)")
def changed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files that changed, with the changed paths as a table."""
    changed = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("en/"), "doc_id").alias("changed"))
    return paths.changed_filter(_page_paths(spark, sf_dir), changed)


@query(f"SELECT CASE path WHEN '' THEN '<unknown>' ELSE split_part(path, '/', 1) END AS key, count(*) AS count FROM {_PAGES} GROUP BY 1")
def group_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first segment of their path."""
    return paths.group_rows(_page_paths(spark, sf_dir), paths.by_directory, summary=True)


@query(f"""
SELECT CASE WHEN path = '' THEN '<unknown>' WHEN regexp_matches(path, '^[a-z]+/[0-9]*7$') THEN '@seven' WHEN starts_with(path, 'de/') THEN '@german'
  WHEN starts_with(path, 'fr/') OR starts_with(path, 'es/') THEN '@romance' ELSE '<no-owner>' END AS key, count(*) AS count FROM {_PAGES} GROUP BY 1""")
def group_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by owner: the last rule that matches decides."""
    rules = parse_owners("# rules\n/fr/ @romance @second\n/es/ @romance\n/de/  @german\n*7 @seven\n/nobody/\n")
    return paths.group_rows(_page_paths(spark, sf_dir), paths.by_owner(rules), paths.NO_OWNER, summary=True)


@query(f"""
SELECT CASE WHEN path = '' THEN '<unknown>' WHEN path = 'en/12' THEN 'en/12' WHEN starts_with(path, 'en/') THEN 'en'
  WHEN starts_with(path, 'de/') THEN 'de' ELSE '<root>' END AS key, count(*) AS count FROM {_PAGES} GROUP BY 1""")
def group_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the longest workspace folder that holds them."""
    return paths.group_rows(_page_paths(spark, sf_dir), paths.by_package(["en", "de", "en/12"]), summary=True)


_OLD, _NEW = "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"


def _two_sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = read(spark, sf_dir, "orders")
    return [orders.where(F.col("o_orderdate") < "1998-01-01" if old else F.col("o_orderdate") >= "1998-01-01").select("o_custkey", "o_orderstatus") for old in (True, False)]


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return diff.diff_rows(*_two_sides(spark, sf_dir))


@query(f"{_NEW} EXCEPT ALL {_OLD}")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in surplus now."""
    return _two(spark, sf_dir)[0]


@query(f"{_OLD} EXCEPT ALL {_NEW}")
def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in surplus before."""
    return _two(spark, sf_dir)[1]


_SNAP = {"files": "SELECT path FROM files WHERE line_count % 5 <> {k}", "dependencies": "SELECT from_path, to_path FROM dependencies WHERE length(from_path) % 3 <> {k}", "deprecated": "SELECT name, kind, file_path FROM symbols WHERE contains(doc_comment, '@deprecated') AND line_start % 4 <> {k}"}
_JSON = {"files": "'{\"path\":\"' || path || '\"}'", "dependencies": "'{\"from_path\":\"' || from_path || '\",\"to_path\":\"' || to_path || '\"}'", "deprecated": "'{\"name\":\"' || name || '\",\"kind\":\"' || kind || '\",\"file_path\":\"' || file_path || '\"}'"}


@query(model.with_model(" UNION ALL ".join(
    f"SELECT '{d}' AS delta, '{c}' AS change, {_JSON[d]} AS row FROM ({_SNAP[d].format(k=a)} EXCEPT ALL {_SNAP[d].format(k=b)}) AS q"
    for d in _SNAP for c, a, b in (("added", 2, 1), ("removed", 1, 2)))))
def audit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three deltas find between two snapshots of an index."""
    t = model.tables(spark, sf_dir)

    def snapshot(k: int) -> Tables:
        return Tables(spark, {"files": t.files.where(f"line_count % 5 <> {k}"), "dependencies": t.dependencies.where(f"length(from_path) % 3 <> {k}"), "symbols": t.symbols.where(f"line_start % 4 <> {k}")})

    return diff.audit_rows(snapshot(1), snapshot(2))


_EDGES = "edges AS (SELECT p_partkey AS src, (p_partkey * 7 + p_size) % n AS dst FROM part, (SELECT count(*) AS n FROM part) UNION SELECT p_partkey, (p_partkey * 3 + 1) % n FROM part, (SELECT count(*) AS n FROM part))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    n = part.count()
    one = part.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % n).alias("dst"))
    return one.union(part.select("p_partkey", ((F.col("p_partkey") * 3 + 1) % n))).select("src", "dst")


def _walk_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_EDGES}, reach(node, depth) AS (
  SELECT CAST(5 AS BIGINT), 0 UNION SELECT {b}, depth + 1 FROM reach JOIN edges ON {a} = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY node HAVING min(depth) > 0"""


@query(_walk_sql("src", "dst"))
def impact_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three steps of node 5, breadth first."""
    return impact.walk(_edges(spark, sf_dir), spark.createDataFrame([(5,)], "node bigint"), 3)


@query(_walk_sql("dst", "src"))
def impact_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from which node 5 is within three steps."""
    back = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return impact.walk(back, spark.createDataFrame([(5,)], "node bigint"), 3)


@query("""
WITH spans AS (SELECT o_orderkey AS id, o_custkey AS key, CAST(o_orderkey % 50 AS INTEGER) AS line_start, CAST(o_orderkey % 50 + floor(o_totalprice) % 200 AS INTEGER) AS line_end FROM orders),
points AS (SELECT event_id AS point_id, user_id AS key, CAST(event_id % 150 AS INTEGER) AS line FROM events)
SELECT point_id, points.key, line, any_value(id) IS NOT NULL AS matched, first(id ORDER BY line_end - line_start, line_start, id) AS id,
  first(line_start ORDER BY line_end - line_start, line_start, id) AS line_start, first(line_end ORDER BY line_end - line_start, line_start, id) AS line_end
FROM points LEFT JOIN spans ON spans.key = points.key AND line BETWEEN line_start AND line_end GROUP BY 1, 2, 3""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with the smallest interval of its key that holds it."""
    start = (F.col("o_orderkey") % 50).cast("int")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), start.alias("line_start"), (start + F.floor("o_totalprice") % 200).cast("int").alias("line_end"))
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("user_id").alias("key"), (F.col("event_id") % 150).cast("int").alias("line"))
    return coverage.innermost(events, orders, "key", "line")


@query(model.with_model("SELECT file_path, round(avg(coalesce(coverage_pct, 0)), 1) AS avg_coverage_pct, count(*) AS measured_symbols FROM coverage AS c GROUP BY ALL"))
def coverage_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average coverage of each file's symbols."""
    return coverage.per_file(model.tables(spark, sf_dir, placed=("coverage",)).coverage)


@query("""
SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unindexed' ELSE 'stale' END AS status
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0""")
def validate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are stale, missing or not indexed, by content hash."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    changed = F.when(F.col("doc_id") % 11 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
    return lookup.validate(docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 5 <> 0").select("path", changed.alias("content_hash")), docs)


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS source FROM documents")
def snippet_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines two to four of each text."""
    return read(spark, sf_dir, "documents").select("doc_id", lookup.lines(F.col("text"), F.lit(2), F.lit(4)).alias("source"))


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS line_number, regexp_extract(line, '\\b(Licensed|Released|Copyright)[\\s:]+(.+)', 1) AS kind,
  regexp_extract(line, '\\b(Licensed|Released|Copyright)[\\s:]+(.+)', 2) AS content
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE regexp_matches(line, '\\b(Licensed|Released|Copyright)[\\s:]+(.+)')""")
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of given keywords with their line numbers."""
    from loomgraph.sources.text_facts import markers

    return markers(read(spark, sf_dir, "documents"), "doc_id", "text", ("Licensed", "Released", "Copyright"))


@query("""
SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'class="([\\w-]+)"', 1)) AS name FROM pages""")
def css_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that pages use, once each."""
    found = F.explode(F.regexp_extract_all("html", F.lit('class="([\\w-]+)"'), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", found.alias("name")).distinct()


@query("""
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session""")
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, joined until six hours pass without one: the debounce window in batch."""
    from loomgraph.streaming.watch import debounce

    return debounce(read(spark, sf_dir, "events"), "ts", "6 hours", "user_id").select("user_id", "began", F.col("last").alias("ended"), "events")


@query("SELECT language, count(*) AS count FROM (SELECT lang AS language FROM documents) GROUP BY ALL")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of languages."""
    return lookup.languages(read(spark, sf_dir, "documents").withColumnRenamed("lang", "language"))


@query(model.with_model("""
SELECT name, kind, file_path, line_start, line_end, signature, is_exported, parent_name, visibility FROM symbols
WHERE name = 'fn10' AND kind = 'function' AND starts_with(file_path, 'src/d1/')"""))
def show_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a name and kind within a folder."""
    return lookup.find_symbols(model.tables(spark, sf_dir).symbols, "fn10", "function", "src/d1")


@query("""
WITH candidates AS (SELECT event_id AS import_id, rank, event_id % 500 + rank * 100 AS key FROM events, (SELECT unnest([0, 1, 2]) AS rank)),
found AS (SELECT import_id, rank, c_custkey FROM candidates JOIN customer ON c_custkey = key WHERE c_nationkey % 2 = 0)
SELECT event_id AS import_id, 'c' || (SELECT first(c_custkey ORDER BY rank) FROM found WHERE import_id = event_id) AS resolved_path FROM events""")
def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each import the first of its candidates that is a file."""
    from loomgraph.sources.resolve import first_existing

    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("import_id"))
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.concat(F.lit("c"), F.col("import_id") % 500 + r * 100))
    files = read(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("path"))
    return first_existing(events.withColumn("candidates", names), files, "import_id")


from loomgraph.plans import catalogue_more  # noqa: E402, F401  registers the rest
