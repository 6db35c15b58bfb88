"""The named queries. Each builds a DataFrame over the tables of an index; Catalyst plans it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.globs import glob_to_regex, literal_prefix
from loomgraph.functions.words import stem
from loomgraph.operators.coverage import mean_by_file, to_decimal
from loomgraph.plans.recipe_sql import SQL

C = F.col
#: Boundary rules that one plan holds as expressions.
RULES = 100


@dataclass(frozen=True)
class Param:
    name: str
    kind: str = "string"
    required: bool = True
    default: object = None


@dataclass(frozen=True)
class Recipe:
    id: str
    description: str
    build: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    actions: tuple[dict, ...] = ()
    sql: str | None = None
    #: The same as SQL, for a reader; a project's recipe is made of its sql alone.
    shown: str | None = None


RECIPES: dict[str, Recipe] = {}


def recipe(id: str, *params: Param, actions: tuple[dict, ...] = ()):
    def add(f):
        RECIPES[id] = Recipe(id, (f.__doc__ or "").strip().split("\n")[0], f, params, actions, shown=SQL[id].strip())
        return f

    return add


def _zero(c: str) -> Column:
    return F.coalesce(C(c), F.lit(0.0).cast("double"))


def _specifiers(imports: DataFrame) -> DataFrame:
    """imports with one row for each specifier."""
    return imports.withColumn("specifier", F.explode(F.from_json("specifiers", "array<string>")))


def _deprecated(symbols: DataFrame) -> DataFrame:
    return symbols.where(C("doc_comment").contains("@deprecated"))


def _covered(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """symbols with their coverage_pct, where measured."""
    pct = coverage.select("file_path", "name", "line_start", "coverage_pct")
    return symbols.join(pct, ["file_path", "name", "line_start"], "left")


def _top(counts: DataFrame, column: str, key: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc(column), key).limit(n)


@recipe("fan-out")
def fan_out(t) -> DataFrame:
    """Files that depend on most others."""
    return _top(t.dependencies.groupBy("from_path").agg(F.count("*").alias("deps")), "deps", "from_path", 10)


@recipe("fan-in")
def fan_in(t) -> DataFrame:
    """Files that most others depend on."""
    return _top(t.dependencies.groupBy("to_path").agg(F.count("*").alias("fan_in")), "fan_in", "to_path", 15)


def _sampled(t) -> DataFrame:
    """The ten of highest fan-out with their first five targets; targets are gathered for those ten only."""
    top = fan_out(t)
    kept = t.dependencies.join(F.broadcast(top.select("from_path")), "from_path", "left_semi")  # ten rows
    first = kept.groupBy("from_path").agg(F.slice(F.sort_array(F.collect_list("to_path")), 1, 5).alias("targets"))
    return top.join(first, "from_path")


@recipe("fan-out-sample")
def fan_out_sample(t) -> DataFrame:
    """Files of highest fan-out, with examples of what they depend on."""
    return _sampled(t).select("from_path", "deps", F.array_join("targets", " | ").alias("sample_targets")).orderBy(F.desc("deps"), "from_path")


@recipe("fan-out-sample-json")
def fan_out_sample_json(t) -> DataFrame:
    """The same with the examples as a JSON array."""
    return _sampled(t).select("from_path", "deps", F.to_json("targets").alias("sample_targets")).orderBy(F.desc("deps"), "from_path")


@recipe("index-summary")
def index_summary(t) -> DataFrame:
    """How much of each kind the index holds."""
    from loomgraph.operators.lookup import table_stats

    return table_stats(t, ("files", "symbols", "imports", "components", "dependencies"))


@recipe("files-largest")
def files_largest(t) -> DataFrame:
    """The files with most lines."""
    return _top(t.files.select("path", "line_count", "size", "language"), "line_count", "path", 20)


@recipe("files-hashes")
def files_hashes(t) -> DataFrame:
    """All files with their content hashes."""
    return t.files.select("path", "content_hash", "language", "line_count").orderBy("path")


@recipe("barrel-files")
def barrel_files(t) -> DataFrame:
    """Files that export most."""
    return _top(t.exports.groupBy("file_path").agg(F.count("*").alias("exports")), "exports", "file_path", 20)


@recipe("markers-by-kind")
def markers_by_kind(t) -> DataFrame:
    """How many markers there are of each kind."""
    return t.markers.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


@recipe("components-by-hooks")
def components_by_hooks(t) -> DataFrame:
    """Components by the number of hooks they use."""
    listed = F.trim("hooks_used")
    commas = F.length("hooks_used") - F.length(F.replace(C("hooks_used"), F.lit(","), F.lit("")))
    count = F.when(listed.isNull() | listed.isin("", "[]"), 0).otherwise(commas + 1).alias("hook_count")
    return t.components.select("name", "file_path", count).orderBy(F.desc("hook_count"), "file_path", "name").limit(20)


@recipe("deprecated-symbols", actions=({"type": "review-deprecated", "auto_fixable": False, "description": "Move callers to what replaces the symbol."},))
def deprecated_symbols(t) -> DataFrame:
    """Symbols whose doc comment deprecates them."""
    return _deprecated(t.symbols).select("name", "kind", "file_path", "line_start", "signature", "doc_comment").orderBy("file_path", "line_start", "name", "kind").limit(50)


@recipe("visibility-tags")
def visibility_tags(t) -> DataFrame:
    """Symbols whose doc comment states a visibility."""
    shown = t.symbols.select("name", "kind", "visibility", "file_path", "line_start", "signature", "doc_comment")
    return shown.where("visibility IS NOT NULL").orderBy("file_path", "line_start", "name", "kind", "doc_comment").limit(100)


@recipe("find-symbol-by-kind", Param("kind"), Param("name_pattern"))
def find_symbol_by_kind(t, kind: str, name_pattern: str) -> DataFrame:
    """Symbols of a kind with a name like a pattern; a backslash in it is an ordinary character."""
    like = C("name").like(name_pattern.replace("\\", "\\\\"))
    return t.symbols.where((C("kind") == kind) & like).select("name", "kind", "file_path", "line_start", "signature").orderBy("file_path", "line_start")


@recipe("files-by-coverage")
def files_by_coverage(t) -> DataFrame:
    """Files from the least covered on."""
    sums = t.coverage.groupBy("file_path").agg(F.sum("hit_statements").alias("hit_statements"), F.sum("total_statements").alias("total_statements"))
    share = F.try_divide(C("hit_statements") * F.lit(100.0).cast("double"), "total_statements")
    return sums.withColumn("coverage_pct", F.round(share, 2)).orderBy(F.asc_nulls_last("coverage_pct"), "file_path").limit(100)


@recipe("worst-covered-exports")
def worst_covered_exports(t) -> DataFrame:
    """Exported functions from the least covered on."""
    own = t.symbols.where("is_exported = 1 AND kind = 'function'")
    return _covered(own, t.coverage).select("name", "file_path", "line_start", _zero("coverage_pct").alias("coverage_pct")).orderBy("coverage_pct", "file_path", "line_start", "name").limit(20)


@recipe("high-complexity-untested")
def high_complexity_untested(t) -> DataFrame:
    """Complex functions that tests hardly reach."""
    own = _covered(t.symbols.where("complexity >= 10"), t.coverage).where(_zero("coverage_pct") < 50)
    shown = own.select("name", "kind", "file_path", "line_start", "line_end", "complexity", F.round(_zero("coverage_pct"), 1).alias("coverage_pct"))
    return shown.orderBy(F.desc("complexity"), "file_path", "name", "line_start", "line_end").limit(30)


def _unsuppressed(rows: DataFrame, suppressions: DataFrame, recipe_id: str, line: str | None) -> DataFrame:
    """rows without those whose file, or line if given, is exempted from a recipe: equality joins, no residual OR."""
    own = suppressions.where(C("recipe_id") == recipe_id).select("file_path", "line_number").distinct()
    kept = rows.join(own.where("line_number = 0").select("file_path"), "file_path", "left_anti")
    if line:
        kept = kept.join(own.where("line_number > 0").withColumnRenamed("line_number", line), ["file_path", line], "left_anti")
    return kept


@recipe("untested-and-dead", actions=({"type": "delete-symbol", "auto_fixable": False, "description": "Delete the function once its users are ruled out."},))
def untested_and_dead(t) -> DataFrame:
    """Exported functions that nothing calls and no test reaches."""
    own = t.symbols.where("is_exported = 1 AND kind = 'function'")
    uncalled = own.join(t.calls.select(C("callee_name").alias("name")), "name", "left_anti")
    bare = _covered(uncalled, t.coverage).where(_zero("coverage_pct") == 0)
    shown = _unsuppressed(bare, t.suppressions, "untested-and-dead", "line_start")
    return shown.select("name", "file_path", "line_start", _zero("coverage_pct").alias("coverage_pct")).orderBy("file_path", "line_start", "name").limit(100)


@recipe("unimported-exports")
def unimported_exports(t, aliases: bool = False) -> DataFrame:
    """Exports that no import names. With aliases, `x as y` counts as x and a namespace import as all."""
    named = _specifiers(t.imports).select(C("resolved_path").alias("file_path"), "specifier")
    if aliases:
        named = named.withColumn("specifier", F.when(C("specifier").startswith("* as "), "*").otherwise(F.substring_index("specifier", " as ", 1)))
    used = named.where("specifier != '*'").withColumnRenamed("specifier", "name")
    every = named.where("specifier = '*'").select("file_path")
    own = t.exports.where("is_default = 0 AND kind != 're-export'")
    unused = own.join(used, ["file_path", "name"], "left_anti").join(every, "file_path", "left_anti")
    kept = _unsuppressed(unused, t.suppressions, "unimported-exports", None)
    return kept.select("name", "kind", "file_path", "is_default", "re_export_source").orderBy("file_path", "name", "kind").limit(50)


@recipe("unused-type-members")
def unused_type_members(t) -> DataFrame:
    """Members of exported types that no import names."""
    named = _specifiers(t.imports).where("specifier != '*'").select(C("specifier").alias("name"))
    types = t.exports.where("is_default = 0 AND kind != 're-export'").join(named, "name", "left_anti").select(C("name").alias("owner_type"), "file_path").distinct()
    members = t.type_members.select(C("symbol_name").alias("owner_type"), C("name").alias("member"), C("type").alias("member_type"), "is_optional", "is_readonly", "file_path")
    return members.join(types, ["file_path", "owner_type"], "left_semi").select("owner_type", "member", "member_type", "is_optional", "is_readonly", "file_path").orderBy("file_path", "owner_type", "member", "member_type", "is_readonly").limit(50)


@recipe("refactor-risk-ranking")
def refactor_risk_ranking(t) -> DataFrame:
    """Files with exports by fan-in and lack of coverage."""
    users = t.dependencies.groupBy(C("to_path").alias("path")).agg(F.count("*").alias("fan_in"))
    tested = mean_by_file(t.coverage).withColumnRenamed("file_path", "path")
    offered = t.symbols.where("is_exported = 1").groupBy(C("file_path").alias("path")).agg(F.count("*").alias("exported_count"))
    wide = t.files.select("path").join(offered, "path").join(users, "path", "left").join(tested, "path", "left")  # files without exports don't count
    none = lambda c: F.coalesce(C(c), F.lit(0))
    score = (none("fan_in") + 1) * (F.lit(100.0).cast("double") - _zero("avg"))
    shown = wide.select(
        C("path").alias("file_path"), "exported_count", none("fan_in").alias("fan_in"), to_decimal(_zero("avg")).alias("avg_coverage_pct"), none("measured").alias("measured_symbols"), to_decimal(score).alias("risk_score")
    )
    return shown.orderBy(F.desc("risk_score"), "file_path").limit(30)


@recipe("components-touching-deprecated")
def components_touching_deprecated(t) -> DataFrame:
    """Components that use a deprecated hook or call a deprecated function."""
    old = _deprecated(t.symbols).select(C("name").alias("deprecated_symbol"), C("file_path").alias("deprecated_file"))
    own = t.components.select(C("name").alias("component"), C("file_path").alias("component_file"), "hooks_used")
    hooks = own.withColumn("deprecated_symbol", F.explode(F.from_json("hooks_used", "array<string>"))).drop("hooks_used").withColumn("via", F.lit("hook"))
    made = t.calls.select(C("caller_name").alias("component"), C("file_path").alias("component_file"), C("callee_name").alias("deprecated_symbol"))
    calls = own.drop("hooks_used").join(made, ["component", "component_file"]).withColumn("via", F.lit("call"))
    touched = hooks.unionByName(calls).join(old, "deprecated_symbol").select("component", "component_file", "deprecated_symbol", "deprecated_file", "via")
    return touched.distinct().orderBy("component_file", "component", "deprecated_symbol", "deprecated_file", "via").limit(50)


def _glob(path: str, rules: list[tuple[str, str]]) -> Column:
    """The names of the rules whose glob matches path; the literal prefix is tried before the pattern."""
    hits = [F.when(C(path).startswith(literal_prefix(g)) & C(path).rlike(glob_to_regex(g)), F.lit(n)) for n, g in rules]
    return F.array_compact(F.array(*hits))


@recipe("boundary-violations")
def boundary_violations(t) -> DataFrame:
    """Dependencies that a rule of the project denies.

    Rules are configuration, a handful of rows: they become expressions of the scan, so that no join
    and no shuffle remain. Many rules are tried RULES at a time, one scan for each block.
    """
    rules = list(t.boundary_rules.where("action = 'deny'").orderBy("name").toLocalIterator())
    empty = t.dependencies.sparkSession.createDataFrame([], "file_path string, to_path string, rule_name string, rule_from_glob string, rule_to_glob string")
    if not rules:
        return empty
    blocks = [_broken(t.dependencies, rules[i : i + RULES]) for i in range(0, len(rules), RULES)]
    return reduce(DataFrame.unionByName, blocks).orderBy("rule_name", "file_path", "to_path")


def _broken(dependencies: DataFrame, rules: list) -> DataFrame:
    """Dependencies that break one of the rules, of which no two have one name."""
    sources, targets = _glob("from_path", [(r["name"], r["from_glob"]) for r in rules]), _glob("to_path", [(r["name"], r["to_glob"]) for r in rules])
    broken = dependencies.withColumn("rule_name", F.explode(F.array_intersect(sources, targets)))
    known = F.create_map(*[x for r in rules for x in (F.lit(r["name"]), F.struct(F.lit(r["from_glob"]).alias("f"), F.lit(r["to_glob"]).alias("t")))])
    return broken.withColumn("__r", known[C("rule_name")]).select(C("from_path").alias("file_path"), "to_path", "rule_name", C("__r.f").alias("rule_from_glob"), C("__r.t").alias("rule_to_glob"))


@recipe("rename-preview", Param("old"), Param("new"), Param("kind", required=False), Param("in_file", required=False), Param("include_tests", "boolean", False, True), Param("include_re_exports", "boolean", False, True))
def rename_preview(t, old: str, new: str, kind: str | None = None, in_file: str | None = None, include_tests: bool = True, include_re_exports: bool = True) -> DataFrame:
    """Places that a rename would edit: definitions, and imports by name."""

    def wanted(df: DataFrame) -> DataFrame:
        if not include_tests:
            df = df.where(~C("file_path").contains("test.") & ~C("file_path").contains("spec."))
        return df

    def near(df: DataFrame) -> DataFrame:
        return df.where(C("file_path").startswith(in_file)) if in_file else df

    own = t.symbols.where(C("name") == old)
    own = wanted(own.where(C("kind") == kind) if kind else own)
    shape = lambda df, place: df.select("file_path", "line_start", "line_end", F.lit(old).alias("before_pattern"), F.lit(new).alias("after_pattern"), F.lit(place).alias("location_kind"), F.lit(0).alias("chain_depth"))
    named = near(wanted(_specifiers(t.imports).where(C("specifier") == old)))
    used = named.join(own.select(C("file_path").alias("resolved_path")), "resolved_path", "left_semi")
    places = used.select("file_path", C("line_number").alias("line_start"), C("line_number").alias("line_end")).distinct()
    return shape(near(own), "definition").unionByName(shape(places, "import_specifier")).orderBy("file_path", "line_start", "location_kind")


@recipe("text-in-deprecated-functions")
def text_in_deprecated_functions(t, terms: tuple[str, ...] = ("TODO", "FIXME", "HACK")) -> DataFrame:
    """Deprecated, hardly tested functions in files whose text speaks of unfinished work."""
    stems = [stem(x.lower()) for x in terms]
    spoken = t.source_fts.where(C("token").isin(stems)).select("file_path")
    own = _deprecated(t.symbols.where("kind = 'function'")).join(spoken, "file_path", "left_semi")
    bare = _covered(own, t.coverage).where(_zero("coverage_pct") < 50)
    shown = bare.select(C("name").alias("symbol"), "kind", "file_path", "line_start", "line_end", F.round(_zero("coverage_pct"), 1).alias("coverage_pct"))
    return shown.distinct().orderBy("file_path", "line_start", "symbol", "line_end", "coverage_pct").limit(50)


ALIASES = {"boundaries": "boundary-violations", "coverage-gaps": "worst-covered-exports", "dead-code": "untested-and-dead", "deprecated": "deprecated-symbols", "hotspots": "fan-in"}
