"""Reference resolution and refactor impact over structural rows.

Structural rows share one schema: reference_id, record_kind (reference,
declaration or coverage), file_id, project_id, path, language, kind,
source_qualified_symbol, written_name, target_name, module_path,
imported_name, alias, receiver_text, start_byte, end_byte, start_line,
end_line, shape_json, content_hash, schema_version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.paths import folder_of, package_roots, python_module_paths, script_module_paths
from strataquery.functions.text import last_segment, owner
from strataquery.operators.graphs import closure, nearest_scope, reach
from strataquery.shared import cut_lineage, unbroadcast

SCHEMA = (
    "reference_id string, record_kind string, file_id string, project_id string, path string, language string, kind string, source_qualified_symbol string, written_name string, target_name string, "
    "module_path string, imported_name string, alias string, receiver_text string, start_byte long, end_byte long, start_line int, end_line int, shape_json string, content_hash string, schema_version int"
)
#: Generation of structural rows; others are ignored when read.
GENERATION = 4
#: Most re-exports in a chain that is followed.
HOPS = 4

CALL_SHAPE = "struct<positional_count: int, keywords: array<string>, has_positional_spread: boolean, has_keyword_spread: boolean, type_argument_count: int, is_constructor: boolean>"
PARAMETERS = "array<struct<name: string, kind: string, required: boolean, position: int, destructured: boolean>>"

#: Reasons, in the order in which they are tried.
EXPLANATIONS = {
    "wildcard_import": "A wildcard import in the file may bind the name.",
    "known_owner_member": "The receiver is the owner of the declaration.",
    "known_namespace_member": "The receiver is an imported namespace that holds the declaration.",
    "unknown_receiver": "The receiver's type is not known.",
    "direct_import_alias": "The local name imports the declaration.",
    "reexport_chain": "The local name reaches the declaration over re-exports.",
    "unproven_reexport": "The local name comes from a module, but no chain of re-exports to the declaration was found.",
    "same_file_symbol": "The use is in the file of the declaration.",
    "name_only_candidate": "Only one declaration has this name, but nothing proves the binding.",
    "ambiguous_symbol": "Several declarations may bind the name.",
}
#: Reasons that a report also lists as limitations.
LIMITING = ("wildcard_import", "unknown_receiver", "unproven_reexport", "ambiguous_symbol")


@dataclass(frozen=True)
class Selected:
    """The declaration that a question is about."""

    file_id: str
    path: str
    language: str
    kind: str
    symbol: str
    qualified_symbol: str

    @property
    def owner(self) -> str:
        return self.qualified_symbol.rpartition(".")[0]


def binding(row: DataFrame | None = None) -> Column:
    """The local name that an import binds."""
    return F.coalesce("alias", F.nullif("written_name", F.lit("")), "imported_name")


def is_namespace_import(imported: Column, alias: Column) -> Column:
    """``import * as name`` binds one name and isn't a wildcard."""
    return (imported == "*") & alias.isNotNull()


def ladder(*, wildcard: Column, receiver: Column, self_receiver: Column, same_owner: Column, receiver_targets: Column, direct: Column, chain: Column, module_known: Column, same_file: Column, declarations: Column) -> Column:
    """Struct (resolution, reason): the first step that holds."""

    def verdict(resolution: str, reason: str) -> Column:
        return F.struct(F.lit(resolution).alias("resolution"), F.lit(reason).alias("reason"))

    return (
        F.when(wildcard, verdict("unresolved", "wildcard_import"))
        .when(receiver.isNotNull() & self_receiver & same_owner, verdict("exact", "known_owner_member"))
        .when(receiver.isNotNull() & receiver_targets, verdict("exact", "known_namespace_member"))
        .when(receiver.isNotNull(), verdict("likely", "unknown_receiver"))
        .when(direct, verdict("exact", "direct_import_alias"))
        .when(chain, verdict("exact", "reexport_chain"))
        .when(module_known, verdict("likely", "unproven_reexport"))
        .when(same_file, verdict("exact", "same_file_symbol"))
        .when(declarations == 1, verdict("likely", "name_only_candidate"))
        .otherwise(verdict("unresolved", "ambiguous_symbol"))
    )


def module_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """reference_id and each known path that the import's module may be: candidates are generated and matched by equality."""
    roots = package_roots(files).withColumnRenamed("path", "_path")
    placed = imports.where("module_path is not null").join(unbroadcast(roots), F.col("path") == F.col("_path"), "left").drop("_path")
    folder = folder_of(F.col("path"))
    names = F.when(F.col("language") == "python", python_module_paths(F.col("module_path"), folder, F.coalesce("root", F.lit("")))).otherwise(script_module_paths(F.col("module_path"), folder))
    return placed.select("reference_id", F.explode(names).alias("target_path")).join(unbroadcast(files.select(F.col("path").alias("target_path"))), "target_path", "left_semi").distinct()


def reexport_chains(imports: DataFrame, exports: DataFrame, targets: DataFrame, selected: Selected, hops: int = HOPS) -> DataFrame:
    """reference_ids of imports that reach the declaration's file over 1 to ``hops`` re-exports.

    A hop leaves the file that an import names by an import or export row of
    the same name there (or of ``*``); the name may change by alias.
    """
    resolved = targets.withColumnRenamed("target_path", "to_path")
    rows = exports.join(unbroadcast(resolved), "reference_id").select(
        F.struct(F.col("path").alias("path"), binding().alias("name")).alias("out"),
        F.struct(F.col("to_path").alias("path"), F.coalesce("imported_name", "written_name").alias("name")).alias("into"),
    )
    named = rows.where(F.col("out.name") != "*")
    stars = rows.where((F.col("into.name") == "*") | (F.col("out.name") == "*")).select(
        F.struct(F.col("out.path").alias("path"), F.lit(selected.symbol).alias("name")).alias("out"), F.struct(F.col("into.path").alias("path"), F.lit(selected.symbol).alias("name")).alias("into")
    )
    edges = named.unionByName(stars).select(F.col("out").alias("src"), F.col("into").alias("dst")).distinct()
    starts = imports.join(unbroadcast(resolved), "reference_id").select(F.col("reference_id").alias("start"), F.struct(F.col("to_path").alias("path"), F.coalesce("imported_name", "written_name").alias("name")).alias("node"))
    found = reach(starts, edges, hops)
    return found.where((F.col("node.path") == selected.path) & F.col("node.name").isin(selected.symbol, "default")).select(F.col("start").alias("reference_id")).distinct()


def find_references(rows: DataFrame, files: DataFrame, selected: Selected) -> DataFrame:
    """Uses of the selected declaration with resolution and reason, ordered by place.

    ``rows`` are one project's structural rows, ``files`` its paths. Only rows
    of the current generation count.
    """
    rows = rows.where(F.col("schema_version") == GENERATION)
    uses = rows.where(F.col("record_kind") == "reference")
    imports = uses.where(F.col("kind") == "import")
    linking = uses.where(F.col("kind").isin("import", "export") & F.col("module_path").isNotNull())
    targets = module_targets(linking, files)
    to_file = targets.where(F.col("target_path") == selected.path).select("reference_id").withColumn("to_file", F.lit(True))
    chains = reexport_chains(imports, linking, targets, selected).withColumn("chain", F.lit(True))
    bound = imports.join(to_file, "reference_id", "left").join(chains, "reference_id", "left")
    space = is_namespace_import(F.col("imported_name"), F.col("alias"))
    names = space | F.col("imported_name").isNull() | F.col("imported_name").isin(selected.symbol, "default")
    bound = bound.select("file_id", binding().alias("local"), (F.coalesce("to_file", F.lit(False)) & names).alias("direct"), F.coalesce("chain", F.lit(False)).alias("chain"), F.col("module_path").isNotNull().alias("known"), space.alias("space"))
    bound = bound.groupBy("file_id", "local").agg(*[F.bool_or(c).alias(c) for c in ("direct", "chain", "known", "space")])
    wild = imports.where((F.col("imported_name") == "*") & F.col("alias").isNull()).select("file_id").distinct().withColumn("wildcard", F.lit(True))
    declared = rows.where((F.col("record_kind") == "declaration") & ((F.col("target_name") == selected.symbol) | (last_segment(F.col("target_name")) == selected.symbol)))
    count = declared.agg(F.count(F.lit(1)).alias("declarations"))

    tails = [F.col(c) for c in ("target_name", "written_name")]
    by_name = F.lit(False)
    for c in tails:
        by_name = by_name | F.coalesce((c == selected.symbol) | (last_segment(c) == selected.symbol), F.lit(False))
    reaching = bound.where((F.col("direct") | F.col("chain")) & ~F.col("space")).select("file_id", F.col("local").alias("written_name"))
    candidates = uses.where(by_name).unionByName(uses.where(~by_name).join(reaching, ["file_id", "written_name"], "left_semi"))
    candidates = candidates.join(_shadowed(candidates, declared, selected), "reference_id", "left_anti")

    own = bound.select("file_id", F.col("local").alias("written_name"), "direct", "chain", "known")
    other = bound.select("file_id", F.col("local").alias("receiver_text"), F.col("direct").alias("receiver_targets"))
    out = candidates.join(own, ["file_id", "written_name"], "left").join(other, ["file_id", "receiver_text"], "left").join(wild, "file_id", "left").join(count)
    no = F.lit(False)
    same_owner = F.lit(bool(selected.owner)) & ((F.col("source_qualified_symbol") == selected.owner) | F.startswith("source_qualified_symbol", F.lit(selected.owner + "."))) & (F.col("file_id") == selected.file_id)
    step = ladder(
        wildcard=F.coalesce("wildcard", no), receiver=F.col("receiver_text"), self_receiver=F.coalesce(F.col("receiver_text").isin("self", "cls", "this"), no), same_owner=F.coalesce(same_owner, no), receiver_targets=F.coalesce("receiver_targets", no),
        direct=F.coalesce("direct", no), chain=F.coalesce("chain", no), module_known=F.coalesce("known", no), same_file=F.col("file_id") == selected.file_id, declarations=F.col("declarations"),
    )
    return out.withColumn("step", step).select(*rows.columns, "step.resolution", "step.reason").orderBy("path", "start_line", "start_byte", "reference_id")


def _shadowed(candidates: DataFrame, declared: DataFrame, selected: Selected) -> DataFrame:
    """Bare uses in the selected file whose innermost visible declaration is another one."""
    bare = candidates.where((F.col("file_id") == selected.file_id) & F.col("receiver_text").isNull() & F.col("kind").isin("call", "read", "write"))
    uses = bare.select(F.col("reference_id").alias("use_id"), F.col("file_id").alias("file"), last_segment(F.coalesce("written_name", "target_name")).alias("name"), F.coalesce("source_qualified_symbol", F.lit("")).alias("scope"))
    visible = declared.where((F.col("file_id") == selected.file_id) & (F.coalesce("kind", F.lit("")) != "method"))
    visible = visible.select(F.col("file_id").alias("file"), last_segment(F.col("target_name")).alias("name"), owner(F.col("target_name")).alias("scope"), F.col("target_name").alias("declaration_id"))
    return nearest_scope(uses, visible).where(F.col("declaration_id") != selected.qualified_symbol).select(F.col("use_id").alias("reference_id"))


def fresh_only(hits: DataFrame, coverage: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits whose file is as it was when indexed, and a limitation for each file that isn't.

    ``coverage`` and ``current`` have path and content_hash; files without
    either aren't suspected.
    """
    moved = coverage.select("path", F.col("content_hash").alias("was")).join(current.select("path", F.col("content_hash").alias("now")), "path").where(F.col("was") != F.col("now")).select("path")
    limits = moved.join(hits.select("path").distinct(), "path", "left_semi").select(F.lit("stale_file").alias("code"), F.lit("The file changed after it was indexed.").alias("explanation"), "path")
    return hits.join(moved, "path", "left_anti"), limits


def limitations(hits: DataFrame) -> DataFrame:
    """Distinct (code, explanation, path) of hits whose reason limits the answer, in order."""
    table = F.create_map(*[F.lit(x) for k in LIMITING for x in (k, EXPLANATIONS[k])])
    return hits.where(F.col("reason").isin(list(LIMITING))).select(F.col("reason").alias("code"), F.try_element_at(table, F.col("reason")).alias("explanation"), "path").distinct().orderBy("code", F.coalesce("path", F.lit("")))


def inheritance_edges(rows: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    """src and dst, structs of path and class: dst names src as a base, and the name binds to it.

    A bare name means the class of that name in its own file, or what an
    import binds to it there (under an alias or as a default). In
    ``space.Name`` the receiver has to be a namespace that the file imports.
    ``classes`` (path, class) are the classes that may be bases.
    """
    bases = rows.where((F.col("record_kind") == "reference") & (F.col("kind") == "inheritance") & (F.col("target_name") != "") & (F.col("source_qualified_symbol") != ""))
    bases = bases.select("path", F.struct("path", F.col("source_qualified_symbol").alias("class")).alias("dst"), owner(F.col("target_name")).alias("receiver"), last_segment(F.col("target_name")).alias("name"))
    imports = rows.where((F.col("record_kind") == "reference") & (F.col("kind") == "import") & F.col("module_path").isNotNull())
    space = is_namespace_import(F.col("imported_name"), F.col("alias")) | ((F.col("language") == "python") & F.col("imported_name").isNull())
    bound = imports.join(unbroadcast(module_targets(imports, files)), "reference_id").select("path", binding().alias("local"), F.coalesce(space, F.lit(False)).alias("space"), "imported_name", "target_path")

    bare = bases.where("receiver = ''")
    own = bare.select(F.col("path").alias("from"), "name", "dst")
    named = bare.join(unbroadcast(bound.where("not space and imported_name is not null").withColumnRenamed("local", "name")), ["path", "name"])
    spaced = bases.where("receiver != ''").join(unbroadcast(bound.where("space").withColumnRenamed("local", "receiver")), ["path", "receiver"]).select(F.col("target_path").alias("from"), "name", "dst")
    by_name = own.unionByName(named.where("imported_name != 'default'").select(F.col("target_path").alias("from"), F.col("imported_name").alias("name"), "dst")).unionByName(spaced)
    anyone = named.where("imported_name = 'default'").select(F.col("target_path").alias("from"), "dst")

    known = classes.select(F.col("path").alias("from"), last_segment(F.col("class")).alias("name"), F.struct("path", "class").alias("src"))
    return known.join(unbroadcast(by_name), ["from", "name"]).select("src", "dst").unionByName(known.join(unbroadcast(anyone), "from").select("src", "dst")).where("src != dst").distinct()


def overrides(rows: DataFrame, files: DataFrame, selected: Selected) -> DataFrame:
    """Methods of the same name in all classes below the selected method's class, however far."""
    rows = rows.where(F.col("schema_version") == GENERATION)
    declared = rows.where(F.col("record_kind") == "declaration")
    top = declared.where((F.col("path") == selected.path) & (F.col("target_name") == selected.owner) & (F.col("kind") == "class"))
    derived = rows.where((F.col("record_kind") == "reference") & (F.col("kind") == "inheritance") & (F.col("source_qualified_symbol") != ""))
    classes = top.select("path", F.col("target_name").alias("class")).unionByName(derived.select("path", F.col("source_qualified_symbol").alias("class"))).distinct()
    # each hop reads both
    start, edges = cut_lineage(top.select(F.struct("path", F.col("target_name").alias("class")).alias("start"))), cut_lineage(inheritance_edges(rows, files, classes))
    below = closure(start, edges).where("node != start").select("node.path", F.concat("node.class", F.lit("." + selected.symbol)).alias("target_name"))
    return declared.join(unbroadcast(below.distinct()), ["path", "target_name"], "left_semi")


def signature_issue(call: Column, old: Column, new: Column, *, overloads: Column, bound: Column) -> Column:
    """The first problem that a call has with a changed signature, or null.

    ``call`` is a CALL_SHAPE, ``old`` and ``new`` are PARAMETERS; ``bound``
    tells that the first parameter is the receiver.
    """

    def positional(parameters: Column) -> Column:
        kept = F.filter(parameters, lambda p: p["kind"].isin("positional", "positional_only"))
        return F.when(bound, F.slice(kept, 2, 1 << 30)).otherwise(kept)

    names, count = F.coalesce(call["keywords"], F.array().cast("array<string>")), F.coalesce(call["positional_count"], F.lit(0))
    fresh, former = positional(new), positional(old)
    by_keyword = lambda p: F.array_contains(names, p["name"])
    unmet = F.exists(new, lambda p: p["required"] & (p["kind"] == "keyword_only") & ~by_keyword(p))
    unknown = F.exists(names, lambda k: ~F.exists(new, lambda p: p["name"] == k))
    placed_only = F.exists(names, lambda k: F.exists(new, lambda p: (p["name"] == k) & (p["kind"] == "positional_only")))
    uncovered = F.exists(F.transform(fresh, lambda p, i: p["required"] & (i >= count) & ~by_keyword(p)), lambda x: x)
    dropped = F.slice(former, F.size(fresh) + 1, F.greatest(count - F.size(fresh), F.lit(0)))
    to_keyword = F.exists(dropped, lambda o: F.exists(new, lambda p: (p["name"] == o["name"]) & (p["kind"] == "keyword_only")))
    surplus = (count > F.size(fresh)) & ~F.exists(new, lambda p: p["kind"] == "variadic")

    def moved(p: Column, i: Column) -> Column:
        before = F.get(former, i)["name"]
        place = F.array_position(F.transform(former, lambda o: o["name"]), p["name"])
        return (i < count) & (before != p["name"]) & (place > 0) & (place - 1 != i)

    reordered = F.exists(F.transform(fresh, moved), lambda x: F.coalesce(x, F.lit(False)))
    return (
        F.when(call.isNull(), F.lit(None))
        .when(call["has_positional_spread"] | call["has_keyword_spread"], "spread_uncertainty")
        .when(overloads > 1, "overload_ambiguity")
        .when((overloads != 1) | old.isNull(), F.lit(None))
        .when(unmet, "missing_required_parameter")
        .when(unknown, "invalid_keyword")
        .when(placed_only, "parameter_mode_change")
        .when(uncovered, "missing_required_parameter")
        .when(surplus & to_keyword, "parameter_mode_change")
        .when(surplus, "removed_positional_parameter")
        .when(reordered, "positional_order_change")
    )


def rename_bucket(resolution: Column, written: Column, kind: Column, symbol: str) -> Column:
    edit = (last_segment(written) == symbol) | kind.isin("import", "export")
    return F.when(resolution == "unresolved", "review").when(resolution == "likely", "likely_change").when(edit, "must_change").otherwise("evidence")


def signature_bucket(resolution: Column, issue: Column) -> Column:
    return (
        F.when(resolution == "unresolved", "review")
        .when(resolution == "likely", "likely_change")
        .when(issue.isin("spread_uncertainty", "overload_ambiguity"), "review")
        .when(issue.isNotNull(), "must_change")
        .otherwise("evidence")
    )


def bucket_counts(findings: DataFrame) -> DataFrame:
    """bucket and findings, over all pages."""
    return findings.groupBy("bucket").agg(F.count(F.lit(1)).alias("findings"))


def completeness(gaps: Column, uncertain: Column) -> Column:
    return F.when(gaps, "incomplete").when(uncertain, "complete_with_dynamic_limitations").otherwise("complete")


def on_page(findings: DataFrame, page: DataFrame) -> DataFrame:
    return findings.join(page.select("reference_id"), "reference_id", "left_semi")


def declaration_matches(declarations: DataFrame, path: str, qualified: str) -> tuple[list, list[str]]:
    """Up to two rows that the selector names, and up to ten near misses with its last segment."""
    rows = declarations.where((F.col("path") == path) & (F.col("target_name") == qualified)).take(2)
    if rows:
        return rows, []
    near = declarations.where(last_segment(F.col("target_name")) == qualified.rpartition(".")[2]).select("target_name").distinct().orderBy("target_name").limit(10)
    return [], [r[0] for r in near.collect()]


def first_by_place(rows: DataFrame) -> DataFrame:
    """First reference of each (kind, start, end) of a file by its order of capture."""
    order = Window.partitionBy("file_id", "kind", "start_byte", "end_byte").orderBy("capture")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
