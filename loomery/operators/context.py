"""Context bundles: budgets, packing, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as T

# fixed values: shares of a budget in percent, and weights of categories
SHARES = {"primary": 40, "tests": 20, "callers": 15, "callees": 15, "other": 10}
CATEGORY_WEIGHTS = {"primary": 1.0, "tests": 0.8, "callers": 0.6, "callees": 0.6, "config": 0.4, "other": 0.3}


def split_budget(budget: Column) -> list[Column]:
    return [F.floor(budget * p / 100).cast("long").alias(k) for k, p in SHARES.items()]


def prioritised(items: DataFrame, category: str = "category", base: str = "base", seq: str = "seq", by: str = "bundle") -> DataFrame:
    """Order within each bundle: base times category weight, first come first."""
    weight = None
    for k, w in CATEGORY_WEIGHTS.items():
        weight = F.when(F.col(category) == k, w) if weight is None else weight.when(F.col(category) == k, w)
    rows = items.withColumn("priority", F.col(base) * weight.otherwise(0.3))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("priority"), F.asc(seq))).cast("long"))


def pack(items: DataFrame, budget: int, by: str = "bundle", order: str = "place") -> DataFrame:
    """(bundle, items, used): items in order, skipping what would exceed the budget; one fold over the bundle's own few items."""
    rows = F.array_sort(F.collect_list(F.struct(order, "id", "tokens")))
    first = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"].cast("long")))).otherwise(acc["ids"]).alias("ids"))

    out = items.groupBy(by).agg(F.aggregate(rows, first, step).alias("p"))
    return out.select(by, F.col("p.ids").alias("ids"), F.col("p.used").alias("used"))


def reservations(events: DataFrame, budget: int, by: str = "bundle", order: str = "seq") -> DataFrame:
    """(bundle, seq, action, category, tokens, accepted, used): a budget under ``reserve`` and ``release`` events, one fold over a bundle's own events.

    A reservation replaces the category's former one and is refused, leaving that, if the sum of all would exceed the budget; a
    release of what isn't reserved does nothing.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "action", "category", "tokens")))
    line = f"struct<{order}: {events.schema[order].dataType.simpleString()}, action: string, category: string, tokens: bigint, accepted: boolean, used: bigint>"
    first = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(map() as map<string, bigint>)").alias("held"), F.expr(f"cast(array() as array<{line}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        had = F.coalesce(F.try_element_at(acc["held"], x["category"]), F.lit(0).cast("long"))
        wanted = F.when(x["action"] == "reserve", x["tokens"].cast("long")).otherwise(F.lit(0).cast("long"))
        used = acc["used"] - had + wanted
        ok = used <= budget
        others = F.map_filter(acc["held"], lambda k, v: k != x["category"])
        held = F.when(~ok, acc["held"]).when(x["action"] == "reserve", F.map_concat(others, F.map_from_arrays(F.array(x["category"]), F.array(wanted)))).otherwise(others)
        now = F.when(ok, used).otherwise(acc["used"])
        said = F.struct(x[order].alias(order), x["action"].alias("action"), x["category"].alias("category"), x["tokens"].cast("long").alias("tokens"), ok.alias("accepted"), now.alias("used")).cast(line)
        return F.struct(now.alias("used"), held.alias("held"), F.concat(acc["out"], F.array(said)).alias("out"))

    out = events.groupBy(by).agg(F.aggregate(rows, first, step, lambda acc: acc["out"]).alias("_o"))
    return out.select(by, F.explode("_o").alias("_o")).select(by, "_o.*")


def one_per_role(items: DataFrame, by: str = "bundle", role: str = "category") -> DataFrame:
    w = Window.partitionBy(by, role).orderBy(F.desc("base"), F.asc("id"))
    return items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# fixed value: what stands for lines that are left out
MARKER = "// ... [truncated] ..."


def _fitting(rows: Column, start: Column, room: Column, below: bool = False) -> Column:
    """How many of ``rows`` in a row keep the estimate of all their bytes, from ``start`` bytes on, within ``room``; ``below``: and none is added once it is reached."""
    first = F.struct(start.cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, x: Column) -> Column:
        more = acc["bytes"] + F.octet_length(x) + F.when(acc["bytes"] > 0, 1).otherwise(0)
        on = acc["on"] & (F.ceil(more / 4) <= room)
        if below:
            on = on & (F.ceil(acc["bytes"] / 4) < room)
        return F.struct(F.when(on, more).otherwise(acc["bytes"]).cast("long").alias("bytes"), F.when(on, acc["n"] + 1).otherwise(acc["n"]).alias("n"), on.alias("on"))

    return F.aggregate(rows, first, step, lambda acc: acc["n"])


def _estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def truncate_head(text: Column, budget: int, marker: str = "\n" + MARKER) -> Column:
    """The whole text if it fits, else its first lines that fit beside the marker."""
    rows = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    kept = _fitting(rows, F.lit(0), F.lit(max(0, budget - -(-len(marker.encode()) // 4))))
    return F.when(_estimate(text) <= budget, text).otherwise(F.concat(F.array_join(F.slice(rows, F.lit(1), kept), "\n"), F.lit(marker)))


def truncate_signature(text: Column, budget: int, marker: str = "\n    " + MARKER + "\n") -> Column:
    """The whole text if it fits, else signature and the comments after it, then as much of the body as fits beside the marker.

    The signature ends with the first line that opens a block or that is neither empty nor a comment; comments and the
    empty lines after them follow it.  Both are kept whatever the budget.
    """
    rows = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    # of each line: c a comment, e empty, o another; b opens a block
    kinds = F.array_join(F.transform(rows, lambda x: F.when(F.trim(x).rlike(r"\{|=>|:$"), F.when(F.trim(x).rlike(r"^(//|/\*|\*|#)"), "B").otherwise("b")).when(F.trim(x) == "", "e").when(F.trim(x).rlike(r"^(//|/\*|\*|#)"), "c").otherwise("o")), "")
    signature = F.greatest(F.length(F.regexp_extract(kinds, "^[ce]*[bBo]", 0)), F.lit(1))
    after = F.substring(kinds, signature + 1, F.length(kinds))
    comments = F.length(F.regexp_extract(after, "^e*[cB][ecB]*", 0))
    head = F.least(signature + comments, F.size(rows))
    start = F.array_join(F.slice(rows, F.lit(1), head), "\n")
    room = F.lit(max(0, budget - -(-len(marker.encode()) // 4)))
    body = F.slice(rows, head + 1, F.greatest(F.size(rows) - head, F.lit(0)))
    more = _fitting(body, F.octet_length(start), room, below=True)
    cut = F.concat(F.array_join(F.slice(rows, F.lit(1), head + more), "\n"), F.when(head + more < F.size(rows), marker).otherwise(""))
    return F.when(_estimate(text) <= budget, text).otherwise(cut)


def truncate_head_and_tail(text: Column, head: int, tail: int, marker: str = "... [truncated]") -> Column:
    rows = F.split(text, "\n")
    return F.when(F.size(rows) <= head + tail, text).otherwise(F.array_join(F.concat(F.slice(rows, 1, head), F.array(F.lit(marker)), F.slice(rows, F.size(rows) - tail + 1, F.lit(tail))), "\n"))


def reason(role: Column, name: Column) -> Column:
    return F.when(role == "primary", F.concat(F.lit("Primary chunk "), name)).when(role == "tests", F.concat(F.lit("Tests "), name)).when(role == "callers", F.concat(F.lit("Calls "), name)).when(role == "callees", F.concat(F.lit("Called by "), name)).otherwise(F.concat(F.lit("Related to "), name))


# fixed values: roles of a bundle in order, with their shares of the budget
BUNDLE_ROLES = (("primary", 0.4), ("tests", 0.3), ("callers", 0.15), ("callees", 0.15))


def bundle(items: DataFrame, budget: int, by: str = "bundle") -> DataFrame:
    """(bundle, primary, tests, callers, callees, used): ids of at most one item (id, category, tokens) of each role.

    The primary item always counts.  Another is left out once the budget is used up, if less than a tenth of its role's
    share is left, or if it would exceed the budget.
    """
    best = one_per_role(items, by)
    roles = [r for r, _ in BUNDLE_ROLES]
    wide = best.groupBy(by).agg(*(F.max(F.when(F.col("category") == r, F.struct("id", "tokens"))).alias(r) for r in roles))
    used, taken = F.coalesce(F.col("primary.tokens"), F.lit(0)).cast("long"), [F.col("primary.id").alias("primary")]
    for role, share in BUNDLE_ROLES[1:]:
        tokens, left = F.col(f"{role}.tokens"), F.greatest(F.lit(budget) - used, F.lit(0))
        fits = F.coalesce((used < budget) & (left >= int(budget * share) // 10) & (used + tokens <= budget), F.lit(False))
        taken.append(F.when(fits, F.col(f"{role}.id")).alias(role))
        used = F.when(fits, used + tokens).otherwise(used)
    return wide.select(by, *taken, used.alias("used"))


def by_language(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, role, other): what belongs to a chunk by the ways of its language, besides calls and imports.

    chunks: id, relpath, symbol_name, kind, language, text; files: id, relpath.
    React (tsx, jsx): hooks that it uses, components that it renders (children) and that render it (parents).
    Rust: the manifest nearest above, implementations of and for its name, module files of its folder.
    Python: __init__.py of its folder, dependency files at the root, its parent classes.
    """
    own = chunks.select("id", "relpath", "symbol_name", "kind", "language", "text")
    names = chunks.filter("symbol_name IS NOT NULL").select(F.col("symbol_name").alias("_name"), F.col("id").alias("other"), F.col("kind").alias("_kind"), F.col("language").alias("_language"))

    def named(rows: DataFrame, role: str, keep: Column) -> DataFrame:
        """rows: (id, language, _name) meet the chunks of that name."""
        met = rows.distinct().join(names.filter(keep), "_name").filter(F.col("id") != F.col("other"))
        return met.filter(F.col("_language") == F.col("language")).select("id", F.lit(role).alias("role"), "other")

    react = own.filter(F.col("language").isin("tsx", "jsx"))
    hooks = react.select("id", "language", F.explode(F.regexp_extract_all("text", F.lit(r"\b(use[A-Z]\w*)\s*\("), F.lit(1))).alias("_name"))
    tags = react.select("id", "language", F.explode(F.regexp_extract_all("text", F.lit(r"<([A-Z]\w*)"), F.lit(1))).alias("_name"))
    children = named(tags, "jsx_child", F.lit(True))
    parents = children.select(F.col("other").alias("id"), F.lit("jsx_parent").alias("role"), F.col("id").alias("other"))
    rust = own.filter("language = 'rs'")
    impls = rust.select(F.col("id").alias("other"), F.explode(F.regexp_extract_all("text", F.lit(r"\bimpl(?:<[^>]*>)?\s+(?:(\w+)(?:<[^>]*>)?\s+for\s+)?(\w+)"), F.lit(0))).alias("_m"))
    two = F.array(F.regexp_extract("_m", r"(\w+)(?:<[^>]*>)?\s+for\s", 1), F.regexp_extract("_m", r"(\w+)$", 1))
    impls = impls.select("other", F.explode(two).alias("_name")).filter("_name <> ''").distinct()
    types = rust.filter(F.col("kind").isin("class", "struct", "enum", "trait")).select("id", F.col("symbol_name").alias("_name"))
    impls = types.join(impls, "_name").filter(F.col("id") != F.col("other")).select("id", F.lit("trait_impl").alias("role"), "other")
    paths = files.select(F.col("id").alias("other"), F.col("relpath").alias("_path"))
    folder, file = T.parent_dir(F.col("_path")), T.file_name(F.col("_path"))
    # every folder above a chunk, the nearest first; a path has few
    above = rust.select("id", F.posexplode(_folders(F.col("relpath"))).alias("_far", "_folder"))
    manifests = above.join(paths.filter(file == "Cargo.toml").select("other", folder.alias("_folder")), "_folder")
    manifests = manifests.groupBy("id").agg(F.min_by("other", "_far").alias("other")).select("id", F.lit("manifest").alias("role"), "other")
    beside = rust.select("id", T.parent_dir(F.col("relpath")).alias("_folder")).join(paths.filter(file.isin("mod.rs", "lib.rs")).select("other", folder.alias("_folder")), "_folder").select("id", F.lit("module").alias("role"), "other")
    python = own.filter("language = 'py'")
    inits = python.select("id", T.parent_dir(F.col("relpath")).alias("_folder")).join(paths.filter(file == "__init__.py").select("other", folder.alias("_folder")), "_folder").select("id", F.lit("init").alias("role"), "other")
    # at most a few files at the root
    roots = paths.filter(F.col("_path").isin("requirements.txt", "pyproject.toml", "setup.py")).select("other")
    depends = python.select("id").join(F.broadcast(roots.limit(3))).select("id", F.lit("dependencies").alias("role"), "other")
    bases = python.filter("kind = 'class'").select("id", "language", F.explode(F.split(F.regexp_extract("text", r"class\s+\w+\(([^)]*)\)", 1), r"\s*,\s*")).alias("_name"))
    out = named(hooks, "hook", F.lit(True)).unionByName(children).unionByName(parents).unionByName(impls).unionByName(manifests).unionByName(beside)
    return out.unionByName(inits).unionByName(depends).unionByName(named(bases, "parent_class", F.col("_kind") == "class")).distinct()


def _folders(path: Column) -> Column:
    """The folders above a path, the nearest first, the root ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
