"""From source files to chunks, links and edges."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import ignores
from loomery.operators.markdown import lines
from loomery.sources.durable import cut

#: Ids of a name that lie in one list; edges that a task makes, and tasks at most.
LISTED, EDGES_A_TASK, MOST_TASKS = 1024, 1 << 24, 1 << 15
CHUNK = "kind string, symbol_name string, start_line int, end_line int, signature string, docstring string, metadata string"


def keys(files: DataFrame, id_col: str, pattern: str, kind: str, text_col: str = "text") -> DataFrame:
    """(id, kind, key, start, end): lines on which a top-level key starts, by ``pattern`` whose first group is the key."""
    rows = lines(files, id_col, text_col).withColumn("last", F.max("n").over(Window.partitionBy(id_col))).filter(F.col("line").rlike(pattern))
    w = Window.partitionBy(id_col).orderBy("n")
    return rows.select(id_col, F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("key"), F.col("n").alias("start"), F.coalesce(F.lead("n").over(w) - 1, F.col("last")).alias("end"))


# fixed values: how a top-level key starts
YAML_KEY, TOML_SECTION, TOML_KEY, JSON_KEY = r"^([A-Za-z_][\w.-]*)\s*:", r"^\[+([^\]]+)\]+\s*$", r"^([A-Za-z_][\w-]*)\s*=", r'^\s{2}"([^"]+)"\s*:'
# fixed values: keys for which a small JSON file is cut up all the same, and how many keys make one that isn't small
JSON_ALWAYS, JSON_FEW = ("scripts", "dependencies", "devDependencies", "config", "exports"), 3


def data_keys(files: DataFrame, id_col: str, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(id, kind, key, start, end) of top-level keys and sections of JSON, YAML and TOML files, from lines and their depth.

    A JSON key counts where it begins a line; a TOML file without sections is cut by its keys; a JSON object of few keys, or
    what isn't one, is a module chunk of up to 40 lines, and so is any file without keys.
    """
    string = r'"[^"\\]*(?:\\.[^"\\]*)*"'
    named = files.select(F.col(id_col).alias("_i"), F.col(language_col).alias("_l"), F.coalesce(text_col, F.lit("")).alias("_t"))
    rows = named.select("_i", "_l", F.posexplode(F.split("_t", "\n")).alias("_p", "line")).withColumn("n", F.col("_p") + 1)
    bare = F.regexp_replace("line", string, "")
    net = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    w, whole = Window.partitionBy("_i").orderBy("n"), Window.partitionBy("_i")
    rows = rows.withColumn("_after", F.sum(net).over(w)).withColumn("_before", F.col("_after") - net)
    opened = F.first(F.when(F.trim("line") != "", F.trim("line").startswith("{")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"_last": F.max("n").over(whole), "_inner": F.max(F.when(F.col("_after") >= 1, F.col("n"))).over(whole), "_object": F.coalesce(opened, F.lit(False)) & (F.max_by("_after", "n").over(whole) == 0)})
    json_, yaml, section, key = rf"^\s*({string})\s*:", r"^([^\s#:][^:]*):", r"^\s*\[+\s*([^\]]*?)\s*\]+", r"^\s*([^\s#=][^=]*?)\s*="
    has = F.max((F.col("_l") == "toml") & F.col("line").rlike(section)).over(whole)
    found = (
        F.when((F.col("_l") == "json") & F.col("_object") & (F.col("_before") == 1) & F.col("line").rlike(json_), F.struct(F.lit("json_key").alias("kind"), F.expr("substring(k, 2, length(k) - 2)").alias("key")))
        .when((F.col("_l") == "yaml") & F.col("line").rlike(yaml), F.struct(F.lit("yaml_key").alias("kind"), F.trim("y").alias("key")))
        .when((F.col("_l") == "toml") & (F.regexp_extract("line", section, 1) != ""), F.struct(F.lit("toml_section").alias("kind"), F.regexp_extract("line", section, 1).alias("key")))
        .when((F.col("_l") == "toml") & ~F.col("_has") & F.col("line").rlike(key), F.struct(F.lit("toml_key").alias("kind"), F.regexp_extract("line", key, 1).alias("key")))
    )
    starts = rows.withColumns({"k": F.regexp_extract("line", json_, 1), "y": F.regexp_extract("line", yaml, 1), "_has": F.coalesce(has, F.lit(False))}).withColumn("_f", found).filter("_f IS NOT NULL")
    few = (F.col("_l") == "json") & (F.count("*").over(whole) <= JSON_FEW) & ~F.max(F.col("_f.key").isin(*JSON_ALWAYS)).over(whole)
    end = F.coalesce(F.lead("n").over(w) - 1, F.when(F.col("_l") == "json", F.col("_inner")).otherwise(F.col("_last")))
    kept = starts.withColumns({"_few": few, "_end": F.when(F.col("_f.kind") == "toml_key", F.col("n")).otherwise(F.greatest("n", end))}).filter("NOT _few")
    out = kept.select(F.col("_i").alias(id_col), "_f.kind", "_f.key", F.col("n").alias("start"), F.col("_end").alias("end"))
    rest = named.join(out.select(F.col(id_col).alias("_i")).distinct(), "_i", "left_anti")
    module = rest.select(F.col("_i").alias(id_col), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(1).alias("start"), F.least(F.lit(40), F.size(F.split("_t", "\n"))).alias("end"))
    return out.unionByName(module)


# fixed values: definitions by language: (kind, pattern of a line; group 1 is the name)
DEFINITIONS = {
    "rs": (("func", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)")),
    "go": (("func", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("type", r"^type\s+(\w+)"), ("variable", r"^var\s+(\w+)"), ("constant", r"^const\s+(\w+)")),
    "rb": (("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")),
    "ts": (("func", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"), ("func", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("constant", r"^\s*(?:export\s+)?const\s+(\w+)\s*=")),
    "java": (("class", r"^\s*(?:public|protected|private)?\s*(?:abstract\s+|final\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "cs": (("class", r"^\s*(?:public|internal|private|protected)?\s*(?:abstract\s+|sealed\s+|static\s+|partial\s+)*(?:class|interface|struct|enum|record)\s+(\w+)"), ("method", r"^\s+(?:public|internal|private|protected)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "c": (("func", r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*$"), ("class", r"^(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)"), ("constant", r"^#define\s+(\w+)")),
}
DEFINITIONS["js"], DEFINITIONS["cpp"] = DEFINITIONS["ts"], (("class", r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)"), ("module", r"^\s*namespace\s+(\w+)"), *DEFINITIONS["c"])
DEFINITIONS["gomod"] = (("module", r"^module\s+(\S+)"), ("imports", r"^\s+([\w./-]+)\s+v[\w.+-]+"))


def python_chunks(source: str) -> list[tuple]:
    """Classes, functions and methods of a Python source, with signatures and docstrings; nothing if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def walk(body: list, inside: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                out.append(("class", node.name, node.lineno, node.end_lineno, f"class {node.name}({', '.join(map(ast.unparse, node.bases))})" if node.bases else f"class {node.name}", ast.get_docstring(node), None))
                walk(node.body, True)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                plain = "method" if inside else "func"
                waits = isinstance(node, ast.AsyncFunctionDef)
                out.append((f"async_{plain}" if waits else plain, node.name, node.lineno, node.end_lineno, f"{'async ' * waits}def {node.name}({ast.unparse(node.args)})", ast.get_docstring(node), None))
            elif isinstance(node, (ast.Import, ast.ImportFrom)) and not inside:
                out.append(("imports", None, node.lineno, node.end_lineno, ast.unparse(node), None, ",".join(a.name for a in node.names)))
            elif isinstance(node, ast.Assign) and not inside:
                for t in node.targets:
                    if isinstance(t, ast.Name):
                        out.append(("constant" if t.id.isupper() else "variable", t.id, node.lineno, node.end_lineno, None, None, None))

    walk(tree.body, False)
    return out


def _block_end(rows: list[str], start: int, language: str) -> int:
    """The line on which a definition that starts on line ``start`` ends: where its brackets close, or its ``end``; its own line if it opens nothing."""
    if language == "rb":
        indent = len(rows[start - 1]) - len(rows[start - 1].lstrip())
        return next((k for k in range(start + 1, len(rows) + 1) if re.match(rf"\s{{{indent}}}end\b", rows[k - 1])), start)
    depth, opened = 0, False
    for k in range(start, len(rows) + 1):
        # brackets in strings and comments don't count
        bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\'|//.*', "", rows[k - 1])
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0:
            return k
        if not opened and (";" in bare or k > start + 10):
            return k if ";" in bare else start
    return len(rows) if opened else start


def pattern_chunks(source: str, language: str) -> list[tuple]:
    """Definitions found line by line, each with the lines of its block; definitions may lie within others."""
    rows, out = source.split("\n"), []
    for i, line in enumerate(rows, 1):
        for kind, pattern in DEFINITIONS.get(language, ()):
            if m := re.match(pattern, line):
                end = i if language == "gomod" or line.startswith("#") else _block_end(rows, i, language)
                out.append((kind, m[1], i, end, line.strip(), None, None))
                break
    return out


def chunks(files: DataFrame, id_col: str, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """Chunks of code files; a file in which nothing is found is one module chunk of its first 40 lines."""
    kind = files.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in CHUNK.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, text, lang in zip(*(b.column(c).to_pylist() for c in (id_col, text_col, language_col))):
                text = text or ""
                own = python_chunks(text) if lang == "py" else pattern_chunks(text, lang or "")
                own = own or [("module", None, 1, min(40, text.count("\n") + 1), None, None, None)]
                ids += [i] * len(own)
                rows += own
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(id_col).type), *(pa.array(c, t) for c, t in zip(cols, types))], [id_col, *names])

    return files.select(id_col, text_col, language_col).mapInArrow(kernel, f"`{id_col}` {kind}, {CHUNK}")


def docstring_text(doc: Column) -> Column:
    """A docstring on one line per entry: section titles of the usual styles become `title:`, field marks go."""
    out = F.regexp_replace(doc, r"(?m)^\s*(Args|Arguments|Parameters|Returns|Raises|Yields|Examples?|Attributes|Notes?)\s*:?\s*\n(?:\s*-{3,}\s*\n)?", "$1: ")
    out = F.regexp_replace(out, r"(?m)^\s*:(?:param|arg|type|raises?|returns?|rtype)\s*([^:]*):\s*", "$1 ")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def enclosing(calls: DataFrame, defs: DataFrame, bin_size: int = 64) -> DataFrame:
    """(call_id, chunk_id): the first chunk of the file whose lines hold the call.  Ranges are dealt to bins, so the join is an equi-join."""
    spans = defs.select(F.col("file_id").alias("_f"), F.col("id"), "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bin_size), F.floor(F.col("end_line") / bin_size))).alias("_b"))
    own = calls.withColumn("_bin", F.floor(F.col("line") / bin_size))
    met = own.join(spans, (F.col("file_id") == F.col("_f")) & (F.col("_bin") == F.col("_b")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("call_id").agg(F.min("id").alias("chunk_id"))


def call_edges(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, type): calls (call_id, file_id, line, callee) to the last chunk of that name in the file."""
    table = defs.filter("symbol_name IS NOT NULL").groupBy(F.col("file_id"), F.col("symbol_name").alias("callee")).agg(F.max("id").alias("dst"))
    return calls.join(enclosing(calls, defs), "call_id").join(table, ["file_id", "callee"]).select(F.col("chunk_id").alias("src"), "dst", F.lit("calls").alias("type")).distinct()


def _named(rows: DataFrame) -> DataFrame:
    """(id, symbol_name), each once, with ``_all``: the names of the id."""
    found = rows.filter(F.col("symbol_name").isNotNull()).groupBy("id").agg(F.collect_set("symbol_name").alias("_all"))
    return found.select("id", "_all", F.explode("_all").alias("symbol_name"))


def _listed(named: DataFrame, out: str) -> DataFrame:
    """(symbol_name, out): the ids of a name in lists of about LISTED, so that no row or task holds all of a frequent name."""
    parts = named.groupBy("symbol_name").agg(F.ceil(F.count("*") / LISTED).alias("_parts"))
    dealt = named.join(parts, "symbol_name").withColumn("_part", F.pmod(F.xxhash64("id"), "_parts"))
    # an id that is null stays in its list
    return dealt.groupBy("symbol_name", "_part").agg(F.collect_list(F.struct("id")).alias(out)).drop("_part")


def import_edges(imports: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, type): import chunks (id, metadata: names joined by commas) to chunks of those names.

    The edges of a name are all pairs of its imports and its chunks, far more than there are rows.  So lists of ids meet by
    name, are dealt evenly, and each edge leaves its task as it is made: nothing after it tells edges apart.  A chunk of one
    name gives an edge once; of several, an edge counts for the least name that both share.
    """
    spark = imports.sparkSession
    # ids and names alone, read twice below
    froms = cut(_named(imports.select("id", F.explode(F.split("metadata", ",")).alias("symbol_name"))))
    tos = cut(_named(defs.select("id", "symbol_name")))
    one, several = tos.filter(F.size("_all") == 1), tos.filter(F.size("_all") > 1)
    sizes = froms.groupBy("symbol_name").agg(F.count("*").alias("a")).join(one.groupBy("symbol_name").agg(F.count("*").alias("b")), "symbol_name")
    # one number
    pairs = sizes.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).head()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-pairs // EDGES_A_TASK)))
    met = _listed(froms, "_src").join(_listed(one, "_dst"), "symbol_name").select("_src", "_dst").repartition(tasks)
    edges = met.select(F.explode("_src").alias("_s"), "_dst").select(F.col("_s.id").alias("src"), F.explode("_dst").alias("_d")).select("src", F.col("_d.id").alias("dst"))
    of_several = froms.select(F.col("id").alias("src"), "symbol_name", F.col("_all").alias("_a")).join(several.select(F.col("id").alias("dst"), "symbol_name", F.col("_all").alias("_b")), "symbol_name")
    of_several = of_several.filter(F.col("symbol_name") == F.array_min(F.array_intersect("_a", "_b"))).select("src", "dst")
    return edges.union(of_several).select("src", "dst", F.lit("imports").alias("type"))


def embedding_todo(rows: DataFrame, have: DataFrame, key: str = "blob_sha") -> DataFrame:
    """One row per content that has no vector yet."""
    return rows.dropDuplicates([key]).join(have.select(key), key, "left_anti")


def embed(rows: DataFrame, provider, dim: int, text_col: str = "text", key: str = "blob_sha", batch: int = 100) -> DataFrame:
    """(key, embedding) by ``provider`` (list of texts to list of vectors), in batches; a vector of another size is an error."""
    kind = rows.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                out = provider(part.column(text_col).to_pylist())
                if any(len(v) != dim for v in out):
                    raise ValueError(f"expected vectors of {dim}")
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text_col).mapInArrow(kernel, f"`{key}` {kind}, embedding array<float>")


def hash_provider(dim: int):
    """Vectors of unit length from word hashes: needs no network, for tests and as a baseline."""

    def provide(texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for t in texts:
            v = [0.0] * dim
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % dim] += 1.0 if h & (1 << 31) else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return provide


# fixed values: files at the root of a tree that list more paths to leave out
IGNORE_FILES = (".gitignore", ".loomeryignore")


def source_rows(files: DataFrame, ignore: DataFrame | None = None, languages: list[str] = ()) -> DataFrame:
    """(path, language, text, hash) of ``files`` (path, text) in known languages that aren't ignored.

    Rules are the default ones, then ``ignore`` (folder, n, pattern), by default those of the ignore files among the rows.
    """
    rules = ignores.rules_in(files, IGNORE_FILES) if ignore is None else ignore
    every = ignores.defaults(files, T.DEFAULT_IGNORES).unionByName(rules.select("folder", F.col("n").cast("long").alias("n"), "pattern"))
    named = files.select("path", "text", T.language(F.col("path")).alias("language")).filter("language IS NOT NULL")
    kept = named.join(ignores.ignored(named.select("path"), every), "path", "left_anti")
    rows = kept.select("path", "language", "text", F.sha2("text", 256).alias("hash"))
    return rows.filter(F.col("language").isin(*languages)) if languages else rows


def ignore_lines(folders: DataFrame, root: str) -> DataFrame:
    """(folder, n, pattern) of the ignore files in the given ``folder``s below ``root``; tasks open them, as Spark's readers pass over names that begin with a dot."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root.rstrip("/")))
        for b in batches:
            rows = []
            for folder in b.column("folder").to_pylist():
                for rank, name in enumerate(IGNORE_FILES):
                    path = "/".join(x for x in (top, folder, name) if x)
                    if files.get_file_info(path).is_file:
                        with files.open_input_stream(path) as f:
                            rows += [(folder, (rank << 32) + k, line) for k, line in enumerate(f.read().decode("utf-8", "replace").split("\n"))]
            yield pa.RecordBatch.from_pydict({"folder": [r[0] for r in rows], "n": [r[1] for r in rows], "pattern": [r[2] for r in rows]}, schema=pa.schema([("folder", pa.string()), ("n", pa.int64()), ("pattern", pa.string())]))

    return folders.select("folder").mapInArrow(kernel, "folder string, n long, pattern string")


def scan(spark, root: str, ignore: list[str] | None = None, languages: list[str] = ()) -> DataFrame:
    """(path, relpath, language, text, hash) of a source tree's files in known languages, but for ignored ones.

    Rules are the default ones and those of the ignore files of all folders, or the lines of ``ignore`` alone.  Empty files
    have nothing to index and give no row.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", "^.*?" + re.escape(base) + "/+", "")
    # paths are judged before contents are read
    paths = raw.select(F.col("path").alias("_file"), rel.alias("path")).withColumn("language", T.language(F.col("path"))).filter("language IS NOT NULL")
    if ignore is None:
        parents = F.concat(F.array(F.lit("")), F.slice(ignores.levels(F.col("path")), 1, F.size(F.split("path", "/")) - 1))
        every = ignores.defaults(raw, T.DEFAULT_IGNORES).unionByName(ignore_lines(paths.select(F.explode(parents).alias("folder")).distinct(), root))
    else:
        every = ignores.defaults(raw, tuple(ignore))
    kept = paths.join(ignores.ignored(paths.select("path"), every), "path", "left_anti")
    if languages:
        kept = kept.filter(F.col("language").isin(*languages))
    named = raw.select("path", "content").join(kept.select(F.col("_file").alias("path"), F.col("path").alias("relpath"), "language"), "path")
    return named.select("path", "relpath", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"), "language")
