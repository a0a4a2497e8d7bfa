"""Queries: sources, chunkers, context bundles, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import context, crdt, ingest, markdown, runs
from loomery.sources import git, sinks
from loomery.sources.durable import cut, shared_folder
from loomery.sources.tables import read, twin
from loomery.streaming import state

from .catalog import query
from .propertygraph import _HAM


_NAMED = ("a.ts", "b.tsx", "c.js", "d.jsx", "e.rs", "f.py", "g.go", "h.rb", "i.rake", "j.c", "k.cs", "l.java", "m.cpp", "n.cxx", "o.cc", "p.c++", "q.hpp", "r.hxx", "s.h", "t.md", "u.mdx", "v.json", "w.yaml", "x.yml", "y.toml", "go.mod", "Gemfile", "Rakefile", "z.mjs", "z.html", "noext")


@query("A02_language_detection", """SELECT doc_id, ['ts', 'tsx', 'js', 'jsx', 'rs', 'py', 'go', 'rb', 'rb', 'c', 'cs', 'java', 'cpp', 'cpp', 'cpp', 'cpp', 'cpp', 'cpp', 'cpp', 'md', 'mdx', 'json', 'yaml', 'yaml', 'toml', 'gomod', 'rb', 'rb', NULL, NULL, NULL][doc_id % 31 + 1] AS language FROM documents""")
def _(spark, d):
    path = F.concat(F.lit("dir/"), F.element_at(F.array(*map(F.lit, _NAMED)), (F.col("doc_id") % len(_NAMED) + 1).cast("int")))
    return read(spark, d, "documents").select("doc_id", T.language(path).alias("language"))


@query("A03_default_ignores", "SELECT doc_id, [true, true, true, true, true, true, true, false, false][doc_id % 9 + 1] AS ignored FROM documents")
def _(spark, d):
    names = ("a/b.log", ".git/config", "node_modules/x.js", "a/dist/y.js", "target/z", "a/.DS_Store", "Thumbs.db", "src/a.rs", "distant/b.rs")
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 9 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", T.ignored(path, list(T.DEFAULT_IGNORES)).alias("ignored"))


@query("A03_A211_ignore_matcher", twin("SELECT id, (relpath LIKE 'tests/%' OR relpath LIKE '%/tests/%' OR regexp_matches(relpath, '(^|/)[^/]*_test\\.rs(/|$)')) AS ignored FROM chunks", "chunks"))
def _(spark, d):
    return read(spark, d, "chunks").select("id", T.ignored(F.col("relpath"), ["# comment", "", "tests/", "*_test.rs"]).alias("ignored"))


def marked(spark, d):
    """Documents as Markdown: every third line a heading."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), F.left(x, F.lit(20)), F.lit("x"))).otherwise(x))
    return read(spark, d, "documents").select("doc_id", F.array_join(rows, "\n").alias("text"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT doc_id, CAST(max(n) AS INTEGER) AS most FROM l GROUP BY doc_id), h AS (SELECT doc_id, n, CAST((n - 1) % 4 + 1 AS INTEGER) AS level, trim(left(line, 20)) || CASE WHEN left(line, 20) LIKE '% ' THEN right(left(line, 20), length(left(line, 20)) - length(rtrim(left(line, 20)))) ELSE '' END || 'x' AS title FROM l WHERE (n - 1) % 3 = 0)"


@query("A05_markdown_sections", f"""WITH {_LINES} SELECT h.doc_id, h.level, h.title, CAST(h.n AS INTEGER) AS start, CAST(coalesce((SELECT min(g.n) FROM h g WHERE g.doc_id = h.doc_id AND g.n > h.n AND g.level <= h.level) - 1, m.most) AS INTEGER) AS "end",
coalesce((SELECT string_agg(g.title, ' > ' ORDER BY g.n) FROM h g WHERE g.doc_id = h.doc_id AND g.n < h.n AND g.level < h.level AND NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = h.doc_id AND x.n > g.n AND x.n < h.n AND x.level <= g.level)) || ' > ', '') || h.title AS path FROM h JOIN m USING (doc_id)""")
def _(spark, d):
    return markdown.sections(marked(spark, d), "doc_id")


@query("A05_markdown_code_blocks", "SELECT doc_id, 'py' AS language, 2::INTEGER AS start, CAST(len(string_split(text, chr(10))) + 3 AS INTEGER) AS \"end\" FROM documents")
def _(spark, d):
    fenced = read(spark, d, "documents").select("doc_id", F.concat(F.lit("a\n```py\n"), "text", F.lit("\n```\nb")).alias("text"))
    return markdown.fences(fenced, "doc_id").drop("lines_of_code")


@query("A06_markdown_links", r"SELECT doc_id, 2::INTEGER AS line, source AS title, concat('https://x/', CAST(doc_id AS VARCHAR)) AS target, 'external' AS class FROM documents")
def _(spark, d):
    linked = read(spark, d, "documents").select("doc_id", F.concat(F.lit("a\nsee ["), "source", F.lit("](https://x/"), F.col("doc_id").cast("string"), F.lit(")")).alias("text"))
    return markdown.links(linked, "doc_id").select("doc_id", "line", "title", "target", "class")


def _woven(spark, d):
    """Markdown with fences within fences, a table, lists and links; how many rows and items it has follows from the id."""
    doc = F.col("doc_id").cast("string")
    head = F.concat(F.lit("# T"), doc, F.lit("\n\n~~~~py {1}\n```\n# no\n~~~\n~~~~\n## A\nsee [x"), doc, F.lit("](https://h/"), doc, F.lit(") and ![](/a.png) [e]() [r](b.md)\n\n| a | b \\| c |\n|---|:-:|\n"))
    rows, items = F.repeat(F.lit("| 1 | 2 |\n"), (F.col("doc_id") % 5 + 1).cast("int")), F.repeat(F.lit("- more\n"), (F.col("doc_id") % 3).cast("int"))
    tail = F.lit("1. first\n2. second\n\np | q\n### B\n```\n| x | y |\n|---|---|\n[dead](l)")
    return read(spark, d, "documents").select("doc_id", F.concat(head, rows, F.lit("\n- one\n  - in\n\n  still\n"), items, tail).alias("text"))


_SIZES = "m AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS r, CAST(doc_id % 3 AS INTEGER) AS i, 'T' || doc_id AS t FROM documents)"


@query("A05_markdown_nested_sections", f"""WITH {_SIZES} SELECT doc_id, 1 AS level, t AS title, 1 AS start, 26 + r + i AS "end", t AS path FROM m UNION ALL SELECT doc_id, 2, 'A', 8, 26 + r + i, t || ' > A' FROM m UNION ALL SELECT doc_id, 3, 'B', 22 + r + i, 26 + r + i, t || ' > A > B' FROM m""")
def _(spark, d):
    return markdown.sections(_woven(spark, d), "doc_id")


@query("A05_markdown_nested_code", f"""WITH {_SIZES} SELECT doc_id, 'py' AS language, 3 AS start, 7 AS "end", 3 AS lines_of_code, t AS path FROM m UNION ALL SELECT doc_id, '', 23 + r + i, 26 + r + i, 3, t || ' > A > B' FROM m""")
def _(spark, d):
    return markdown.code_blocks(_woven(spark, d), "doc_id")


@query("A05_markdown_tables", f"""WITH {_SIZES} SELECT doc_id, 11 AS start, 12 + r AS "end", r + 1 AS rows, 2 AS columns FROM m""")
def _(spark, d):
    return markdown.tables(_woven(spark, d), "doc_id")


@query("A05_markdown_lists", f"""WITH {_SIZES} SELECT doc_id, 14 + r AS start, 17 + r + i AS "end", 'unordered' AS type, CAST(1 + i AS BIGINT) AS items FROM m UNION ALL SELECT doc_id, 18 + r + i, 19 + r + i, 'ordered', 2 FROM m""")
def _(spark, d):
    return markdown.lists(_woven(spark, d), "doc_id")


@query("A06_links_in_sections", f"""WITH {_SIZES} SELECT doc_id, 9 AS line, 'x' || doc_id AS title, 'https://h/' || doc_id AS target, 'external' AS class, false AS image, t || ' > A' AS path FROM m
UNION ALL SELECT doc_id, 9, '', '/a.png', 'absolute', true, t || ' > A' FROM m UNION ALL SELECT doc_id, 9, 'r', 'b.md', 'relative', false, t || ' > A' FROM m UNION ALL SELECT doc_id, 26 + r + i, 'dead', 'l', 'relative', false, t || ' > A > B' FROM m""")
def _(spark, d):
    return markdown.links(_woven(spark, d), "doc_id")


@query("A07_yaml_keys", "SELECT doc_id, 'yaml_key' AS kind, 'lang' AS key, 1 AS start, 1 AS \"end\" FROM documents UNION ALL SELECT doc_id, 'yaml_key', 'body', 2, 3 FROM documents")
def _(spark, d):
    y = read(spark, d, "documents").select("doc_id", F.concat(F.lit("lang: "), "lang", F.lit("\nbody:\n  source: "), "source").alias("text"))
    return ingest.keys(y, "doc_id", ingest.YAML_KEY, "yaml_key")


_DATA = {
    0: ("json", '{\n  "name": "n@ { } \\" ,",\n  "scripts": {\n    "a": [1, {"b": 2}]\n  },\n  "x": [\n    1\n  ]\n}'),
    1: ("json", '{\n  "a": 1,\n  "b": {\n  }\n}'),
    2: ("toml", 'top = 1\n[package]\nname = "@"\n# [no]\n[[bin]]\npath = "x"'),
    3: ("toml", 'a = 1\n# b = 2\nc.d = "@"'),
    4: ("yaml", '# top: no\nlang: @\nbody:\n  - x: 1\n\n"q r": 2'),
    5: ("json", '{ "a": @'),
}


@query("A07_data_formats", """SELECT doc_id, kind, key, start, "end" FROM documents JOIN (VALUES (0, 'json_key', 'name', 2, 2), (0, 'json_key', 'scripts', 3, 5), (0, 'json_key', 'x', 6, 8), (1, 'module', NULL, 1, 5), (2, 'toml_section', 'package', 2, 4), (2, 'toml_section', 'bin', 5, 6),
    (3, 'toml_key', 'a', 1, 1), (3, 'toml_key', 'c.d', 3, 3), (4, 'yaml_key', 'lang', 2, 2), (4, 'yaml_key', 'body', 3, 5), (4, 'yaml_key', '"q r"', 6, 6), (5, 'module', NULL, 1, 1)) t(form, kind, key, start, "end") ON doc_id % 6 = form""")
def _(spark, d):
    form = (F.col("doc_id") % 6).cast("int")
    text, language = F.lit(None), F.lit(None)
    for k, (lang, t) in _DATA.items():
        text, language = F.when(form == k, t).otherwise(text), F.when(form == k, lang).otherwise(language)
    files = read(spark, d, "documents").select("doc_id", language.alias("language"), F.replace(text, F.lit("@"), F.col("doc_id").cast("string")).alias("text"))
    return ingest.data_keys(files, "doc_id")


@query("A04_A08_code_chunks", """SELECT doc_id, kind, replace(symbol_name, '?', CAST(doc_id AS VARCHAR)) AS symbol_name, start_line, end_line, replace(signature, '?', CAST(doc_id AS VARCHAR)) AS signature, docstring, metadata FROM documents CROSS JOIN
    (VALUES ('imports', NULL, 1, 1, 'import os', NULL, 'os'), ('class', 'C?', 3, 7, 'class C?', 'Doc.', NULL), ('method', 'run', 6, 7, 'def run(self, x)', NULL, NULL), ('async_func', 'go', 10, 11, 'async def go()', NULL, NULL))
    t(kind, symbol_name, start_line, end_line, signature, docstring, metadata)""")
def _(spark, d):
    code = F.concat(F.lit("import os\n\nclass C"), F.col("doc_id").cast("string"), F.lit(":\n    \"\"\"Doc.\"\"\"\n\n    def run(self, x):\n        return x\n\n\nasync def go():\n    pass\n"))
    return ingest.chunks(read(spark, d, "documents").select("doc_id", code.alias("text"), F.lit("py").alias("language")), "doc_id")


_SOURCES = {
    "rs": "pub struct S?;\n\nimpl S? {\n    pub fn run?(&self) -> u8 {\n        if true { 1 } else { 2 }\n    }\n}\n\npub async fn go() {\n}\nmod m;",
    "go": "package p\n\nfunc Run?(a int) int {\n\treturn a\n}\n\nfunc (s *S) Get() {\n}\n\ntype T? struct {\n\tx int\n}",
    "rb": "module M?\n  class C\n    def run?\n      1\n    end\n  end\nend",
    "ts": "export interface I? {\n  a: string\n}\nexport async function go?() {\n  return '}'\n}\nexport class K {\n}\nexport const z = (a) => {\n  return a\n}",
    "java": "public class J? {\n    public static int run(int a) {\n        return a;\n    }\n}",
    "c": "#define N? 1\nstruct S? {\n  int x;\n};\nstatic int run(int a) {\n  return a;\n}",
    "gomod": "module example.org/m?\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)",
}


@query("A08_pattern_chunkers", """SELECT doc_id, language, kind, replace(name, '?', CAST(doc_id AS VARCHAR)) AS symbol_name, start_line, end_line FROM (SELECT doc_id, ['rs', 'go', 'rb', 'ts', 'java', 'c', 'gomod'][doc_id % 7 + 1] AS language FROM documents) JOIN
(VALUES ('rs', 'class', 'S?', 1, 1), ('rs', 'func', 'run?', 4, 6), ('rs', 'func', 'go', 9, 10), ('rs', 'module', 'm', 11, 11),
('go', 'func', 'Run?', 3, 5), ('go', 'method', 'Get', 7, 8), ('go', 'type', 'T?', 10, 12), ('rb', 'module', 'M?', 1, 7), ('rb', 'class', 'C', 2, 6), ('rb', 'method', 'run?', 3, 5),
('ts', 'type', 'I?', 1, 3), ('ts', 'func', 'go?', 4, 6), ('ts', 'class', 'K', 7, 8), ('ts', 'func', 'z', 9, 11), ('java', 'class', 'J?', 1, 5), ('java', 'method', 'run', 2, 4),
('c', 'constant', 'N?', 1, 1), ('c', 'class', 'S?', 2, 4), ('c', 'func', 'run', 5, 7), ('gomod', 'module', 'example.org/m?', 1, 1), ('gomod', 'imports', 'github.com/a/b', 4, 4)) t(language, kind, name, start_line, end_line) USING (language)""")
def _(spark, d):
    pick = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("doc_id") % len(_SOURCES) + 1).cast("int"))
    code = F.element_at(F.create_map(*(F.lit(x) for kv in _SOURCES.items() for x in kv)), F.col("language"))
    files = read(spark, d, "documents").select("doc_id", pick.alias("language")).withColumn("text", F.replace(code, F.lit("?"), F.col("doc_id").cast("string")))
    return ingest.chunks(files, "doc_id").join(files.select("doc_id", "language"), "doc_id").select("doc_id", "language", "kind", "symbol_name", "start_line", "end_line")


@query("A09_docstrings", "SELECT doc_id, concat('Does ', source, '.', chr(10), 'Args: x: a number', chr(10), 'Returns: another') AS doc FROM documents")
def _(spark, d):
    doc = F.concat(F.lit("Does "), "source", F.lit(".\n\nArgs:\n    x: a number\nReturns:\n    another\n"))
    return read(spark, d, "documents").select("doc_id", ingest.docstring_text(doc).alias("doc"))


@query("A10_preview_document", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 40), chr(10)) AS preview, source || ' ' || chr(10) || ' ' || lang AS ts_doc FROM documents")
def _(spark, d):
    none = F.lit(None).cast("string")
    return read(spark, d, "documents").select("doc_id", T.first_lines(F.col("text")).alias("preview"), T.search_document(F.col("source"), F.col("lang"), none, none, none).alias("ts_doc"))


@query("A11_blob_sha", "SELECT doc_id, sha256('blob ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS blob_sha FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.blob_sha(F.col("text")).alias("blob_sha"))


@query("A12_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("A13_diff_tree", "SELECT CASE o_orderstatus WHEN 'O' THEN 'M' WHEN 'F' THEN 'A' ELSE 'D' END AS status, concat('f/', CAST(o_orderkey AS VARCHAR)) AS path FROM orders")
def _(spark, d):
    letter = F.when(F.col("o_orderstatus") == "O", "M").when(F.col("o_orderstatus") == "F", "A").otherwise("D")
    return git.diff_tree(read(spark, d, "orders").select(F.concat(F.lit(":100644 100644 abc1 def2 "), letter, F.lit("\tf/"), F.col("o_orderkey").cast("string")).alias("value")))


@query("A14_git_status", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('new/', CAST(o_orderkey AS VARCHAR)) ELSE concat('f/', CAST(o_orderkey AS VARCHAR)) END AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'renamed' WHEN o_orderkey % 3 = 1 THEN 'modified' ELSE 'untracked' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN concat('f/', CAST(o_orderkey AS VARCHAR)) END AS renamed_from FROM orders")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 3
    line = F.when(m == 0, F.concat(F.lit("R  f/"), k, F.lit(" -> new/"), k)).when(m == 1, F.concat(F.lit(" M f/"), k)).otherwise(F.concat(F.lit("?? f/"), k))
    return git.status(read(spark, d, "orders").select(line.alias("value")))


_CALLS = "x AS (SELECT id AS call_id, file_id, start_line + 5 AS line, CASE WHEN id % 2 = 0 THEN symbol_name ELSE 'the' END AS callee FROM chunks), e AS (SELECT call_id, min(c.id) AS src FROM x JOIN chunks c ON c.file_id = x.file_id AND x.line BETWEEN c.start_line AND c.end_line GROUP BY call_id), t AS (SELECT file_id, symbol_name AS callee, max(id) AS dst FROM chunks WHERE symbol_name IS NOT NULL GROUP BY ALL)"


@query("A15_call_edges", twin(f"WITH {_CALLS} SELECT DISTINCT e.src, t.dst, 'calls' AS type FROM x JOIN e ON e.call_id = x.call_id JOIN t ON t.file_id = x.file_id AND t.callee = x.callee", "chunks"))
def _(spark, d):
    c = read(spark, d, "chunks")
    calls = c.select(F.col("id").alias("call_id"), "file_id", (F.col("start_line") + 5).alias("line"), F.when(F.col("id") % 2 == 0, F.col("symbol_name")).otherwise("the").alias("callee"))
    return ingest.call_edges(calls, c)


@query("A16_import_edges", twin("SELECT DISTINCT i.id AS src, c.id AS dst, 'imports' AS type FROM (SELECT id, unnest([replace(symbol_name, ',', ''), language]) AS s FROM chunks WHERE symbol_name IS NOT NULL) i JOIN chunks c ON c.symbol_name = i.s", "chunks"))
def _(spark, d):
    # texts are cut into names once
    c = cut(read(spark, d, "chunks").select("id", "symbol_name", "language"))
    return ingest.import_edges(c.filter("symbol_name IS NOT NULL").select("id", F.concat_ws(",", F.replace("symbol_name", F.lit(","), F.lit("")), "language").alias("metadata")), c)


@query("A18_json_sink", "SELECT CAST(to_json(n) AS VARCHAR) AS value FROM nation n")
def _(spark, d):
    return sinks.as_json(read(spark, d, "nation"))


@query("A18_agent_lines", twin("SELECT concat(relpath, ':', CAST(start_line AS VARCHAR), '-', CAST(end_line AS VARCHAR), ' ', kind, CASE WHEN symbol_name IS NULL THEN '' ELSE ' ' || symbol_name END, ' ', format('({:.3f})', recency_score)) AS value FROM chunks", "chunks"))
def _(spark, d):
    return sinks.agent_lines(read(spark, d, "chunks").withColumn("score", F.col("recency_score")))


@query("A21_A22_embedding_pipeline")
def _(spark, d):
    docs = read(spark, d, "documents").withColumn("blob_sha", F.sha2("text", 256))
    have = docs.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("blob_sha").distinct()
    return ingest.embed(ingest.embedding_todo(docs, have), ingest.hash_provider(64), 64)


@query("A204_A205_cache_split", "WITH h AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) SELECT count(*) FILTER (WHERE text IN (SELECT text FROM h)) AS hits, count(*) FILTER (WHERE text NOT IN (SELECT text FROM h)) AS misses FROM documents")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    have = docs.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("h").distinct().withColumn("hit", F.lit(True))
    return docs.join(have, "h", "left").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("A200_line_slice", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@query("A203_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 100).alias("preview"))


@query("A108_token_estimate", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("A104_budget_split", "SELECT o_orderkey, CAST(floor(b * 40 / 100) AS BIGINT) AS \"primary\", CAST(floor(b * 20 / 100) AS BIGINT) AS tests, CAST(floor(b * 15 / 100) AS BIGINT) AS callers, CAST(floor(b * 15 / 100) AS BIGINT) AS callees, CAST(floor(b * 10 / 100) AS BIGINT) AS other FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders) x")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", *context.split_budget(F.floor("o_totalprice")))


_CATEGORY = "CASE l_linenumber % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'tests' WHEN 2 THEN 'callers' WHEN 3 THEN 'callees' ELSE 'other' END"
_ITEMS = f"i AS (SELECT l_orderkey AS bundle, l_partkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS tokens, {_CATEGORY} AS category, l_extendedprice AS base, l_linenumber AS seq FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY base * CASE category WHEN 'primary' THEN 1.0::DOUBLE WHEN 'tests' THEN 0.8::DOUBLE WHEN 'callers' THEN 0.6::DOUBLE WHEN 'callees' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END DESC, seq, id) AS place FROM i)"


def _items(spark, d):
    li = read(spark, d, "lineitem")
    k = F.col("l_linenumber") % 5
    category = F.when(k == 0, "primary").when(k == 1, "tests").when(k == 2, "callers").when(k == 3, "callees").otherwise("other")
    return li.select(F.col("l_orderkey").alias("bundle"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("long").alias("tokens"), category.alias("category"), F.col("l_extendedprice").alias("base"), F.col("l_linenumber").cast("long").alias("seq"))


# texts by address in batches of 40; the first run may cost what 30,000 tokens do, the second what 90,000 do, the third anything
_RUNS = """t AS (SELECT DISTINCT sha256(text) AS blob, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents),
r1 AS (SELECT blob, tokens, (row_number() OVER (ORDER BY blob) - 1) // 40 AS batch, sum(tokens) OVER (ORDER BY blob) AS upto FROM t), e1 AS (SELECT batch, max(upto) AS upto FROM r1 GROUP BY batch), d1 AS (SELECT coalesce(max(batch) FILTER (upto <= 30000), -1) AS last FROM e1),
r2 AS (SELECT blob, tokens, (row_number() OVER (ORDER BY blob) - 1) // 40 AS batch, sum(tokens) OVER (ORDER BY blob) AS upto FROM r1, d1 WHERE batch > last), e2 AS (SELECT batch, max(upto) AS upto FROM r2 GROUP BY batch), d2 AS (SELECT coalesce(max(batch) FILTER (upto <= 90000), -1) AS last FROM e2),
r3 AS (SELECT blob, tokens, (row_number() OVER (ORDER BY blob) - 1) // 40 AS batch FROM r2, d2 WHERE batch > last)"""


def _runs(spark, d):
    store = runs.EmbeddingRuns(spark, f"{shared_folder(spark)}/runs", 16, batch=40)
    texts = read(spark, d, "documents").select("text")
    for tokens in (30_000, 90_000, None):
        store.run(texts, ingest.hash_provider(16), None if tokens is None else (tokens + 0.5) * store.price / 1000)
    return store


@query("A22_embedding_runs", f"""WITH {_RUNS}, a AS (SELECT CAST(0 AS BIGINT) AS run, (SELECT count(*) FROM r1) AS total, count(*) FILTER (batch <= last) AS completed, last + 1 AS batches, coalesce(sum(tokens) FILTER (batch <= last), 0) AS tokens FROM r1, d1 GROUP BY last
UNION ALL SELECT 1, (SELECT count(*) FROM r2), count(*) FILTER (batch <= last), last + 1, coalesce(sum(tokens) FILTER (batch <= last), 0) FROM r2, d2 GROUP BY last UNION ALL SELECT 2, count(*), count(*), max(batch) + 1, sum(tokens) FROM r3 HAVING count(*) > 0)
SELECT run, CASE WHEN completed < total THEN 'stopped' ELSE 'completed' END AS status, total, completed, CAST(batches AS BIGINT) AS batches, CAST(tokens AS BIGINT) AS tokens, round(tokens * 0.00013::DOUBLE / 1000, 9) AS cost FROM a""")
def _(spark, d):
    return _runs(spark, d).ledger().select("run", "status", "total", "completed", "batches", "tokens", F.round("cost", 9).alias("cost"))


@query("A22_embedded_once", "SELECT sha256(text) AS blob, CAST(1 AS BIGINT) AS n, CAST(16 AS INTEGER) AS dim FROM documents GROUP BY text")
def _(spark, d):
    # after a stop and two more runs each text has one vector
    return _runs(spark, d).vectors().groupBy("blob").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))


@query("A103_priority_order", f"WITH {_ITEMS} SELECT bundle, id, place FROM p")
def _(spark, d):
    return context.prioritised(_items(spark, d).withColumn("seq", F.struct("seq", "id"))).select("bundle", "id", "place")


@query("A105_A106_bundle_packing")
def _(spark, d):
    rows = context.prioritised(_items(spark, d).withColumn("seq", F.struct("seq", "id")))
    return context.pack(rows, 80)


_KEPT = ("primary", "tests", "callers", "callees")
_ACTIONS = f"""v AS (SELECT l_orderkey AS bundle, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS seq, CASE WHEN l_linenumber % 4 = 0 THEN 'release' ELSE 'reserve' END AS action, ['primary', 'tests', 'callers', 'callees'][l_partkey % 4 + 1] AS category, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)"""


@query("A105_reservations", f"""WITH RECURSIVE {_ACTIONS}, r AS (SELECT DISTINCT bundle, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS category, CAST(0 AS BIGINT) AS tokens, true AS accepted, CAST(0 AS BIGINT) AS used, {', '.join(f'CAST(0 AS BIGINT) AS h_{k}' for k in _KEPT)} FROM v
UNION ALL SELECT bundle, seq, action, category, tokens, ok, CASE WHEN ok THEN total ELSE used END, {', '.join(f"CASE WHEN ok AND category = '{k}' THEN wanted ELSE h_{k} END" for k in _KEPT)}
    FROM (SELECT *, used - had + wanted AS total, used - had + wanted <= 80 AS ok FROM (SELECT v.*, r.used, {', '.join(f'r.h_{k}' for k in _KEPT)}, CASE v.category {' '.join(f"WHEN '{k}' THEN r.h_{k}" for k in _KEPT)} END AS had, CASE WHEN v.action = 'reserve' THEN v.tokens ELSE 0 END AS wanted FROM r JOIN v ON v.bundle = r.bundle AND v.seq = r.seq + 1) x) y)
SELECT bundle, seq, action, category, tokens, accepted, used FROM r WHERE seq > 0""")
def _(spark, d):
    li = read(spark, d, "lineitem")
    category = F.element_at(F.array(*map(F.lit, _KEPT)), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = li.select(F.col("l_orderkey").alias("bundle"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")).cast("long").alias("seq"), F.when(F.col("l_linenumber") % 4 == 0, "release").otherwise("reserve").alias("action"), category.alias("category"), F.col("l_quantity").cast("long").alias("tokens"))
    return context.reservations(rows, 80)


@query("A106_one_per_role", f"WITH {_ITEMS} SELECT bundle, category, id FROM (SELECT *, row_number() OVER (PARTITION BY bundle, category ORDER BY base DESC, id) AS rn FROM i) x WHERE rn = 1")
def _(spark, d):
    return context.one_per_role(_items(spark, d)).select("bundle", "category", "id")


# lines of a text with the estimate of all bytes up to each; those that fit beside the marker of 23 bytes
_UPTO = "l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents), u AS (SELECT doc_id, text, l, list_transform(range(1, len(l) + 1), lambda k: ceil((list_sum(list_transform(l[1:k], lambda x: strlen(x) + 1)) - 1) / 4.0)) AS c FROM l)"


@query("A107_truncate_head", f"WITH {_UPTO} SELECT doc_id, CASE WHEN ceil(strlen(text) / 4.0) <= 100 THEN text ELSE array_to_string(l[1:len(list_filter(c, lambda x: x <= 94))], chr(10)) || chr(10) || '// ... [truncated] ...' END AS text FROM u")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", context.truncate_head(F.col("text"), 100).alias("text"))


@query("A107_preserve_signature", f"WITH coded AS (SELECT doc_id, '// about' || chr(10) || 'fn f' || doc_id || '() {{' || chr(10) || '  // says' || chr(10) || chr(10) || text AS text FROM documents), {_UPTO.replace('FROM documents', 'FROM coded')} SELECT doc_id, CASE WHEN ceil(strlen(text) / 4.0) <= 100 THEN text ELSE array_to_string(l[1:greatest(len(list_filter(range(1, len(c) + 1), lambda k: c[k] <= 93 AND (k = 1 OR c[k - 1] < 93))), 4)], chr(10)) || CASE WHEN greatest(len(list_filter(range(1, len(c) + 1), lambda k: c[k] <= 93 AND (k = 1 OR c[k - 1] < 93))), 4) < len(l) THEN chr(10) || '    // ... [truncated] ...' || chr(10) ELSE '' END END AS text FROM u")
def _(spark, d):
    code = F.concat(F.lit("// about\nfn f"), F.col("doc_id").cast("string"), F.lit("() {\n  // says\n\n"), "text")
    return read(spark, d, "documents").select("doc_id", context.truncate_signature(code, 100).alias("text"))


@query("A106_bundle_by_role", f"""WITH {_ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY bundle, category ORDER BY base DESC, id) AS rn FROM i),
w AS (SELECT bundle, max(id) FILTER (category = 'primary') AS p, coalesce(max(tokens) FILTER (category = 'primary'), 0) AS u0, max(id) FILTER (category = 'tests') AS t, max(tokens) FILTER (category = 'tests') AS tt,
max(id) FILTER (category = 'callers') AS c, max(tokens) FILTER (category = 'callers') AS ct, max(id) FILTER (category = 'callees') AS e, max(tokens) FILTER (category = 'callees') AS et FROM b WHERE rn = 1 GROUP BY bundle),
x AS (SELECT *, coalesce(u0 < 60 AND 60 - u0 >= 1 AND u0 + tt <= 60, false) AS ft FROM w), y AS (SELECT *, u0 + CASE WHEN ft THEN tt ELSE 0 END AS u1 FROM x),
z AS (SELECT *, coalesce(u1 < 60 AND u1 + ct <= 60, false) AS fc FROM y), q AS (SELECT *, u1 + CASE WHEN fc THEN ct ELSE 0 END AS u2 FROM z), v AS (SELECT *, coalesce(u2 < 60 AND u2 + et <= 60, false) AS fe FROM q)
SELECT bundle, p AS "primary", CASE WHEN ft THEN t END AS tests, CASE WHEN fc THEN c END AS callers, CASE WHEN fe THEN e END AS callees, u2 + CASE WHEN fe THEN et ELSE 0 END AS used FROM v""")
def _(spark, d):
    return context.bundle(_items(spark, d), 60)


@query("A107_truncate_ends", "SELECT doc_id, CASE WHEN len(l) <= 3 THEN text ELSE array_to_string(list_concat(list_concat(list_slice(l, 1, 2), ['... [truncated]']), list_slice(l, len(l), len(l))), chr(10)) END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) x")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", context.truncate_head_and_tail(F.col("text"), 2, 1).alias("text"))


@query("A201_reasons", f"WITH {_ITEMS} SELECT category, concat(CASE category WHEN 'primary' THEN 'Primary chunk ' WHEN 'tests' THEN 'Tests ' WHEN 'callers' THEN 'Calls ' WHEN 'callees' THEN 'Called by ' ELSE 'Related to ' END, 'f') AS reason, count(*) AS n FROM i GROUP BY ALL")
def _(spark, d):
    return _items(spark, d).groupBy("category", context.reason(F.col("category"), F.lit("f")).alias("reason")).agg(F.count("*").alias("n"))


_TOKENS = ("authenticate", "func", "config", "tests", "errors", "db", "query", "login", "asynchronous")


@query("A145_synonym_expansion", """SELECT doc_id, ['authentication,authorize,login', '', 'config,configuration,settings', 'spec,unittest', 'err,exception', '', 'find,search', 'auth,signin', 'asynchronous,await'][doc_id % 9 + 1] AS terms FROM documents""")
def _(spark, d):
    token = F.element_at(F.array(*map(F.lit, _TOKENS)), (F.col("doc_id") % len(_TOKENS) + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.expand(F.array(token)), ",").alias("terms"))


@query("B70_ham_stream", twin("""SELECT soul, key, state FROM (SELECT *, row_number() OVER (PARTITION BY soul, key ORDER BY state DESC, event_id) AS rn FROM cells) x WHERE rn = 1""", "cells"))
def _(spark, d):
    where = shared_folder(spark)
    read(spark, d, "cells").drop("event_id", "msg_id").write.parquet(f"{where}/ops")
    stream = spark.readStream.schema(spark.read.parquet(f"{where}/ops").schema).parquet(f"{where}/ops")
    state.run_available(state.ham_stream(stream), "parquet", f"{where}/out", f"{where}/check")
    # what the stream gave out so far converges by the batch rule
    return crdt.ham(spark.read.parquet(f"{where}/out")).select("soul", "key", "state")


@query("C51_bucket_stream", "SELECT count(*) AS buckets, sum(n)::BIGINT AS n FROM (SELECT floor(epoch(ts) / 3600) AS b, count(*) AS n FROM events GROUP BY 1) x WHERE b < (SELECT floor(epoch(max(ts)) / 3600) FROM events)")
def _(spark, d):
    where = shared_folder(spark)
    stream = _events_stream(spark, d, where)
    state.run_available(state.bucket_stream(stream, "at", "1 hour", "0 seconds", F.count("*").alias("n")), "parquet", f"{where}/out", f"{where}/check")
    return spark.read.parquet(f"{where}/out").agg(F.count("*").alias("buckets"), F.sum("n").alias("n"))


def _events_stream(spark, d, where):
    read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).write.parquet(f"{where}/events")
    return spark.readStream.schema(spark.read.parquet(f"{where}/events").schema).parquet(f"{where}/events")


@query("B73_dedup_stream", "SELECT count(DISTINCT event_id % 500) AS n FROM events")
def _(spark, d):
    where = shared_folder(spark)
    stream = _events_stream(spark, d, where).withColumn("msg_id", F.col("event_id") % 500)
    state.run_available(state.dedup_stream(stream, "at", "3650 days"), "parquet", f"{where}/out", f"{where}/check")
    return spark.read.parquet(f"{where}/out").agg(F.count("*").alias("n"))


@query("B02_sorted_store", twin(f"WITH {_HAM} SELECT soul || chr(27) || key AS k, canon AS v, state FROM m WHERE soul LIKE '1%'", "cells"))
def _(spark, d):
    where = shared_folder(spark)
    k = crdt.storage_key(F.col("soul"), F.col("key"))
    sinks.write_sorted(crdt.ham(read(spark, d, "cells")).select(k.alias("k"), crdt.canonical().alias("v"), "state"), f"{where}/store", "k", 8)
    return spark.read.parquet(f"{where}/store").filter(crdt.prefix_range(F.col("k"), "1"))
