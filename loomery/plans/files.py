"""Queries: ignore rules of every folder, what goes with ignored files, source rows; key-ordered stores and polls as data sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as T
from loomery.operators import delta, ignores, ingest
from loomery.sources import store
from loomery.sources.durable import shared_folder
from loomery.sources.tables import DERIVED, read, twin
from loomery.streaming import state

from .catalog import query

#: Rule lines of the root and of folders below it: comments, anchored folders, globs at any depth, classes, rules that take back.
DERIVED["ignore_rules"] = """SELECT CASE WHEN n_nationkey % 8 = 3 THEN concat('src/src', CAST(n_nationkey AS STRING)) WHEN n_nationkey % 8 = 7 THEN concat('src/src', CAST(n_nationkey % 5 AS STRING)) ELSE '' END AS folder, n_nationkey AS n,
    CASE n_nationkey % 8 WHEN 0 THEN concat('# ', n_name) WHEN 1 THEN concat('/tests/src', CAST(n_nationkey % 6 AS STRING), '/') WHEN 2 THEN concat('f', CAST(n_nationkey % 10 AS STRING), '*.rs')
        WHEN 3 THEN '!f2?.rs' WHEN 4 THEN concat('f[', CAST(n_nationkey % 10 AS STRING), '-9]?_test.rs') WHEN 5 THEN concat('!/src/**/f', CAST(n_nationkey AS STRING), '.rs')
        WHEN 6 THEN concat('src', CAST(n_nationkey AS STRING), '/*') ELSE '*.rs' END AS pattern FROM {nation}"""

# the same lines as regular expressions, typed by hand
_VERDICT = r"""r AS (SELECT folder, n, pattern LIKE '!%' AS kept, n % 8 = 1 AS folders_only, CASE n % 8 WHEN 1 THEN '^tests/src' || (n % 6) || '$' WHEN 2 THEN '^(.*/)?f' || (n % 10) || '[^/]*\.rs$' WHEN 3 THEN '^(.*/)?f2[^/]\.rs$'
    WHEN 4 THEN '^(.*/)?f[' || (n % 10) || '-9][^/]_test\.rs$' WHEN 5 THEN '^src/(.*/)?f' || n || '\.rs$' WHEN 6 THEN '^src' || n || '/[^/]*$' WHEN 7 THEN '^(.*/)?[^/]*\.rs$' END AS regex FROM ignore_rules WHERE n % 8 <> 0),
p AS (SELECT DISTINCT relpath AS path, string_split(relpath, '/') AS parts FROM chunks),
l AS (SELECT path, array_to_string(parts[1:i], '/') AS entry, i < len(parts) AS is_folder FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM p) x),
m AS (SELECT entry, r.kept, len(r.folder) AS depth, n FROM (SELECT DISTINCT entry, is_folder FROM l) e JOIN r ON (r.folder = '' OR starts_with(entry, r.folder || '/')) AND (is_folder OR NOT folders_only)
    AND regexp_matches(CASE WHEN r.folder = '' THEN entry ELSE substr(entry, len(r.folder) + 2) END, r.regex)),
o AS (SELECT entry FROM m GROUP BY entry HAVING NOT arg_max(kept, depth * 1000 + n)),
ignored AS (SELECT DISTINCT path FROM l WHERE entry IN (SELECT entry FROM o))"""


def _ignored(spark, d):
    return ignores.ignored(read(spark, d, "chunks").select(F.col("relpath").alias("path")), read(spark, d, "ignore_rules"))


@query("A03_ignore_rules", twin(f"WITH {_VERDICT} SELECT path FROM ignored", "chunks", "ignore_rules"))
def _(spark, d):
    return _ignored(spark, d)


@query("A211_clean_ignored", twin(f"""WITH {_VERDICT}, g AS (SELECT id FROM chunks WHERE relpath IN (SELECT path FROM ignored))
SELECT (SELECT count(*) FROM chunks WHERE id NOT IN (SELECT id FROM g)) AS chunks, (SELECT count(*) FROM junction WHERE chunk_id NOT IN (SELECT id FROM g)) AS junction,
    (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)) AS edges, (SELECT count(*) FROM g) AS removed""", "chunks", "junction", "edges", "ignore_rules"))
def _(spark, d):
    chunks = read(spark, d, "chunks")
    left = delta.clean_ignored(chunks, read(spark, d, "junction"), read(spark, d, "edges"), _ignored(spark, d))
    counts = [left[k].agg(F.count("*").alias(k)) for k in ("chunks", "junction", "edges")]
    out = counts[0].join(counts[1]).join(counts[2]).join(chunks.agg(F.count("*").alias("_n")))
    return out.select("chunks", "junction", "edges", (F.col("_n") - F.col("chunks")).alias("removed"))


#: A tree of files: documents at the chunks' paths, and an ignore file in each folder that has rules.
DERIVED["tree_files"] = """SELECT concat(relpath, '/', CAST(id AS STRING), CASE id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '.go' END) AS path, preview AS text FROM {chunks}"""


@query("A01_source_rows", twin(f"""WITH {_VERDICT}, f AS (SELECT path, text, string_split(path, '/') AS parts FROM tree_files),
    a AS (SELECT path, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS entry FROM f)
SELECT path, CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'py' WHEN 'md' THEN 'md' ELSE 'go' END AS language, sha256(text) AS hash FROM f WHERE path NOT LIKE '%.txt'
    AND path NOT IN (SELECT path FROM a WHERE entry IN (SELECT path FROM ignored))""", "chunks", "tree_files", "ignore_rules"))
def _(spark, d):
    files = read(spark, d, "tree_files")
    rules = read(spark, d, "ignore_rules")
    # each folder's rules as the text of its ignore file
    w = F.array_sort(F.collect_list(F.struct("n", "pattern")))
    lines = rules.groupBy("folder").agg(F.array_join(F.transform(w, lambda x: x["pattern"]), "\n").alias("text"))
    own = lines.select(F.concat("folder", F.when(F.col("folder") == "", "").otherwise("/"), F.lit(".gitignore")).alias("path"), "text")
    return ingest.source_rows(files.unionByName(own)).select("path", "language", "hash")


# ---------------------------------------------------------------- data sources


@query("B01_sorted_source", twin(r"SELECT soul || chr(27) || key AS k, max(state) AS state FROM cells WHERE soul = '1' OR soul LIKE '1_' AND key >= 'view' GROUP BY 1", "cells"))
def _(spark, d):
    # a prefix scan and two ranges, each of which opens only the files that may hold its keys
    where = f"{shared_folder(spark)}/store"
    rows = read(spark, d, "cells").groupBy(F.concat("soul", F.lit("\x1b"), "key").alias("k")).agg(F.max("state").alias("state"))
    store.write(rows, where, "k", 500)
    table = store.scan(spark, where)
    one = table.filter(F.col("k").startswith("1\x1b"))
    more = table.filter((F.col("k") >= "10") & (F.col("k") < "2")).filter((F.instr("k", "\x1b") == 3) & (F.substring_index("k", "\x1b", -1) >= "view"))
    return one.unionByName(more)


@query("A190_polled_source", twin("""WITH p AS (SELECT 0 AS poll, path, hash FROM old_files UNION ALL SELECT 1, path, hash FROM new_files UNION ALL SELECT 2, path, hash FROM new_files WHERE strlen(path) % 2 = 0)
SELECT CAST(b.poll + 1 AS BIGINT) AS poll, b.path, CASE WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM p b LEFT JOIN p a ON a.path = b.path AND a.poll = b.poll + 1 WHERE b.poll < 2 AND (a.path IS NULL OR a.hash <> b.hash)
UNION ALL SELECT CAST(a.poll AS BIGINT), a.path, 'new' FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.path = a.path AND b.poll = a.poll - 1)""", "old_files", "new_files"))
def _(spark, d):
    where = shared_folder(spark)
    old, new = (read(spark, d, t).select("path", "hash") for t in ("old_files", "new_files"))
    polls = (old, new, new.filter(F.length("path") % 2 == 0))
    # the stream stops after two polls and goes on from its offset
    for upto in (2, 3):
        for n in range(0 if upto == 2 else 2, upto):
            store.record_poll(polls[n], f"{where}/polls", n)
        state.run_available(store.poll_stream(spark, f"{where}/polls"), "parquet", f"{where}/out", f"{where}/check")
    return spark.read.schema(store.POLLED).parquet(f"{where}/out").select("poll", "path", "change")
