"""Ignore rules as a table: each folder's rules in their order, over paths of any number.

A rule line works as in git: blank lines and ``#`` comments are none; ``!`` takes back; a slash at the end means folders only;
a slash elsewhere anchors the pattern at its rules' folder, without one it holds at any depth below it; ``*`` and ``?`` stop
at slashes, ``**`` as a whole part doesn't; ``[a-z]`` and ``[!a-z]`` are classes; a backslash quotes.  The last rule that
matches decides, rules of deeper folders coming after those above; what lies below an ignored folder is ignored, whatever
rules say of it.

Each path stands for itself and for every folder above it; folders shared by many paths are judged once.  Rules meet paths
by an equi-join on the folder they belong to.  A null path isn't ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the pieces of a pattern that mean something, then plain characters
_TOKENS = r"(?s)^\*\*/|(?:/\*\*)+/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|[^\\\[*?/]+|."


def _regex_of(token: Column) -> Column:
    """A piece of a pattern as a regular expression."""
    negated = token.rlike(r"^\[[!^]")
    inside = F.when(negated, F.substring(token, F.lit(3), F.length(token) - 3)).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))
    one_of = F.concat(F.lit("(?!/)["), F.when(negated, "^").otherwise(""), F.regexp_replace(inside, r"([\[\]&])", r"\\$1"), F.lit("]"))
    return (
        F.when(token == "**/", F.lit("(?:.*/)?"))
        .when(token.rlike(r"^(/\*\*)+/$"), F.lit("/(?:.*/)?"))
        .when(token == "/**", F.lit("/.+"))
        .when(token.rlike(r"^\*+$"), F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .when(token.rlike(r"(?s)^\[.+\]$"), one_of)
        .when(token.rlike(r"(?s)^\\."), F.concat(F.lit(r"\Q"), F.substring(token, 2, 1), F.lit(r"\E")))
        .otherwise(F.concat(F.lit(r"\Q"), token, F.lit(r"\E")))
    )


def parsed(rules: DataFrame) -> DataFrame:
    """(folder, n, negated, folders_only, regex) of the lines (folder, n, pattern) that are rules; ``regex`` is for paths below the folder."""
    line = F.regexp_replace(F.regexp_replace("pattern", r"\r$", ""), r"(?<!\\)[ \t]+$", "")
    rows = rules.select(F.coalesce("folder", F.lit("")).alias("folder"), "n", line.alias("line")).filter(~F.col("line").startswith("#"))
    rows = rows.withColumn("negated", F.col("line").startswith("!")).withColumn("line", F.regexp_replace("line", "^!", ""))
    rows = rows.withColumn("folders_only", F.col("line").endswith("/")).withColumn("line", F.regexp_replace("line", "/+$", ""))
    rows = rows.withColumn("anchored", F.col("line").contains("/")).withColumn("line", F.regexp_replace("line", "^/", "")).filter("line <> ''")
    body = F.array_join(F.transform(F.expr(f"regexp_extract_all(line, r'{_TOKENS}', 0)"), lambda x: _regex_of(x)), "")
    return rows.select("folder", "n", "negated", "folders_only", F.concat(F.lit("(?s)^"), F.when(F.col("anchored"), "").otherwise("(?:.*/)?"), body, F.lit("$")).alias("regex"))


def levels(path: Column) -> Column:
    """The path's folders from the top, then the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``path``s that ``rules`` (folder, n, pattern; ``n`` in their order) ignore."""
    paths = paths.select("path").filter("path IS NOT NULL").distinct()
    standing = paths.select("path", F.explode(levels(F.col("path"))).alias("entry")).withColumn("is_folder", F.col("path") != F.col("entry"))
    entries = standing.select("entry", "is_folder").distinct()
    # an entry meets the rules of each folder above it
    above = F.concat(F.array(F.lit("")), F.slice(levels(F.col("entry")), 1, F.size(F.split("entry", "/")) - 1))
    placed = entries.select("entry", "is_folder", F.posexplode(above).alias("depth", "_folder"))
    below = F.when(F.col("_folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(_folder) + 2)"))
    met = placed.join(parsed(rules), F.col("_folder") == F.col("folder")).filter((~F.col("folders_only") | F.col("is_folder")) & F.call_function("rlike", below, F.col("regex")))
    last = met.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "n")).alias("_kept")).filter("NOT _kept").select("entry", "is_folder")
    return standing.join(last, ["entry", "is_folder"], "left_semi").select("path").distinct()


def rules_in(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(folder, n, pattern) of the lines of those ``files`` (path, text) that have one of these names; a later name's rules come after."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rank = F.array_position(F.array(*map(F.lit, names)), name)
    lines = files.filter(name.isin(*names)).select(folder.alias("folder"), rank.alias("_rank"), F.posexplode(F.split("text", "\n")).alias("_n", "pattern"))
    return lines.select("folder", (F.col("_rank") * (1 << 32) + F.col("_n")).alias("n"), "pattern")


def defaults(like: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Rules at the root that come before all others (``like`` gives the session)."""
    return like.sparkSession.createDataFrame([("", k - len(patterns), p) for k, p in enumerate(patterns)], "folder string, n long, pattern string")


def folder_pattern(path: str) -> str:
    """A literal path as an anchored pattern."""
    return "/" + re.sub(r"([\\\[\]*?!# ])", r"\\\1", path)
