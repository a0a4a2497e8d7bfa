"""Git listings as sources: ``diff-tree -r`` and ``status --porcelain`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_tree(lines: DataFrame, col: str = "value") -> DataFrame:
    """(status, path) of raw diff lines; others are left out."""
    pattern = r"^:\d+ \d+ [0-9a-f]+ [0-9a-f]+ ([A-Z])\d*\t([^\t]+)(?:\t(.+))?$"
    rows = lines.filter(F.col(col).rlike(pattern))
    to = F.regexp_extract(col, pattern, 3)
    return rows.select(F.regexp_extract(col, pattern, 1).alias("status"), F.when(to != "", to).otherwise(F.regexp_extract(col, pattern, 2)).alias("path"))


def status(lines: DataFrame, col: str = "value") -> DataFrame:
    """(path, status, renamed_from) of porcelain lines.  Quoted paths are unescaped; paths that leave the tree are left out."""
    code, rest = F.substring(col, 1, 2), F.expr(f"substring({col}, 4)")
    moved = code.rlike("[RC]")
    old, new = F.split(rest, " -> ").getItem(0), F.element_at(F.split(rest, " -> "), -1)

    def plain(path):
        quoted = path.rlike('^".*"$')
        inner = F.regexp_replace(F.regexp_replace(path, '^"|"$', ""), r'\\(["\\])', "$1")
        return F.when(quoted, F.replace(F.replace(inner, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))).otherwise(path)

    kind = F.when(code == "??", "untracked").when(code.contains("R"), "renamed").when(code.contains("C"), "added").when(code.contains("D"), "deleted").when(code.contains("A"), "added").otherwise("modified")
    path = plain(F.when(moved, new).otherwise(rest))
    rows = lines.filter(F.length(col) > 3).select(path.alias("path"), kind.alias("status"), F.when(code.contains("R"), plain(old)).alias("renamed_from"))
    return rows.filter(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"))
