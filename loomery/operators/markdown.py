"""Markdown as rows: sections, fenced code, tables, lists and links.

Lines are rows of their text.  Fences are the one thing that needs a state: the marks of a text (not its lines) are folded in
order, as a fence is closed only by one of its own character that is at least as long and says nothing else.  All else are
islands over lines outside fences: windows that look back, so a long text costs what it is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = r"^ {0,3}(`{3,}|~{3,})\s*(.*?)\s*$"
_ITEM = r"^( *)([-*+]|\d{1,9}[.)])(?: |$)"
_RULER = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$"
_LINK = r"(!?)\[([^\]]*)\]\(([^)]+)\)"


def lines(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line number from 1, line)."""
    return files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("_p", "line")).select(id_col, (F.col("_p") + 1).alias("n"), "line")


def fences(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, language, start, end, lines_of_code) of fenced blocks; one that isn't closed ends with the text."""
    rows = F.split(text_col, "\n")
    marks = F.filter(F.transform(rows, lambda x, i: F.struct((i + 1).alias("n"), F.regexp_extract(x, _MARK, 1).alias("mark"), F.regexp_extract(x, _MARK, 2).alias("info"))), lambda m: m["mark"] != "")
    none = F.expr("cast(null as struct<n: int, mark: string, info: string>)")
    done = F.expr("cast(array() as array<struct<info: string, start: int, end: int, closed: boolean>>)")

    def step(acc: Column, m: Column) -> Column:
        o = acc["open"]
        same = F.left(m["mark"], F.lit(1)) == F.left(o["mark"], F.lit(1))
        closes = o.isNotNull() & same & (F.length(m["mark"]) >= F.length(o["mark"])) & (m["info"] == "")
        # what a fence of backticks says has none
        opens = o.isNull() & ~(m["mark"].startswith("`") & m["info"].contains("`"))
        block = F.struct(o["info"].alias("info"), o["n"].alias("start"), m["n"].alias("end"), F.lit(True).alias("closed"))
        return F.struct(F.when(closes, none).when(opens, m).otherwise(o).alias("open"), F.when(closes, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        o = acc["open"]
        rest = F.array(F.struct(o["info"].alias("info"), o["n"].alias("start"), F.size(rows).alias("end"), F.lit(False).alias("closed")))
        return F.when(o.isNull(), acc["out"]).otherwise(F.concat(acc["out"], rest))

    folded = F.aggregate(marks, F.struct(none.alias("open"), done.alias("out")), step, finish)
    found = files.select(id_col, F.explode(folded).alias("_b"))
    size = F.col("_b.end") - F.col("_b.start") - F.col("_b.closed").cast("int")
    return found.select(id_col, F.regexp_extract("_b.info", r"^(\S*)", 1).alias("language"), F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), size.alias("lines_of_code"))


def outside(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``lines`` with ``inside``: whether a line is in a fenced block, its marks included."""
    edges = fences(files, id_col, text_col).select(id_col, F.explode(F.array(F.struct(F.col("start").alias("n"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("n"), F.lit(-1).alias("step")))).alias("_e"))
    steps = edges.select(F.col(id_col).alias("_i"), F.col("_e.n").alias("_n"), F.col("_e.step").alias("_step")).groupBy("_i", "_n").agg(F.sum("_step").alias("_step"))
    rows = lines(files, id_col, text_col)
    met = rows.join(steps, (rows[id_col] == F.col("_i")) & (F.col("n") == F.col("_n")), "left")
    w = Window.partitionBy(id_col).orderBy("n")
    return met.withColumn("inside", F.sum(F.coalesce("_step", F.lit(0))).over(w) > 0).select(id_col, "n", "line", "inside")


def _headings(rows: DataFrame, id_col: str) -> DataFrame:
    heads = rows.filter(~F.col("inside") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s+#+\s*$", ""))
    return heads.select(id_col, F.col("n").alias("start"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), title.alias("title"))


def sections(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, level, title, start, end, path): ATX headings outside fences; a section ends before the next heading of its or a higher level."""
    rows = outside(files, id_col, text_col)
    back, ahead = Window.partitionBy(id_col).orderBy("start"), Window.partitionBy(id_col).orderBy(F.desc("start"))
    past, coming = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (back, ahead))
    # the nearest following start of each level, and the nearest preceding title of each level
    nexts = [F.min(F.when(F.col("level") == k, F.col("start"))).over(coming).alias(f"next{k}") for k in range(1, 7)]
    prior = [F.max(F.when(F.col("level") == k, F.struct("start", "title"))).over(past).alias(f"prior{k}") for k in range(1, 7)]
    last = rows.groupBy(id_col).agg(F.max("n").alias("last"))
    wide = _headings(rows, id_col).select("*", *nexts, *prior).join(last, id_col)
    end = F.least(*(F.when(F.col("level") >= k, F.col(f"next{k}")) for k in range(1, 7)))
    parents: Column = F.array().cast("array<string>")
    floor: Column = F.lit(0)
    for k in range(1, 6):
        # a parent counts if no later heading above it has closed it
        own = F.col(f"prior{k}")
        open_ = (F.col("level") > k) & own.isNotNull() & (F.coalesce(own["start"], F.lit(0)) > floor)
        parents = F.when(open_, F.concat(parents, F.array(own["title"]))).otherwise(parents)
        floor = F.greatest(floor, F.coalesce(own["start"], F.lit(0)))
    return wide.select(id_col, "level", "title", "start", (F.coalesce(end - 1, F.col("last"))).cast("int").alias("end"), F.array_join(F.concat(parents, F.array("title")), " > ").alias("path"))


def in_sections(found: DataFrame, files: DataFrame, id_col: str, at: str, text_col: str = "text") -> DataFrame:
    """``found`` with ``path``: that of the innermost section around line ``at``, which is the last that began by then; null before the first."""
    heads = sections(files, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("path"))
    both = found.select(F.col(id_col).alias("_i"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*found.columns).alias("_row")).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy("_i").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("path", F.last("path", ignorenulls=True).over(w)).filter("_kind = 1").select("_row.*", "path")


def code_blocks(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``fences`` with the path of their section."""
    return in_sections(fences(files, id_col, text_col), files, id_col, "start", text_col)


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.size(F.split(inner, r"(?<!\\)\|"))


def tables(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, end, rows, columns): a header, a ruler of as many cells, and the lines with a bar that follow; the ruler is no row."""
    piped = outside(files, id_col, text_col).filter(~F.col("inside") & F.col("line").contains("|"))
    w = Window.partitionBy(id_col).orderBy("n")
    rows = piped.withColumn("_island", F.col("n") - F.row_number().over(w))
    own = Window.partitionBy(id_col, "_island").orderBy("n")
    ruler = F.col("line").rlike(_RULER) & F.lag("line").over(own).isNotNull() & (_cells(F.lag("line").over(own)) == _cells(F.col("line")))
    marked = rows.withColumn("_ruler", F.when(ruler, F.col("n"))).withColumn("_columns", _cells(F.col("line")))
    whole = marked.groupBy(id_col, "_island").agg(F.min("_ruler").alias("_at"), F.max("n").alias("end"), F.min_by("_columns", F.col("_ruler")).alias("columns")).filter("_at IS NOT NULL")
    return whole.select(id_col, (F.col("_at") - 1).alias("start"), "end", (F.col("end") - F.col("_at") + 1).alias("rows"), "columns")


def lists(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, start, end, type, items) of top-level lists: items, what is indented below them, and blank lines between.  Another kind of mark begins another list."""
    rows = outside(files, id_col, text_col)
    blank, indented = F.trim("line") == "", F.col("line").rlike(r"^(?: {2,}|\t)\S")
    item = ~F.col("inside") & F.col("line").rlike(_ITEM) & (F.length(F.regexp_extract("line", _ITEM, 1)) < 2) & ~F.col("line").rlike(r"^ *([-*])(?: *\1){2,} *$")
    mark = F.regexp_replace(F.regexp_extract("line", _ITEM, 2), r"\d+", "1")
    w = Window.partitionBy(id_col).orderBy("n")
    rows = rows.select(id_col, "n", blank.alias("_blank"), F.when(item, mark).alias("_mark"), (~item & ~indented & ~blank).alias("_other"))
    # a line that is neither ends what came before
    rows = rows.withColumn("_part", F.sum(F.col("_other").cast("int")).over(w)).filter("NOT _other")
    part = Window.partitionBy(id_col, "_part").orderBy("n")
    last = F.last("_mark", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.col("_mark").isNotNull() & (last.isNull() | (last != F.col("_mark")))).cast("int"))
    rows = rows.withColumn("_list", F.sum("_new").over(part)).filter("_list > 0 AND NOT _blank")
    out = rows.groupBy(id_col, "_part", "_list").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.min_by("_mark", "n").alias("_m"), F.count("_mark").alias("items"))
    return out.select(id_col, "start", "end", F.when(F.col("_m").startswith("1"), "ordered").otherwise("unordered").alias("type"), "items")


def links(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line, title, target, class, image, path) of [title](target) and ![title](target), with the path of their section; empty targets are none."""
    rows = lines(files, id_col, text_col).select(id_col, F.col("n").alias("line"), F.posexplode(F.regexp_extract_all("line", F.lit(_LINK), F.lit(0))).alias("place", "m"))
    target = F.regexp_extract("m", _LINK, 3)
    kind = F.when(target.rlike("^https?://"), "external").when(target.startswith("#"), "anchor").when(target.startswith("/"), "absolute").otherwise("relative")
    found = rows.select(id_col, "line", "place", F.regexp_extract("m", _LINK, 2).alias("title"), target.alias("target"), kind.alias("class"), F.col("m").startswith("!").alias("image")).filter(F.trim("target") != "")
    return in_sections(found, files, id_col, "line", text_col).drop("place")
