"""Block structure and calls of source code, from tokens as rows.

A small kernel blanks what isn't code: comments (nested ones too), strings, raw strings and character literals become spaces, so
lines and columns stay.  All else is done on rows: brackets and semicolons are exploded from the blanked lines, running sums give
their depth, and an opening bracket meets the closing one that comes next at its depth.  A definition is a line with its
language's pattern; its block is that of the first bracket after it, unless a semicolon comes before.  Ruby's blocks are
opened by words and closed by ``end``, with the same sums.

A call is a name before a round bracket.  It lies in the innermost definition around its line and is resolved by scope: in
the nearest definition around it that holds one of that name, else at the top of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import DEFINITIONS

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED, _CHAR = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\u\{[0-9A-Fa-f]+\}|\\.[^'\n]*|[^\\'\n])'"
#: What isn't code, by language; the first that fits at a place is taken.
NO_CODE = {
    "rs": rf"//[^\n]*|/\*|b?r(?P<h>#*)\".*?\"(?P=h)|b?{_QUOTED}|b?{_CHAR}",
    "go": rf"{_C}|`[^`]*`|{_QUOTED}|{_CHAR}",
    "c": rf"{_C}|{_QUOTED}|{_CHAR}",
    "cpp": rf"{_C}|R\"(?P<d>[^(\s]*)\(.*?\)(?P=d)\"|{_QUOTED}|{_CHAR}",
    "java": rf"{_C}|\"\"\".*?(?<!\\)\"\"\"|{_QUOTED}|{_CHAR}",
    "cs": rf"{_C}|\$?@\$?\"(?:\"\"|[^\"])*\"|\"\"\".*?\"\"\"|{_QUOTED}|{_CHAR}",
    "ts": rf"{_C}|`(?:\\.|[^`\\])*`|{_QUOTED}|'(?:\\.|[^'\\\n])*'?",
    "rb": r"(?m:^=begin\b.*?^=end\b[^\n]*)|#[^\n]*|<<[~-]?(?P<q>['\"]?)(?P<w>[A-Z_]+)(?P=q)[^\n]*\n.*?^\s*(?P=w)$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
}
NO_CODE["js"] = NO_CODE["tsx"] = NO_CODE["jsx"] = NO_CODE["ts"]
#: Words before a round bracket that aren't calls.
NO_CALL = ("if", "for", "while", "switch", "match", "return", "catch", "function", "func", "fn", "def", "sizeof", "when", "elsif", "until", "unless", "using", "lock", "super", "await", "yield", "and", "or", "not", "in")
_CALL = r"([A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*)[ \t]*\("
_RB_OPEN, _RB_CLOSE = r"^\s*(?:class|module|begin|case|if|unless|while|until|for)\b|^\s*def\s+(?!.*\)\s*=|\S+\s*=\s)|\bdo\s*(?:\|[^|]*\|)?\s*$", r"(?:^\s*|;\s*)end\b"


def blanked(text: str, language: str) -> str:
    """``text`` with everything that isn't code as spaces; a language without rules is left as it is."""
    pattern = NO_CODE.get(language)
    if pattern is None:
        return text
    out, at = [], 0
    for m in iter_no_code(text, language, pattern):
        start, end = m
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at = end
    return "".join([*out, text[at:]])


def iter_no_code(text: str, language: str, pattern: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces that aren't code."""
    find, at = re.compile(pattern, re.S | re.M), 0
    while m := find.search(text, at):
        end = m.end()
        if language == "rs" and m[0] == "/*":
            # nested: as many ends as beginnings
            depth = 1
            while depth and (x := re.compile(r"/\*|\*/").search(text, end)):
                depth, end = depth + (1 if x[0] == "/*" else -1), x.end()
            end = len(text) if depth else end
        yield m.start(), max(end, m.start() + 1)
        at = max(end, m.start() + 1)


def code_lines(files: DataFrame, id_col: str, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(id, language, n, line, bare): the lines of each file, as they are and blanked."""
    kind = files.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, languages = b.column("_text").to_pylist(), b.column("language").to_pylist()
            bare = [blanked(t or "", k or "") for t, k in zip(texts, languages)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("language"), b.column("_text"), pa.array(bare, pa.string())], ["_id", "language", "_text", "_bare"])

    rows = files.select(F.col(id_col).alias("_id"), F.col(language_col).alias("language"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    both = rows.mapInArrow(kernel, f"_id {kind}, language string, _text string, _bare string")
    pairs = F.arrays_zip(F.split("_text", "\n").alias("line"), F.split("_bare", "\n").alias("bare"))
    return both.select(F.col("_id").alias("id"), "language", F.posexplode(pairs).alias("_n", "_x")).select("id", "language", (F.col("_n") + 1).alias("n"), F.col("_x.line").alias("line"), F.col("_x.bare").alias("bare"))


def _definitions(rows: DataFrame) -> DataFrame:
    """(id, language, n, kind, name, signature) of lines that define something; of several patterns the first counts."""
    found: Column | None = None
    for language, patterns in DEFINITIONS.items():
        if language == "gomod":
            continue
        for kind, pattern in patterns:
            name = F.regexp_extract("bare", pattern, 1)
            # words that begin a statement look like a type before a name
            ok = (F.col("language") == language) & F.col("bare").rlike(pattern) & ~F.col("bare").rlike(r"^\s*(?:return|else|throw|new|delete|goto)\b")
            value = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
            found = F.when(ok, value) if found is None else found.when(ok, value)
    return rows.withColumn("_d", found).filter("_d IS NOT NULL").select("id", "language", "n", F.col("_d.kind").alias("kind"), F.col("_d.name").alias("name"), F.trim("line").alias("signature"))


def _tokens(rows: DataFrame) -> DataFrame:
    """(id, n, place, token): brackets and semicolons; in Ruby, words that open and close blocks as curly brackets."""
    ruby = F.concat(
        F.array_repeat(F.lit("{"), F.when(F.col("bare").rlike(_RB_OPEN), 1).otherwise(0)),
        F.array_repeat(F.lit("}"), F.size(F.regexp_extract_all("bare", F.lit(_RB_CLOSE), F.lit(0)))),
    )
    marks = F.when(F.col("language") == "rb", ruby).otherwise(F.regexp_extract_all("bare", F.lit(r"[{}()\[\];]"), F.lit(0)))
    return rows.select("id", "n", F.posexplode(marks).alias("place", "token"))


def blocks(rows: DataFrame) -> DataFrame:
    """(id, language, kind, name, start, end, signature) of the definitions in ``code_lines``."""
    order = Window.partitionBy("id").orderBy("n", "place")
    curly = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    round_ = F.when(F.col("token").isin("(", "["), 1).when(F.col("token").isin(")", "]"), -1).otherwise(0)
    deep = _tokens(rows).withColumn("_depth", F.sum(curly).over(order)).withColumn("_inside", F.sum(round_).over(order))
    # an opening bracket and its closing one have the same depth outside
    pairs = deep.filter(F.col("token").isin("{", "}")).withColumn("_level", F.col("_depth") - F.when(F.col("token") == "{", 1).otherwise(0))
    pairs = pairs.withColumn("_close", F.lead("n").over(Window.partitionBy("id", "_level").orderBy("n", "place"))).select("id", "n", "place", "token", F.col("_close"))
    ends = deep.filter((F.col("token") == ";") & (F.col("_inside") == 0)).select("id", "n", "place", "token", F.lit(None).cast("int").alias("_close"))
    stops = pairs.unionByName(ends).select("id", "n", "place", F.struct("token", "_close", F.col("n").alias("at")).alias("_stop"))
    defs = _definitions(rows)
    # a definition is followed by what opens its block, or by what shows that it has none: a semicolon, the end of the block
    # around it, another definition
    marks = defs.select("id", "n", F.lit(-1).alias("place"), F.struct(F.lit("").alias("token"), F.lit(None).cast("int").alias("_close"), F.col("n").alias("at")).alias("_stop"))
    # backwards, so that each row looks at those behind it in one pass
    follows = F.last("_stop").over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    seen = stops.unionByName(marks).withColumn("_next", follows).filter("place = -1").select("id", "n", "_next")
    out = defs.join(seen, ["id", "n"]).join(rows.groupBy("id").agg(F.max("n").alias("_last")), "id")
    near = F.col("_next.at") - F.col("n") <= 10
    end = F.when(F.col("signature").startswith("#"), F.col("n")).when(near & (F.col("_next.token") == "{"), F.coalesce("_next._close", "_last")).when(near & (F.col("_next.token") == ";"), F.col("_next.at")).otherwise(F.col("n"))
    return out.select("id", "language", "kind", "name", F.col("n").alias("start"), end.cast("int").alias("end"), "signature")


def calls(rows: DataFrame) -> DataFrame:
    """(id, line, receiver, callee) of the calls in ``code_lines``; a definition's own name isn't one."""
    found = rows.select("id", "language", "n", "bare", F.explode(F.regexp_extract_all("bare", F.lit(_CALL), F.lit(1))).alias("_path"))
    parts = F.split("_path", r"\.|::|->")
    callee = F.element_at(parts, -1)
    receiver = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))
    named = found.select("id", F.col("n").alias("line"), receiver.alias("receiver"), callee.alias("callee"), "language").filter(~F.col("callee").isin(*NO_CALL))
    own = _definitions(rows).select("id", F.col("n").alias("line"), F.col("name").alias("callee"))
    return named.join(own, ["id", "line", "callee"], "left_anti").select("id", "line", "receiver", "callee")


def innermost(found: DataFrame, defs: DataFrame, bin_size: int = 64) -> DataFrame:
    """``found`` (id, line, ...) with every definition around each row: ``start`` and ``end`` of it; ranges are dealt to bins of lines, so it is an equi-join."""
    spans = defs.select(F.col("id").alias("_id"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))).alias("_b"))
    return found.join(spans, (F.col("id") == F.col("_id")) & (F.floor(F.col("line") / bin_size) == F.col("_b")) & F.col("line").between(F.col("start"), F.col("end"))).drop("_id", "_b")


def call_edges(rows: DataFrame) -> DataFrame:
    """(id, caller, callee, line, receiver, target_start): calls in a function or method to a definition of their file, found by scope.

    ``target_start`` is the line of the definition called: of those that share the name the one in the innermost scope around
    the call, of those in one scope the first.
    """
    defs = blocks(rows)
    functions = defs.filter(F.col("kind").isin("func", "method"))
    site = ["id", "line", "receiver", "callee"]
    around = innermost(calls(rows).distinct(), functions).groupBy(*site).agg(F.max(F.struct("start", "end")).alias("_in"))
    names = functions.select("id", F.col("start").alias("_s"), F.col("name").alias("caller")).dropDuplicates(["id", "_s"])
    callers = around.withColumn("_s", F.col("_in.start")).join(names, ["id", "_s"]).select(*site, "caller")
    # each definition's scopes: the definitions around it, and the file
    scope = innermost(defs.select("id", F.col("start").alias("line"), "name"), defs).filter(F.col("start") < F.col("line")).select("id", "line", "name", F.col("start").alias("_from"), F.col("end").alias("_to"))
    nearest = scope.groupBy("id", "line", "name").agg(F.max(F.struct("_from", "_to")).alias("_scope"))
    held = defs.select("id", F.col("start").alias("line"), "name").join(nearest, ["id", "line", "name"], "left")
    known = held.select("id", F.col("name").alias("callee"), F.col("line").alias("target_start"), F.coalesce(F.col("_scope._from"), F.lit(0)).alias("_from"), F.coalesce(F.col("_scope._to"), F.lit((1 << 31) - 1)).alias("_to"))
    met = callers.join(known, ["id", "callee"]).filter(F.col("line").between(F.col("_from"), F.col("_to")))
    best = met.groupBy(*site, "caller").agg(F.min(F.struct((-F.col("_from")).alias("_far"), "target_start")).alias("_t"))
    return best.select("id", "caller", "callee", "line", "receiver", F.col("_t.target_start").alias("target_start"))


def languages() -> list[str]:
    """Languages with both definitions and rules for what isn't code."""
    return sorted(reduce(lambda a, b: a & b, (set(NO_CODE), set(DEFINITIONS))))
