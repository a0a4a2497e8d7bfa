"""Secret scans over an incremental blob ledger (operator 4), built-in functions only.

1. Every version of a file is addressed by the SHA-256 of its text.  While a text is in hand it is also told whether any
   rule can match it at all (one alternation of the rules' first characters); a text in which none can has no findings.
2. Blobs are matched with the ledger: pairs of blob and rule version that it holds are not scanned again.
3. Of the rest one row stands for each blob; its text is scanned by the rules that the ledger lacks.
4. Findings, old and new, join back to all paths by the blob, and the ledger grows by the new pairs.

Spans come from what lies between matches: ``split`` and ``regexp_extract_all`` with one pattern give pieces and matches
in turn, whose lengths add up to positions in code points; the sums are running sums over rows, so a text with very many
matches costs in proportion.

Defined cases: a null text is the empty one, with no findings; equal texts are scanned once; repeated rows are kept; a
null id is an id; an empty table gives no rows; further columns are ignored or kept, whatever their names; a finding keeps
the text's own letters and case; a text is scanned whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted, release, unused


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java syntax.  ``group``, ``least``: a match counts if that group has so many code points.

    A text that ``pattern`` matches holds one of ``literals`` and is matched by ``hint``, where those are given; both are
    cheaper to look for.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    literals: tuple[str, ...] = ()


# fixed values: the base kinds, in the order in which they are listed
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, literals=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
# published token formats; their order follows the base kinds
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", literals=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", literals=(".eyJ",)),
    Rule("provider_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,})", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "sk_live_")),
    Rule("url_password", 1, r"\b[a-zA-Z][a-zA-Z0-9+.-]+://[^\s:/@]+:[^\s:/@]+@", literals=("://",)),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,kind:string,end:int>>"


def may_match(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule can match."""
    out = F.lit(False)
    for r in rules:
        own = F.lit(not r.literals)
        for x in r.literals:
            own = own | F.contains(text, F.lit(x))
        out = out | (own & text.rlike(r.hint) if r.hint else own)
    return out


def addressed(versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob, _text): the content address of every version; _text is null where no rule can match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.select(id_col, F.sha2(text, 256).alias("blob"), F.when(may_match(text, rules), text).alias("_text"))


def pending(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo): the rules by which a blob is still to be scanned.  ``blobs`` has distinct blobs."""
    wanted = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    if ledger is None:
        return blobs.select("blob", wanted.alias("todo"))
    # a blob has at most one ledger row for each rule version
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", F.col("version").cast("string"))).alias("_done"))
    left = blobs.select("blob").join(done, "blob", "left").select("blob", F.array_except(wanted, F.coalesce(F.col("_done"), F.array().cast("array<string>"))).alias("todo"))
    return left.filter(F.size("todo") > 0)


def matches(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, start, end) of all matches in ``blobs`` (blob, _text, todo), one row for each blob: leftmost, non-overlapping by kind."""
    out = None
    for r in rules:
        found = F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0))
        zipped = F.arrays_zip(F.split("_text", r.pattern, -1).alias("a"), found.alias("m"))
        own = blobs.filter(F.array_contains("todo", f"{r.kind}@{r.version}") & F.col("_text").rlike(r.pattern))
        each = own.select("blob", F.posexplode(zipped).alias("n", "x")).select("blob", "n", F.length("x.a").alias("_gap"), F.col("x.m").alias("_found"))
        size = F.length(F.regexp_extract("_found", r.pattern, r.group)) if r.group else F.length("_found")
        narrow = each.select("blob", "n", "_gap", F.length("_found").alias("_size"), (size >= r.least).alias("_counts"), F.lit(r.kind).alias("kind"))
        out = narrow if out is None else out.unionByName(narrow)
    # the last piece has no match after it
    run = F.sum(F.col("_gap") + F.coalesce("_size", F.lit(0))).over(Window.partitionBy("blob", "kind").orderBy("n"))
    ends = out.withColumn("end", run.cast("int")).filter("_size IS NOT NULL AND _counts")
    return ends.select("blob", "kind", (F.col("end") - F.col("_size")).alias("start"), "end")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path, new ledger rows).

    findings: id_col, blob, spans (start, kind, end; by start, then in the rules' order).  ledger: blob, kind, version,
    spans; append it to the one given.
    """
    return scan_addressed(cut(addressed(versions, rules, id_col, text_col), "addressed"), ledger, rules, id_col)


def scan_addressed(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``scan`` of what ``addressed`` gives, once it is cut."""
    # equal texts have equal blobs, so any row may stand for its blob; first() picks one before texts are shuffled
    texts = paths.filter("_text IS NOT NULL").groupBy("blob").agg(F.first("_text").alias("_text"))
    todo = pending(paths.select("blob").distinct(), ledger, rules)
    # the cut keeps the patterns behind the choice of blobs
    chosen = cut(texts.join(todo, "blob"), "chosen")
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))))
    found = matches(chosen, rules).groupBy("blob", "kind").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).cast(SPAN).alias("spans"))
    found = cut(found, "found")
    release(chosen)
    none = F.from_json(F.lit("[]"), SPAN)
    version = F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.version))))
    pairs = todo.select("blob", F.explode("todo").alias("_pair")).select("blob", F.regexp_extract("_pair", "^(.*)@", 1).alias("kind"))
    fresh = pairs.join(found, ["blob", "kind"], "left").select("blob", "kind", F.try_element_at(version, F.col("kind")).alias("version"), F.coalesce("spans", none).alias("spans"))
    every = found
    if ledger is not None:
        # rows of a rule's other versions are history
        every = every.unionByName(ledger.filter((F.size("spans") > 0) & (F.try_element_at(version, F.col("kind")) == F.col("version"))).select("blob", "kind", F.col("spans").cast(SPAN).alias("spans")))
    # a blob has one row for each rule at most
    whole = every.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_all"))
    ranked = F.transform("_all", lambda s: F.struct(s["start"].alias("start"), F.try_element_at(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    whole = whole.select("blob", F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("_all"))
    # a text in which no rule can match has no findings and meets none
    some = paths.filter("_text IS NOT NULL").select(id_col, "blob").join(whole, "blob", "left").select(id_col, "blob", F.coalesce("_all", none).alias("spans"))
    return paths.filter("_text IS NULL").select(id_col, "blob", none.alias("spans")).unionByName(some), fresh


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text.

    The rows come as two versions of a store: those up to the middle id first, whose ledger the second batch goes on with,
    so a blob of both batches is scanned once.  Null ids are in the first.
    """
    paths = cut(addressed(versions, RULES, id_col, text_col), "addressed")
    middle = paths.agg(F.percentile_approx(id_col, 0.5, 1000)).head()[0]
    late = F.coalesce(F.col(id_col) > F.lit(middle), F.lit(False))
    earlier, ledger = scan_addressed(paths.filter(~late), id_col=id_col)
    later, _ = scan_addressed(paths.filter(late), cut(ledger, "ledger"), id_col=id_col)
    findings = earlier.unionByName(later)

    def of(r: Rule) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return findings.select(id_col, *(of(r).alias(f"n_{r.kind}") for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def kept_before(findings: DataFrame) -> DataFrame:
    """(blob, cuts): per blob with findings its spans as (start, end, from), where ``from`` is the furthest end before the span."""
    each = findings.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", F.posexplode("spans").alias("n", "s")).select("blob", "n", "s.start", "s.end")
    before = F.max("end").over(Window.partitionBy("blob").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("from", F.coalesce(before, F.lit(0))).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("cuts"))


def redact(text: Column, cuts: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span of ``kept_before`` replaced; overlapping spans become one mark."""
    parts = F.transform(cuts, lambda c: F.when(c["start"] < c["from"], F.lit("")).otherwise(F.concat(F.substring(text, c["from"] + 1, c["start"] - c["from"]), F.lit(mark))))
    last = F.array_max(F.transform(cuts, lambda c: c["end"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows of ``docs`` with their secrets replaced by ``mark``; ``size_col``, if there, counts the new text's code points.

    Only the texts in which a rule can match meet the findings by a join; the others go straight through.
    """
    may = F.coalesce(may_match(F.col(text_col)), F.lit(False))
    some = cut(docs.filter(may), "hinted")
    findings, _ = scan(some, id_col=id_col, text_col=text_col)
    blob, all_, new = unused(docs, "_blob", "_all", "_new")
    found = kept_before(findings).select(F.col("blob").alias(blob), F.col("cuts").alias(all_))
    text = F.col(text_col)
    out = some.join(found, F.sha2(text, 256) == F.col(blob), "left").withColumn(new, F.when(F.col(all_).isNull(), text).otherwise(redact(text, F.col(all_), mark)))
    named = {text_col: F.col(new)}
    if size_col in docs.columns:
        named[size_col] = F.when(F.col(all_).isNull(), F.col(size_col)).otherwise(F.length(new).cast(docs.schema[size_col].dataType))
    return docs.filter(~may).unionByName(out.select(*(named.get(c, F.col(quoted(c))).alias(c) for c in docs.columns)))
