"""Text expressions: identifier normalisation, query building, tokens, previews, language and path classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file endings and whole names by language
LANGUAGES = {
    "ts": ("ts",),
    "tsx": ("tsx",),
    "js": ("js",),
    "jsx": ("jsx",),
    "rs": ("rs",),
    "py": ("py",),
    "go": ("go",),
    "rb": ("rb", "rake"),
    "c": ("c",),
    "cs": ("cs",),
    "java": ("java",),
    "cpp": ("cpp", "cxx", "cc", "c++", "hpp", "hxx", "h"),
    "md": ("md",),
    "mdx": ("mdx",),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "toml": ("toml",),
}
NAMES = {"go.mod": "gomod", "Gemfile": "rb", "Rakefile": "rb"}
# fixed values: words left out of queries
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with")
# fixed values: paths that are never indexed
DEFAULT_IGNORES = ("*.log", ".git/**", "**/node_modules", "**/node_modules/**", "**/dist", "**/dist/**", "**/target", "**/target/**", "**/.DS_Store", "**/Thumbs.db")
# fixed values: words that stand for others in code
SYNONYMS = {
    "function": ("fn", "func", "method"),
    "fn": ("function", "func", "method"),
    "method": ("function", "fn", "func"),
    "class": ("type", "struct", "object"),
    "struct": ("class", "type"),
    "interface": ("trait", "protocol"),
    "trait": ("interface",),
    "variable": ("var", "let", "const"),
    "var": ("variable", "let"),
    "const": ("constant",),
    "constant": ("const",),
    "auth": ("authentication", "authorize", "login"),
    "authentication": ("auth", "login"),
    "login": ("signin", "auth"),
    "logout": ("signout",),
    "component": ("comp", "widget"),
    "hook": ("usehook",),
    "api": ("endpoint", "service"),
    "request": ("req",),
    "response": ("resp", "res"),
    "database": ("db", "store"),
    "query": ("search", "find"),
    "error": ("err", "exception"),
    "exception": ("error", "err"),
    "config": ("configuration", "settings"),
    "configuration": ("config", "settings"),
    "test": ("spec", "unittest"),
    "mock": ("stub", "fake"),
    "async": ("asynchronous", "await"),
    "promise": ("future",),
    "import": ("require", "use"),
    "export": ("expose",),
}
# fixed values: paths of test code, and names of configuration files
TEST_PATHS = (r"\.test\.(ts|js|tsx|jsx|rs|go|py)$", r"\.spec\.(ts|js|tsx|jsx|rs|go|py)$", r"__tests__", r"^tests/", r"/tests/", r"_test\.(ts|js|tsx|jsx|rs|go|py)$")
CONFIG_NAMES = (r"^package\.json$", r"^tsconfig\.json$", r"^jsconfig\.json$", r"\.config\.(ts|js|json|yaml|yml|toml)$", r"^\.env(\..+)?$", r"^Cargo\.toml$", r"^go\.mod$", r"^pyproject\.toml$", r"^setup\.py$")
# fixed values: operators kept as tokens
OPERATORS = ("::", "->", "=>", "<-", "!=", "==", "<=", ">=")


def normalise_identifier(name: Column) -> Column:
    """camelCase, kebab-case, spaces and dots as snake_case."""
    out = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    out = F.regexp_replace(out, r"([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, r"([0-9])([A-Z])", "$1_$2")
    out = F.lower(F.regexp_replace(out, r"[\s\-.]+", "_"))
    return F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_|_$", "")


def normalise_identifier_text(name: str) -> str:
    """The same for a literal."""
    out = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    out = re.sub(r"([a-z])([A-Z])", r"\1_\2", out)
    out = re.sub(r"([0-9])([A-Z])", r"\1_\2", out)
    out = re.sub(r"[\s\-.]+", "_", out).lower()
    return re.sub("_+", "_", out).strip("_")


def query_terms(query: str) -> list[str]:
    """Prefix terms of a query: other characters than letters, digits and _ separate."""
    return [t for part in query.split() for t in re.sub(r"[^\w\s]", " ", part).split()]


def match_expression(query: str) -> str:
    """The terms as a disjunction of prefixes."""
    return " OR ".join(f"{t}*" for t in query_terms(query))


def match_of(query: Column) -> Column:
    """``match_expression`` of a column of queries."""
    return F.array_join(F.transform(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.concat(t, F.lit("*"))), " OR ")


NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda x: x != "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def language(path: Column) -> Column:
    """Language of a path, null where unknown."""
    pairs = [x for k, ends in LANGUAGES.items() for e in ends for x in (F.lit(e), F.lit(k))]
    whole = [x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*whole), file_name(path)), F.element_at(F.create_map(*pairs), extension(path)))


def globs_to_regex(patterns: list[str]) -> str | None:
    """One pattern for a list of ignore globs; blank lines and comments are skipped."""
    out = []
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        rooted, folder = p.startswith("/"), p.endswith("/")
        body = p.strip("/")
        body = re.escape(body).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(out) or None


def ignored(path: Column, patterns: list[str]) -> Column:
    regex = globs_to_regex(patterns)
    return path.rlike(regex) if regex else F.lit(False)


def file_class(path: Column) -> Column:
    """test, config or regular; either slash separates folders."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    test, config = F.lit(False), F.lit(False)
    for p in TEST_PATHS:
        test = test | plain.rlike(p)
    for p in CONFIG_NAMES:
        config = config | file_name(plain).rlike(p) | plain.rlike(p)
    return F.when(test, "test").when(config, "config").otherwise("regular")


def first_lines(text: Column, n: int = 40) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, numbered from 1, inclusive, within the text; empty if start is beyond end."""
    lines = F.split(text, "\n")
    s = F.greatest(start, F.lit(1))
    e = F.least(end, F.size(lines))
    return F.when(s > e, "").otherwise(F.array_join(F.slice(lines, s, F.greatest(e - s + 1, F.lit(0))), "\n"))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def search_document(relpath: Column, symbol: Column, signature: Column, docstring: Column, text: Column) -> Column:
    return F.concat_ws(" \n ", relpath, symbol, signature, docstring, text)


def blob_sha(text: Column) -> Column:
    """SHA-256 in the manner of git: over a header with the size, a NUL and the content."""
    raw = F.encode(text, "UTF-8")
    return F.sha2(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def query_mode(query: str) -> str:
    """code, text or auto: operators, a call's brackets, one word, or two words of which one looks like a name are code."""
    n = len(query.split())
    if any(o in query for o in OPERATORS) or {"(", ")"} <= set(query) or n == 1:
        return "code"
    two_cases = any(c.isupper() for c in query) and any(c.islower() for c in query)
    if n == 2 and ("_" in query or two_cases):
        return "code"
    return "text" if n > 3 else "auto"


_TOKEN = re.compile(r"::|->|=>|<-|!=|==|<=|>=|[:\->=<!&|]|[\w.]+")


def query_tokens(query: str) -> list[str]:
    """Words, names with _ or ., and operators.  A single operator sign counts before a word and not right after one; stop words are left out."""
    out = []
    for m in _TOKEN.finditer(query):
        t, before, after = m[0], query[m.start() - 1 : m.start()], query[m.end() : m.end() + 1]
        if t[0] in ":->=<!&|":
            if len(t) == 2 or (after.isalnum() and not (before.isalnum() or before in ("_", ".") and before)):
                out.append(t)
        elif not ((w := t.lower()).isalpha() and w in STOP_WORDS):
            out.append(w)
    return out


def tokens_of(query: Column) -> Column:
    """``query_tokens`` of a column of queries."""
    # a single sign after a word or before none is passed over
    pattern = r"::|->|=>|<-|!=|==|<=|>=|(?<![\p{L}\p{N}_.])[:\->=<!&|](?=[\p{L}\p{N}])|[\p{L}\p{N}_.]+"
    found = F.transform(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)), lambda t: F.lower(t))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def mode_of(query: Column) -> Column:
    """``query_mode`` of a column of queries."""
    n = F.size(F.regexp_extract_all(query, F.lit(r"\S+"), F.lit(0)))
    code = (n == 1) | (query.contains("(") & query.contains(")"))
    for o in OPERATORS:
        code = code | query.contains(o)
    name = query.contains("_") | (query.rlike(r"\p{Lu}") & query.rlike(r"\p{Ll}"))
    return F.when(code | ((n == 2) & name), "code").when(n > 3, "text").otherwise("auto")


def valid_of(query: Column) -> Column:
    """``valid_query`` of a column of queries; null isn't valid."""
    return F.coalesce((F.octet_length(query) <= 1000) & query.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def expansions(tokens: list[str]) -> list[str]:
    """Words that stand for the tokens, sorted: those of the token itself, and for one of more than four bytes also those of words that begin it or that it begins."""
    return sorted({s for t in tokens for k, v in SYNONYMS.items() if k == t or (len(t.encode()) > 4 and (t.startswith(k) or k.startswith(t))) for s in v})


def valid_query(query: str) -> bool:
    return bool(query.strip()) and len(query.encode()) <= 1000 and any(c.isalnum() for c in query)


def tsquery(tokens: list[str], synonyms: dict[str, list[str]] | None = None) -> str:
    """a & b, or (a | synonym) & b."""
    if not synonyms:
        return " & ".join(tokens)
    return " & ".join(f"({' | '.join([t, *synonyms[t]])})" if synonyms.get(t) else t for t in tokens)


def expand(tokens: Column) -> Column:
    """``expansions`` of an array of tokens."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in SYNONYMS.items()))

    def of(t: Column) -> Column:
        met = F.filter(table, lambda p: (p["k"] == t) | ((F.octet_length(t) > 4) & (F.startswith(t, p["k"]) | F.startswith(p["k"], t))))
        return F.flatten(F.transform(met, lambda p: p["v"]))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, of))))


def language_of_kind(kind: Column) -> Column:
    """Language that a kind of chunk tells, or null."""
    # fixed values: kinds that only one language has
    return F.when(kind.isin("impl", "trait", "mod"), "rs").when(kind == "module", "rb").when(kind == "constructor", "java").when(kind == "namespace", "cpp")


def language_of_content(text: Column) -> Column:
    """Language that a text's words tell, the more telling ones first, or null."""

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    # fixed values: words of each language, in the order in which they are tried
    tells = (
        ("cs", has("using System", "using static") | (has("namespace ") & has("class ", "interface "))),
        ("java", has("import java.") | (has("public class", "public interface") & ~has("namespace "))),
        ("cpp", has("#include") & has("class ", "namespace ", "template<")),
        ("rb", has("end") & ((has("class") & has("<")) | has("def") | has("module"))),
        ("py", has("def ") & has("import ")),
        ("rs", has("fn ") & has("impl ", "pub ")),
        ("ts", has("interface ", ": string", ": number")),
        ("js", has("function ", "const ")),
        ("go", has("func ") & has("package ")),
    )
    out = None
    for name, told in tells:
        out = F.when(told, name) if out is None else out.when(told, name)
    return out


# fixed values: what an error's text tells of its class, first match first, and what to try next
ERROR_CLASSES = (
    ("validation", r"(?i)empty|too long|no meaningful", "Enter a query of 1 to 1000 characters with a letter or digit"),
    ("timeout", r"(?i)timed? ?out|deadline", "Narrow the query or raise the time limit"),
    ("not_found", r"(?i)not found|not indexed|no such|does not exist", "Index the repository first"),
    ("embedding_provider", r"(?i)embedding|provider|api key|rate limit|quota|unauthori[sz]ed|model unavailable", "Check the provider's key, quota and model"),
    ("database", r"(?i)database|sqlite|connection|corrupt|lock", "Check the store and build it anew if it is damaged"),
)


def error_class(message: Column) -> Column:
    """(class, suggestion) of an error's text; unknown where nothing tells."""
    out = None
    for name, pattern, hint in ERROR_CLASSES:
        own = F.struct(F.lit(name).alias("class"), F.lit(hint).alias("suggestion"))
        out = F.when(message.rlike(pattern), own) if out is None else out.when(message.rlike(pattern), own)
    return out.otherwise(F.struct(F.lit("unknown").alias("class"), F.lit("See the log for the whole message").alias("suggestion")))


def rolling_hash(text: Column) -> Column:
    """31-based rolling hash in 32-bit two's complement, over code points."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    wrapped = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c).cast("long"), F.lit(1 << 32)))
    return F.when(wrapped >= (1 << 31), wrapped - (1 << 32)).otherwise(wrapped)
