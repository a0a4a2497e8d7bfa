"""Queries: block ends and calls in sources woven with comments, strings and quotes that hold brackets.

Every document is a source: ``@`` stands for its id, ``~`` for words of its text.  Lines are known by construction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import code
from loomery.sources.tables import read

from .catalog import query

_WOVEN = {
    "rs": """pub struct S@;
/* } /* { nested ~ */ } */
impl S@ {
    pub fn run@(&self) -> char {
        let s = r#"} " ~ {"#; // }
        let t: [u8; 2] = [1, 2];
        if s == "}" { '}' } else { '{' }
    }
    fn lift<'a>(x: &'a str) -> &'a str { x }
}

pub async fn go@(
    a: [u8; 2],
) {
    /* {{ */ helper(a); S@.run@()
}
fn helper(a: u8) {
}""",
    "go": """package p

func Run@(a int) int {
	x := `}
~ {`
	_ = '}' // }
	return Help(a) + len(x)
}

type T@ struct {
	x int /* } */
}

func (t *T@) Get() string { return fmt.Sprint("{", Run@(1)) }
func Help(a int) int {
	return a
}""",
    "ts": """export interface I@ {
  a: string // }
}
export async function go@() {
  const s = `~ } ${"{"} {`
  return '}' + "\\"}" + help(s)
}
export class K@ {
  /* } ~ */
  run() { return go@() }
}
export const help = (a) => {
  return a
}""",
    "java": """public class J@ {
    static final String T = \"\"\"
        } ~ {
        \"\"\";
    public static int run(int a) {
        char c = '}'; /* { */
        return help(a) + "}".length();
    }
    private int help(int a) {
        return a; // }
    }
}""",
    "c": """#define N@ 1
struct S@ {
  int x; /* } ~
  { */
};
static int help(int a) {
  return '}' + a; }
static int run@(int a)
{
  // }
  return help(a) + N@;
}""",
    "cpp": """namespace n@ {
class C@ {
  const char* s = R"x(} ~ )" {)x";
};
}
static int run@(int a) {
  return a ? '{' : '}';
}""",
    "cs": """public class D@ {
    public string Run(int a) {
        return @"}""~ {" + Help(a); // }
    }
    private string Help(int a) {
        return "{";
    }
}""",
    "js": """function go@() {
  return '}' + `{ ~
  {`
}
class K@ {
}""",
    "rb": """module M@
  # end ~
  class C
    def run@(x)
      return 1 if x == "end"
      [1].each do |y|
        help(y)
      end
    end
    def help(y) = y
  end
end""",
}
_ORDER = tuple(_WOVEN)
_BLOCKS = """(VALUES ('rs', 'class', 'S?', 1, 1), ('rs', 'func', 'run?', 4, 8), ('rs', 'func', 'lift', 9, 9), ('rs', 'func', 'go?', 12, 16), ('rs', 'func', 'helper', 17, 18),
('go', 'func', 'Run?', 3, 8), ('go', 'type', 'T?', 10, 12), ('go', 'method', 'Get', 14, 14), ('go', 'func', 'Help', 15, 17),
('ts', 'type', 'I?', 1, 3), ('ts', 'func', 'go?', 4, 7), ('ts', 'constant', 's', 5, 5), ('ts', 'class', 'K?', 8, 11), ('ts', 'func', 'help', 12, 14),
('java', 'class', 'J?', 1, 12), ('java', 'method', 'run', 5, 8), ('java', 'method', 'help', 9, 11), ('c', 'constant', 'N?', 1, 1), ('c', 'class', 'S?', 2, 5), ('c', 'func', 'help', 6, 7), ('c', 'func', 'run?', 8, 12),
('cpp', 'module', 'n?', 1, 5), ('cpp', 'class', 'C?', 2, 4), ('cpp', 'func', 'run?', 6, 8), ('cs', 'class', 'D?', 1, 8), ('cs', 'method', 'Run', 2, 4), ('cs', 'method', 'Help', 5, 7),
('js', 'func', 'go?', 1, 4), ('js', 'class', 'K?', 5, 6), ('rb', 'module', 'M?', 1, 12), ('rb', 'class', 'C', 3, 11), ('rb', 'method', 'run?', 4, 9), ('rb', 'method', 'help', 10, 10)) t(language, kind, name, start, "end")"""
_CALLS = """(VALUES ('rs', 'go?', 'helper', 15, NULL, 17), ('rs', 'go?', 'run?', 15, 'S?', 4), ('go', 'Run?', 'Help', 7, NULL, 15), ('go', 'Get', 'Run?', 14, NULL, 3), ('ts', 'go?', 'help', 6, NULL, 12),
('java', 'run', 'help', 7, NULL, 9), ('c', 'run?', 'help', 11, NULL, 6), ('cs', 'Run', 'Help', 3, NULL, 5), ('rb', 'run?', 'help', 7, NULL, 10)) t(language, caller, callee, line, receiver, target_start)"""
_FILES = f"(SELECT doc_id AS id, {list(_ORDER)}[doc_id % {len(_ORDER)} + 1] AS language FROM documents)"


def _rows(spark, d):
    language = F.element_at(F.array(*map(F.lit, _ORDER)), (F.col("doc_id") % len(_ORDER) + 1).cast("int"))
    source = F.element_at(F.create_map(*(F.lit(x) for kv in _WOVEN.items() for x in kv)), F.col("language"))
    # the words stay within their line and their quotes
    words = F.regexp_replace(F.left("text", F.lit(200)), r"[^\p{L}\p{N} ]", " ")
    files = read(spark, d, "documents").withColumn("language", language)
    text = F.replace(F.replace(source, F.lit("@"), F.col("doc_id").cast("string")), F.lit("~"), words)
    # a string that begins with @ in one language keeps it
    text = F.when(F.col("language") == "cs", F.replace(text, F.concat(F.lit("return "), F.col("doc_id").cast("string"), F.lit('"')), F.lit('return @"'))).otherwise(text)
    return code.code_lines(files.select("doc_id", "language", text.alias("text")), "doc_id")


@query("A08_block_structure", f"""SELECT id, language, kind, replace(name, '?', CAST(id AS VARCHAR)) AS name, start, "end" FROM {_FILES} JOIN {_BLOCKS} USING (language)""")
def _(spark, d):
    return code.blocks(_rows(spark, d)).select("id", "language", "kind", "name", "start", "end")


@query("A15_calls_from_text", f"SELECT id, replace(caller, '?', CAST(id AS VARCHAR)) AS caller, replace(callee, '?', CAST(id AS VARCHAR)) AS callee, line, replace(receiver, '?', CAST(id AS VARCHAR)) AS receiver, target_start FROM {_FILES} JOIN {_CALLS} USING (language)")
def _(spark, d):
    return code.call_edges(_rows(spark, d))
