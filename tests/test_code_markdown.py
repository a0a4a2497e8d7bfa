"""Blocks and calls of code, Markdown blocks: small texts whose lines are known."""

import pytest

from loomery.operators import code, markdown


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("rs", "a /* { /* } */ { */ b \"}\" r#\"}\"{\"# '}' &'a x // }\n}", 'a                   b "}" r#"}"{"# \'}\' &\'a x // }\n}'),
        ("go", "x := `}\n{` + \"}\" // {\n}", None),
        ("cs", '@"}""{" $"}" {', None),
        ("rb", '# end\n"end" <<~EOS\n end\nEOS\nputs 1', None),
        ("", "{", "{"),
    ],
)
def test_blanked_keeps_lines(language, text, want):
    got = code.blanked(text, language)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    left = "".join(got.split())
    assert left == {"rs": "ab&'ax}", "go": "x:=+}", "cs": "${", "rb": "puts1", "": "{"}[language]


def files(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, language string, text string")


def test_blocks_end_where_their_bracket_closes(spark):
    rows = [("rs", "fn a() { /* } */ }\nfn b();\nfn c(\n  x: [u8; 2],\n) {\n  if x { }\n}\nconst K: u8 = 1;\nstruct U\n"), ("go", "func f() {\n\tx := `{`\n}\nvar v = 1\nfunc g() {"), ("ts", "const a = 1\nfunction f() {\n}\n"), ("java", None), (None, "fn a() {}"), ("rb", "class A\n  def b\n    x if y\n  end; end\ndef c() = 1\n")]
    got = sorted((r["id"], r["name"], r["start"], r["end"]) for r in code.blocks(code.code_lines(files(spark, rows), "id")).collect())
    assert got == [(0, "K", 8, 8), (0, "U", 9, 9), (0, "a", 1, 1), (0, "b", 2, 2), (0, "c", 3, 7), (1, "f", 1, 3), (1, "g", 5, 5), (1, "v", 4, 4), (2, "a", 1, 1), (2, "f", 2, 3), (5, "A", 1, 4), (5, "b", 2, 4), (5, "c", 5, 5)]


def test_calls_are_resolved_by_scope(spark):
    text = """public class A {
    public int run(int a) { // help(1)
        return help(a) + other.help(a) + "help(2)".length() + gone(3);
    }
    private int help(int a) {
        return top(a);
    }
}
public class B {
    private int help(int a) {
        return help(a - 1);
    }
    private int top(int a) {
        return 0;
    }
}"""
    edges = code.call_edges(code.code_lines(files(spark, [("java", text)]), "id"))
    got = sorted(((r["caller"], r["callee"], r["line"], r["receiver"], r["target_start"]) for r in edges.collect()), key=str)
    # top is in another class: no scope around the call holds it
    assert got == sorted([("help", "help", 11, None, 10), ("run", "help", 3, None, 5), ("run", "help", 3, "other", 5)], key=str)
    found = {(r["receiver"], r["callee"]) for r in code.calls(code.code_lines(files(spark, [("java", text)]), "id")).collect()}
    assert found == {(None, "help"), ("other", "help"), (None, "length"), (None, "gone"), (None, "top")}
    assert code.call_edges(code.code_lines(files(spark, []), "id")).count() == 0


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_fences_are_closed_by_their_own_kind(spark):
    df = docs(spark, "```py\n~~~\n# x\n````\n# y", "~~~~\n```\n~~~\n~~~~ no\n~~~~\n# z\n``` a`b\n# w", "    ```\n# i", None, "")
    got = [(r["id"], r["language"], r["start"], r["end"], r["lines_of_code"]) for r in markdown.fences(df, "id").orderBy("id", "start").collect()]
    assert got == [(0, "py", 1, 4, 2), (1, "", 1, 5, 3)]
    assert sorted((r["id"], r["title"], r["end"]) for r in markdown.sections(df, "id").collect()) == [(0, "y", 5), (1, "w", 8), (1, "z", 7), (2, "i", 2)]


def test_tables(spark):
    df = docs(spark, "a | b\n--|--\n1 | 2\n\nx | y\n---\n", "p | q\n| a | b |\n|:-|-:|\n", "```\n| a |\n|---|\n```", "|a|\n|-|-|\n", "| a \\| b |\n| - |")
    got = [(r["id"], r["start"], r["end"], r["rows"], r["columns"]) for r in markdown.tables(df, "id").orderBy("id").collect()]
    assert got == [(0, 1, 3, 2, 2), (1, 2, 3, 1, 2), (4, 1, 2, 1, 1)]


def test_lists(spark):
    df = docs(spark, "- a\n- b\n* c\n\ntext\n  - not\n1. x\n   y\n\n   z\n3. w\n\n\nend", "---\n- - -\n***", "```\n- a\n```\n- b\n", "  indented\n")
    got = [(r["id"], r["start"], r["end"], r["type"], r["items"]) for r in markdown.lists(df, "id").orderBy("id", "start").collect()]
    assert got == [(0, 1, 2, "unordered", 2), (0, 3, 3, "unordered", 1), (0, 7, 11, "ordered", 2), (2, 4, 4, "unordered", 1)]


def test_links_belong_to_the_innermost_section(spark):
    df = docs(spark, "[top](a)\n# A\n![i](/p \"t\") [](#x)\n## B\n[b](http://h) [c]( )\n# C\n")
    got = [tuple(r)[1:] for r in markdown.links(df, "id").orderBy("line").collect()]
    assert sorted(got, key=str) == sorted([(1, "top", "a", "relative", False, None), (3, "i", '/p "t"', "absolute", True, "A"), (3, "", "#x", "anchor", False, "A"), (5, "b", "http://h", "external", False, "A > B")], key=str)
