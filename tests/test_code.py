"""Lexers, fragments and detection on source code."""

import pytest

from reprise import detector
from reprise.config import CloneConfig
from reprise.functions import lexers
from reprise.operators import reports
from reprise.sources import files

LOOPS = """package demo;

/** Two methods that do the same. */
public class Loops {

    public int sum(int[] values) {
        int total = 0;
        for (int value : values) {
            total += value;
        }
        return total;
    }

    public int other(int[] values) {
        int total = 0;
        for (int value : values) {
            total += value;
        }
        return total;
    }
}
"""


def names(text, lang, *types):
    language = lexers.language(lang)
    tokens = lexers.tokenize(text, language)
    return [(kind, " ".join(t.text for t in tokens[i : j + 1])) for kind, i, j in lexers.fragments(text, language, types)]


def test_java_members():
    text = """class A<T> { int x = f(3); Map<K, V> m = new HashMap<>() { void in() { } };
      A(int q) { super(q); } @Ann(v = 1) public <Q> List<Q> go(int a) throws E { run(() -> { x(); }); return null; }
      abstract void none(int z); static { init(); } int[] arr = { 1, 2 }; }"""
    kinds = [k for k, _ in names(text, "java", "method_declaration", "constructor_declaration")]
    assert kinds == ["method_declaration", "constructor_declaration", "method_declaration", "method_declaration"]


def test_java_enum_and_interface():
    text = "enum E { P(1) { int f() { return 2; } }, Q(2); E(int v) { } } interface I { int m(); default int d() { return 0; } }"
    found = names(text, "java", "method_declaration", "constructor_declaration")
    assert [k for k, _ in found] == ["method_declaration", "constructor_declaration", "method_declaration", "method_declaration"]
    assert found[0][1].startswith("int f")


@pytest.mark.parametrize(
    "lang, text, kind, count",
    [
        ("c", "#include <a.h>\nstatic int f(int a) { if (a) { return 1; } return 0; }\nstruct S { int x; };\nint t[] = { 1 };\nvoid h(void);", "function_definition", 1),
        ("cpp", "namespace n { class K : public B { public: K(int a) : x(a) { y(); } int m() const { return 1; } }; }", "function_definition", 2),
        ("js", "function a(x) { return x; }\nasync function b() { const c = function() { }; }\nexport function e() {}", "function_declaration", 3),
        ("js", "class K { constructor(a) { this.a = a; } get v() { return 1; } m(x) { return x; } }", "method_definition", 3),
        ("ts", "function a(x: number): number { return x; }", "function_declaration", 1),
        ("py", "@dec\ndef f(x,\n      y):\n    def g(): pass\n    return y\nclass C:\n    def m(self):\n        return 1\nx = 3", "function_definition", 3),
        ("py", "class C:\n    x = 1\n\nclass D(C): pass\n", "class_definition", 2),
        ("go", "package m\nfunc A(x int) (int, error) { f := func() { }; return 0, nil }\nfunc (s *S) M() interface{} { return s }", "function_declaration", 1),
        ("rs", "pub fn a<'a>(x: &'a str) -> i32 { match x { _ => 1 } }\nimpl S { pub(crate) fn m(&self) -> u8 { fn inner() {} 1 } }", "function_item", 3),
    ],
)
def test_functions(lang, text, kind, count):
    assert len(names(text, lang, kind)) == count


def test_whole_file_and_unknown_language():
    assert [k for k, _ in names("x = 1", "py", "module")] == ["module"]
    assert lexers.language("cobol") is lexers.JAVA


def test_unterminated_text_is_lexed():
    for lang in lexers.LANGUAGES:
        assert lexers.tokenize('f("abc\n /* x', lexers.language(lang)) is not None
        lexers.fragments("class A { void f( { } ) ] }", lexers.language(lang), ("method_declaration", "function_definition"))


def test_detection_in_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Loops.java").write_text(LOOPS)
    (tmp_path / "sub" / "notes.txt").write_text(LOOPS)
    config = CloneConfig(fragment_query="(method_declaration) @method", clone_token_threshold=20, index_git_files_only=False)
    found = detector.detect_folder(spark, str(tmp_path), config)
    got = [tuple(r) for r in found.select(*reports.RANGE).orderBy("start_line").collect()]
    assert got == [(5, 18, 11, 5), (13, 20, 19, 5)]
    out = str(tmp_path / "pairs")
    reports.write_pairs(found, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["sub,Loops.java,14,20,sub,Loops.java,6,12", "sub,Loops.java,6,12,sub,Loops.java,14,20"]


def test_blind_tokens_find_renamed_copies(spark):
    text = LOOPS.replace("total", "amount", 2).replace("= 0", "= 7", 1)
    docs = spark.createDataFrame([("f", text)], "uri string, text string")
    config = CloneConfig(fragment_query="(method_declaration) @method", clone_token_threshold=20)
    blind = CloneConfig(fragment_query="(method_declaration) @method", clone_token_threshold=20, blind_nodes=("identifier", "decimal_integer_literal"))
    assert detector.detect(docs, config).count() == 0
    assert detector.detect(docs, blind).count() == 2


def test_nested_fragments_of_one_type_are_left_to_the_outer_one(spark):
    docs = spark.createDataFrame([("f", "def a():\n    def b():\n        return 1\n    return b\n")], "uri string, text string")
    config = CloneConfig(language="py", fragment_query="(function_definition) @f")
    assert files.code_fragments(docs, config).count() == 2
    assert detector.prepared(docs, config).count() == 1


def test_ignored_tokens(spark):
    docs = spark.createDataFrame([("f", "def a():\n    return 1\n")], "uri string, text string")
    keep = CloneConfig(language="py", fragment_query="(module) @m", ignore_nodes=("(", ")"))
    assert detector.prepared(docs, keep).first().toks == ["def", "a", ":", "return", "1"]


def test_git_files(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("x = 2\n")
    (tmp_path / "c.txt").write_text("x\n")
    run("add", "a.py", "c.txt")
    assert [p.rpartition("/")[2] for p in files.git_files(str(tmp_path), "py")] == ["a.py"]
    assert files.scan_git(spark, str(tmp_path)).count() == 2


def test_change_lists(spark, tmp_path):
    for v, text in (("a", 'M "x/y.java"\nD "z.java"\n'), ("b", 'A "new file.java"\n# no\n')):
        (tmp_path / v).mkdir()
        (tmp_path / v / "changes").write_text(text)
    got = sorted(tuple(r) for r in files.read_changes(spark, str(tmp_path)).collect())
    assert got == [("a", "D", "z.java"), ("a", "M", "x/y.java"), ("b", "A", "new file.java")]


def test_options():
    c = CloneConfig.from_json('{"indexGitFilesOnly": false, "blind_nodes": ["a"], "language": null, "x": 1}')
    assert (c.index_git_files_only, c.blind_nodes, c.language) == (False, ("a",), "java")
    assert c.fragment_types == ("method_declaration", "constructor_declaration")
    assert CloneConfig.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        CloneConfig(clone_token_threshold=0)


@pytest.mark.parametrize(
    "lang, text, expected",
    [
        ("java", "class A { void f() { if (a) { x(); } else if (b) y(); else { z(); } for (int i : q) w(i); do { v(); } while (c); run(() -> { u(); }, k -> k + 1); } }",
         {"if_statement": 2, "for_statement": 1, "do_statement": 1, "while_statement": 0, "lambda_expression": 2, "block": 5}),
        ("js", "function f() { try { a(); } catch (e) { b(); } finally { c(); } while (d) e(); return x => x + 1; }", {"try_statement": 1, "while_statement": 1, "arrow_function": 1, "statement_block": 4}),
        ("c", "int f(int a) { while (a) { a--; } switch (a) { case 1: return 2; } return 0; }", {"while_statement": 1, "switch_statement": 1, "compound_statement": 3}),
        ("go", "func f() { if x := g(); x > 0 { h() } else { k() }\nfor i := range xs { m(i) } }", {"if_statement": 1, "for_statement": 1, "block": 4}),
        ("rs", "impl A for B { fn f() { for x in y { g(x); } match z { _ => {} } } }", {"for_expression": 1, "match_expression": 1}),
        ("py", "def f():\n    if a:\n        b()\n    else:\n        c()\n    for x in y:\n        d()\n    e()\n", {"if_statement": 1, "for_statement": 1, "block": 3}),
    ],
)
def test_statements_blocks_and_lambdas(lang, text, expected):
    assert {kind: len(names(text, lang, kind)) for kind in expected} == expected


def test_ends_of_statements():
    text = "class A { void f() { if (a) { x(); } else if (b) y(); else { z(); } for (int i : q) w(i); k(); } }"
    assert [t for _, t in names(text, "java", "if_statement")] == ["if ( a ) { x ( ) ; } else if ( b ) y ( ) ; else { z ( ) ; }", "if ( b ) y ( ) ; else { z ( ) ; }"]
    assert names(text, "java", "for_statement") == [("for_statement", "for ( int i : q ) w ( i ) ;")]


def test_unknown_fragment_types_raise():
    with pytest.raises(ValueError, match="no java nodes of type no_such_node"):
        files._lex(CloneConfig(fragment_query="(no_such_node) @x"))


def test_extra_nodes_are_tokens_in_front_of_what_is_in_them(spark):
    df = spark.createDataFrame([("file:///Loops.java", LOOPS)], "uri string, text string")
    counts = {}
    for extra in ((), ("for_statement", "block"), ("comment",)):
        config = CloneConfig(fragment_query="(method_declaration) @m", clone_token_threshold=10, index_git_files_only=False, extra_nodes=extra)
        rows = detector.prepared(df, config).collect()
        counts[extra] = [len(r.toks) for r in rows]
        if "block" in extra:
            at = next(k for k, t in enumerate(rows[0].tokens) if t.type == "for_statement")
            assert rows[0].tokens[at].text.startswith("for (int value") and rows[0].tokens[at + 1].type == "for" and not rows[0].tokens[at].leaf
    assert counts[("for_statement", "block")] == [n + 3 for n in counts[()]] and counts[("comment",)] == counts[()]
