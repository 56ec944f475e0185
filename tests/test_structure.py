from pyspark.sql import functions as F

from tandem.functions.text import words
from tandem.operators import structure as S
from tandem.operators import trees as N


def spans(spark, fn, codes, **kw):
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string").select("id", words(F.col("code")).alias("t"))
    out = fn(df, "id", "t", **kw).orderBy("id", "start").collect()
    return [(r.id, r.kind, r.function) for r in out]


def test_java_functions(spark):
    got = spans(spark, S.brace_spans, [
        "import a ; class A { @ Override public int f ( int x ) { if ( x ) { y ( ) ; } } static void g ( ) throws E { z ; } int h ; } end end",
        "int first ( ) { x ; } ; int second ( ) { y ; } end end end",
        "a ; /* note } */ int f ( ) { b ; } end ; // say ENDCOM int g ( ) { c ; } end end",
        "a ; int f ( ) { b ; ( ) { c"])
    assert got == [
        (0, "class", "public int f ( int x ) { if ( x ) { y ( ) ; } }"),
        (0, "standalone", "static void g ( ) throws E { z ; }"),
        (2, "class", "/* note } */ int f ( ) { b ; }"),
        (2, "class", "// say ENDCOM int g ( ) { c ; }"),
        (3, "class", "int f ( ) { b ; ( ) { c")]


def test_line_ends_before_a_body(spark):
    got = spans(spark, S.brace_spans, ["; static int f ( int a ) NEW_LINE { b ; NEW_LINE } end end",
                                       "; int g ( ) throws NEW_LINE E NEW_LINE { c ; } end", "; int h ( ) { } NEW_LINE NEW_LINE NEW_LINE"])
    assert got == [(0, "standalone", "static int f ( int a ) NEW_LINE { b ; NEW_LINE }"),
                   (1, "class", "int g ( ) throws NEW_LINE E NEW_LINE { c ; }")]


def test_edges_at_one_position_stay_apart(spark):
    e = edges(spark, [(0, "a", "comesFrom", [], []), (5, "b", "computedFrom", ["a"], [0]), (5, "c", "computedFrom", ["a", "d"], [0, 1]),
                      (5, "b", "computedFrom", ["a"], [0])])
    got = sorted((r.pos, r["var"], r.parents) for r in S.alpha_rename(e, ["pair"]).collect())
    assert got == [(0, "var_0", []), (5, "var_1", ["var_0"]), (5, "var_1", ["var_0"]), (5, "var_3", ["var_0", "var_2"])]


def test_cpp_functions(spark):
    got = spans(spark, S.brace_spans, [
        "using namespace std ; int f ( int x ) { g ( ) ; } void A :: m ( ) { h ; } class B { int k ( ) { return 1 ; } static int s ( ) { return 2 ; } } ; void e ( ) { }"],
        language="cpp")
    assert [(k, f.split(" (")[0]) for _, k, f in got] == [
        ("standalone", "int f"), ("class", "void A :: m"), ("class", "int k"), ("standalone", "static int s")]


def test_python_functions(spark):
    got = spans(spark, S.indent_spans, [
        "import a NEW_LINE def f ( x ) : NEW_LINE INDENT def g ( ) : NEW_LINE INDENT y NEW_LINE DEDENT z NEW_LINE DEDENT "
        "class A : NEW_LINE INDENT def m ( self ) : NEW_LINE INDENT w NEW_LINE DEDENT DEDENT",
        "def p ( ) : NEW_LINE INDENT print x NEW_LINE DEDENT def q ( ) : NEW_LINE INDENT k NEW_LINE DEDENT",
        "def open ( ) : NEW_LINE INDENT a NEW_LINE def inner ( ) : NEW_LINE INDENT b NEW_LINE DEDENT"])
    assert got == [
        (0, "standalone", "def f ( x ) : NEW_LINE INDENT def g ( ) : NEW_LINE INDENT y NEW_LINE DEDENT z NEW_LINE DEDENT"),
        (0, "class", "def m ( self ) : NEW_LINE INDENT w NEW_LINE DEDENT"),
        (1, "standalone", "def q ( ) : NEW_LINE INDENT k NEW_LINE DEDENT")]


def edges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows],
                                 "pair long, pos int, var string, rel string, parents array<string>, parent_pos array<int>")


def test_edges(spark):
    e = edges(spark, [(0, "a", "comesFrom", [], []), (3, "b", "computedFrom", ["a"], [0]), (5, "c", "comesFrom", [], []),
                      (3, "b", "computedFrom", ["c", "a"], [1, 0])])
    assert sorted(r.pos for r in S.prune_edges(e, ["pair"]).collect()) == [0, 3, 3]
    merged = {r.pos: r for r in S.merge_edges(e, ["pair"]).collect()}
    assert merged[3].parents == ["a", "c"] and merged[3].parent_pos == [0, 1] and merged[5].parents == []
    named = {r.pos: (r["var"], r.parents) for r in S.alpha_rename(S.merge_edges(e, ["pair"]), ["pair"]).collect()}
    assert named == {0: ("var_0", []), 3: ("var_2", ["var_0", "var_1"]), 5: ("var_1", [])}


def test_last_definition(spark):
    df = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (1, 2, "a", False), (1, 3, "a", True),
                                (1, 4, "a", False), (1, 5, "b", False)], "doc long, pos int, name string, def boolean")
    got = S.last_definition(df, ["doc"], "pos", "name", F.col("def")).orderBy("pos").collect()
    assert [r.def_pos for r in got] == [0, 1, 0, 0, 3, 1]


def test_subtrees(spark):
    codes = ["f ( a , [ 1 ] ) { return g ( b ) ; }", "h ( x , [ 22 ] ) { return k ( y ) ; }", "( [ ) ] a", "", "if x : NEW_LINE INDENT y ( ) NEW_LINE DEDENT"]
    df = spark.createDataFrame([*enumerate(codes), (9, None)], "id long, code string").select("id", words(F.col("code")).alias("t"))
    rows = N.subtrees(df, "id", "t", ["return", "if"]).collect()
    shapes = {i: sorted((r.depth, r.start, r.stop, r.digest) for r in rows if r.id == i) for i in (*range(5), 9)}
    assert [x[:3] for x in shapes[0]] == [(0, 0, 15), (1, 1, 7), (1, 8, 15), (2, 4, 6), (2, 11, 13)]
    assert shapes[0] == shapes[1] and shapes[3] == shapes[9] == []
    assert [x[:3] for x in shapes[2]] == [(0, 0, 4)]  # what is not closed in its level is no node
    assert [x[:3] for x in shapes[4]] == [(0, 0, 9), (1, 4, 9), (2, 6, 7)]
    parens = {r.digest for r in rows if r.id == 4 and r.depth == 2}
    assert parens == {r.digest for r in N.subtrees(df.filter("id = 4").select("id", F.array(F.lit("("), F.lit(")")).alias("t")), "id", "t", []).collect()
                      if r.depth == 1}


def test_sole_function(spark):
    df = spark.createDataFrame([(1, "class", "a"), (2, "standalone", "b"), (3, "class", "c"), (3, "standalone", "d")],
                               "id long, kind string, function string")
    assert {r.id for r in S.sole_function(df, "id").collect()} == {1, 2}
    assert [r.function for r in S.sole_function(df, "id", standalone_only=True).collect()] == ["b"]
