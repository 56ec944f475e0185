import pytest
from pyspark.sql import functions as F

from tandem.functions import arrays as A
from tandem.functions import text as X
from tandem.functions.hashing import uniform
from tandem.operators import batches as B
from tandem.operators import layout as L
from tandem.operators import lexers as Z
from tandem.operators import noise as N
from tandem.operators import templates as P


def val(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_words_sees_unicode_blanks(spark):
    s = " a\u00a0b\u2003c\x1cd\u0085e "
    assert val(spark, X.words(F.col("s")), s=s) == s.split()


def test_docstring_tokens(spark):
    got = val(spark, X.docstring_tokens(F.col("s")), s="Returns foo.bar(x) == {} if a-b, else `[1]`...")
    assert got == ["Returns", "foo", ".", "bar", "(", "x", ")", "==", "{}", "if", "a", "-", "b", "else",
                   "[", "1", "]", "..."]


def test_mteval(spark):
    s = "Hello,  World! 3.14 a-\nb &lt;x&gt; &amp;lt; 5-6 end."
    assert " ".join(val(spark, X.mteval_tokens(F.col("s")), s=s)) == "hello , world ! 3.14 ab < x > & lt ; 5 - 6 end ."


def test_literals(spark):
    assert val(spark, X.literal_tokens(F.col("s"), X.C_FAMILY_SYMBOLS), s='"a b;\n{"') == '" a ▁ b ; STRNEWLINE { "'
    com = val(spark, X.literal_tokens(F.col("s"), X.C_FAMILY_SYMBOLS, comment=True), s="// -------- hi")
    assert com == "// ▁ - - - - - ▁ hi ENDCOM"
    assert val(spark, X.literal_tokens(F.col("s"), X.C_FAMILY_SYMBOLS, comment=True), s="// -- a") == ""
    assert val(spark, X.join_literal(F.col("s")), s="a ▁ b") == "a b"


def test_comments_and_strings(spark):
    s = 'int a; // it\'s\nchar *s = "// no"; /* x\ny */ b / c;\n\n'
    assert val(spark, X.strip_comments(F.col("s")), s=s) == 'int a;  \nchar *s = "// no";   b / c;'
    long = '"' + "x\\n" * 60000 + '"'
    assert val(spark, X.strip_comments(F.col("s")), s=long) == long


def test_prefixes_and_directives(spark):
    assert val(spark, X.strip_prefix(F.col("s"), ["private :", "public :"]), s="public : int f") == "int f"
    assert val(spark, X.strip_annotations(F.col("s")), s="@ Override @ Deprecated int f") == "int f"
    assert val(spark, X.strip_directives(F.col("s")), s="# include < a > # ifdef X int x ; # endif") == "int x ;"


def test_java_tokens(spark):
    code = 'int a = b[0x1F] + 1.5e3f; // c\nif (a >>= 2) { s = "x y"; /* d */ c = \'\\\'\'; }'
    got = val(spark, F.array_join(Z.c_tokens(F.col("s")), " "), s=code)
    assert got == 'int a = b [ 0x1F ] + 1.5e3f ; if ( a >>= 2 ) { s = " x ▁ y " ; c = \' \\\' \' ; }'
    kept = val(spark, F.array_join(Z.c_tokens(F.col("s"), True), " "), s="a; // note it\n b;")
    assert kept == "a ; // ▁ note ▁ it ENDCOM b ;"


def test_python_tokens(spark):
    ok = 'def f(a):\n    """doc"""\n    # c\n    if a:\n        """only"""\n    x = f"v {a}!"\n    return "p q"\n'
    df = spark.createDataFrame([(1, ok), (2, "x = ("), (3, "x = 'open\n")], "id long, code string")
    got = {r.id: r for r in Z.python_tokens(df, "id", "code").collect()}
    assert " ".join(got[1].tokens) == ('def f ( a ) : NEW_LINE INDENT if a : NEW_LINE x = f " v ▁ { a } ! " NEW_LINE '
                                       'return " p ▁ q " NEW_LINE DEDENT')
    assert got[1].stripped.split("\n")[0] == "def f(a):" and "doc" not in got[1].stripped and "#" not in got[1].stripped
    assert (got[2].status, got[3].status) == ("err", "err") and got[2].tokens is None


def test_python_levels_and_comments(spark):
    rows = [("if a:\n    if b:\n        c\nd\n",
             "if a : NEW_LINE INDENT if b : NEW_LINE INDENT c NEW_LINE DEDENT DEDENT d NEW_LINE"),
            ("f(a,\n  b)  # two words\n", "f ( a , b ) #"), ("if a:\n        b\n    c\n", None), ("a)\n", None),
            ("x = 1.5e3 ** y // 2\n", "x = 1.5e3 ** y // 2 NEW_LINE"), ("", ""), ("x = 'a", None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + [(99, None)], "id long, code string")
    got = {r.id: r for r in Z.python_tokens(df, "id", "code", keep_comments=True).collect()}
    assert len(got) == len(rows) + 1
    for i, (_, want) in enumerate(rows):
        assert got[i].status == ("err" if want is None else "ok")
        assert want is None or " ".join(got[i].tokens).startswith(want)


@pytest.mark.parametrize("code, types, names", [
    ("static int f ( )", ["None"], ["None"]),
    ("int f ( int a , String [ ] b )", ["int ", "String [ ]"], ["a", "b"]),
    ("f ( g ( x ) y , int z ) { h ( ) }", ["g ( x ) ", "int "], ["y", "z"])])
def test_arguments(spark, code, types, names):
    got = val(spark, A.argument_list(X.words(F.col("s"))), s=code)
    assert [g.type for g in got] == types and [g.name for g in got] == names


def test_names_and_types(spark):
    assert val(spark, A.name_before_paren(X.words(F.col("s"))), s="static int foo ( )") == "foo"
    assert val(spark, A.name_after_def(X.words(F.col("s"))), s="def bar ( x )") == "bar"
    assert val(spark, A.return_type(F.col("s")), s="static long foo ( )") == "long"
    assert val(spark, A.boxed_type(F.col("s")), s="char") == "Character"
    assert val(spark, A.boxed_type(F.col("s")), s="Foo") == "Foo"


def test_reindent(spark):
    df = spark.createDataFrame([(1, 'int f ( ) { if ( a ) { s = " x ▁ y " ; } else { b ; } } ; // ▁ z ENDCOM c ;')],
                               "id long, code string")
    assert L.reindent_braces(df, "id", "code").first().text.split("\n") == [
        "int f ( ) {", "  if ( a ) {", '    s = "x y" ;', "  }", "  else {", "    b ;", "  }", "};", "// z", "c ;", ""]
    py = "def f ( a ) : NEW_LINE INDENT if a : NEW_LINE INDENT x = ' p ▁ q ' NEW_LINE DEDENT DEDENT import . b NEW_LINE"
    df = spark.createDataFrame([(1, py)], "id long, code string")
    assert L.reindent_blocks(df, "id", "code").first().text.split("\n") == [
        "def f ( a ) :", "    if a :", "        x = 'p q'", "import .b", ""]


def test_templates(spark):
    script = "void main ( int a ) { } //TOFILL import javafx.util.Pair;"
    got = val(spark, P.fill_template(F.col("s"), F.lit("int go ( ) { go ( ) ; }"), F.lit("go"), "java"), s=script)
    assert got == "void main ( int a ) { } int f_filled ( ) { f_filled ( ) ; } // import javafx.util.Pair;"
    gold = "static int f_gold ( int arr [ ] , int n , string s , char c ) { } //TOFILL"
    mine = "int f ( vector<int> & arr , int n , char * s , string c )"
    got = val(spark, P.adapter(F.col("a"), F.col("b"), "cpp"), a=gold, b=mine)
    assert got.split("\n") == [
        "static int f_filled(int   param0 [ ], int param1, string param2, char param3)", "{",
        "vector<int>  vect_param0(param0, param0 + param1);", "char char_arr_param2[param2.length() + 1];",
        "strcopy(char_arr_param2, param2.c_str());", "string string_param3(param3);",
        "return f_filled_inner(vect_param0,param1,char_arr_param2,string_param3);", "}"]
    assert val(spark, P.adapter(F.col("a"), F.col("a"), "cpp"), a=gold) is None
    none = val(spark, P.adapter(F.col("a"), F.col("b"), "cpp"), a="int g ( int n , int a [ ] )", b="int f ( int n , vector<int> a )")
    assert none is None  # no length argument after the array
    java = val(spark, P.adapter(F.col("a"), F.col("b"), "java"), a="static int g ( int a , String s )",
               b="static long f ( Integer a , char [ ] s )")
    assert "return (int) f_filled_inner(Integer.valueOf(param0),param1.toCharArray());" in java


def test_adapted_script_and_flags(spark):
    script = "static int f_gold ( int a ) { } //TOFILL"
    f = "static long go ( Integer a ) { return a ; }"
    got = val(spark, P.fill_adapted(F.col("s"), F.col("f"), F.lit("go"), F.col("f"), "java"), s=script, f=f)
    assert got.startswith("static int f_gold ( int a ) { } static long f_filled_inner ( Integer a ) { return a ; }\n\n\n"
                          "static int f_filled(int param0)\n{\nreturn (int) f_filled_inner(Integer.valueOf(param0));\n}")
    flags = spark.createDataFrame([("ON",), ("0",), ("maybe",)], ["s"]).select(X.parse_flag(F.col("s")).alias("x"))
    assert [r.x for r in flags.collect()] == [True, False, None]


def test_special_tokens(spark):
    t = F.array(*[F.lit(x) for x in "a b c d </s>".split()])
    assert val(spark, A.truncate_with_end(t, 3, F.lit("</s>"))) == ["a", "b", "</s>"]
    assert val(spark, A.frame(t, 10, "</s>", append="[x]")) == ["a", "b", "c", "d", "</s>", "[x]"]
    assert val(spark, A.frame(t, 3, "</s>", prepend="<s>")) == ["<s>", "a", "b", "</s>"]
    assert val(spark, A.shift_right(t)) == ["</s>", "a", "b", "c", "d"]
    assert val(spark, A.pad(t, F.lit(7), F.lit("_"), True))[:2] == ["_", "_"]


def test_schedule(spark):
    points = B.parse_schedule("0:0,1000:0,2000:1")
    got = [val(spark, B.schedule(F.lit(s), points)) for s in (0, 1500, 2000, 9999)]
    assert got == [0.0, 0.5, 1.0, 1.0]
    assert val(spark, B.schedule(F.lit(5), B.parse_schedule("3"))) == 3.0


def test_uniform_draws_look_uniform(spark):
    df = spark.range(200000).select(uniform(1, F.col("id")).alias("u"), uniform(1, F.col("id") + 1).alias("v"))
    r = df.agg(F.avg("u").alias("m"), F.stddev("u").alias("s"), F.corr("u", "v").alias("c"), F.min("u"), F.max("u")).first()
    assert abs(r.m - 0.5) < 0.005 and abs(r.s - 0.2887) < 0.005 and abs(r.c) < 0.02


def test_noise(spark):
    row = ["<s>"] + [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(7, row)], "id long, t array<string>")
    got = df.select(A.local_shuffle(F.col("t"), 3.0, 1, F.col("id")).alias("s"),
                    A.drop_tokens(F.col("t"), 0.3, 1, F.col("id")).alias("d"),
                    A.drop_tokens(F.col("t"), 1.0, 1, F.col("id")).alias("all"),
                    A.blank_tokens(F.col("t"), 0.25, "#", 1, F.col("id")).alias("b")).first()
    assert sorted(got.s) == sorted(row) and got.s[0] == "<s>" and got.s != row
    assert all(abs(i - row.index(w)) <= 3 for i, w in enumerate(got.s))
    assert 230 < len(got.d) < 330 and len(getattr(got, "all")) == 2
    assert len(got.b) == len(row) and 60 < got.b.count("#") < 140


def test_span_noise(spark):
    df = spark.createDataFrame([(i, [2] + list(range(1000, 1000 + 10 * i)) + [2]) for i in range(40)],
                               "id long, ids array<bigint>")
    once = {r.id: r.ids for r in N.mask_spans(df, "id", "ids", seed=3).collect()}
    again = {r.id: r.ids for r in N.mask_spans(df.repartition(7), "id", "ids", seed=3).collect()}
    assert once == again
    assert once[0] == [2, 2] and all(v[0] == v[-1] == 2 for v in once.values())
    big = once[39]
    assert 5 in big and len(big) < 392
    kept = [x for x in big if 1000 <= x < 1390]
    assert len(kept) > 0.7 * 390


def test_span_noise_of_a_very_long_row(spark):
    n = 80000
    df = spark.range(1).select("id", F.concat(F.array(F.lit(2)), F.sequence(F.lit(100), F.lit(n)), F.array(F.lit(2)))
                               .cast("array<bigint>").alias("ids"))
    got = N.mask_spans(df, "id", "ids", seed=3).first().ids
    assert got[0] == got[-1] == 2 and 0.9 * n < len(got) < n and 0.04 * n < got.count(5) < 0.15 * n
    kept = [x for x in got if 100 <= x <= n]
    assert sum(a < b for a, b in zip(kept, kept[1:])) > 0.95 * len(kept)


def test_span_noise_of_rows_without_ids(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [2, 2]), (4, [2])], "id long, ids array<bigint>")
    got = {r.id: r.ids for r in N.mask_spans(df, "id", "ids", seed=3).collect()}
    assert got == {1: [], 2: None, 3: [2, 2], 4: [2]}


def test_adapter_reads_each_source_once(spark):
    df = spark.createDataFrame([("static int g ( int [ ] a , String s , x [ ] [ ] y , [ ] z [ ] , int  [ ]  w )", "static long f ( char a )")],
                               "a string, b string")
    plan = df.select(P.adapter(F.col("a"), F.col("b"), "java").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace") == 4  # the tokens and the return type of each; there were 18 splits
    args = df.select(F.inline(A.argument_list(X.words(F.col("a"))))).collect()
    assert [tuple(r) for r in args] == [("int [ ]", "a"), ("String ", "s"), ("x [ ] [ ]", "y"), ("[ ] z [ [ ] [ ]", "]"), ("int [ ]", "w")]
    got = df.select(P.adapter(F.col("a"), F.col("b"), "java")).first()[0]
    assert "f_filled(int   param0 [ ], String param1, x     param2 [ ][ ]," in got
    cells = [(" a b\u0085c\x1fd\t\ne ",), ("",), (None,), ("\n",)]
    got = spark.createDataFrame(cells, "t string").select(X.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [list("abcde"), [], None, []]
