"""The scanner of code, and symbols of languages with braces, on fixtures in several languages."""

import pytest

from graphlens.sources import lexer, parse


def code(source, language):
    out = lexer.scan(source, language)
    assert len(out.code) == len(source) and out.code.count("\n") == source.count("\n")
    return out.code.split()


@pytest.mark.parametrize(
    ("language", "source", "left"),
    [
        ("c", 'int a; /* not { here */ char *s = "x { \\" y"; // tail {\nint b;', "int a; char *s = ; int b;"),
        ("cpp", 'auto s = R"d(raw " ) { // )d"; int x = 1\'000;', "auto s = ; int x = 1'000;"),
        ("c", "char c = '{'; char q = '\\''; int z;", "char c = ; char q = ; int z;"),
        ("java", 'String s = """\n  text " {\n  """; int a;', "String s = ; int a;"),
        ("javascript", "let s = `a ${b + `in ${c}` + d} e`; f();", "let s = b + c + d ; f();"),
        ("javascript", "let r = /[/{]\\/x/g; a = b / c / d; // no", "let r = ; a = b / c / d;"),
        ("go", "s := `raw \\` + x + \"q\\\"\" + 'c'", "s := + x + +"),
        ("rust", "fn f<'a>(x: &'a str) { r#\"raw \" }\"#; '{'; /* a /* b */ c */ y }", "fn f<'a>(x: &'a str) { ; ; y }"),
        ("swift", 'let s = "a \\(b + f("c")) d"; let t = #"x \\(no)"#', "let s = b + f( ) ; let t ="),
        ("kotlin", 'val s = """raw "x" ${y.z { it }} end"""; val c = \'"\'', "val s = y.z { it } ; val c ="),
        ("c_sharp", 'var s = @"a "" b"; var t = $"x {y} z"; int k;', "var s = ; var t = y ; int k;"),
        ("php", "$a = 'x'; # no\n$b = \"y\n z\"; // no", "$a = ; $b = ;"),
        ("python", 'x = """a\n# b""" + y  # c\nz = \'#\' + w', "x = + y z = + w"),
        ("ruby", 'x = "a #{b + "c"} d" # e', "x = b +"),
        ("lua", "x = [==[ a ]] ]==] --[[ b\n]] y = 'c' -- d", "x = y ="),
        ("haskell", 'f = g {- a {- b -} c -} "d" -- e', "f = g"),
        ("unknown", 'x = "a"', 'x = "a"'),
        ("java", 'String open = "never closed {\nint a; /* open to the end', "String open = int a;"),
        ("javascript", "`open ${a", "a"),
        ("c", "", ""),
    ],
)
def test_code_without_strings_and_comments(language, source, left):
    assert code(source, language) == left.split()


def test_pairs():
    source = 'f() { if (x) { "}" } /* } */ } {'
    assert lexer.scan(source, "c").pairs == [(source.index("{"), 29), (13, 19), (31, len(source))]


FIXTURES = {
    "java": ('package p;\n\npublic class Order {\n    private int n = f("{");\n\n    public Order(int n) {\n        this.n = n;\n    }\n\n    public int total(List<Item> items) throws E {\n        for (Item i : items) {\n            n += i.price(); // }\n        }\n        return n;\n    }\n\n    interface Inner {\n        int one();\n    }\n}\n',
             [("Order", "class", 3, 20), ("Order", "method", 6, 8), ("total", "method", 10, 15), ("Inner", "class", 17, 19)]),
    "go": ('package p\n\ntype Order struct {\n\tn int\n}\n\nfunc (o *Order) Total(x int) int {\n\tif x > 0 {\n\t\treturn len("}")\n\t}\n\treturn o.n\n}\n\nfunc main() {\n\tprintln(`}`)\n}\n', [("Order", "class", 3, 5), ("Total", "function", 7, 12), ("main", "function", 14, 16)]),
    "rust": ("pub struct Order { n: i32 }\n\nimpl Order {\n    pub fn total(&self) -> i32 {\n        let c = '}';\n        self.n\n    }\n}\n\nfn free<'a>(x: &'a str) {\n    loop { break; }\n}\n\ntrait Named {\n    fn name(&self) -> String;\n}\n",
             [("Order", "class", 1, 1), ("Order", "class", 3, 8), ("total", "method", 4, 7), ("free", "function", 10, 12), ("Named", "class", 14, 16), ("name", "method", 15, 15)]),
    "typescript": ('export class Cart {\n  add(item: Item): void {\n    this.items.push({ item, note: `}${item.name}` });\n  }\n}\n\nexport async function load(url: string): Promise<Cart> {\n  if (!url) {\n    throw new Error("no {");\n  }\n  return fetch(url).then((r) => { return r.json(); });\n}\n\ninterface Item {\n  name: string;\n}\n',
                   [("Cart", "class", 1, 5), ("add", "method", 2, 4), ("load", "function", 7, 12), ("Item", "class", 14, 16)]),
    "c": ('#include "x.h"\n\nstruct point {\n    int x;\n};\n\nint add(int a, int b);\n\nstatic int\nadd(int a, int b)\n{\n    if (a) {\n        return call("{", b);\n    }\n    return a + b;\n}\n', [("point", "class", 3, 5), ("add", "function", 10, 16)]),
    "kotlin": ('data class Order(val n: Int) {\n    fun total(): Int {\n        return items.map { it.price }.sum()\n    }\n    fun short() = n\n}\n\nobject Main {\n    fun run() {\n        println("${"}"}")\n    }\n}\n', [("Order", "class", 1, 6), ("total", "method", 2, 4), ("short", "method", 5, 5), ("Main", "class", 8, 12), ("run", "method", 9, 11)]),
    "swift": ('struct Order: Named {\n    func total() -> Int {\n        return items.reduce(0) { $0 + $1 }\n    }\n}\n\nprotocol Named {\n    func name() -> String\n}\n', [("Order", "class", 1, 5), ("total", "method", 2, 4), ("Named", "class", 7, 9), ("name", "method", 8, 8)]),
    "c_sharp": ('namespace N\n{\n    public sealed class Order\n    {\n        public int Total(int n)\n        {\n            var s = @"}""";\n            return n;\n        }\n    }\n}\n', [("Order", "class", 3, 10), ("Total", "method", 5, 9)]),
}


@pytest.mark.parametrize("language", sorted(FIXTURES))
def test_symbols_by_braces(language):
    source, want = FIXTURES[language]
    got = [(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in parse.symbols_of(source, language)]
    assert got == want


def test_identifiers_of_code(spark):
    rows = spark.createDataFrame([(1, 'int total = call("hidden", x1); // gone', "java"), (2, "y = '''none''' + other  # gone", "python"), (3, None, "c"), (4, "left as 'it' is", "")], "id int, code string, language string")
    got = {r.id: sorted(r.identifiers) for r in parse.code_identifiers(rows, ["id"]).collect()}
    assert got == {1: ["call", "total", "x1"], 2: ["other"], 3: [], 4: ["it", "left"]}


def test_a_language_for_files_without_one(spark):
    files = spark.createDataFrame([("r", "script", "def go():\n    pass\n"), ("r", "b.go", "func run() {\n}\n")], "repo string, path string, content string")
    assert [r.name for r in parse.symbols(files).collect()] == ["run"]
    assert sorted(r.name for r in parse.symbols(files, "python").collect()) == ["go", "run"]


def test_long_sources_take_linear_time():
    import time

    source = 'void f() { g("' + "x" * 200_000 + '"); }\n' + "/* " + "* " * 100_000 + "*/\n" + "int a = 1;\n" * 20_000
    began = time.time()
    assert len(lexer.scan(source, "c").code) == len(source)
    assert time.time() - began < 20
