import pytest
from pyspark.sql import functions as F

from commitlens.operators import scan
from commitlens.languages import REGISTRY, register, supported


def got(lang, text):
    return [(f.line, f.name) for f in REGISTRY[lang].extract(text)]


RUST = {
    "none": ("struct y {}\n", []),
    "one": ("fn alone() {}\n", [(1, "alone")]),
    "closure": ("fn first() {}\n\nfn second() {\n    let inner = || {};\n}\n", [(1, "first"), (3, "second"), (4, "inner")]),
    "methods": ("struct y {}\nimpl y {\n    fn a() {}\n    fn b(&self) -> [u8; 4] { let c = move |q| q; [0; 4] }\n}\n", [(3, "a"), (4, "b"), (4, "c")]),
    "signature": ("trait T { fn no(&self); fn yes(&self) {} }", [(1, "yes")]),
    "nested comment": ("/* a /* fn x() {} */ fn y() {} */ fn z() {}", [(1, "z")]),
    "strings": ('fn a() { let s = "fn b() {}"; let t = r#"fn c() { " }"#; }\nfn d<\'a>(x: &\'a str) {}', [(1, "a"), (2, "d")]),
    "macros": ("macro_rules! m { () => { fn no() {} } }\nfn a() { vec![|x| x]; println!(\"{}\", 1); }\n#[cfg(fn_x)] fn b() {}", [(2, "a"), (3, "b")]),
    "let forms": ("fn a() { let mut f = |x| x; let g: Box<dyn Fn(i32) -> i32> = Box::new(|x| x); let h: fn() = || (); if let i = || 1 {} let (j, k) = (|| 1, 2); call(|z| z); }", [(1, "a"), (1, "f"), (1, "h")]),
    "or pattern": ("fn a() { let b = 1 | 2; match b { 1 | 2 => {} _ => {} } }", [(1, "a")]),
    "broken": ("fn a() { ) \nfn b() {}\n", [(1, "a"), (2, "b")]),
    "name line": ("fn\n  below\n() {}", [(2, "below")]),
}
GO = {
    "none": ("package p\n", []),
    "one": ("package p\n\nfunc One() {}\n", [(3, "One")]),
    "literal": ("package p\nfunc A() {}\nfunc B() {\n\tinner := func() {}\n\t_ = inner\n}\n", [(2, "A"), (3, "B"), (4, "inner")]),
    "list": ("package p\nfunc A() {\n\ta, b := func() {}, 1\n\tc := 1\n\td := func() int { return 1 }()\n\te, f := 1, func(x int) {}\n}", [(2, "A"), (3, "a, b"), (6, "e, f")]),
    "deeper": ("package p\nvar v = func() {}\nfunc A() {\n\tif x := func() {}; true {\n\t\ty := func() {}\n\t}\n\tvar z = func() {}\n\tw := func() { q := func() {} }\n}", [(3, "A"), (8, "w")]),
    "interface": ("package p\ntype I interface {\n\tM() int\n}\nfunc F(x interface{}, y struct{ a int }) (r map[string]int) {\n\tg := func() {}\n}\n", [(5, "F"), (6, "g")]),
    "generic": ("package p\nfunc Map[K comparable, V any](m map[K]V) []V {\n\th := func() {}\n\treturn nil\n}", [(2, "Map"), (3, "h")]),
    "comments": ("package p\n// func No() {}\n/* func No() {} */\nvar s = `\nfunc No() {}\n`\nfunc Yes() {}", [(7, "Yes")]),
    "no body": ("package p\nfunc ext(x int) int\nfunc B() {}", [(2, "ext"), (3, "B")]),
}
LUA = {
    "none": ("local a = 10\n", []),
    "one": ("local a = 10\n\nlocal function f() end\n", [(3, "f")]),
    "many": ("function a() end\nfunction b() end\n\nlocal M = {}\nM.c = function() end\n", [(1, "a"), (2, "b"), (5, "c")]),
    "methods": ("local M = {}\n\nM.a = function() end\n\nfunction M.b() end\n\nfunction M:c()\n  M.d = function() end\nend\n", [(3, "a"), (5, "b"), (7, "c"), (8, "d")]),
    "local": ("local f = function() return 1 end\nlocal g <const> = function() end\nh = function() end", [(1, "f"), (2, "g")]),
    "long targets": ("a.b.c = function() end\nfunction a.b.d() end\nfunction a.b:e() end\nT['f'] = function() end\nlocal t = { g = function() end }", []),
    "text": ("--[[ function a() end ]]\n--[==[ function b() end ]] ]==]\nlocal s = [[ function c() end ]]\n-- function d() end\nfunction e() end", [(5, "e")]),
    "binary": ("M.a = function() end or nil\nM.b = x or function() end\nM.c = function() if x then y() end for i = 1, 2 do z() end repeat until w end", [(3, "c")]),
    "comparison": ("if M.a == function_x then end", []),
}


@pytest.mark.parametrize("lang, case", [(lang, c) for lang, cases in (("rust", RUST), ("go", GO), ("lua", LUA)) for c in cases])
def test_extract(lang, case):
    text, want = {"rust": RUST, "go": GO, "lua": LUA}[lang][case]
    assert got(lang, text) == want


def test_go_receivers():
    text = "package p\ntype x struct{}\nfunc (x) A() {}\nfunc (*x) B() {\n\tn := func() {}\n}\nfunc (f *x) C() {}\n"
    assert [(f.line, f.name, f.receiver, f.capture_index) for f in REGISTRY["go"].extract(text)] == [
        (3, "A", "(x)", 1), (4, "B", "(*x)", 1), (5, "n", None, 1), (7, "C", "(f *x)", 1)]


@pytest.mark.parametrize("lang", REGISTRY)
@pytest.mark.parametrize("text", ["", "\n", "((((", "}}}}", "func", "fn", "function", "func (", "let x =", "local", "'", '"', "/*", "--[[", "func a(", "a.b =", "é ß", "\0"])
def test_broken_text_never_fails(lang, text):
    assert got(lang, text) in ([], [(1, "a")])


def test_file_set(spark, tmp_path):
    (tmp_path / "a.rs").write_text("fn a() {}\nfn skip_me() {}\n")
    (tmp_path / "b.rs").write_text("fn b() {}\n")
    files = scan.FileSet("rust", str(tmp_path))
    with pytest.raises(scan.NoFiles):
        files.find_functions(spark)
    files.add_file("a.rs", "rust")
    files.add_file("b.rs", "rust")
    with pytest.raises(scan.NotCompatible):
        files.add_file("missing.go", "go")
    files.filter_name("skip")
    assert sorted((r.file, r.line, r.name, r.capture_index) for r in files.find_functions(spark).collect()) == [("a.rs", 1, "a", 0), ("b.rs", 1, "b", 0)]


def test_a_language_is_added_in_one_place(spark, monkeypatch):
    from commitlens.functions import names
    from commitlens.operators.extract.lexer import Found

    monkeypatch.setitem(REGISTRY, "shell", None)
    register("shell", ("sh", "bash"), lambda text: [Found(k + 1, x.split("(")[0]) for k, x in enumerate(text.split("\n")) if "()" in x])
    df = spark.createDataFrame([("a.sh", b"f() {\n}\ng() { :; }"), ("b.bash", b""), ("c.zsh", b"h() {}")], "path string, content binary")
    df = df.withColumn("lang", names.lang_of(F.col("path")))
    assert supported("shell") and not supported("zsh")
    assert sorted((r.file, r.line, r.name) for r in scan.elements(scan.scan_sources(df)).collect()) == [("a.sh", 1, "f"), ("a.sh", 3, "g")]


def test_scan_sources(spark):
    rows = [("m.go", "go", b"package p\nfunc (f *x) C() {}\nfunc D() {}\n"), ("bad.rs", "rust", b"fn a() {} // \xff"), ("none.lua", "lua", None), ("t.txt", "undefined", b"fn a() {}"), ("e.rs", "rust", b"")]
    scanned = scan.scan_sources(spark.createDataFrame(rows, "path string, lang string, content binary"))
    assert {(r.file, r.status) for r in scanned.collect()} == {("m.go", "ok"), ("bad.rs", "not_utf8"), ("none.lua", "unreadable")}
    assert sorted((r.file, r.line, r.name, r.capture_index) for r in scan.elements(scanned).collect()) == [("m.go", 2, "(*x) C", 1), ("m.go", 3, "D", 1)]
    assert [r.name for r in scan.elements(scanned, ("(*x)",)).collect()] == ["D"]
    assert {(r.file, r.status) for r in scan.problems(scanned).collect()} == {("bad.rs", "not_utf8"), ("none.lua", "unreadable")}
    assert [tuple(r) for r in scan.redacted(scanned, ("(*x)",)).collect()] == [("go", 2, 1)]
