"""Every operator of the report on the test tables, which hold neither sources nor history, with the same in SQL.

Sources are made from rows of ``part``: a Rust, Go or Lua file for each, whose
functions, and what only looks like one, stand at known lines. Logs are made
from ``lineitem``. What goes over them are the operators themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions import history_text, names, predicates
from commitlens.operators import report, scan
from commitlens.sources import tree

#: The path of a URL.
_PATH = "^https?://[^/]+(/[^?#]*)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_prefix(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("path"))
    return pages.where(predicates.has_prefix(F.col("path"), ("/en", "/fr")))


def invert_match(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(predicates.contains_none(F.col("url"), ("page=", "#top"))).select("page_id")


def hidden_file(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where(predicates.is_visible(F.regexp_extract("url", _PATH, 1))).select("page_id")


def exclude_name(spark, sf_dir):
    return _table(spark, sf_dir, "part").where(predicates.contains_none(F.col("p_name"), ("red", "ring"))).select("p_partkey")


def path_language(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("rs", "go", "lua", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("./src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ext)
    return _table(spark, sf_dir, "part").select("p_partkey", names.lang_of(path).alias("lang"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tree_scan(spark, sf_dir):
    """The folder of the tables as a source tree; a table of several files is its folder, once; other files are left out."""
    files = tree.scan(spark, sf_dir, [f"./{t}.parquet" for t in _TABLES])
    tables = files.select(F.substring_index("path", "/", 2).alias("path")).distinct()
    return tables.withColumn("lang", names.lang_of(F.col("path")))


def lang_map(spark, sf_dir):
    """Documents as files whose extension their language gives; those of supported languages stay."""
    path = F.concat(F.lit("./d"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("lang") == "en", "rs").when(F.col("lang") == "fr", "go").when(F.col("lang") == "de", "lua").otherwise("txt"))
    files = _table(spark, sf_dir, "documents").select("doc_id", names.lang_of(path).alias("lang"))
    return files.where(predicates.is_supported(F.col("lang")))


#: Lines of the made files, by language. N is the part's key, W the first word of its name.
_RUST = (
    "// fn comment_N() {}",
    "pub struct S_N;",
    "impl S_N {",
    "    fn method_N(&self) -> [u8; 4] { let inner_N = move |q| q; [0; 4] }",
    "}",
    "trait T_N { fn absent_N(&self); fn given_N(&self) {} }",
    'const TEXT: &str = r#"fn text_N() {"#;',
    "macro_rules! made_N { () => { fn expanded_N() {} } }",
    "fn W_N<'a>(x: &'a str) { let (a, b) = (|| 1, 2); call(|z| z);",
    "    let mut bound_N = |x| x;",
    "}",
)
_GO = (
    "package p",
    "type x struct{}",
    "// func comment_N() {}",
    "func One_N() {}",
    "func (x) Value_N() {}",
    "func (*x) Pointer_N() {",
    "\tinner_N := func() {}",
    "\tif true { deep_N := func() {}; _ = deep_N }",
    "}",
    "func (g *G[K, V]) W_N(y interface{}) (r map[string]int) {",
    "\ta_N, b_N := func() {}, 1",
    "}",
    "var v_N = func() {}",
    "type I_N interface {",
    "\tSpec_N() int",
    "}",
)
_LUA = (
    "local M = {}",
    "-- function comment_N() end",
    "function plain_N() end",
    "local function own_N() end",
    "local bound_N = function() end",
    "M.W_N = function() M.nested_N = function() end end",
    "function M.dotted_N() end",
    "function M:colon_N() end",
    "a.b.long_N = function() end",
    "M['index_N'] = function() end",
    "local text = [[ function text_N() end ]]",
    "global_N = function() end",
)
#: What of it is a function: line and shown name.
_RUST_FOUND = ((4, "method_N"), (4, "inner_N"), (6, "given_N"), (9, "W_N"), (10, "bound_N"))
_GO_FOUND = ((4, "One_N"), (5, "(x) Value_N"), (6, "(*x) Pointer_N"), (7, "inner_N"), (10, "(*G[K, W_N"), (11, "a_N, b_N"))
_LUA_FOUND = ((3, "plain_N"), (4, "own_N"), (5, "bound_N"), (6, "W_N"), (6, "nested_N"), (7, "dotted_N"), (8, "colon_N"))


def _sources(spark, sf_dir) -> DataFrame:
    """path, lang, content: Rust, Go, Lua and other files by key; some broken at the end, some not UTF-8, some without content."""
    key = F.col("p_partkey")
    word = F.regexp_replace(F.element_at(F.split("p_name", " "), 1), "[^a-z]", "_")
    filled = lambda lines: F.replace(F.replace(F.lit("\n".join(lines) + "\n"), F.lit("W_N"), F.concat(word, F.lit("_N"))), F.lit("_N"), F.concat(F.lit("_"), key.cast("string")))
    text = F.when(key % 4 == 0, filled(_RUST)).when(key % 4 == 1, filled(_GO)).when(key % 4 == 2, filled(_LUA)).otherwise("fn text() {}")
    text = F.when(key % 5 == 0, F.concat(text, F.lit(") ] } \n'"))).otherwise(text)
    content = F.when(key % 29 == 0, F.concat(text.cast("binary"), F.lit(b"\xff"))).when(key % 31 != 0, text.cast("binary"))
    ext = F.when(key % 4 == 0, "rs").when(key % 4 == 1, "go").when(key % 4 == 2, "lua").otherwise("txt")
    path = F.concat(F.lit("./src/p"), key.cast("string"), F.lit("."), ext)
    return _table(spark, sf_dir, "part").select(path.alias("path"), names.lang_of(path).alias("lang"), content.alias("content"))


def _extracted(lang: str):
    def query(spark, sf_dir):
        found = scan.elements(scan.scan_sources(_sources(spark, sf_dir).where(F.col("lang") == lang)))
        return found.select("file", "lang", "line", "name", F.col("capture_index").cast("long").alias("capture_index"))

    query.__name__ = f"extract_{lang}"
    return query


def extract_excluded(spark, sf_dir):
    """Terms are looked for in names with their receivers."""
    return scan.elements(scan.scan_sources(_sources(spark, sf_dir)), ("(*x)", "inner", "plain_1")).select("file", "line", "name")


def extract_problems(spark, sf_dir):
    return scan.problems(scan.scan_sources(_sources(spark, sf_dir)))


def extract_redacted(spark, sf_dir):
    return scan.redacted(scan.scan_sources(_sources(spark, sf_dir)), ("(*x)", "inner"))


def _log(commits: Column, of: Column) -> Column:
    """A log of so many commits, with indented headers that don't count."""
    line = F.concat(F.lit("commit "), F.substring(F.sha2(of.cast("string"), 256), 1, 40), F.lit("\n    commit "), F.repeat(F.lit("0"), 40), F.lit("\n"))
    return F.repeat(line, commits.cast("int"))


def _logs(spark, sf_dir) -> DataFrame:
    """file, name, log: a part's first function has as many commits as the part has lines of orders."""
    n = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    key = F.col("l_partkey").cast("string")
    rows = (("rs", "method_"), ("go", "One_"), ("lua", "plain_"))
    each = F.array(*[F.struct(F.concat(F.lit("./src/p"), key, F.lit(f".{e}")).alias("file"), F.concat(F.lit(f), key).alias("name")) for e, f in rows])
    return n.select(F.explode(each).alias("at"), _log(F.col("n"), F.col("l_partkey")).alias("log")).select("at.file", "at.name", "log")


def _counted(spark, sf_dir) -> DataFrame:
    return report.with_frequency(scan.elements(scan.scan_sources(_sources(spark, sf_dir))), _logs(spark, sf_dir))


def history_left_count(spark, sf_dir):
    return _counted(spark, sf_dir).select("file", "line", "name", "frequency")


def union_blocks(spark, sf_dir):
    """Rows of all languages with the place of theirs."""
    return scan.elements(scan.scan_sources(_sources(spark, sf_dir))).select("file", "name", names.lang_order(F.col("lang")).cast("long").alias("ord"))


def report_ranked(spark, sf_dir):
    """The report: by frequency, language, file, line and name, the first rows skipped."""
    return report.ranked(_counted(spark, sf_dir), 5, 60)


def header_extract(spark, sf_dir):
    """Ids of the commits in a log, in order."""
    n = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    ids = history_text.commit_ids(_log(F.col("n"), F.col("l_orderkey")))
    return n.select("l_orderkey", F.posexplode(ids).alias("at", "id")).select("l_orderkey", F.col("at").cast("long").alias("at"), "id")


def commit_headers(spark, sf_dir):
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return orders.select("l_orderkey", history_text.commit_count(_log(F.col("n"), F.col("l_orderkey"))).alias("n"))


def receiver_norm(spark, sf_dir):
    kind = F.concat(F.lit("("), names.receiver_type(F.col("p_name")))
    return _table(spark, sf_dir, "part").select("p_partkey", kind.alias("r"))


def pair_prev(spark, sf_dir):
    """Types of parts as receivers, where there is one, of their names."""
    receiver = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("("), F.col("p_type"), F.lit(")")))
    return _table(spark, sf_dir, "part").select("p_partkey", names.qualified_name(receiver, F.col("p_name")).alias("name"))


def report_topn(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = _table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(n, "c_custkey", "left")
    rows = joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("frequency"))
    return report.top(rows, [F.col("frequency").desc(), F.col("c_custkey")], 10, 50)


def line_report(spark, sf_dir):
    """Documents as files, lines as functions, and how many documents hold a line as the frequency."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "name"))
    lines = rows.where(F.length("name") > 0).select(F.col("doc_id").alias("file"), (F.col("at") + 1).cast("long").alias("line"), "name")
    counts = lines.groupBy("name").agg(F.countDistinct("file").alias("frequency"))
    rows = lines.join(counts, "name", "left").select("file", "line", "name", "frequency")
    return report.top(rows, [F.col("frequency").desc(), F.col("file"), F.col("line"), F.col("name")], 0, 50)


_ALL = (
    path_prefix, invert_match, hidden_file, exclude_name, path_language, tree_scan, lang_map, _extracted("rust"), _extracted("go"), _extracted("lua"), extract_excluded,
    extract_problems, extract_redacted, history_left_count, union_blocks, report_ranked, header_extract, commit_headers, receiver_norm, pair_prev, report_topn, line_report,
)
QUERIES = {f.__name__: f for f in _ALL}


def _values(found: tuple, lang: str, ext: str, rest: int, index: int) -> str:
    """Rows of the functions in the made files of a language."""
    rows = ", ".join(f"({line}, '{name}')" for line, name in found)
    word = "regexp_replace(string_split(p_name, ' ')[1], '[^a-z]', '_', 'g')"
    name = f"replace(replace(f.name, 'W_N', {word} || '_N'), '_N', '_' || p_partkey)"
    return f"""select './src/p' || p_partkey || '.{ext}' as file, '{lang}' as lang, f.line::bigint as line, {name} as name, {index}::bigint as capture_index, p_partkey
from part, (values {rows}) f(line, name) where p_partkey % 4 = {rest} and p_partkey % 29 <> 0 and p_partkey % 31 <> 0"""


_BY_LANG = {"rust": _values(_RUST_FOUND, "rust", "rs", 0, 0), "go": _values(_GO_FOUND, "go", "go", 1, 1), "lua": _values(_LUA_FOUND, "lua", "lua", 2, 0)}
_FOUND = " union all ".join(f"({q})" for q in _BY_LANG.values())
_COUNTED = f"""select e.file, e.lang, e.line, e.name, case when e.name in ('method_' || e.p_partkey, 'One_' || e.p_partkey, 'plain_' || e.p_partkey) then coalesce(n, 0) else 0 end::bigint as frequency
from ({_FOUND}) e left join (select l_partkey, count(*) as n from lineitem group by 1) h on h.l_partkey = e.p_partkey"""
_ORDER = "case lang when 'go' then 0 when 'rust' then 1 else 2 end"
_LINES = """select doc_id, i::bigint as line, l[i] as name
from (select doc_id, string_split(text, chr(10)) as l from documents) t, range(1, len(l) + 1) r(i) where length(l[i]) > 0"""
_COUNTS = """select c_custkey, c_name, coalesce(n, 0)::bigint as frequency from customer
left join (select o_custkey, count(*) as n from orders group by 1) h on c_custkey = o_custkey"""
_EXT = "case p_partkey % 4 when 0 then 'rs' when 1 then 'go' else 'lua' end"

ORACLE_SQL = {
    "path_prefix": f"""select * from (select page_id, regexp_extract(url, '{_PATH}', 1) as path from pages)
where path in ('/en', '/fr') or starts_with(path, '/en/') or starts_with(path, '/fr/')""",
    "invert_match": "select page_id from pages where not contains(url, 'page=') and not contains(url, '#top')",
    "hidden_file": f"select page_id from pages where not starts_with(string_split(regexp_extract(url, '{_PATH}', 1), '/')[-1], '.')",
    "exclude_name": "select p_partkey from part where not contains(p_name, 'red') and not contains(p_name, 'ring')",
    "path_language": "select p_partkey, ['rust', 'go', 'lua', 'undefined'][p_partkey % 4 + 1] as lang from part",
    "tree_scan": f"select './' || t || '.parquet' as path, 'undefined' as lang from (values {', '.join(f"('{t}')" for t in _TABLES)}) v(t)",
    "lang_map": "select doc_id, case lang when 'en' then 'rust' when 'fr' then 'go' else 'lua' end as lang from documents where lang in ('en', 'fr', 'de')",
    **{f"extract_{lang}": f"select file, lang, line, name, capture_index from ({q})" for lang, q in _BY_LANG.items()},
    "extract_excluded": f"select file, line, name from ({_FOUND}) where not contains(name, '(*x)') and not contains(name, 'inner') and not contains(name, 'plain_1')",
    "extract_problems": f"""select './src/p' || p_partkey || '.' || {_EXT} as file, case p_partkey % 4 when 0 then 'rust' when 1 then 'go' else 'lua' end as lang,
case when p_partkey % 29 = 0 then 'not_utf8' else 'unreadable' end as status from part where p_partkey % 4 < 3 and (p_partkey % 29 = 0 or p_partkey % 31 = 0)""",
    "extract_redacted": f"select lang, count(*) as found, count(*) filter (contains(name, '(*x)') or contains(name, 'inner')) as redacted from ({_FOUND}) group by 1",
    "history_left_count": f"select file, line, name, frequency from ({_COUNTED})",
    "union_blocks": f"select file, name, ({_ORDER})::bigint as ord from ({_FOUND})",
    "report_ranked": f"select file, line, name, frequency from ({_COUNTED}) order by frequency desc, {_ORDER}, file, line, name limit 60 offset 5",
    "header_extract": "select l_orderkey, i::bigint as at, sha256(l_orderkey::varchar)[1:40] as id from (select l_orderkey, count(*) as n from lineitem group by 1), range(0, n) r(i)",
    "commit_headers": "select l_orderkey, count(*) as n from lineitem group by 1",
    "receiver_norm": "select p_partkey, '(' || coalesce(string_split(p_name, ' ')[2], substring(p_name, 2)) as r from part",
    "pair_prev": """select p_partkey, case when p_partkey % 3 > 0 then '(' || coalesce(string_split('(' || p_type || ')', ' ')[2], p_type || ')') || ' ' || p_name else p_name end as name
from part""",
    "report_topn": f"{_COUNTS} order by frequency desc, c_custkey limit 50 offset 10",
    "line_report": f"""with e as ({_LINES}), h as (select name, count(distinct doc_id) as frequency from e group by 1)
select doc_id as file, line, e.name as name, frequency from e join h on e.name = h.name order by frequency desc, file, line, e.name limit 50""",
}
