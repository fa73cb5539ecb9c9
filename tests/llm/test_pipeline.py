"""The queries of the subpackage on the smallest tables, and the pipeline stage by stage."""

import os
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from commitlens.llm import queries, shared

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    order = [d[0] for d in rel.description]
    assert sorted(order) == names
    want = sorted(tuple(repr(r[order.index(n)]) for n in names) for r in rel.fetchall())
    assert sorted(tuple(repr(v) for v in r) for r in df.select(*names).collect()) == want


def test_stages_on_the_test_tables(spark, tmp_path):
    """Columns stay, rows only go, and each stage does what its operator says of the rows that it got."""
    from commitlens.llm import decontaminate, jaccardjoin, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    gone = {
        "toxicity": lambda d: toxicity.predict(d, labels).where("predicted = 1"),
        "ngram_jaccard_join": lambda d: jaccardjoin.groups(d).where("doc_id <> component_id"),
        "benchmark_decontamination": lambda d: decontaminate.find(d, bench),
        "pii": lambda d: d.limit(0),
        "source_mixture": lambda d: d.limit(0),
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == list(gone)
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        drop = {r.doc_id for r in gone[name](docs).collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert (now == before - drop if k < 4 else now <= before) and docs.columns == columns + ["mix_repeats", "mix_taken"] * (k == 4)
        before = now


def test_planted_cases(spark, tmp_path):
    """What is planted is caught by its stage, clean documents stay, and odd rows and clashing columns go through."""
    r = random.Random(5)
    fill = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    item, base = fill(40), fill(120)
    rows = {i: fill(r.randrange(30, 90)) for i in range(300)}
    toxic = {i for i in rows if i % 5 == 0}
    for i in toxic:
        rows[i] += ". such a grobnik it is"
    rows |= {1000: base, 1001: base, 1002: base.replace(" ", "  ").upper(), 1003: " ".join([*base.split()[:-1], "other"])}
    rows |= {2000: f"{fill(50)} {item} {fill(20)}", 2001: " ".join(w if k % 9 else "x" for k, w in enumerate(item.split()))}
    rows |= {3000: f"{fill(40)} ann.lee@mail.org and Dr. Anna Cole", 4000: None, 4001: "", 4002: fill(30_000), 5000: "gr0bnik here", 5001: "a grob1nik"}
    table = [(i, t, "en", f"s{i % 3}", len(t or ""), "mine", i) for i, t in rows.items()]
    table += [(None, fill(40), "en", None, 5, "mine", 0), (None, None, None, None, None, None, None)]
    made = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, found string, rep long")
    for name, df in {
        "documents": made,
        "labels": spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*made.columns, "mix_repeats", "mix_taken"]
    got = out.collect()
    ids = {x.doc_id for x in got}
    gone = toxic | {5000, 5001} | {1001, 1002, 1003} | {2000, 2001}
    # The mix takes no words of texts without any; of the others some may get no part of a source's target.
    assert not ids & (gone | {4000, 4001}) and all(x.found == "mine" and 0 < x.mix_taken <= 3 * len(x.text.split()) for x in got)
    kept = {i for i, t in rows.items() if t} - gone
    assert len(kept - ids) < 0.7 * len(kept) and ids <= kept | {None}
    for x in got:
        assert x.text == rows[x.doc_id] if x.doc_id not in (None, 3000) else "ann.lee" not in x.text and "Cole" not in x.text
    assert not [f for f in os.listdir(_checkpoints(spark)) if f.startswith("pipeline-") and len(os.listdir(f"{_checkpoints(spark)}/{f}")) > 1]


def _checkpoints(spark):
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def test_no_folder_of_one_machine_on_a_cluster():
    class Far:
        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Far)


def test_numbered(spark):
    """Rows keep their order and are numbered without gaps, over partitions that are empty, too."""
    df = spark.createDataFrame([(i, "x") for i in range(50)], "a int, b string").repartition(9, "a").where("a % 7 > 2").sortWithinPartitions("a")
    before = [r.a for r in df.collect()]
    got = shared.numbered(df, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(before))) and [r.a for r in got] == before
    assert shared.numbered(df.limit(0), "n").collect() == []
