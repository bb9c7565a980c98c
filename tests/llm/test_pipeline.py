import duckdb

import corpus_pipeline
from trajlake.llm import decontaminate, neardup, quality
from trajlake.llm.queries import ORACLE, QUERIES


def test_stages_follow_their_definitions(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        assert docs.columns == (columns if name != "mixing" else [*columns, "mix_copies"])
        if name == "quality_rules":
            rules = quality.learned_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert set(after) == {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), rules).filter("kept").collect()}
        if name == "decontamination":
            bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(b in (r["text"] or "") for b in bench for r in after.values())
            gone = [before[i]["text"] for i in set(before) - set(after)]
            index = decontaminate.Index(list(enumerate(bench)))
            assert all(decontaminate.regions(index, t) for t in gone)
        if name == "secret_scan":
            assert set(after) == set(before)


def test_sql_twins(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, text in ORACLE.items():
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
        cur = con.execute(text)
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        assert sorted(d[0] for d in cur.description) == cols
        assert got == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall()), name


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text), (1, text), (2, text + " more"), (4, "other"), (4, "other")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in neardup.stage(spark, docs, "").collect()) == [1, 4]


def test_unlike_texts_under_one_id_or_none_stay(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, d + " more"), (None, None), (8, ""), (8, e)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(None, a), (None, b), (7, c), (3, d + " more"), (None, None), (8, ""), (8, e)]
    assert sorted(map(str, map(tuple, neardup.stage(spark, docs, "").collect()))) == sorted(map(str, want))


def test_a_leak_takes_no_other_row_of_its_id(spark, tmp_path):
    bench = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "clean text"), (None, f"see {bench} here"), (5, "other clean text"), (5, bench), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(str, map(tuple, decontaminate.stage(spark, docs, str(tmp_path)).collect()))) == sorted(map(str, map(tuple, [rows[0], rows[2], rows[4]])))
