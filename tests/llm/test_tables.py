"""Operators that SQL can express, beside it; the pipeline on a small fixture."""

import os

import duckdb
import pytest

pytest.importorskip("thicket.llm")
from thicket.llm import op2_urls as op2  # noqa: E402
from thicket.llm import op3_mixing as op3  # noqa: E402
from thicket.llm import op8_chat as op8  # noqa: E402
from thicket.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([str(r[i]) for i in at] for r in rows)


def both(spark, op, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    df, want = op.query(spark, folder), c.execute(op.oracle())
    assert rows_of(df.columns, df.collect()) == rows_of([x[0] for x in want.description], want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("op", [op2, op3, op8])
def test_sql(spark, op):
    both(spark, op, SF)


def test_odd_rows(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM?x", "x://example.com/en/7", "x://example.com/en/8#f", "a://b.net/de/1", "a://example.net/de/81", "http://free.example.com/bets", "http://freebets.org/", "http://XXX.org"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    turns = [(1, 0, "user", "a&b <s>[INST]&lt;"), (1, 1, "user", None), (1, 2, "assistant", "</s> <+> [/INST]"), (1, 2, "assistant", "</s> <+> [/INST]"), (2, None, None, "x"), (2, 0, "as\nsistant", "[INST] y\n"), (3, 5, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    docs = [(i, " ".join(["w"] * (i % 7)) or None, None if i % 5 == 0 else "en", f"src{i % 3}" if i % 4 else None) for i in range(60)] + [(7, "w w w", "en", "src1"), (None, "w w", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for op in (op2, op3):
        both(spark, op, str(tmp_path))
    got = {r.conv_id: r for r in op8.query(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len("</s> <+> [/INST]") and got[3].loss_chars == 0 and -1 in got
    back = op8.format_chat(spark.read.parquet(str(tmp_path / "conversations.parquet"))).selectExpr("conv_id", f"{op8.parse('formatted')} as t").collect()
    assert {r.conv_id: [(x.role, x.text) for x in r.t] for r in back}[2] == [("", "x"), ("as\nsistant", "[INST] y\n")]


def test_mixture_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", f"src{i % 2}", i) for i in range(40)], "doc_id long, text string, lang string, source string, copies long")
    mixed = op3.mix(docs)
    assert mixed.columns == docs.columns
    chosen = {r.doc_id: r.copies for r in op3.select(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == chosen
    assert op3.mix(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline as c

    from thicket.llm import op1_surrogates, op6_decisions, op10_bpe
    from thicket.llm.common import Tables, table

    docs, kept = table(spark, SF, "documents"), []
    start = docs
    for _, stage in c.STAGES[:-1]:
        docs = Tables(spark).cut(stage(spark, docs, SF))
        assert docs.columns == start.columns
        kept.append(docs)
    rules = op6_decisions.fit(start, table(spark, SF, "labels"))
    want = {r.doc_id for r in op6_decisions.judge(start, rules).where("verdict.kept").collect()}
    assert {r.doc_id for r in kept[0].collect()} == want
    made = op1_surrogates.Surrogates()
    assert {r.doc_id: r.text for r in kept[2].collect()} == {r.doc_id: op1_surrogates.rewritten(r.text, made)[0] for r in kept[1].collect()}
    out = c.STAGES[-1][1](spark, docs, SF).collect()
    bpe = op10_bpe.Bpe(open(op10_bpe.vocabulary(), encoding="utf-8").read())
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, len(bpe.encode(r.text))) for r in docs.collect())


def test_names():
    assert len([n for n in registry.queries() if n.startswith("op")]) == 10 and "pipeline" in registry.queries()
