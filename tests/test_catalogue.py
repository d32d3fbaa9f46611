"""Every registered query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest
from relquarry.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE:
        r = db.execute(catalogue.ORACLE[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert sorted(names) == columns and got == want
    else:
        assert got


@pytest.mark.parametrize("name", ["tok_unicode", "tok_whitespace", "doc_len_quantized", "term_df", "corpus_stats", "phrase_bigram"])
def test_texts_of_over_65536_tokens(spark, tmp_path, name):
    import duckdb

    text = " ".join(f"w{k % 50_000}" for k in range(70_000)) + " the thing at the end of the thing lastword"
    docs = spark.createDataFrame([(1, text, "en", "src0", len(text)), (2, "the thing lastword", "en", "src0", 18)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    r = c.execute(catalogue.ORACLE[name])
    names = [d[0] for d in r.description]
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
