"""The registered queries themselves on small tables, against brute force, and against their SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from relquarry.llm import decontam, html_extract, line_dedup, queries, simhash, toxicity

from test_operators import PAGE, brute_rule, brute_tiles, corpus, encoded, union, words

BAD = "grumblox zanderfool mippeldorf".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of the contract, with nulls, empty and repeated rows, copies, benchmark passages and toxic documents."""
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(31)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(6)] + [(9, None), (10, ""), (11, "tiny item")]
    rows = [(d, t) for d, t in corpus() if d is not None and d >= 0]
    base = [" ".join(words(rng, 70)) for _ in range(40)]
    rows += [(1000 + k, t) for k, t in enumerate(base)] + [(1100 + k, base[7]) for k in range(30)] + [(1200 + k, base[k] + " tail") for k in range(5)]
    w = items[0][1].split()
    rows += [(1300, " ".join(w[15:] + ["aa"] + w[:15])), (1301, " ".join(w[:10])), (1302, "x " + items[1][1].upper())]
    labels = []
    for i in range(2000, 2500):
        text = words(rng, 25)
        if i % 7 == 0:
            text.insert(rng.randrange(25), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 7 == 0)))
    rows += [(2600, "what a g r u m b l o x"), (2601, "such a zand3rfo0l"), (2602, "mippeldoooorf"), (2603, None), (2604, "")]
    rng.shuffle(rows)
    save = lambda r, ddl, name: spark.createDataFrame(r, ddl).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    save([(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    save(labels, "doc_id bigint, quality int, toxic int", "labels")
    save(items, "item_id bigint, text string", "benchmark")
    urls = [None, "", "http://a.example.com/en/1", "https://WWW.example.com/en/x?q", "http://b.net/es/1#z", "ftp://x.org", "//no", "http://net/fr/"]
    save([(i, u, h) for i, (u, h) in enumerate(zip(urls, [PAGE, None, "", "<p>just text", *[PAGE] * 4]))], "page_id bigint, url string, html string", "pages")
    g = np.random.default_rng(32)
    x = g.standard_normal((120, 8))
    x = np.concatenate([x, x[:40] + 0.15 * g.standard_normal((40, 8)), x[:3]])
    save([(i, [float(np.float32(c)) for c in v], int(i % 40 % 3) if i % 11 else None) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 8, 1)], "vec_id bigint, embedding array<float>, label int", "embeddings")
    return str(folder), rows, items, labels, urls


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))


def test_op1(spark, sf):
    folder, rows, *_ = sf
    lines = [(d, zlib.crc32((t or "").encode()), k, line_dedup.normal(x)) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()]
    lines = sorted(set(lines), key=lambda r: (r[0], line_dedup_key(rows, r), r[2]))
    sets = [line_dedup.shingles(r[3]) for r in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if lines[i][3] == lines[j][3] or min(len(lines[i][3]), len(lines[j][3])) >= 8 and line_dedup.jaccard(sets[i], sets[j]) >= 0.8]
    root = union(len(lines), pairs)
    want = Counter((r[0], r[2], lines[root[i]][0], lines[root[i]][2], root[i] == i) for i, r in enumerate(lines))
    got = Counter(map(tuple, queries.QUERIES["op1_line_dedup"](spark, folder).collect()))
    repeated = {d for d, n in Counter(d for d, _ in rows).items() if n > 1}  # lines of repeated rows are each returned
    assert {k for k in got} == {k for k in want} and all(got[k] == n for k, n in want.items() if k[0] not in repeated)


def line_dedup_key(rows, r):
    from xxhash import xxh64_intdigest

    t = next(t for d, t in rows if d == r[0] and zlib.crc32((t or "").encode()) == r[1])
    h = xxh64_intdigest(t, 42)
    return h - (1 << 64) if h >> 63 else h


def test_op2(spark, sf):
    folder, *_, urls = sf
    got = {r.page_id: r for r in queries.QUERIES["op2_html_extract"](spark, folder).collect()}
    want = "Title & more\nFirst para with bold words.\nSecond <para> é.\nitem one\nitem two"
    assert [got[i].text for i in range(8)] == [want, "", "", "just text", *[want] * 4] and [got[i].url for i in range(8)] == urls
    assert all(r.n_chars == len(r.text) for r in got.values())
    w = html_extract.fit(html_extract.labelled())
    assert html_extract.main_text(PAGE, w) == want


def test_op3(spark, sf):
    folder, rows, _, labels, _ = sf
    got = queries.QUERIES["op3_toxicity"](spark, folder).collect()
    assert len(got) == len(rows)
    toxic = {d for d, _, t in labels if t} | {2600, 2601, 2602}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    assert len(held) > 80 and all(r.predicted == (r.doc_id in toxic) for r in got)


def test_op4(spark, sf):
    folder, rows, items, *_ = sf
    got = {r.doc_id: r for r in queries.QUERIES["op4_decontamination"](spark, folder).collect()}
    for d, t in rows:
        share = {}
        doc = decontam.words(t)
        for i, x in items:
            item = decontam.words(x)
            if len(item) >= decontam.MIN_MATCH and set(item) & set(doc):
                share[i] = brute_tiles(doc, item, decontam.MIN_MATCH) / len(item)
            elif item and " ".join(item) in " ".join(doc):
                share[i] = 1.0
        best = max(share.values(), default=0.0)
        assert got[d].contaminated == (best >= decontam.THRESHOLD), d
        if best >= decontam.THRESHOLD:
            assert got[d].coverage == best and got[d].item_id == min(i for i, s in share.items() if s == best) and got[d].n_items == sum(s >= decontam.THRESHOLD for s in share.values())


def test_op5(spark, sf):
    folder, rows, *_ = sf
    fps = [simhash.fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root, near = union(len(rows), pairs), Counter(x for p in pairs for x in p)
    name = {}
    for i, (d, _) in enumerate(rows):
        name[root[i]] = min(name.get(root[i], d), d)
    got = Counter(map(tuple, queries.QUERIES["op5_simhash"](spark, folder).collect()))
    assert got == Counter((d, f"{fps[i]:016x}", near[i], name[root[i]]) for i, (d, _) in enumerate(rows))


def test_op6_and_op10(spark, sf):
    folder, rows, *_ = sf
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(encoded("byte_bpe_50k.json", t, 0))
    of, seqs = {}, {}
    for r in queries.QUERIES["op6_packing"](spark, folder).collect():
        of.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(of) == set(want)
    for d, pieces in of.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, want[d]))
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    at, last = 0, -1
    got = sorted(queries.QUERIES["op10_token_output"](spark, folder).collect(), key=lambda r: r.start)
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ((d, encoded("word_bpe_49k.json", t, 2)) for d, t in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at and r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id


def test_op8(spark, sf):
    folder, *_ = sf
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ok = [r for r in rows if r.embedding and any(r.embedding) and r.label is not None]
    y = np.array([r.embedding for r in ok])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = (y @ y.T >= 0.93) & np.equal.outer([r.label for r in ok], [r.label for r in ok])
    np.fill_diagonal(s, False)
    order = sorted(range(len(ok)), key=lambda i: ok[i].vec_id)
    s = s[order][:, order]
    root = union(len(ok), list(zip(*np.nonzero(np.tril(s)))))
    ids = [ok[i].vec_id for i in order]
    want = {v: (int(s[i].sum()), ids[root[i]], root[i] == i) for i, v in enumerate(ids)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op8_embedding_dedup"](spark, folder).collect()}
    assert len(got) == len(rows) and s.any()
    assert got == {r.vec_id: want.get(r.vec_id, (0, r.vec_id, True)) for r in rows}


def test_op9(spark, sf):
    folder, *_, urls = sf
    got = queries.QUERIES["op9_url_filter"](spark, folder).collect()
    assert {r.page_id: (r.verdict, r.rule) for r in got} == {i: brute_rule(u) for i, u in enumerate(urls)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    import duckdb

    folder = sf[0]
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    r = c.execute(queries.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert sorted((tuple(x[k] for k in columns) for x in df.collect()), key=repr) == sorted((tuple(x[names.index(k)] for k in columns) for x in r.fetchall()), key=repr)


def test_pipeline(spark, sf, tmp_path):
    """The registered pipeline, stage by stage, against brute force on each stage's own input."""
    import __spark_entry__
    import corpus_pipeline

    folder, rows, items, labels, _ = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            after = [(r.doc_id, r.text) for r in docs.collect()]
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            toxic = {d for d, _, t in labels if t} | {2600, 2601, 2602}
            assert sorted(after, key=repr) == sorted(((d, t) for d, t in before if d not in toxic), key=repr)
        elif name == "line_dedup":
            assert sorted(d for d, _ in after) == sorted(d for d, _ in before)
            lines = {line_dedup.normal(x) for _, t in before if t for x in t.split("\n") if x.strip()}
            left = Counter(line_dedup.normal(x) for _, t in after if t for x in t.split("\n") if x.strip())
            assert max(left.values()) == 2 and sum(n > 1 for n in left.values()) == 1  # the lines of the row that is there twice
            sets = {x: line_dedup.shingles(x) for x in lines}
            for x in lines - set(left):
                assert len(x) >= 8 and any(line_dedup.jaccard(sets[x], sets[y]) >= 0.8 for y in lines if y != x and len(y) >= 8)
        elif name == "simhash_dedup":
            fps = [simhash.fingerprint(t) for _, t in before]
            root = union(len(before), [(i, j) for i in range(len(before)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
            least = {}
            for i, (d, _) in enumerate(before):
                least[root[i]] = min(least.get(root[i], d), d)
            assert sorted(d for d, _ in after) == sorted(least.values())
        elif name == "decontamination":
            bad = {d for d, t in before if any(len(x := decontam.words(i)) >= 4 and brute_tiles(decontam.words(t), x, 4) >= len(x) / 2 for _, i in items if i)}
            assert bad and {d for d, _ in before} - {d for d, _ in after} == bad
        else:
            total = Counter()
            for r in docs.collect():
                total[r.doc_id] += r.length
            assert total == Counter({d: len(encoded("byte_bpe_50k.json", t, 0)) for d, t in before})
    assert __spark_entry__.queries()["pipeline"](spark, folder).count() == docs.count()
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_toxicity_scores_lie_in_range():
    assert 0 < toxicity.BASE < 0.5
