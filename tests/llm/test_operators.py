"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random
import time
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from relquarry.llm import decontam, embed_dedup, html_extract, line_dedup, packing, sharding, simhash, token_output, toxicity, url_filter
from relquarry.llm.components import components, forest
from relquarry.llm.queries import URL_RULES, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pid int, h bigint, shard string, node string, fp string"


def words(rng, n):
    return [rng.choice("ab cd efg hijk lm nop qrs tuv wxyz".split()) + rng.choice("ing ed s er ly um".split()) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(1, 90))) for _ in range(25)]
    texts = [*base, base[3], base[3], base[4] + " extra", base[5].upper(), None, None, "", "   ", "one", "one two", "\n\n", "é ß 日本 \x1c <|endoftext|> x"]
    texts += [" ".join(words(rng, 6000)), "\n".join(base[:5]), "\n".join(base[2:7])]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(9, texts[3]), (None, base[8]), (-5, base[9])]  # a repeated row, a null doc_id, a negative one
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "src0", None, 1, 2, "s", "n", "f") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    label = union(300, edges)
    want = {i: r for i, r in enumerate(label) if i != r}
    for one_task in (10_000, 1):
        assert {r[0]: r[1] for r in components(df, one_task).collect()} == want
    assert components(df.limit(0)).count() == 0
    nodes, roots = forest(np.array([3, 9]), np.array([7, 7]))
    assert roots.tolist() == [3, 3, 3]


def line_rows(rows):
    return sorted({(d, line_dedup_hash(t), k, line_dedup.normal(x)) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip()}, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def line_dedup_hash(t):
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(t, 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("small", [line_dedup.SMALL, 1])
def test_line_classes_match_brute_force(spark, docs, empty, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(5)
    rows = corpus()
    line = " ".join(words(rng, 60))
    for k in range(12):  # a crowd of variants, and a chain
        w = line.split()
        w[5 * k % 60] = "other"
        rows.append((500 + k, " ".join(w) + "\nshort\n" + " ".join(words(rng, 30))))
    lines = line_rows(rows)
    forms = [r[3] for r in lines]
    sets = [line_dedup.shingles(f) for f in forms]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if forms[i] == forms[j] or min(len(forms[i]), len(forms[j])) >= line_dedup.WORTH and line_dedup.jaccard(sets[i], sets[j]) >= line_dedup.THRESHOLD]
    root = union(len(lines), pairs)
    want = {(d, h, k): (lines[root[i]][0], lines[root[i]][2], root[i] == i) for i, (d, h, k, _) in enumerate(lines)}
    got = line_dedup.line_classes(frame(spark, rows)).collect()
    assert {(r.doc_id, r.text_hash, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in got} == want
    assert line_dedup.line_classes(empty).count() == 0
    out = line_dedup.deduplicate(frame(spark, rows))
    assert out.columns == docs.columns and out.count() == len(rows)
    for d, t in {(r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and r.doc_id >= 500}:
        source = dict(rows)[d]
        h = line_dedup_hash(source)
        assert t == "\n".join(x for k, x in enumerate(source.split("\n")) if want.get((d, h, k), (0, 0, True))[2])
    assert line_dedup.deduplicate(empty).count() == 0


def test_prefix_pairs_lose_none(spark, monkeypatch):
    rng = random.Random(15)
    forms = []
    for k in range(12):
        w = words(rng, rng.randint(4, 30))
        for _ in range(14):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words(rng, 3))
            forms.append(" ".join(v[: rng.randint(max(2, len(v) - 2), len(v))]))
    forms = [f for f in dict.fromkeys(forms) if len(f) >= line_dedup.SHINGLE]
    rows = spark.createDataFrame([(i, i, f) for i, f in enumerate(forms)], "h bigint, top bigint, line string")
    sets = [line_dedup.shingles(f) for f in forms]
    near = {(i, j) for j in range(len(forms)) for i in range(j) if line_dedup.jaccard(sets[i], sets[j]) >= 0.8}
    for hot in (2000, 3):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {tuple(r) for r in line_dedup.prefix_pairs(rows, 0.8).collect()}
        assert near and near <= got
    same = rows.withColumn("top", rows.h * 0)
    assert line_dedup.prefix_pairs(same, 0.8).isEmpty()


def test_lines_with_a_common_part_cost_their_rare_shingles(spark):
    """Lines that share band keys by the thousand without being similar: pairs grow with the lines, not with their square."""
    rng = random.Random(16)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(6))
    pairs = []
    for n in (1000, 4000):
        forms = [f"posted by {name()} in the general discussion forum, reply number {rng.randrange(10**7)}" for _ in range(n)]
        rows = spark.createDataFrame([(i, i, f) for i, f in enumerate(forms)], "h bigint, top bigint, line string")
        pairs.append(line_dedup.prefix_pairs(rows, 0.8).count())
    assert pairs[1] < 4000 and pairs[1] <= 40 + 8 * pairs[0]


def test_packed_shingles_are_the_shingles():
    for form in ("the cat sat on the cat sat on the mat", "äöü ñandú über alles straße", "exactly8"):
        assert len(line_dedup.packed_shingles(form)) == len(line_dedup.shingles(form))
        assert {n.to_bytes(8, "little").decode("latin-1") for n in line_dedup.packed_shingles(form)} == line_dedup.shingles(form)
    assert line_dedup.packed_shingles("日本語日本語日本語") is None


def test_forms_are_the_lines_normal_forms():
    rng = random.Random(17)
    white = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = ["".join(rng.choice([*white, *"  \n\n\naBÄ日"]) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += ["".join(rng.choice("  \naB") for _ in range(rng.randrange(14))) for _ in range(5000)]
    for t in [*texts, *(f"a{c}b c\nd" for c in white), *(f"{c}a\nb{c}" for c in white)]:
        assert list(line_dedup.forms(t)) == [line_dedup.normal(x) for x in t.split("\n")]


@pytest.mark.parametrize("held", [1 << 18, 40, 2])
def test_stars_need_their_keys_in_order_only(monkeypatch, held):
    """Rows of a key come in any order, repeatedly, over several batches; all its lines meet one of them."""
    monkeypatch.setattr(line_dedup, "HELD", held, raising=False)
    rng = random.Random(18)
    rows = [(k, h) for k in (-7, -3, 0, 4, 5, 9) for h in rng.choices(range(-50, 50), k=rng.choice([1, 2, 90, 300]))]
    rows += [(20 + k, rng.randrange(5)) for k in range(200) for _ in range(rng.randint(1, 3))]
    cuts = sorted([0, 3, len(rows), *rng.sample(range(len(rows)), 20)])
    got = [r for b in line_dedup._stars(line_dedup.batch(pa.schema([("key", pa.int64()), ("h", pa.int64())]), *zip(*rows[i:j])) for i, j in zip(cuts, cuts[1:]) if i < j) for r in zip(*b.to_pydict().values())]
    lines, centres = {}, {}
    for k, h in rows:
        lines.setdefault(k, set()).add(h)
    for k, a, b in got:
        centres.setdefault(k, set()).add(a)
        assert a != b
    assert set(centres) == {k for k, hs in lines.items() if len(hs) > 1}
    for k, c in centres.items():
        assert len(c) == 1 and {b for key, _, b in got if key == k} == lines[k] - c
        assert held < 1 << 18 or min(lines[k]) in c
    assert held < 1 << 18 or len(set(got)) == len(got)
    assert sum(b.num_rows for b in line_dedup._stars(iter(()))) == 0


def test_pairs_are_verified_exactly_and_without_sets():
    rng = random.Random(19)
    pairs = []
    for _ in range(150):
        w = words(rng, 70)
        v = [x if rng.random() > 0.03 else "other" for x in w]
        pairs.append((" ".join(w), " ".join(v)))
    pairs += [("exactly8", "exactly8"), ("ab" * 20, "ab" * 30), ("日本語" * 9, "日本語" * 8), ("plain line of text", "plain line of text日")]
    rows = line_dedup.batch(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("la", pa.string()), ("lb", pa.string())]), range(len(pairs)), range(1000, 1000 + len(pairs)), *zip(*pairs))

    def sets():
        packed = [(line_dedup.packed_shingles(x), line_dedup.packed_shingles(y)) for x, y in pairs]
        return [i for i, (s, t) in enumerate(packed) if s and t and line_dedup.jaccard(s, t) >= 0.8]

    def took(f):
        best = []
        for _ in range(7):
            began = time.process_time()
            f()
            best.append(time.process_time() - began)
        return min(best)

    want = [i for i, (x, y) in enumerate(pairs) if line_dedup.jaccard(line_dedup.shingles(x), line_dedup.shingles(y)) >= 0.8]
    (got,) = line_dedup._verify([rows], 0.8)
    assert got.column("a").to_pylist() == want and 20 < len(want) < len(pairs) - 5
    assert took(lambda: list(line_dedup._verify([rows], 0.8))) < 0.75 * took(sets)


PAGE = """<html><head><title>no</title></head><body><header>Site</header><nav><a>m</a></nav><div class="cookie-banner">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>First   para<br>with <b>bold</b> words.<p>Second &lt;para&gt; &eacute;.<div class="ad">Buy</div><script>if (a < b) { "</p>" }</script>
<form>Your name <input><button>Go</button></form><ul><li>item one</li><li>item two</li></ul></article><section id="comments"><p>reader says hello hello hello</p></section></main>
<aside>Related stuff</aside><footer>&copy; me</footer></body></html>"""


def test_html_extract(spark):
    want = "Title & more\nFirst para with bold words.\nSecond <para> é.\nitem one\nitem two"
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "u", "<nav>menu only</nav>"), (1, "u", PAGE), (5, "u", PAGE[: PAGE.index("<div class=\"ad\"")]), (6, "u", "<article>" + "<p>word</p>" * 5000), (None, "u", "<p>plain page text here"), (7, "u", "<article><p>cut <b>off &am")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {(r.page_id): r for r in html_extract.extract(df).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3, 4)] == ["", "", ""] and got[2].n_chars == 0
    assert got[5].text == "\n".join(want.split("\n")[:3])
    assert got[6].text.count("\n") == 4999 and got[None].text == "plain page text here" and got[7].text == "cut off &am"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_region_is_the_best_of_all():
    rng = random.Random(13)
    for _ in range(300):
        g = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 14))]
        i, j = html_extract.best_region(g)
        best = max((sum(g[a:b]) for a in range(len(g)) for b in range(a + 1, len(g) + 1)), default=0)
        assert sum(g[i:j]) == max(best, 0)


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<div class="post-content">%s</div>', "<div>%s</div>"])
def test_html_keeps_the_whole_article(wrap):
    w = html_extract.default_weights()
    said = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    page = "<html><head><title>t</title></head><body><nav><a>m</a> <a>n</a></nav>" + wrap + "<footer>f f f</footer></body></html>"
    title, short, end = "Title here", said("s", 6), said("e", 60)
    for box in (f'<div class=ad>{said("a", 80)}</div>', f'<div class="share">{said("b", 50)}</div>', f"<form>{said('c', 90)}</form>", f'<div id="related-links">{said("d", 70)}</div>'):
        for body, want in (
            (f"<h1>{title}</h1><p>{short}</p>{box}<p>{end}</p>", [title, short, end]),
            (f"<h1>{title}</h1><p>{end}</p>{box}<p>{short}</p>", [title, end, short]),
        ):
            assert html_extract.main_text(page % body, w).split("\n") == want, (box, wrap)
    for name in ("social-history", "story", "commentary", "searching", "advertising-history-of-france", "discussion", "more", "menu-of-the-day"):
        body = f'<h1>{title}</h1><p>{end}</p><div class="{name}"><p>{short}</p></div>'
        assert html_extract.main_text(page % body, w).split("\n") == [title, end, short], name
    for name in ("site-footer", "cookie-banner", "main-nav", "post-comments", "ad-slot-1", "newsletter_signup"):
        body = f'<h1>{title}</h1><p>{end}</p><div class="{name}"><p>{short}</p></div>'
        assert html_extract.main_text(page % body, w).split("\n") == [title, end], name


def test_html_article_header_and_depth():
    w = html_extract.default_weights()
    body = "<header><h1>Title of it</h1></header><p>" + "word " * 30 + "</p>"
    for page in (f"<body><header>Site name</header><article>{body}</article></body>", f"<body><header>Site name</header><main>{body}</main></body>", f'<body><header>Site name</header><article>{body.replace("<header>", chr(60) + "header class=entry-header>")}</article></body>'):
        assert html_extract.main_text(page, w).split("\n")[0] == "Title of it"
    import time

    spent = []
    for n in (4000, 32000):
        start = time.process_time()
        assert html_extract.main_text("<article>" + "<b>" * n + "text " * 4 * n + "</i>" * n + "<p>end of it</article>", w).endswith("end of it")
        spent.append(time.process_time() - start)
    assert spent[1] < 24 * spent[0]  # eight times the page; a walk over the stack would take 64 times


def test_html_accuracy_on_held_out_templates():
    """Words right on templates that weights were not fitted on."""
    pages = list(html_extract.labelled())
    for fold in range(3):
        w = html_extract.fit([p for i, p in enumerate(pages) if i % 3 != fold])
        for html, words_ in pages[fold::3]:
            got = html_extract.main_text(html, w).split()
            assert len(words_ - set(got)) == 0 and sum(g not in words_ for g in got) <= 2


def test_html_weights_sign():
    w = html_extract.default_weights()
    assert w.tag < 0 < w.word["article"] and all(w.word[k] < 0 for k in html_extract.NEVER if k != "meta")


def test_toxicity_learns_and_restores(spark, empty):
    rng = random.Random(3)
    bad = "grumblox zanderfool mippeldorf".split()
    rows, labels = [], []
    for i in range(900):
        w = words(rng, rng.randint(5, 60))
        toxic = i % 8 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    hard = {5000: "so you are a grumbl0x today", 5001: "what a z a n d e r f o o l this is", 5002: "mippeldoooorf indeed", 5003: "a plain and kind text", 5004: None, 5005: ""}
    rows += list(hard.items()) + [(None, "text of a null id")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    truth = {i: int(i % 8 == 0) for i in range(900)}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert [got[k].predicted for k in hard] == [1, 1, 1, 0, 0, 0]
    assert got[5004].score == got[5005].score == pytest.approx(toxicity.BASE)
    kept = toxicity.drop_toxic(frame(spark, rows), lab)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {d for d in got if not got[d].predicted}
    assert toxicity.score_toxicity(empty, lab).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(frame(spark, rows), lab.limit(0)).collect()} == {0}


def brute_tiles(a, b, least):
    fa, fb, total = [1] * len(a), [1] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [0] * best
                total += best


def test_decontamination(spark, empty):
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert sum(t[2] for t in decontam.tiles(a, b, 3)) == brute_tiles(a, b, 3)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(5)] + [(9, None), (10, ""), (11, "tiny item"), (None, "w x y z")]
    w = items[0][1].split()
    rows = [(1, "aa " + " ".join(w) + " bb"), (2, " ".join(w[20:]) + " cc dd " + " ".join(w[:20])), (3, " ".join(w[:14])), (4, " ".join(w[:15])), (5, None), (6, ""), (7, "a tiny item here"), (8, "clean text of words"), (8, "clean text of words"), (None, items[1][1].upper()), (12, " ".join(["pad"] * 20000) + " " + items[2][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    want = {1: (True, 0), 2: (True, 0), 3: (False, 0), 4: (True, 0), 5: (False, None), 6: (False, None), 7: (True, 11), 8: (False, None), None: (True, 1), 12: (True, 2)}
    for most in (decontam.MAX_SEEDS, 1):
        got = decontam.decontaminate(frame(spark, rows), bench, max_seeds=most).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.contaminated, r.item_id) == want[r.doc_id] or (not r.contaminated and not want[r.doc_id][0]), r
        kept = decontam.drop_contaminated(frame(spark, rows), bench, max_seeds=most).collect()
        assert sorted(r.doc_id for r in kept) == [3, 5, 6, 8, 8]
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_simhash_matches_brute_force(spark, docs, empty, monkeypatch):
    rows = corpus()
    fps = [simhash.fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = union(len(rows), pairs)
    near = [sum(i in p for p in pairs) for i in range(len(rows))]
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root[i]] = min(name.get(root[i], d), d)
    want = sorted((str(rows[i][0]), f"{fps[i]:016x}", near[i], name.get(root[i])) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, r.n_near, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(name.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_near_fingerprints_in_crowded_shards(spark, monkeypatch):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {base ^ (1 << rng.randrange(48)) ^ (1 << rng.randrange(48)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    count = {v: rng.randint(1, 3) for v in values}
    nodes = spark.createDataFrame(list(count.items()), "fp bigint, n bigint")
    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    want = {a: sum(count[b] for b in values if b != a and close(a, b)) for a in values}
    for large in (4096, 10, 1):  # up to all four levels
        monkeypatch.setattr(simhash, "LARGE", large)
        got = {}
        for r in simhash.near_fingerprints(nodes).collect():
            got[r.fp] = got.get(r.fp, 0) + r.near
        assert got == {a: n for a, n in want.items() if n}


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(7)
    values = [rng.getrandbits(8) for _ in range(80)]
    tree, seen = simhash.BKTree(2), []
    for v in dict.fromkeys(values):
        assert sorted(tree.add(v)) == sorted(w for w in seen if (v ^ w).bit_count() <= 2)
        seen.append(v)


@lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def encoded(name, text, end):
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("small", [False, True])
def test_packing_round_trip(spark, docs, empty, monkeypatch, small):
    from relquarry.llm import common

    if small:
        monkeypatch.setattr(common, "RANGE_BYTES", 2000)
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, 64).collect()
    want = {}
    for d, t in corpus():
        ids = encoded("byte_bpe_50k.json", t, 0)
        want.setdefault((d, len(ids)), []).append(ids)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for k, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[k]))
        crcs = [{(a, n): zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a in [p.start for p in pieces] for n in [p.length for p in pieces]} for ids in want[k]]
        assert all(any(c.get((p.start, p.length)) == p.ids_crc32 for c in crcs) for p in pieces)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two: no padding at all
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_hilbert_keys_are_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute_capacity(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if fits(m) else (m + 1, high)
    return low


@pytest.mark.parametrize("hot, fan", [(0, 12), (400, 12), (0, 2), (40, 2)])
def test_sharding(spark, docs, empty, monkeypatch, hot, fan):
    import hashlib

    monkeypatch.setattr(sharding, "FAN", fan)
    if hot == 40:  # slots over several ranges
        monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    rows = corpus() + [(None if k % 3 else 10_000 + k, "the very same text") for k in range(hot)]
    df = frame(spark, rows)
    got = sharding.shard(df, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, size(t), crc(t)) for d, t in rows), key=repr)
    groups = {}
    for _, t in rows:
        h = 0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
        groups[h] = groups.get(h, 0) + size(t)
    best = brute_capacity([groups[h] for h in sorted(groups)], 8)
    # the greedy filling at that capacity
    place, at, left = {}, 0, best
    for h in sorted(groups):
        if groups[h] > left:
            at, left = at + 1, best
        place[h], left = at, left - groups[h]
    null_first = lambda v: (v is not None, v or 0)
    want = sorted((place[0 if t is None else int(hashlib.md5(t.encode()).hexdigest()[:15], 16)], null_first(d), size(t), null_first(crc(t))) for d, t in rows)
    assert [(r.shard, null_first(r.doc_id), r.size, null_first(r.text_crc32)) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_capacity_is_the_least(spark, monkeypatch):
    rng = random.Random(21)
    for n, shards, fan in ((1, 3, 12), (5, 8, 4), (200, 7, 3), (300, 4, 12), (120, 9, 2)):
        monkeypatch.setattr(sharding, "FAN", fan)
        groups = {rng.getrandbits(60) if rng.random() < 0.7 else rng.getrandbits(20): rng.choice([1, 5, 60, 900]) for _ in range(n)}
        order = sorted(groups)
        capacity, cuts = sharding.capacity_cuts(spark.createDataFrame(list(groups.items()), "h bigint, bytes bigint"), shards)
        assert capacity == brute_capacity([groups[h] for h in order], shards)
        load = [0] * shards
        for h in order:
            load[sum(h >= c for c in cuts)] += groups[h]
        assert max(load) <= capacity


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    near = base[:60] + 0.35 * rng.standard_normal((60, 16)) / 4 * np.linalg.norm(base[:60], axis=1, keepdims=True) / 4
    crowd = base[:1] + 0.02 * rng.standard_normal((50, 16))
    x = np.concatenate([base, near, crowd, base[5:8]])
    label = [int(k) for k in rng.integers(0, 3, 300)]
    label += label[:60] + [label[0]] * 50 + label[5:8]
    rows = [(i, [float(np.float32(c)) for c in v], label[i]) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [1.0] * 3, 1), (1007, [float("inf")] * 16, 1), (None, None, 1), (None, [float(c) for c in rng.standard_normal(16)], 2)]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as first")
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = (y @ y.T >= 0.93) & np.equal.outer(label, label)
    np.fill_diagonal(s, False)
    pairs = list(zip(*np.nonzero(np.tril(s))))
    root = union(len(rows), pairs)
    for leaf, rows_a_leaf in ((32, 8192), (32, 20)):
        monkeypatch.setattr(embed_dedup, "LEAF_ROWS", rows_a_leaf)
        every = embed_dedup.near_vectors(df, 0.93, leaf=leaf).collect()
        got = {r.vec_id: r for r in every}
        assert len(every) == len(rows) + len(odd)
        found = sum(got[i].n_links for i in range(len(rows)))
        assert found <= s.sum() and found >= 0.98 * s.sum()
        if found == s.sum():
            assert [got[i].n_links for i in range(len(rows))] == s.sum(axis=1).tolist()
            assert [got[i].component_id for i in range(len(rows))] == root
        assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1000, 1008))
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def brute_rule(url):
    host, path = url_filter.split_url(url)
    fits = [(h.count("."), len(p), v == "block", v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else ("allow", None)


@pytest.mark.parametrize("most", [url_filter.MAX_RULES, 2])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)  # past it, block by block
    rng = random.Random(9)
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "notexample.com", "x.net", "net", "org", "example.com:80", "", "com.", "exampleacom"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/EN/1", "/es/x", "/fr/", "//en/", "/en?x=/en/", "?q", "#f", "/es/#a"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "://", "a://b://example.com/en/", "http://example.com/en/" + "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)) * 2 + [(None, urls[20])], "page_id bigint, url string").selectExpr("*", "1 as host", "2 as id", "3 as rule")
    got = url_filter.judge_urls(df, URL_RULES).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        assert (r.verdict, r.rule) == brute_rule(urls[20 if r.page_id is None else r.page_id]), urls[r.page_id]
    assert {r.verdict for r in url_filter.judge_urls(df, [], "block").collect()} == {"block"}
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    trie = url_filter.RuleTrie([("block", "", "/ads"), ("allow", "b.c", "/a/b"), ("block", "b.c", "/a/b")])
    assert trie.find("x.y", "/adsense/1")[:2] == ("block", "/ads") and trie.find("a.b.c", "/a/bc")[:2] == ("block", "b.c/a/b") and trie.find("b.c", "/a") is None


def test_elias_fano():
    rng = np.random.default_rng(10)
    for v in (np.array([], np.uint64), np.array([0]), np.array([0, 0, 0]), np.sort(rng.integers(0, 10**7, 3000)), np.arange(700), np.array([5, 1 << 40])):
        e = token_output.EliasFano.from_bytes(memoryview(token_output.EliasFano.of(v).to_bytes()))
        assert e.run(0, len(v)).tolist() == v.tolist() and [e.select(i) for i in range(len(v))] == v.tolist()
        for i, j in ((1, 2), (3, 300), (255, 258), (256, 600)):
            assert e.run(min(i, len(v)), min(j, len(v))).tolist() == v[i:j].tolist()
    v = np.sort(rng.integers(0, 1 << 30, 100_000))
    assert len(token_output.EliasFano.of(v).to_bytes()) * 8 < len(v) * (2 + np.log2((1 << 30) / len(v)) + 1)


@pytest.mark.parametrize("small", [False, True])
def test_token_files_round_trip(spark, docs, empty, tmp_path, monkeypatch, small):
    from relquarry.llm import common

    if small:  # many ranges and runs; the workers' own limits stay
        monkeypatch.setattr(common, "RANGE_BYTES", 2000)
        monkeypatch.setattr(token_output, "READ_IDS", 100)
    path = vocabulary("word_bpe_49k.json")
    manifest = token_output.write_tokens(docs, path, f"file://{tmp_path}/t", 2)
    rows = sorted(((d, encoded("word_bpe_49k.json", t, 2)) for d, t in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = token_output.read_tokens(spark, f"file://{tmp_path}/t").collect()
    got.sort(key=lambda r: r.start)
    at = 0
    for (d, ids), r in zip(rows, got, strict=True):
        data = np.array(ids, "<u4")
        same = sorted(x[1] for x in rows if x[0] == d)
        assert r.doc_id == d and r.start == at
        assert list(np.frombuffer(bytes(r.ids), "<u2")) in same
        if len(same) == 1:
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(data.tobytes()))
        at += r.n_tokens
    assert at == sum(f["ids"] for f in manifest["files"])
    t = token_output.TokenFile.of((tmp_path / "t" / manifest["files"][-1]["name"]).read_bytes())
    assert t.doc_id(len(t) - 1) == rows[-1][0] and t.ids(len(t) - 1).tolist() == rows[-1][1]
    token_output.write_tokens(empty, path, f"file://{tmp_path}/e", 2)
    assert token_output.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_token_files_roll_over(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_output, "FILE_IDS", 40)
    monkeypatch.setattr(token_output, "FILE_DOCS", 3)
    monkeypatch.setattr(token_output, "READ_IDS", 8)
    path, rng = vocabulary("word_bpe_49k.json"), np.random.default_rng(2)
    ids = [rng.integers(3, 40_000, n).astype("<u2").tobytes() for n in (5, 0, 70, 1, 2, 3, 30, 30, 1)]
    docs = [None, None, -(1 << 62), -3, 0, 0, 7, 1 << 62, 1 << 62]
    parts = [pa.RecordBatch.from_pydict({"pid": [4] * 9, "doc_id": pa.array(docs, pa.int64()), "ids": ids})]
    files = [r for b in token_output._write(parts, path, 2, f"file://{tmp_path}") for r in b.to_pylist()]
    assert [(f["part"], f["no"], f["n_docs"]) for f in files] == [(4, 0, 3), (4, 1, 3), (4, 2, 2), (4, 3, 1)]
    asked = pa.RecordBatch.from_pydict({"name": [f["name"] for f in files], "base": [0, 78, 87, 149], "first": [0] * 4, "last": [f["n_docs"] for f in files]})
    got = [r for b in token_output._read([asked], f"file://{tmp_path}", True) for r in b.to_pylist()]
    assert [r["doc_id"] for r in got] == docs and [r["ids"] for r in got] == [i + b"\x02\x00" for i in ids]
    assert [r["start"] for r in got] == np.cumsum([0, *(len(i) // 2 + 1 for i in ids)]).tolist()[:-1]


def test_cached_pieces_equal_the_library():
    rng = random.Random(11)
    signs = " \n\t'aZ09_-é½ßsÀ —.\x1f\xad‘’ŉİſ日🙂́<|"
    texts = ["", "it's We'll 'S don'T", "<|endoftext|> a", "1234 ½² x1y"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    from relquarry.llm.tokens import Ids

    special = {"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}
    texts += ["a <|endoftext|> b", "a<|ENDOFTEXT|>b<|startoftext|>", "<|", "x <|endoftext|>" * 50]
    for name, end in special.items():
        coder = Ids(vocabulary(name))
        got = coder.encode(texts)
        assert got == coder.whole(texts)
        assert [list(np.frombuffer(g, coder.kind)) for g in got] == [encoded(name, t, 0)[:-1] for t in texts]
        assert end in np.frombuffer(got[texts.index("a <|endoftext|> b")], coder.kind)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus() + [(7000 + k, "same words again and again " * 8) for k in range(5)]
    rows.append((8000, " ".join(f"bench{k}" for k in range(30))))
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"bench{k}" for k in range(30)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert 8000 not in kept and len({7000 + k for k in range(5)} & kept) == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_duplicates_are_dropped_by_row_and_class(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c), (3, d), (9, e), (9, d), (20, a), (30, b + " "), (9, e)]
    kept = simhash.drop_near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(20, a), (30, b + " "), (None, c), (3, d), (9, e)], key=str)


def test_boxes_inside_an_article_do_not_split_it():
    title, body, end = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("t", 5), ("b", 200), ("e", 25)))
    junk = " ".join(f"junk{k}" for k in range(40))
    page = f'<html><body><nav>{junk}</nav><%s><h1>{title}</h1><div class="share">share this page with all of your friends</div><p>{body}</p><div class="ad"><p>{junk}</p>{junk}</div>{"<aside></aside>" * 200}<form>{junk}<button>go</button></form><p>{end}</p></%s><footer>{junk}</footer></body></html>'
    for tag in ("article", "main"):
        assert html_extract.main_text(page % (tag, tag), html_extract.default_weights()) == "\n".join((title, body, end))


@pytest.mark.parametrize("hot", [50_000, 2])
def test_decontamination_is_the_same_for_small_and_large_benchmarks(spark, monkeypatch, hot):
    monkeypatch.setattr(decontam, "HOT", hot)
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    marks = "nai\u0308ve cafe\u0301 \u0130stanbul x\u00b2 \u2160\u2161 a\u200db \u0915\u094d\u0937 end"  # combining marks, and letters and digits that Java and Python tell apart
    items = [(1, a), (1, b), (1, b), (2, marks), (3, c), (3, c + " " + a), (4, "tiny it\u0301em"), (4, "tiny one")]
    rows = [(None, "x " + a), (None, "clean words here"), (None, None), (7, "y " + b + " y"), (7, "clean seven of seven"), (8, "z " + marks + " z"), (9, c + " " + a), (10, "a tiny it\u0301em of"), (11, "a tiny one"), (7, "y " + b + " y"), (12, "")]
    rng = random.Random(19)  # items and documents with a common beginning, mixed passages, repeats within an item
    lead = "which of the following is true about"
    for k in range(12):
        items.append((20 + k, lead + " " + " ".join(f"q{k}x{rng.randrange(12)}" for _ in range(30))))
        w = items[-1][1].split()
        rows += [(100 + k, " ".join(w[rng.randrange(20) :] + w[: rng.randrange(20)] + ["pad"] * 9)), (200 + k, lead + " " + " ".join(f"z{rng.randrange(99)}" for _ in range(30)))]
    items.append((50, "again and again and " * 8))
    rows += [(300, "so again and again and so"), (301, "again and again and again and again and " * 3)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows).repartition(3)
    judge = decontam.Items(items).judge
    clean = {(d, t) for d, t in rows if not judge(t, decontam.THRESHOLD)[0]}
    assert 12 < len(clean) < len(rows) - 12
    small, large = (sorted((tuple(r) for r in decontam.decontaminate(docs, bench, max_seeds=m).collect()), key=repr) for m in (decontam.MAX_SEEDS, 1))
    assert small == large and len(small) == len(rows)
    for m in (decontam.MAX_SEEDS, 1):
        kept = decontam.drop_contaminated(docs, bench, max_seeds=m)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    assert clean >= {(None, "clean words here"), (None, None), (7, "clean seven of seven"), (12, "")} and not clean & {rows[0], rows[3], rows[5], rows[6], rows[7], rows[8]}


HARD = ["l o $ e r", "i d ! o t", "i.d.!.o.t", "i/d/i/o/t", "i,d,i,o,t", "i~d~i~o~t", "i  d  i  o  t", "i\nd\n\ni\no\nt", "id-iot", "sc.um", "iddiioott", "$ t u p i d", "s t u p ! d", "i - d  !,o\tt", "s / c / u / m", "1d-i0t"]


def test_obfuscated_words_reach_the_lattice():
    model = toxicity.CharModel(trigrams("you are an idiot and a loser they are stupid scum of the earth " * 50))
    restorer = toxicity.Restorer(model)
    for hard in HARD:
        found = {w for t in restorer.tokens(f"We say: {hard}!") for w in restorer.words(t)}
        assert found & {"idiot", "loser", "scum", "stupid"}, hard


def every_path(segment, model):
    """(score, string) of all ways through a segment's lattice."""
    log = model.log
    todo = [(0, 0, 0, "", False, 0.0, "")]
    while todo:
        i, a, b, last, dropped, p, s = todo.pop()
        if i == len(segment):
            yield p + float(log[a, b, 0]), s
            continue
        c = segment[i]
        letters = [(x, -0.7) for x in toxicity.LOOKS.get(c, "")] or ([(c, 0.0)] if c.isalpha() else [])
        for x, cost in letters:
            k = toxicity.sign(x)
            todo.append((i + 1, b, k, x, False, p + cost + float(log[a, b, k]), s + x))
            if x == last:
                todo.append((i + 1, a, b, last, True, p + cost - (0.2 if dropped else 2.5), s))
        if c in toxicity.LOOKS:
            todo.append((i + 1, a, b, last, dropped, p - 12.0, s))
        if not letters:
            todo.append((i + 1, a, b, last, dropped, p, s))
            todo.append((i + 1, b, 0, "", False, p - 1.0 + float(log[a, b, 0]), s + " "))


def test_decode_finds_the_best_of_all_paths():
    rng = random.Random(17)
    model = toxicity.CharModel(trigrams("you are an idiot and a loser they are stupid scum of the earth " * 50))
    for segment in ["1d10t", "l 0 5 e r", "$tup!d", "looooser", "s.c-u m", "ii11ii", "", "!!!", "äß7"] + ["".join(rng.choice("aidot 10!5|.sl6") for _ in range(rng.randint(1, 8))) for _ in range(120)]:
        paths = list(every_path(segment, model))
        best = max(p for p, _ in paths)
        got = toxicity.decode(segment, model)
        assert max(p for p, s in paths if s == got) == pytest.approx(best, abs=1e-9), segment
        if sum(p > best - 1e-9 for p, _ in paths) == 1:
            assert got == max(paths)[1]


def test_toxicity_of_long_texts_repeated_rows_and_labels(spark):
    model = toxicity.CharModel(trigrams("you are an idiot and a loser they are stupid scum of the earth " * 50))
    letters = "youareanidiotandaloser" * 40
    spelled = " ".join(letters)
    found = {w for t in toxicity.Restorer(model).tokens(spelled) for w in toxicity.Restorer(model).words(t)}
    assert letters in {"".join(toxicity.decode(spelled, model).split())} and any(len(w) > 4 for w in found)
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = words(rng, 20)
        if toxic:
            w.insert(rng.randrange(20), "grumblox")
        rows += [(i, " ".join(w))] * (1 + (i % 50 == 0))  # some rows twice
        labels += [(i, int(toxic), 7, "t")] * (1 + i % 2) + ([(i, 0, 7, "t"), (i, None, 7, "t")] if i % 4 == 0 else [])
    rows += [(9000, " ".join(words(rng, 150_000)) + " grumblox"), (9000, "kind words"), (9001, " ".join(words(rng, 150_000)))]
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int, score int, text string")
    docs = frame(spark, rows).selectExpr("*", "1 as score", "2 as toxic", "3 as held_out")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == len(rows) and sum(r.predicted for r in got) == sum("grumblox" in t for _, t in rows)
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum("grumblox" not in t for _, t in rows)


def test_plain_words_are_restored_as_by_the_expressions():
    rng = random.Random(22)
    model = toxicity.CharModel(trigrams("you are an idiot and a loser they are stupid scum of the earth " * 50))
    restorer = toxicity.Restorer(model)
    tokens = ["word", "(iddiot),", "'looser'", "stuupid.", "na\u00efve?", "\u00e9\u00e9t\u00e9;", "\u65e5\u65e5", "...", "", "a.b", "ab-cd:", "scum!", "\"!diot\"", "x1", "aa", "re:.aa"]
    tokens += ["".join(rng.choice("aiddo.,;:?()'\"!1\u00e9\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(600)]
    for t in tokens:
        want = toxicity._words(t)
        for m in toxicity._ODD.finditer(t):
            x = toxicity._gaps(" ", m[0]).rstrip("!|+") if toxicity._gap(m[0]) else m[0]
            want += toxicity.decode(x, model).split()
        assert list(restorer.words(t)) == want, t
    weights = {"=idiot": 0.9, "^loos": 0.8, "^aidd": 0.7, "=oo": 0.6, "^ioaad": 0.6}
    scorer = toxicity.Scorer(model, weights)
    for t in tokens + ["iiddioott", "loooser", "aaiddx", "ioaaadd"]:
        hit = {max(h, key=lambda x: (weights[x], x)) for v in restorer.words(t) if (h := [f for f in toxicity.features(v) if f in weights])}
        assert scorer.score(t) == pytest.approx(1 - 0.98 * np.prod([1 - weights[f] for f in hit])), t


def trigrams(text):
    counts = np.zeros(toxicity.SIGNS**3, np.int64)
    import pyarrow as pa

    for b in toxicity._grams([pa.RecordBatch.from_pydict({"text": [text]})]):
        counts[b.column(0).to_numpy()] += b.column(1).to_numpy()
    return counts


def test_short_lines_are_linked(spark):
    rows = [(1, "abcdefgh ijklmno\nunrelated line"), (2, "abcdefgh ijklmnop"), (3, "exactly8"), (4, "exactly9!")]
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(frame(spark, rows)).collect()} == {1: rows[0][1], 2: "", 3: "exactly8", 4: "exactly9!"}
