"""Operators on small tables: brute force, exact round trips, edge rows and empty tables."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import bm25, langid, mixing, order, pieces, quality, simhash, template, toxicity, urls
from kestrel.llm import queries as Q
from kestrel.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size int, verdict string, fingerprint string"
MODEL = pieces.PieceModel.from_path("/opt/tokenizers/piece_bpe_32k.model")
VOCAB = order.BytePairs.from_path("/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def edge(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away " * 4000
    texts = [None, "", "   \n\t ", "a", long, "same words here", "same words here", "12 34 !!", "ünï  cödé ▁ \U0001f600 tail ", long + "end"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 1.0, "x", 1, "v", "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id at all", "en", "s1", None, 1.0, "x", 1, "v", "f")], DOC)


def test_edge_rows_and_empty_tables(spark, edge):
    """Every operator takes nulls, empty and long texts, repeated rows, clashing names and no rows at all."""
    lid, tox = langid.fit(edge), toxicity.ToxicityModel(toxicity.char_model(edge), -1.0, {"lazy": 2.0})
    run = {
        "quality": lambda d: quality.quality(d), "mix": lambda d: mixing.mix(d), "repeat": lambda d: mixing.repeat(d), "near": lambda d: simhash.near_groups(d), "lid": lambda d: langid.identify(d, lid), "tox": lambda d: toxicity.score(d, tox), "pieces": lambda d: pieces.encode(d, MODEL), "digests": lambda d: pieces.digests(d, MODEL),
    }
    for name, f in run.items():
        n = f(edge).count()
        assert n == edge.count() or name == "repeat", name
        assert f(edge.limit(0)).count() == 0, name
    assert simhash.deduplicate(edge).count() == edge.count() - 2  # row 6 copies row 5, row 9 nearly copies row 4; rows that repeat an id stay or go together
    assert simhash.deduplicate(edge.limit(0)).count() == 0
    assert order.records(order.shards(edge.limit(0), VOCAB)).count() == 0
    assert bm25.search(edge, F.lit(True)).filter("rank = 1 and query_id = 0").count() == 0 and bm25.search(edge.limit(0), F.lit(True)).count() == 0
    assert toxicity.fit(edge.limit(0), edge.limit(0).select("doc_id", F.lit(1).alias("toxic"))).weights == {}


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(str(None if x != x else x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_feistel_is_a_permutation_and_shards_read_back(spark):
    for n in (1, 2, 3, 100, 1000):
        p = order.Feistel(n, 9)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.ordinal(slots) == np.arange(n)).all()
    docs = spark.createDataFrame([(i, f"Some text {i}. It's  here\n\n and\tthere  x é{i} " * (i % 7)) for i in range(60)], "doc_id long, text string")
    layout = order.Layout(16, 32)
    t = order.shards(docs, VOCAB, layout, key=5)
    rows = order.records(t).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    enc, got = VOCAB.encoding(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["seq"])):
        got[r["doc_id"]] = got.get(r["doc_id"], []) + np.frombuffer(r["ids"], "<u2").tolist()
    assert got == {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in docs.collect() if r["text"]}
    assert [r["slot"] for r in order.read_from(t, 40, layout).collect()] == list(range(40, len(rows)))


def test_template_language():
    render = lambda s, **v: "".join(x for x, _ in template.Template(s).render([], **v))
    assert render("{{ 1 + 2 }}{{ 'a' ~ 'b' | upper }}{# no #}{% if true and not false %}y{% else %}n{% endif %}") == "3aBy"
    assert len(template.Template("{{ 'x' | upper }}-{% if 1 == 2 %}a{% else %}b{% endif %}").tree) == 1  # folded to one text
    assert render("{% for x in xs -%}  {{ loop.index }}{{ x.k }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}]) == "1a,2b"
    assert render("{% set y = z if z else 'd' %}{{ y.__class__ }}{{ y[0] }}", z=None) == ""
    for bad in ("{% for %}", "{{ f(1) }}", "{{ x", "{% if 1 %}", "{% endfor %}", "{{ x | nope }}"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)


def test_chat_round_trip(spark):
    text = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text + "\\"), (1, 2, "we\nird: role", None), (1, 3, "assistant", ""), (2, 0, None, "x"), (None, 0, "assistant", "</turn>\n### user\nno")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for part in (4_000_000, 5):
        got = {r["conv_id"]: r for r in template.read_digests(template.format_conversations(df, part_chars=part)).collect()}
        for conv in (1, 2, None):
            mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
            loss = "".join(t for r, t in mine if r == "assistant")
            want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
            assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(mine), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert template.format_conversations(df.limit(0)).count() == 0


def brute_groups(fps, radius):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
            a, b = min(label[i], label[j]), max(label[i], label[j])
            label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("tile", [8, 32768])
def test_simhash_links_are_exact(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [int(b) for b in base] + [0]
    for b in base[:6]:  # chains and dense balls around it
        for _ in range(30):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.append(int(b) ^ sum(1 << int(f) for f in flips))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, simhash.block_keys(), simhash.star_links, tile)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_groups(fps, 4)


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 300)) for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(10):
        near, far = list(base[i]), list(base[i])
        near[50 + i] = "changed"
        far[:120] = list(rng.choice(words, 120))
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(far)), (300 + i, rows[i][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [*range(20), *range(200, 210)]


def test_sampler_draws_the_right_distribution():
    sampler = pieces.Sampler(MODEL)
    v, text, n, k = sampler.v, "the cat", 3000, 3
    known = {t.decode(): i for i, t in enumerate(v.text_of) if t and i not in set(v.byte_ids.tolist())}
    found = {}

    def go(at, ids, w):
        if at == len(text) + 1:
            found[tuple(ids)] = w
        for m in range(1, len(text) + 2 - at):
            piece = (" " + text)[at : at + m]
            if piece in known:
                go(at + m, [*ids, known[piece]], w + v.logw[known[piece]])

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(found.values()))
    samples, lat, threshold = sampler.sample([text] * n, list(range(n)), k)
    flat = [pieces.path_ids(lat, s.edge, s.begin) for s in samples]
    first, pairs = {}, {}
    for i in range(n):
        got = [tuple(f[b[i] : b[i + 1]].tolist()) for f, b in flat]
        assert len(set(got)) == k and all(abs(found[g] - z - s.log_prob[i]) < 1e-9 for g, s in zip(got, samples, strict=True))
        assert samples[0].perturbed[i] >= samples[1].perturbed[i] >= samples[2].perturbed[i] >= threshold[i]
        first[got[0]] = first.get(got[0], 0) + 1
        pairs[got[:1][0], got[1]] = pairs.get((got[0], got[1]), 0) + 1
    best = sorted(found, key=found.get, reverse=True)[:3]
    p = {g: math.exp(found[g] - z) for g in best}
    assert all(abs(first.get(g, 0) / n - p[g]) < 0.04 for g in best)
    assert abs(pairs[best[0], best[1]] / n - p[best[0]] * p[best[1]] / (1 - p[best[0]])) < 0.04


def test_pieces_round_trip(spark, edge):
    t = pieces.encode(edge, MODEL).select("text", F.explode("samples").alias("s")).select("text", F.col("s.ids").alias("ids"))
    assert all(r["text"] == r["decoded"] for r in pieces.decode(t, MODEL).collect())


def test_bm25_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in bm25.search(docs, F.col("doc_id") % 20 == 0, k=5, shard_docs=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
    rows = docs.orderBy("doc_id").collect()
    lists = [dict(zip(h.tolist(), n.tolist(), strict=True)) for h, n, _ in (bm25.terms(r["text"]) for r in rows)]
    size = [sum(x.values()) for x in lists]
    avg, df = sum(size) / len(size), {}
    for x in lists:
        for t in x:
            df[t] = df.get(t, 0) + 1
    for q, asked in zip(rows, lists, strict=True):
        if q["doc_id"] % 20 or not asked:
            continue
        idf = {t: math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in asked}
        score = [sum(asked[t] * idf[t] * x[t] * 2.2 / (x[t] + 1.2 * (0.25 + 0.75 * n / avg)) for t in asked if t in x) for x, n in zip(lists, size, strict=True)]
        want = sorted(((r["doc_id"], round(s, 6)) for r, s in zip(rows, score, strict=True) if s > 0), key=lambda p: (-p[1], p[0]))[:5]
        assert [d for d, _ in got[q["doc_id"]]] == [d for d, _ in want]


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    t = Q.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert t.filter("lang = lang_pred").count() > 0.97 * t.count()
    t = Q.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert t.filter("toxic = predicted").count() > 0.93 * t.count()


@pytest.mark.parametrize("token", ["1d10t", "i.d.i.o.t", "idiooooot", "!diot", "id!0t###", "***idiot***", "IDIOT!!".lower()])
def test_obfuscated_words_are_restored(spark, token):
    docs = spark.createDataFrame([("you idiot are an idiot and this is stupid text about cats in it " * 30,)], "text string")
    model = toxicity.ToxicityModel(toxicity.char_model(docs), -3.0, {"idiot": 6.0})
    score = model.scorer()
    assert score(f"what {token} said")[1] == ["idiot"] and score("an i d i o t here")[1] == ["idiot"]
    assert score("a clean idea about ibis 101 $100")[1] == []


def test_skeletons_never_hide_a_reading():
    logp = np.zeros((toxicity.CLASSES,) * 3, np.float32)
    for token in ("1d10t", "$h!t", "a$$", "b00k", "7rash", "l0$3r", "(lown"):
        readings = ["".join(r) for r in itertools.product(*[[x for x, _ in slot] for slot in toxicity.lattice(token)])]
        shapes = set(toxicity.skeletons(token))
        assert all(toxicity._skeleton(r) in shapes or not r for r in readings), (token, set(readings))
        assert toxicity.decode(token, logp) in readings


def test_water_filling(spark):
    rows = [(i, "w " * (1 if i < 10 else 50), None, "a" if i < 10 else "b" if i < 40 else "c", 0) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("n")).collect()}
    assert got["a"]["t"] == 30.0 and got["a"]["n"] == 30  # clamped at three times its 10 words
    assert got["b"]["t"] == pytest.approx(2980 * 2 / 5) and abs(got["b"]["n"] - got["b"]["t"]) <= 25 and abs(got["c"]["n"] - got["c"]["t"]) <= 25
    assert mixing.repeat(docs).count() == sum(r["taken"] // r["size"] for r in mixing.mix(docs).collect())


def test_url_rules(spark):
    rules = [urls.Rule(*r) for r in Q.RULES]
    pages = spark.createDataFrame([(1, "http://A.Example.ORG/es/1?x", "c"), (2, "https://example.org/en/12", "c"), (3, "x", "c"), (4, None, "c"), (5, "ftp://b.com/fr/#", "c"), (6, "http://notorg/", "c")], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(pages, rules).collect()}
    assert got == {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.com", "/fr/", "com/fr/", "allow"), 6: ("notorg", "/", None, "allow")}
    bad = spark.createDataFrame([(i, f"http://h.x/spam/{i}", "") for i in range(40)] + [(100 + i, f"http://h.x/ok/{i}", "") for i in range(40)], "page_id long, url string, html string")
    labels = bad.select("page_id", (F.col("page_id") < 100).cast("int").alias("bad")).filter("page_id % 2 = 0")
    verdicts = urls.url_filter(bad, [], labels).groupBy("template", "verdict").count().collect()
    assert {(r["template"], r["verdict"], r["count"]) for r in verdicts} == {("/spam/*", "block", 40), ("/ok/*", "allow", 40)}


def test_url_branches_part_at_any_depth(spark):
    deep = [(i, f"http://h.x/2024/05/01/cat/a/b/{'spam' if i < 40 else 'ok'}/p{i}x/{i}") for i in range(80)] + [(200, "http://h.x/" + "t/" * 300)]
    pages = spark.createDataFrame(deep, "page_id long, url string")
    labels = pages.select("page_id", (F.col("page_id") < 40).cast("int").alias("bad")).filter("page_id % 2 = 0 and page_id < 80")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.url_filter(pages, [], labels).collect()}
    assert len(got) == 81 and got[200] == ("/*" * 300, "allow")
    assert {got[i] for i in range(40)} == {("/*" * 6 + "/spam/*/*", "block")} and {got[i] for i in range(40, 80)} == {("/*" * 6 + "/ok/*/*", "allow")}


def test_quality_features_by_hand(spark):
    text = "a b c d a b c\n\nx\n x\nx # $|"
    row = quality.features(spark.createDataFrame([(1, text, None, None)], "doc_id long, text string, lang string, source string")).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), 3, 0, len(covered))
