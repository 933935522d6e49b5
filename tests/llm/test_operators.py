"""Each operator against a plain version over the smallest tables, or an exact round trip."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import decontamination, fixity, html_extraction, licenses, packing, quality_classifier, quality_rules, queries, sharding, simhash, token_store
from loomspan.llm.common import components, table
from loomspan.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def test_queries_are_whole(spark, docs):
    found = queries.queries()
    assert [k.split("_")[0] for k in found] == [f"op{i}" for i in range(1, len(found) + 1)]


# --- simhash

def slow_fingerprint(text):
    import xxhash

    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = WORD.findall(words)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_simhash(spark, docs):
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    group = {i: i for i in fps}
    ids = sorted(fps)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    want = {i: (f"{fps[i]:016x}", root(i)) for i in ids}
    for block in (simhash.BLOCK, 4):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, SF, "documents"), block=block).collect()}
        assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=20), st.lists(st.tuples(st.integers(0, 19), st.sets(st.integers(0, 63), max_size=5)), max_size=150), st.integers(0, 3))
def test_bit_slices(base, flips, radius):
    fps = set(base)
    for k, bits in flips:
        fps.add(base[k % len(base)] ^ sum(1 << b for b in bits))
    fps = np.array(sorted(fps), np.uint64)
    a, b = simhash.block_links(np.zeros(len(fps), int), fps, radius)
    got = simhash.forest(np.arange(len(fps)), a, b)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    assert (got == simhash.forest(np.arange(len(fps)), i, j)).all()


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1000, 1100)} == {1000} and len(got) == 161


# --- quality rules

def slow_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, docs):
    rows = quality_rules.judge(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == slow_counts(texts[r["doc_id"]]), r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        allowed = quality_rules.MAX_CHAR_DISTANCE + quality_rules.CHAR_NOISE / math.sqrt(max(1, len(texts[r["doc_id"]])))
        far = (r["char_distance"] or 0) > allowed or (r["word_distance"] or 0) > quality_rules.MAX_WORD_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)
    quality = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    good = [r["kept"] for r in rows if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if quality.get(r["doc_id"]) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(a * math.log2(a / c) for a, c in zip(q, m) if a) / 2)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.distance(F.col("p"), F.col("q")).alias("d"), quality_rules.distance(F.col("p"), F.col("p")).alias("z")).first()
    assert abs(row["d"] - want) < 1e-12 and row["z"] == 0


# --- tokens

TEXTS = st.text(st.sampled_from("aBé ß\n\t .,' 　 <|>9€😀") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_encoding_is_the_library_s(texts):
    enc = encoder(tokenizer_path())
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])] == (enc.plain(texts) if texts else [])


def test_token_store(spark, docs):
    enc = encoder(tokenizer_path())
    store = token_store.write(table(spark, SF, "documents"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.documents(spark, store).collect()}
    at, want = 0, {}
    for i in sorted(docs):
        raw = enc.plain([docs[i]])[0] + np.array([0], "<u4").tobytes()
        want[i] = (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert got == want
    foreign = spark.createDataFrame([(10**9 + i, 0) for i in range(500)] + [(5, 0)], "doc_id long, rank int")
    assert [r["doc_id"] for r in token_store.lookup(spark, store, foreign).collect()] == [5]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 3000):
        k1, k2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        seeds, slot = token_store.perfect_hash(k1, k2)
        assert sorted(slot) == list(range(n)) and len(seeds) == -(-n // token_store.GROUP)


# --- packing

def test_packing(spark, docs):
    enc = encoder(tokenizer_path())
    rows = packing.pack_documents(table(spark, SF, "documents")).toPandas()
    assert set(rows["doc_id"]) == set(docs)
    for i, g in rows.groupby("doc_id"):
        raw = enc.plain([docs[i]])[0] + np.array([2], "<u4").tobytes()
        g, at = g.sort_values("piece"), 0
        assert list(g["piece"]) == list(range(math.ceil(len(raw) / 4096)))
        for k, (s, n, crc) in enumerate(zip(g["start"], g["length"], g["ids_crc32"])):
            assert s == at and (k == 0 or n == 1024) and zlib.crc32(raw[4 * at : 4 * (at + n)]) == crc
            at += n
        assert at * 4 == len(raw)
    check_bins(rows)
    assert rows["sequence_id"].nunique() <= 1.02 * math.ceil(rows["length"].sum() / 1024) + 1


def check_bins(rows, capacity=1024):
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= capacity


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1, max_size=30))
def test_plan(counts):
    plan = packing.plan(counts, 60)
    bins = collections.defaultdict(list)
    for n, first, last, seq, off in plan.itertuples(index=False):
        for r in range(first, last):
            bins[seq + r - first].append((off, n))
    assert collections.Counter(n for b in bins.values() for _, n in b) == counts
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 60
        assert sum(3 * n > 60 for _, n in b) <= 2
    slow, gaps = 0, []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):  # first fit, decreasing
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(60 - n)
        else:
            gaps[k] -= n
    slow = len(gaps)
    assert len(bins) <= slow + 1


# --- sharding

def test_sharding(spark, docs):
    rows = sharding.shard_map(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(texts) and set(rows["shard"]) == set(range(16))
    assert all(r.size_ == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows.rename(columns={"size": "size_"}).itertuples())
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    ideal, most = rows["size"].sum() / 16, rows["size"].max()
    assert (abs(rows.groupby("shard")["size"].sum() - ideal) <= most + 0.06 * ideal).all()


def test_sharding_of_one_large_group(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard_map(df).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))


# --- decontamination

def test_decontamination(spark, docs):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(i, k) for i, t in docs.items() for k, s in items.items() if plain(s) in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(table(spark, SF, "documents"), table(spark, SF, "benchmark")).collect()}
    assert want <= got and len(got - want) <= len(want) // 10


def test_templates_and_slots(spark):
    item = "A train left Paris at noon and drove 120 km before Anna saw it stop for 120 minutes near the old bridge"
    docs = [
        (1, f"Some words before. {item}. And some behind it."),
        (2, item.replace("120", "95").replace("Anna", "Bertha").replace("Paris", "Rome")),
        (3, item.replace("120 km", "95 km").replace("Anna", "Bertha")),  # one of two equal numbers changed: the windows of the rarer one are dropped
        (4, "A boat left the harbour at noon and drove 120 km before anyone saw that it had not stopped anywhere on the way"),
    ]
    got = {r["doc_id"]: r for r in decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[1]["n_changed"] == 0 and got[2]["n_changed"] == 3


# --- classifier

def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality_classifier.score(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    known = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(rows[i]["predicted"], y) for i, y in known.items() if rows[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_held_out_labels_are_not_learned(spark):
    sf = SF
    flipped = table(spark, sf, "labels").selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a = quality_classifier.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    b = quality_classifier.train(table(spark, sf, "documents"), flipped)
    assert (a["w"] == b["w"]).all()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    doc, good, move = np.array([0, 0, 0, 1, 2, 2]), rng.normal(size=6), rng.normal(size=(2, 2))
    got = quality_classifier.marginals(doc, good, move)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, hits = 0.0, np.zeros(len(at))
        for code in range(2 ** len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            w = math.exp(sum(good[i] * v for i, v in zip(at, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total, hits = total + w, hits + w * np.array(y)
        assert np.allclose(got[at], hits / total)


# --- html

PAGE = "<html><head><title>t{0}</title></head><body><header>Site</header><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div>{1}<section id='comments'><p>comment {0}</p></section><footer>&copy; us</footer><script>var a = '<p>no</p>'</script></body></html>"


def test_html_templates(spark):
    pages = [(i, f"https://h.example/{i}", PAGE.format(i, f"<div class='box'><h2>Head {i}</h2><p>Body &amp; <b>soul</b>\n  of {i}<br>next</p><form>f</form><aside>s</aside></div>")) for i in range(6)]
    pages += [(6, "https://h.example/6", None), (7, None, "<article><p>alone</p></article>"), (8, "https://other.example", "<p>a<p>b &lt;c&gt;"), (9, "https://h.example/9", "")]
    got = {r["page_id"]: r for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    salted = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), most_broadcast=0).collect()
    assert {r["page_id"]: r["text"] for r in salted} == {i: r["text"] for i, r in got.items()}
    for i in range(6):
        assert got[i]["text"] == f"Head {i}\nBody & soul of {i}\nnext" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[6]["text"] == got[9]["text"] == "" and got[7]["text"] == "alone" and got[8]["text"] == "a\nb <c>"


def test_html_pages(spark):
    import html

    rows = html_extraction.extract(table(spark, SF, "pages")).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|i)>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# --- fixity

def test_fixity(spark):
    records = fixity.records(table(spark, SF, "pages"), per_file=8)
    assert fixity.audit(records, records).count() == 0
    got = {(r["record"], r["kind"]) for r in fixity.audit(records, fixity.damaged(records)).collect()}
    kinds = {"00": "missing", "01": "changed", "02": "changed"}
    want = {(r["record"], kinds[t]) for r in records.select("record").collect() if (t := hashlib.md5(str(r["record"]).encode()).hexdigest()[:2]) in kinds}
    assert got == want
    bad = records.selectExpr("file", "record", "CASE WHEN record IN (3, 30) THEN cast(concat(payload, cast('x' AS binary)) AS binary) ELSE payload END AS payload").where("record <> 17")
    more = bad.unionByName(spark.createDataFrame([(2, 10**6, bytearray(b"new"))], "file long, record long, payload binary"))
    assert {(r["record"], r["kind"]) for r in fixity.audit(records, more).collect()} == {(3, "changed"), (30, "changed"), (17, "missing"), (10**6, "extra")}


# --- licences

def test_licenses(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = licenses.train(spark, docs)
    rows = [r for r in licenses.scan(docs, model).collect() if r["confirmed"]]
    want = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    lines = [(r["doc_id"], k, x) for r in docs.collect() for k, x in enumerate((r["text"] or "").split("\n")) if x in want]
    assert {(i, k, want[x]) for i, k, x in lines} == {(r["doc_id"], r["paragraph"], r["family"]) for r in rows if r["text"] in want}
    own = spark.createDataFrame([(1, "Licensed under the Mozilla Public License, Version 2.0.\nThe license plate was yellow and old.\nReleased under the BSD license, as of 2021."), (2, "My driving license is void.")], "doc_id long, text string")
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(own, model).collect()}
    assert got == {(1, 0): "MPL", (1, 1): "unknown", (1, 2): "BSD", (2, 0): "unknown"}
