"""The ten operators against brute force, on small tables with hard cases."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from topicloom.llm import bpe, components, exact_dedup, html_extract, media, mixing, quality, simhash, token_count, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, sha string, fp long, score double, kept boolean, key string"
WORDS = "the of and to in is for on with as river stone cloud amber tiger lamp desk window garden paper train music color shape".split()


def rows():
    """Texts with copies, near copies, nulls, repeated rows, odd white space and one very long text."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(60)]
    texts += [t.replace(" ", "\n", 1) for t in texts[:5]] + texts[5:9] + [texts[10] + " extra", texts[10], "", None, " \t\n", "a", "Ünïcode — ‘quotes’  日本語 🙂 <|endoftext|> x", "x " * 30_000, " nbsp ", "it's they'LL we'd", "   lead", "trail   "]
    out = [(i, t, "en", f"src{i % 4}" if i % 9 else None, 0, 7, "clash", 1, 0.5, True, "k") for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id", "en", "src1", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


# ---- 10: byte-pair encoding ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_encoding_is_exact(reference):
    coder, rng = bpe.load(bpe.default_vocabulary()), random.Random(1)
    pieces = list("aabeetthh  '''sdlr\n\t.,!?019éüñ日🙂　٣Ⅷ²") + ["<|endoftext|>", "'ll", "  ", "   ", " \n", "ing", " the", "\r\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids, repr(text)
        assert coder.decode(coder.encode(text)) == reference.decode(ids, skip_special_tokens=False)
    for _ in range(2000):
        word = "".join(rng.choice("thesandingoredionx") for _ in range(rng.randint(3, 60)))
        assert coder.encode(word).tolist() == reference.encode(word, add_special_tokens=False).ids
    long = "ab" * 20_000 + " " + "é" * 5_000
    assert coder.encode(long).tolist() == reference.encode(long, add_special_tokens=False).ids


def test_bpe_query(docs, empty, reference):
    got = bpe.digests(docs).collect()
    assert len(got) == len(rows()) and all(r["exact"] for r in got)
    want = Counter((i, len(ids := reference.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    assert bpe.digests(empty).count() == 0
    pair = bpe.encode(docs.where("doc_id = 1")).first()
    assert pair["decoded"] == rows()[1][1] and pair["ids"] == reference.encode(rows()[1][1]).ids


# ---- 2: token counts -----------------------------------------------------------------------------------


def test_scan_stitches_blocks(spark, tmp_path):
    rng, want = np.random.default_rng(3), []
    for f in range(3):
        lengths = [*rng.integers(0, 40, 50), 700, 0, 0, 3]
        parts = [np.append(rng.integers(0, 100, n), 50_256) for n in lengths] + ([rng.integers(0, 100, 9)] if f == 1 else [])
        np.concatenate(parts).astype("<u2").tofile(tmp_path / f"f{f}.bin")
        start = 0
        for i, p in enumerate(parts):
            n = len(p) - (p[-1] == 50_256)
            want.append((f"f{f}.bin", i, start, n, bool(p[-1] == 50_256)))
            start += n + 1
    (tmp_path / "none.bin").touch()
    for block in (16, 256, 1 << 20):
        got = token_count.scan(spark, f"file://{tmp_path}", block_bytes=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        token_count.scan(spark, f"file://{tmp_path}")


def test_token_counts_of_documents(docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.default_vocabulary())
    plain.encode_special_tokens = True  # a text that spells the separator is ordinary text
    want = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_count.counts(docs).collect()) == want
    assert token_count.counts(empty).count() == 0


# ---- 3: exact duplicates --------------------------------------------------------------------------------


def test_binary_fuse_filter():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 100, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        f = exact_dedup.BinaryFuse.load(exact_dedup.BinaryFuse.build(keys).dump())
        assert f.contains(keys).all()
        other = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert f.contains(other).mean() < 0.01
        # the published size: a factor of the keys, rounded up to segments, and two segments more
        grow = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        assert len(f.slots) <= grow * n + 3 * f.segment


def brute_dedup(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for body, g in groups.items():
        keep = min(g)[3]
        for *_, i in g:
            out[i, keep, len(g), i == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def test_exact_dedup(docs, empty):
    from pyspark.sql import functions as F

    for split in (None, F.col("doc_id") < 5, F.lit(False), F.lit(True)):
        got = exact_dedup.dedup(docs, split=split).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["n"], r["kept"], r["sha"]) for r in got) == brute_dedup(rows())
    assert exact_dedup.dedup(empty).count() == 0


# ---- 8: SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    s = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            top[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_simhash(docs, empty):
    data = rows()
    fps = [brute_fingerprint(t) for _, t, *_ in data]
    classes = brute_classes(fps)
    least = {}
    for (i, *_), c in zip(data, classes, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f - (1 << 64) * (f >> 63), least.get(c)) for (i, *_), f, c in zip(data, fps, classes, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_nothing(spark, monkeypatch):
    """Dense balls of fingerprints, with cells small enough to be split into pairs of blocks."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(120):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for n in (len(fps), 50_000_000):  # another layout of blocks
        top = {r["v"]: r["top"] for r in components.components(simhash.links(df, n)).collect()}
        mine = [top.get(f, f) for f in signed]
        want = brute_classes(fps)
        assert len({*zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    got = {r["v"]: r["top"] for r in components.components(edges).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1 and got[1000] == got[1001] != got[0]
    assert components.components(edges.where("u < 0")).count() == 0


# ---- 6: mixing ---------------------------------------------------------------------------------------------


def test_targets_and_flow():
    assert mixing.targets([10, 10], [5, 2], 30) == [20.0, 10.0]
    assert sum(mixing.targets([100, 1, 50], [5, 2, 1], 226.5)) == pytest.approx(226.5)
    assert mixing.targets([0, 4], [5, 2], 6) == [0.0, 6.0]
    # the shared pattern fills the quota that the own one cannot, and repeats only as needed
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [25, 5], 2)
    assert sum(flow) == 30 and max(flow) <= 20 and flow[1] == 5 and flow[0] + flow[2] == 25
    assert abs(flow[0] - flow[2]) <= 15
    assert mixing.min_cost_flow([4], [[0]], [100], 2) == [8]


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    size = Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, mixing.targets([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values())), strict=True))
    taken = Counter()
    for r in got:
        s = r["members"][0]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    for s in names:  # one text of 30,000 words is more than its source's quota
        assert taken[s] <= want[s] + 1
        assert taken[s] >= 0.8 * want[s] or size[s] > 20_000
    assert mixing.mix(empty).count() == 0


def brute_targets(sizes, weights, total):
    """Water-filling by bisection on the common rate: min(rate * weight, 2 * size) sums up to the total."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, 2 * s) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    return [min(hi * w, 2 * s) for s, w in zip(sizes, weights, strict=True)]


def test_flow_against_all_integer_plans():
    from itertools import product

    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply, quota = [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 5) for _ in range(m)]
        allowed = [sorted(rng.sample(range(m), rng.randint(0, m))) for _ in range(n)]
        # every split of what each pattern may send over its sources
        splits = [[x for x in product(*([range(2 * s + 1)] * len(a))) if sum(x) <= 2 * s] for s, a in zip(supply, allowed, strict=True)]
        best = None
        for plan in product(*splits):
            into = [0] * m
            for a, x in zip(allowed, plan, strict=True):
                for q, y in zip(a, x, strict=True):
                    into[q] += y
            if all(i <= q for i, q in zip(into, quota, strict=True)):
                cost = sum(sum(x) + 2 * max(0, sum(x) - s) for s, x in zip(supply, plan, strict=True))
                best = min(best, (-sum(into), cost)) if best else (-sum(into), cost)
        flow = mixing.min_cost_flow(supply, allowed, quota)
        assert (-sum(flow), sum(f + 2 * max(0, f - s) for f, s in zip(flow, supply, strict=True))) == best


def test_flow_over_many_patterns():
    import time

    rng = random.Random(1)
    supply = [rng.randint(1, 1000) for _ in range(20_000)]
    allowed = [rng.sample(range(14), rng.randint(1, 5)) for _ in supply]
    began = time.process_time()
    flow = mixing.min_cost_flow(supply, allowed, [sum(supply) // 10] * 14)
    assert sum(flow) == 14 * (sum(supply) // 10) and time.process_time() - began < 60


def test_mix_of_overlapping_sources_and_shared_ids(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    data = [(i if i % 3 else None, " ".join(["w"] * rng.randint(0, 9)), [["a"], ["b"], ["a", "b"], ["b", None], None, []][i % 6]) for i in range(900)]
    data += [(7, "w w w", ["a"])] * 90
    docs = spark.createDataFrame(data, "doc_id long, text string, in_ array<string>")
    got = mixing.mix(docs, sources=F.col("in_")).collect()
    again = mixing.mix(docs.repartition(7), sources=F.col("in_")).collect()
    tell = lambda rs: Counter((r["doc_id"], tuple(r["members"]), r["size"], r["taken"]) for r in rs)
    assert tell(got) == tell(again) and len(got) == len(data)
    size = Counter()
    for _, t, m in data:
        for x in [None] if m is None else m:
            size[x] += len(t.split())
    names = ["a", "b", None]
    want = brute_targets([size[x] for x in names], [5, 2, 1], 1.5 * sum(len(t.split()) for _, t, _ in data))
    taken = Counter()
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"] and (r["members"] or r["taken"] == 0 == r["target"])
        taken[tuple(r["members"])] += r["taken"]
    for x, w in zip(names, want, strict=True):
        assert next(r["target"] for r in got if r["members"] and r["members"][0] == x) == pytest.approx(w, rel=1e-6)
    # all quotas together are met as far as the patterns allow, within a document for each pattern
    assert sum(taken.values()) <= sum(want) + 3 and sum(taken.values()) >= min(sum(want), 2 * sum(taken[m] and sum(r["size"] for r in got if tuple(r["members"]) == m) for m in taken)) - 9 * len(taken)


def test_rows_without_ids_are_taken_one_by_one(spark):
    data = [(None, "w " * (i % 7 + 1), "s" + str(i % 2)) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1"):
        own = [r for r in got if r["members"][0] == s]
        target = own[0]["target"]
        assert abs(sum(r["taken"] for r in own) - target) <= 7 and target == pytest.approx(brute_targets([sum(r["size"] for r in got if r["members"][0] == x) for x in ("s0", "s1")], [5, 2], 1.5 * sum(r["size"] for r in got))[s == "s1"])


# ---- 7: media -----------------------------------------------------------------------------------------------


def test_media(docs, empty):
    got = media.features(media.store(docs)).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows():
        raw = (t or "").encode()
        body = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = next(x for x in by[i] if x["n_bytes"] == len(raw))
        assert r["payload_bytes"] == len(body) and r["payload_sha256"] == hashlib.sha256(body).hexdigest() and r["tail_crc32"] == zlib.crc32(body[-64:])
        with io.BytesIO() as f:
            with wave.open(f, "wb") as w:
                w.setparams((1, 1, media.RATE, 0, "NONE", ""))
                w.writeframes(body)
            assert r["media_sha256"] == hashlib.sha256(f.getvalue()).hexdigest() and r["media_bytes"] == len(f.getvalue())
    assert media.features(media.store(empty)).count() == 0


def test_peaks_find_a_tone():
    t = np.arange(8 * media.FRAME)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8)
    bins, power = media.peaks(tone)
    assert (bins[:, 1] == 40).all() and (power[:, 1] > power[:, 0]).all()
    times, codes = media.landmarks(np.concatenate([tone[:700], tone[100:900], np.roll(tone, 3)]))
    assert (np.diff(times) >= 0).all() and ((codes >> 20) > 0).all()
    # blocks of frames give what one pass gives
    x = np.random.default_rng(0).integers(0, 256, 40 * media.FRAME).astype(np.uint8)
    whole = media.landmarks(x)
    media.BLOCK, keep = 7, media.BLOCK
    assert all((a == b).all() for a, b in zip(media.landmarks(x), whole, strict=True))
    media.BLOCK = keep


# ---- 9: URL filter -------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["https://WWW.example.com/en/1", "http://a.example.com/en/x?y#z", "http://example.com/de/", "http://b.net/es/1", "http://b.net/en/1", "net://net/fr/", "http://com/", "http://notexample.com/en/", None, "no scheme", "http://", "http://c.org#f", "http://x.com?q=/en/"]
    pages = spark.createDataFrame([(i, u, None, "clash", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, bound double")
    outcomes = spark.createDataFrame([("http://c.org/1", 1)] * 30 + [("http://b.net/en/1", 0)] * 30, "page_url string, good int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/", "com/", "com/", None, None, None, None, None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 11)] == ["allow", "block", "allow", "block", "block", "allow"]
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/1") and (got[1]["host"], got[1]["path"]) == ("a.example.com", "/en/x")
    assert (got[8]["host"], got[8]["path"], got[9]["host"]) == ("", "", "")
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    none = url_filter.judge(pages, outcomes.limit(0)).collect()
    assert len(none) == len(urls) and all(r["bound"] is not None for r in none)


def test_reputation_shrinks(spark):
    rows = [("a.x.com", 1, 0), ("b.x.com", 200, 198), ("c.x.com", 0, 0), ("bad.org", 200, 2), ("new.org", 0, 0)]
    b = {r["host"]: r["bound"] for r in url_filter.reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()}
    assert b["b.x.com"] > b["c.x.com"] and b["bad.org"] < 0.1 and b["a.x.com"] < b["b.x.com"] and 0 <= b["new.org"] < b["b.x.com"]


# ---- 5: HTML ---------------------------------------------------------------------------------------------------


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x > y --><div class="ad">Buy</div><div class="cookie-notice">OK?</div>
    <article><header><h1>Head &amp; more</h1></header><p><b>First<br>line<p>Second   para
    &lt;tag&gt; &eacute;</p><form><input value="<p>no</p>">Search</form><ul><li>one<li>two</ul><div id="comments"><p>Reader says</p></div><aside>Side</aside></article>
    <footer>&copy; me</footer>"""
    assert html_extract.blocks(page) == (["Head & more", "First line", "Second para <tag> é", "one", "two"], True)
    assert html_extract.blocks("<main><p>a</p></main><p>b</p>") == (["a"], True)
    assert html_extract.blocks("<p>a<div class='sidebar'>x</div>b &nbsp; c") == (["a", "b c"], False)
    assert html_extract.blocks(None) == ([], False) and html_extract.blocks("") == ([], False)
    assert html_extract.blocks("plain < text & more")[0] == ["plain < text & more"]
    assert html_extract.blocks("<p>x<script>never closed <p>y")[0] == ["x"]


def test_suffix_arrays_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(0, 120))
        tokens, page = rng.integers(0, 3, n), np.sort(rng.integers(0, 4, n))
        hit = html_extract.covered(tokens, page, 4)
        want = np.zeros(n, dtype=bool)
        for i in range(n - 3):
            if page[i] == page[i + 3]:
                same = {page[j] for j in range(n - 3) if page[j] == page[j + 3] and (tokens[j : j + 4] == tokens[i : i + 4]).all()}
                if len(same) >= 2:
                    want[i : i + 4] = True
        assert (hit == want).all()


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 30, 64, 200):
        for k in (1, 2, 5):
            x = rng.integers(0, k, n)
            order, shared = html_extract.suffix_array(x)
            assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
            for i in range(1, n):
                a, b = x[order[i - 1] :], x[order[i] :]
                m = min(len(a), len(b))
                same = np.flatnonzero(a[:m] != b[:m])
                assert shared[i] == (same[0] if len(same) else m)


def test_hostile_pages_are_read_in_linear_time():
    import time

    n = 1_000_000
    for piece in ('<a "x', "<a ='x", '<a x="', "<div>", "<b x=1>", "</q>", "<", "<!--", "<p><b c=d>", "&amp", "<script>"):
        began = time.process_time()
        html_extract.blocks(piece * (n // len(piece)))
        assert time.process_time() - began < 20, piece
    for many in ("<div>" * 50_000 + "</p>" * 50_000, "<i x=y>" * 50_000 + "<p>" * 50_000):
        began = time.process_time()
        html_extract.blocks(many)
        assert time.process_time() - began < 20
    assert html_extract.blocks('<p title="a > b">x</p><p title=it\'s>y</p><p class="never closed>z')[0] == ["x", "y"]


def test_extract(spark):
    boiler = "Welcome to our site please read all the terms of use before you go on"
    pages = [(i, f"http://h.example/{i}", f"<div>{boiler}</div><div>Own words of page {i} that are like no other {i * 7}</div>", "clash") for i in range(5)]
    pages += [(7, None, None, "x"), (8, "http://h.example/8", "", "x"), (9, "http://z.example/", f"<article><p>{boiler}</p></article>", "x"), (10, "http://z.example/2", f"<article><p>{boiler}</p></article>", "x")]
    df = spark.createDataFrame(pages + pages[:1], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == len(pages) + 1
    for i in range(5):
        assert got[i]["text"] == f"Own words of page {i} that are like no other {i * 7}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[7]["text"] == got[8]["text"] == "" and got[9]["text"] == got[10]["text"] == boiler  # articles may repeat
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- 1 and 4: classifiers ----------------------------------------------------------------------------------------


def test_grammar():
    g = toxicity.Grammar()
    weight = lambda t: sum(w for w, _ in g.clauses(t)[0])
    assert weight("you are an idiot") > weight("this idiot here") > weight("he is not an idiot here") / 1.5 > 0
    assert weight("she said he is an idiot") < weight("he is an idiot") and weight('"an idiot" in quotes') < weight("an idiot")
    assert weight("I will kill you") > 0 == weight("kill the process") and weight("") == 0 == weight("a fine day. not bad")
    assert len(g.clauses("an idiot. a moron; you loser")[0]) == 3
    assert g.clauses("idiot")[0] == g.clauses("idiot!")[0] == []  # a word alone is no clause
    assert len(g.clauses("idiot. moron; loser")[0]) == 1  # nor are marks between single words the ends of clauses
    assert weight('a 5" pipe. you are an idiot.') == weight("you are an idiot.")  # a quotation ends with its clause


def brute_clause(symbols):
    """Score of one clause by looking back from every insult and threat; weights are 1."""
    T = toxicity
    words = [x for x in symbols if x != T.QUOTE]
    if len(words) < 2:
        return 0.0
    total = 0.0
    for i, x in enumerate(symbols):
        if x not in (T.INSULT, T.THREAT):
            continue
        before = symbols[:i]
        since = [y for y in before if y != T.QUOTE]
        w = T.NEGATED if T.NOT in since[-T.REACH :] else 1.0
        w *= T.REPORTED if T.SAYS in before or before.count(T.QUOTE) % 2 else 1.0
        aimed = T.TARGET in symbols
        total += w * (T.TARGETED if aimed else 1.0) if x == T.INSULT else w * aimed
    return total


def test_machine_against_every_short_clause():
    from itertools import product

    T, m = toxicity, toxicity.MACHINE
    for n in range(6):
        for symbols in product([x for x in T.SYMBOLS if x < T.PAUSE], repeat=n):
            q, sums = 0, {T.INSULT: 0.0, T.THREAT: 0.0}
            for x in symbols:
                if x in sums:
                    sums[x] += m.factor[q][x]
                q = m.next[q][x]
            a, b = m.accept[q]
            assert a * sums[T.INSULT] + b * sums[T.THREAT] == pytest.approx(brute_clause(list(symbols)))
            n_words = sum(x != T.QUOTE for x in symbols)
            assert (m.gives[q][T.END], m.next[q][T.END]) == ((T.END, 0) if n_words > 1 else (T.PAUSE, q))


def test_toxicity_learns(spark):
    rng, data, lab = random.Random(2), [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choices(WORDS, k=30)
        if toxic:
            for w in rng.sample(["grumblix", "snarfo", "idiot"], 2):
                words.insert(rng.randrange(30), w)
        data.append((i, " ".join(words)))
        lab.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(data + [(900, None), (901, ""), (902, "x " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in lab) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_quality_learns(spark):
    rng, data, lab = random.Random(3), [], []
    for i in range(800):
        good = i % 5 != 0
        words = rng.choices(WORDS, k=40)
        data.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        if i % 2:
            lab.append((i, int(good), 0))
    docs = spark.createDataFrame(data + [(900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([got[i]["predicted"] == (i % 5 != 0) for i in range(800)]) > 0.98
    assert got[900]["score"] == got[901]["score"] and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_class_prior_and_risk():
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-4, 1, 1200)])
    assert quality.class_prior(p, u) == pytest.approx(0.7, abs=0.06)
    assert quality.pu_risk(np.ones(5) * 9, np.ones(5) * 9, 0.9)[0] < 1e-3


def test_classifiers_take_hard_rows(docs, empty, labels):
    for f in (toxicity.classify, quality.classify):
        got = f(docs, labels).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
        assert f(empty, labels).count() == 0
        assert f(docs, labels.limit(0)).count() == len(rows())


def test_insult_stems():
    g = toxicity.Grammar({"foo*": 2.0, "foobar*": 5.0, "plain": 3.0})
    assert g.hits({"foo", "fool", "foobars", "plain", "plainly", "kill"}) == {"fool": ("insult", 2.0), "foobars": ("insult", 5.0), "plain": ("insult", 3.0), "kill": ("threat", g.threats["kill"])}
    assert g.clauses("you fool")[0] == [(2.0 * toxicity.TARGETED, True)] and g.clauses("foo")[0] == []


def test_short_payloads_have_landmarks():
    t, c = media.landmarks(np.frombuffer(media.padded(b"a few words"), dtype=np.uint8))
    assert len(t) == len(media.BANDS) - 1 and (c & 255 == 0).all()
