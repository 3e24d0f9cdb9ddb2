"""The operators against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import html_extraction, page_maker, pieces, toxicity
from loam.llm.components import components
from loam.llm.dom import blocks
from loam.llm.line_dedup import LineRuns, line_dedup
from loam.llm.media import interleaved, media_columns, png, resolved, samples, sequence, text_media
from loam.llm.minhash_dedup import minhash_dedup
from loam.llm.mixing import mix
from loam.llm.quality_rules import host_verdicts, quality_rules
from loam.llm.sharding import stratified_shards
from loam.llm.substring_dedup import substring_dedup
from loam.llm.words import Substrings, Words, buffers, chunks, grams, mix as spread

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Substrings


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 30))] for _ in range(6)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 20))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += ["x y " * 40, "z " * 50, texts[0]]
    window = 6
    first, gone = {}, {}
    for d, text in enumerate(texts):
        w = WORD.findall(text)
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (d, s)) != (d, s):
                gone.setdefault(d, set()).update(range(s, s + window))
    got = {r.doc_id: r for r in substring_dedup(frame(spark, texts), window=window, seed=3, with_text=True).collect()}
    for d, text in enumerate(texts):
        w = WORD.findall(text)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone.get(d, ()))
        assert (got[d].n_words, got[d].n_removed, got[d].kept, got[d].kept_sha256) == (len(w), len(gone.get(d, ())), kept, sha(kept))


# Lines


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    lines = ["common", " Common\t", "rare", "", "ÉCOLE", "école", "two words", "x"]
    texts = ["\n".join(rng.choice(lines) + (str(rng.randint(0, 9)) if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 6))) for _ in range(80)] + [None, ""]
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    held = {}
    for d, text in enumerate(texts):
        for s in (text or "").split("\n"):
            held.setdefault(key(s), set()).add(d)
    got = {r.doc_id: r for r in line_dedup(frame(spark, texts), min_docs=10, batches=5, fan_in=2, with_text=True).collect()}
    for d, text in enumerate(texts):
        parts = (text or "").split("\n")
        kept = [s for s in parts if not key(s) or len(held[key(s)]) < 10]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept) == (len(parts), len(parts) - len(kept), "\n".join(kept))


def test_runs_compact_by_level_and_leave_decided_keys_out(spark):
    runs = LineRuns(spark, min_docs=3, fan_in=2, buckets=3)
    batch = lambda keys: spark.createDataFrame([(k.encode(),) for k in keys], "key binary")
    runs.add(batch("aaab"))
    assert [len(x) for x in runs.levels] == [1]
    runs.add(batch("abbc"))
    assert [len(x) for x in runs.levels] == [0, 1]
    stored = {bytes(r.key): r.n for r in runs.read(runs.levels[1][0]).collect()}
    assert stored == {b"a": 3, b"b": 3, b"c": 1}  # a was decided before the second batch
    assert {bytes(r.key) for r in runs.decided().collect()} == {b"a", b"b"}


def test_runs_are_read_without_shuffle_or_sort(spark):
    runs = LineRuns(spark, min_docs=3, fan_in=9, buckets=3)
    batch = lambda keys: spark.createDataFrame([(k.encode(),) for k in keys], "key binary")
    runs.add(batch("aaab"))
    runs.add(batch("abbc"))
    with runs._merging():
        plan = runs._summed(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan


def test_runs_of_an_earlier_call_count(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    first = frame(spark, ["x\ny", "x\nz"])
    second = frame(spark, ["x\nonly", "y\nz", "z"])
    dedup = lambda docs: {r.doc_id: r.kept for r in line_dedup(docs, batches=2, with_text=True, runs=LineRuns(spark, min_docs=3, path=folder, buckets=2)).collect()}
    assert dedup(first) == {0: "x\ny", 1: "x\nz"}
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]:
        spark.sql(f"DROP TABLE {name}")  # as a new session has none
    assert dedup(second) == {0: "only", 1: "y", 2: ""}  # x in 3 documents, z in 3, y in 2
    with pytest.raises(ValueError, match="2 buckets"):
        LineRuns(spark, min_docs=3, path=folder, buckets=5)


# Near-duplicates


def near_brute(texts, k=4, percent=80):
    sets = []
    for text in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(w)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], sets


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 4)])
def test_near_duplicates_equal_brute_force(spark, seed, block):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):  # from links to none
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["a b", "A b", "c", "", None, texts[0].upper().replace("V", "v")]
    want, sets = near_brute(texts)
    got = {r.doc_id: r for r in minhash_dedup(frame(spark, texts), block=block).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# Mixing and shards


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    size = {r[0]: len(r[1].split()) for r in rows}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    names = sorted((s for s in total if s), key=str) + [None]
    weight = dict(zip(names, [5, 2, 1, 5], strict=True))
    # pour the budget until no source is above twice its size
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(r.source_size == total[s] and math.isclose(r.target, target[s]) and r.size == size[r.doc_id] for r in mine)
        taken = sum(r.taken for r in mine)
        assert taken <= target[s] + 1e-6 and target[s] - taken <= 50
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)


def test_shards_hold_the_mixture(spark):
    rows = [(i, "t" * (i % 7), "abc"[min(i % 10 // 4, 2)] if i % 11 else None) for i in range(1003)]
    got = stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    source = {r[0]: r[2] for r in rows}
    counts = [[r for r in got if r.shard == s] for s in range(8)]
    assert {len(c) for c in counts} == {125, 126}
    for c in counts:
        assert sorted(r.slot for r in c) == list(range(len(c)))
        for name in ("a", "b", "c", None):
            share = sum(source[i] == name for i in source) / len(rows)
            assert abs(sum(source[r.doc_id] == name for r in c) - share * len(c)) <= 2
    again = stratified_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), shards=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


# Quality


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["\n".join(" ".join(rng.choice(["a", "b#", "c", "$$", "é"]) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 20))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, text in enumerate(texts):
        w = WORD.findall(text)
        at = {}
        for j in range(len(w) - 2):
            at.setdefault(tuple(w[j : j + 3]), []).append(j)
        covered = {j + k for js in at.values() if len(js) > 1 for j in js for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_hosts_are_shrunk_towards_the_rest(spark):
    counts = spark.createDataFrame([("good", 1000, 10), ("bad", 1000, 990), ("tiny", 1, 1), ("mid", 1000, 100), ("fine", 800, 5)], "host string, n long, failed long")
    got = {r.host: r for r in host_verdicts(counts).collect()}
    assert got["bad"].host_failed and not got["good"].host_failed
    assert got["tiny"].host_rate < 1 and got["good"].host_rate > 0.01


# Toxicity


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = rng.integers(-3, 4, rng.integers(1, 14)).astype(float)

        def parts(a, b, x=x):
            """The best segment, shortest, then both sides of it."""
            best = max(((x[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*parts(a, i), (i, j, best[0]), *parts(j, b)]

        got = toxicity.segments(x)
        assert sum(s for *_, s in got) == sum(s for *_, s in parts(0, len(x)))
        assert max([s for *_, s in got], default=0) == toxicity.best(x)


def test_toxic_documents_are_found_and_held_out_labels_unread(spark):
    import zlib

    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["awful", "nasty", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    first = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    flipped = [(i, 1 - y if held(i) else y) for i, y in labels]
    again = toxicity.toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.score for r in first} == {r.doc_id: r.score for r in again}
    right = [r.predicted == (r.doc_id % 5 == 0) for r in first if held(r.doc_id)]
    assert sum(right) / len(right) > 0.97
    text = dict(rows)
    some = next(r for r in first if r.predicted and r.passages)
    p = some.passages[0]
    assert any(w in ("awful", "nasty", "vile") for w in text[some.doc_id].split()[p["first"] : p["last"] + 1])


# Pieces


def test_pieces_are_lossless_and_reproducible(spark):
    rng = random.Random(10)
    chars = "abc  \n\té漢🎉▁\x00"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["x" * 3000, "   "]
    one = {r.doc_id: r for r in pieces.encode(frame(spark, texts, 2)).collect()}
    two = {r.doc_id: r for r in pieces.encode(frame(spark, texts, 5)).collect()}
    assert all(one[i].ids == two[i].ids and one[i].text_sha256 == sha(texts[i]) for i in range(len(texts)))
    back = pieces.decoded(pieces.encode(frame(spark, texts))).collect()
    assert all(r.text == texts[r.doc_id] for r in back)


def test_sampled_segmentations_have_the_lattice_distribution():
    p = pieces.load(sharpness=0.2)
    word, n = "nation", 30_000
    data, at = pieces._prefixed(pa.array([word] * n))
    got = pieces.sample(p, data, at, spread(np.arange(n, dtype=np.uint64)))
    ends = np.flatnonzero(got >= 0)
    cuts = np.searchsorted(ends, at)
    seen = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = tuple(got[ends[a:b]].tolist())
        seen[k] = seen.get(k, 0) + 1
    raw = {bytes(p.text[p.start[i] : p.start[i + 1]]): i for i in range(len(p.weight)) if p.hashes[i]}

    def every(b):
        if not b:
            yield ()
        for k in range(1, len(b) + 1):
            if b[:k] in raw:
                for rest in every(b[k:]):
                    yield (raw[b[:k]], *rest)

    weights = {s: math.exp(p.weight[list(s)].sum()) for s in every(b" " + word.encode())}
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for s, w in weights.items():
        share = w / total
        assert abs(seen.get(s, 0) / n - share) < 5 * math.sqrt(share / n) + 1e-3


# HTML


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body><header class="site-header"><h2>Site</h2><nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav></header>
<div class="cookie-banner"><p>We use cookies, accept them.</p><button>OK</button></div>
<main><article><h1>A  title &amp; more</h1><p>First <b>bold</b> words&nbsp;here,<br>after break.<p>Second &lt;tag&gt; paragraph, which is long enough to look like text.<div class="ad">Buy now, cheap!</div><ul><li>item one</li><li>item two</li></ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree, strongly.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><a href="/x">Another story</a></aside><form class="search"><label>Find</label><input></form><footer>&copy; 2024 Site, all rights reserved.</footer></body></html>"""


def main_text(page):
    nodes = blocks(page)
    return html_extraction.decode(nodes, html_extraction.trained().margin(html_extraction.features(nodes)))


def test_main_text_of_a_page():
    assert main_text(PAGE) == ["A title & more", "First bold words here, after break.", "Second <tag> paragraph, which is long enough to look like text.", "item one", "item two"]


def test_held_out_pages_of_the_generator():
    rng = np.random.default_rng(77)
    hit = found = wanted = 0
    for _ in range(120):
        page = page_maker.page(rng)
        nodes = blocks(page)
        y = page_maker.labels(nodes)
        want = {i for i, x in enumerate(nodes) if x.text and y[i]}
        margin = html_extraction.trained().margin(html_extraction.features(nodes))
        got = html_extraction.decode(nodes, margin)
        texts = {nodes[i].text for i in want}
        hit += sum(g in texts for g in got)
        found += len(got)
        wanted += len(want)
    assert hit / found > 0.97 and hit / wanted > 0.97


def test_decoding_never_keeps_a_node_under_a_dropped_one():
    nodes = blocks("<div><p>a</p></div><div><p>b</p><p>c</p></div>")
    margin = np.array([1.0, -9, 1, 5, -5, 2, 1, 2, 1])[: len(nodes) - 1]
    kept = html_extraction.decode(nodes, margin)
    assert set(kept) <= {"a", "b", "c"}
    assert html_extraction.decode(nodes, np.full(len(nodes) - 1, -1.0)) == []


# Media


def test_sequences_keep_order_positions_and_captions(spark):
    d1, d2 = "1" * 64, "2" * 64
    page = f'<p>before <img src="sha256:{d1}" alt="one"> after</p><figure><img src="sha256:{d2}"><figcaption>the <b>second</b></figcaption></figure><p>end<img src="http://x/y.png"></p>'
    items = sequence(page)
    assert [(i["position"], i["kind"], i["text"], i["digest"] and i["digest"][0], i["caption"]) for i in items] == [
        (0, "text", "before", None, None), (1, "media", None, "1", "one"), (2, "text", "after", None, None), (3, "media", None, "2", "the second"), (4, "text", "end", None, None), (5, "media", "http://x/y.png", None, None),
    ]
    out = interleaved(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert len(out[0]["items"]) == 6 and out[1]["items"] == []


def test_images_are_lossless_and_digests_resolve_once(spark):
    for n in (1, 2, 50):
        payload = np.random.default_rng(n).integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        assert samples(png(payload)).tobytes() == payload
    image = png(bytes(64))
    with pytest.raises(ValueError, match="damaged"):
        samples(image[:-20] + b"\x01" + image[-19:])
    store = spark.createDataFrame([("d", image), ("d", image), (None, image)], "digest string, media binary")
    refs = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e"), (4, None)], "id long, digest string")
    got = {r.id: r.payload_bytes for r in resolved(refs, store).collect()}
    assert got == {1: 64, 2: 64, 3: None, 4: None}


def plain_pixels(image):
    """The samples of an 8-bit grey PNG image without row filters, read without the operator."""
    import struct
    import zlib

    at, packed = 8, b""
    while at < len(image):
        n, name = struct.unpack(">I4s", image[at : at + 8])
        if name == b"IHDR":
            width, height = struct.unpack(">II", image[at + 8 : at + 16])
            assert image[at + 16 : at + 21] == bytes([8, 0, 0, 0, 0])
        if name == b"IDAT":
            packed += image[at + 8 : at + 8 + n]
        at += n + 12
    raw = zlib.decompress(packed)
    return b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def test_text_media_equal_brute_force(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    awkward = [(-1, None), (-2, ""), (-3, "x" * 64), (-4, "é" * 40 + "\n\n<b>&amp;"), (-5, "x" * 64)]
    docs = docs.union(spark.createDataFrame(awkward, docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in text_media(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = png(payload)
        assert plain_pixels(image) == payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.tail_sha256 == hashlib.sha256(payload[-64:]).hexdigest()
        mean = sum(payload) / len(payload)
        assert f"rows={len(payload) // 64};mean={mean:.6f};" in r.feature
        lines = [" ".join(x.split()) for x in text.split("\n")]
        assert r.n_items == sum(bool(x) for x in lines) + 2
        assert r.position == sum(bool(x) for x in lines[: (len(lines) + 1) // 2])
        assert r.caption == f"all {len(raw)} bytes"


def test_references_return_to_their_positions(spark):
    images = {hashlib.sha256(p).hexdigest(): png(p) for p in (bytes([i]) * 64 * (i + 1) for i in range(4))}
    names = list(images)
    rng = random.Random(13)
    rows, want = [], {}
    for i in range(30):
        refs = [rng.choice([*names, "f" * 64]) for _ in range(rng.randint(0, 5))]
        page = "".join(f"<p>text {k}</p><figure><img src='sha256:{d}'><figcaption>cap {i} {k}</figcaption></figure>" for k, d in enumerate(refs))
        rows.append((i % 20, page, "kept"))
        want.setdefault(i % 20, []).append([(f"cap {i} {k}", d, names.index(d) + 1 if d in images else None) for k, d in enumerate(refs)])
    pages = spark.createDataFrame([*rows, (None, None, "kept")], "page_id long, html string, stored string")
    store = spark.createDataFrame([*images.items(), (names[0], images[names[0]])], "digest string, media binary")
    got = {}
    for r in media_columns(pages, store, carry=("page_id", "stored")).collect():
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"])))
        assert [x["text"] for x in r["items"] if x["kind"] == "text"] == [f"text {k}" for k in range(len(r["items"]) // 2)]
        assert r.stored == "kept"
        got.setdefault(r.page_id, []).append([(x["caption"], x["digest"], x["stored"] and x["stored"]["payload_bytes"] // 64) for x in r["items"] if x["kind"] == "media"])
    assert got.pop(None) == [[]]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert media_columns(pages.filter("false"), store).collect() == []


# Words


def test_hashes_depend_on_words_alone():
    texts = ["aa bb", "", None, "bb\taa\n", "é " * 5, "x" * (3 << 20) + " aa"]
    column = pa.array(texts)
    seen = {}
    for a, b, words in chunks(column, 1 << 10):
        h = words.hashes()
        for i in range(b - a):
            own = WORD.findall(texts[a + i] or "")
            assert len(own) == words.first[i + 1] - words.first[i]
            for w, x in zip(own, h[words.first[i] : words.first[i + 1]], strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    data, at = buffers(pa.chunked_array([["ab"], ["c"]]))
    assert bytes(data) == b"abc" and at.tolist() == [0, 2, 3]
    assert isinstance(words, Words)


def thue_morse(n, a="a", b="b"):
    """Words of equal length on which sums weighted by powers of an odd number agree."""
    s = a
    for _ in range(n):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


@pytest.mark.parametrize("n", [6, 11])
def test_words_that_defeat_linear_hashes_stay_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    halves = [w.hashes(half=i) for i in (0, 1) for *_, w in chunks(pa.array([f"{one} {two}"]))]
    assert all(h[0] != h[1] for h in halves)
    rest = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [f"{one} {one} {one} {one}", f"{two} {two} {two} {two}", f"{rest} {one}", f"{rest} {two}"])
    assert {r.doc_id: r.component_id for r in minhash_dedup(docs, percent=95).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert [r.n_removed for r in sorted(substring_dedup(docs, window=21).collect())] == [0, 0, 0, 0]


def test_halves_are_independent():
    (*_, w), *_ = chunks(pa.array([" ".join(f"word{i}" for i in range(20_000))]))
    for k in (1, 20):
        one, two = (grams(w.hashes(half=i), k) for i in (0, 1))
        bits = np.unpackbits((one ^ two).view(np.uint8)).mean()
        assert abs(bits - 0.5) < 0.01
        # equal low bits of the one say nothing about those of the other
        same = (one[:-1] ^ one[1:]) & np.uint64(7) == 0
        agree = ((two[:-1] ^ two[1:]) & np.uint64(7) == 0)[same].mean()
        assert abs(agree - 1 / 8) < 0.03


def test_substrings_and_grams_agree_with_words():
    rng = np.random.default_rng(11)
    data = rng.integers(97, 100, 300, dtype=np.uint8)
    parts = Substrings(data)
    for size in (1, 4, 8, 9, 16, 17, 63, 64, 65, 100):
        start = np.arange(len(data) - size + 1)
        assert (parts.hashes(start, size) == Words(data, start, start + size, np.array([0, len(start)])).hashes()).all()
    h = rng.integers(0, 2**63, 40).astype(np.uint64)
    for k in (1, 2, 3, 7, 8, 20, 40):
        assert all(grams(h, k)[i] == grams(h[i : i + k], k)[0] for i in range(41 - k))


def test_unlike_components_of_one_bucket(spark):
    """Two groups share a passage, so that bands put members of both into one bucket; no pair
    across them reaches 80 %. Small blocks; the answer is brute force's."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for g in range(2):
        own = [f"g{g}x{i}" for i in range(25)]
        for _ in range(40):
            copy = shared + own
            for _ in range(3):
                copy[rng.randrange(len(copy))] = f"r{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    want, _ = near_brute(texts)
    for block, shingles in ((1024, 1 << 20), (8, 1 << 20), (1024, 200)):
        got = {r.doc_id: r.component_id for r in minhash_dedup(frame(spark, texts), block=block, shingles=shingles).collect()}
        assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_long_passages_merge_over_nonbranching_paths(spark, seed):
    """Copies of long passages, some entered or left in the middle, against brute force."""
    rng = random.Random(seed)
    long = [f"p{i}" for i in range(600)]
    texts = [" ".join([*(f"u{d}x{i}" for i in range(rng.randint(0, 30))), *long[a:b], *(f"v{d}x{i}" for i in range(rng.randint(0, 30)))]) for d, (a, b) in enumerate([(0, 600), (100, 500), (0, 600), (100, 500), (250, 270), (250, 269), (599, 600)])]
    first, gone = {}, {}
    for d, text in enumerate(texts):
        w = WORD.findall(text)
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s : s + 20]), (d, s)) != (d, s):
                gone.setdefault(d, set()).update(range(s, s + 20))
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, texts)).collect()}
    assert got == {d: len(gone.get(d, ())) for d in range(len(texts))}
