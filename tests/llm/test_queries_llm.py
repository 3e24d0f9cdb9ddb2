"""The operators' queries against DuckDB, and on awkward tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from loam.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: Counter(zip(*[[round(v, 6) if isinstance(v, float) else v for v in t.column(n).to_pylist()] for n in names], strict=True))
    assert rows(got) == rows(want)


LONG = " ".join(f"w{i}" for i in range(30_000))
AWKWARD = [
    (1, "a b c\nA B C \n\n" + "x y z " * 30, "s", 7), (2, None, None, 8), (3, "", "s", 9), (4, " \t\n\x0b\x0c\r ", "t", None), (5, LONG, "s", 1), (6, LONG, "s", 2), (None, "no id " * 40, "t", 3), (None, None, None, None),
    (7, "twin twin", "u", 4), (7, "twin twin", "u", 4), (8, "émoji 🎉 漢字 ▁ nbsp here", None, 5), (9, "one", "t", 6),
]


@pytest.fixture(scope="module")
def awkward(spark):
    # names that differ by case only, and clash with what the operators add
    names = ["doc_id", "text", "source", "TEXT", "n", "kept", "key", "h", "size", "shard"]
    rows = [(*r, 1, "x", 2, 3, 4, 5) for r in AWKWARD]
    return spark.createDataFrame(rows, "c0 long, c1 string, c2 string, c3 long, c4 long, c5 string, c6 long, c7 long, c8 long, c9 long").toDF(*names)


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")


def every(spark, docs):
    from loam.llm.line_dedup import line_dedup
    from loam.llm.media import text_media
    from loam.llm.minhash_dedup import minhash_dedup
    from loam.llm.mixing import mix
    from loam.llm.pieces import encode
    from loam.llm.quality_rules import quality_rules
    from loam.llm.sharding import stratified_shards
    from loam.llm.substring_dedup import substring_dedup
    from loam.llm.toxicity import toxicity

    return {
        "substring": lambda: substring_dedup(docs), "line": lambda: line_dedup(docs, min_docs=2), "media": lambda: text_media(docs), "quality": lambda: quality_rules(docs), "toxicity": lambda: toxicity(docs, labels(spark)),
        "mix": lambda: mix(docs), "shards": lambda: stratified_shards(docs, shards=3), "pieces": lambda: encode(docs), "minhash": lambda: minhash_dedup(docs),
    }


KINDS = ["substring", "line", "media", "quality", "toxicity", "mix", "shards", "pieces", "minhash"]


@pytest.mark.parametrize("kind", KINDS)
def test_awkward_rows_are_all_returned(kind, spark, awkward):
    rows = every(spark, awkward)[kind]().collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in AWKWARD)


@pytest.mark.parametrize("kind", KINDS)
def test_empty_tables(kind, spark, awkward):
    assert every(spark, awkward.filter("false"))[kind]().collect() == []


def test_awkward_values(spark, awkward):
    ops = every(spark, awkward)
    got = {}
    for r in ops["substring"]().collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[6][0].n_removed == 30_000 and got[5][0].n_removed == 0 and got[2][0].n_words == 0
    assert all(r.n_removed == 0 for r in got[None])
    assert got[2][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    same = [(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in ops["minhash"]().collect()]
    assert (6, 5, False, 29_997) in same and (5, 5, True, 29_997) in same and (2, 2, True, 0) in same and (3, 3, True, 0) in same and (9, 9, True, 1) in same
    assert same.count((7, 7, True, 1)) == 2
    media = {r.doc_id: r for r in ops["media"]().collect()}
    assert media[3].payload_bytes == 64 and media[3].tail_crc32 == zlib.crc32(bytes(64)) and media[5].feature == media[6].feature
    pieces = {r.doc_id: r for r in ops["pieces"]().collect()}
    text = {r[0]: r[1] for r in AWKWARD}
    for i in (1, 3, 5, 8):
        assert pieces[i].text_sha256 == hashlib.sha256(text[i].encode()).hexdigest()
    assert pieces[2].n_pieces == 0 and pieces[3].ids == []


def test_pages_and_awkward_pages(spark, sf_dir):
    from loam.llm.html_extraction import extract

    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", "<p>plain & simple"), (2, "v", "</div></p><<<a href='x>"), (3, "w", "<article><p>" + "word, " * 20_000 + "</article>")], "page_id long, url string, html string")
    rows = extract(df.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert len(rows) == 5 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id == 1] == [""]
    assert max(r.n_chars for r in rows) == len(" ".join(["word,"] * 20_000))
    assert extract(df.filter("false")).collect() == []


SF01 = "/root/testdata/sf0.01"


def test_held_out_toxic_documents(spark):
    """op5 on whole tables: recall, and clean documents flagged, among labels never learnt."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, SF01).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) / len(toxic) >= 0.6 and sum(clean) / len(clean) <= 0.06


def test_scores_equal_plain_scores(spark, sf_dir):
    """The score of each text, from the fitted model, by a search of all segments."""
    import math

    import numpy as np
    import pyarrow as pa

    from loam.llm import toxicity as T
    from loam.llm.words import chunks

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels, "doc_id", "text", "toxic", 20_000)
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}

    def maximal(x):
        """All maximal segments: the best one, then those on both sides of it."""
        if not len(x):
            return []
        height = np.concatenate(([0.0], np.cumsum(x)))
        low = np.minimum.accumulate(height)
        b = int(np.argmax(height - low))
        if height[b] - low[b] <= 0:
            return []
        a = int(np.flatnonzero(height[: b + 1] == low[b])[-1])
        return [*maximal(x[:a]), float(height[b] - height[a]), *maximal(x[b:])]

    for r in docs.limit(150).collect():
        ((*_, words),) = chunks(pa.array([r.text]))
        x = T.walk(model.odds, words)
        parts = [s for s in maximal(x) if model.rate * s > 1]
        offset = math.log(model.scale) + math.log(max(len(x), 1))
        if len(x):
            surprise = [model.rate * s - offset for s in parts]
            top = min(max(model.rate * max([s for s in maximal(x)], default=0.0) - offset, -10), 60)
            total = model.rate * sum(parts)
            feature = [top, math.log1p(sum(s for s in surprise if s >= -math.log(T.SIGNIFICANT))), math.log1p(total), math.log1p(100 * total / len(x)), math.log(len(x))]
        else:
            feature = [0.0] * 5
        want = 1 / (1 + math.exp(-min(max(model.curve[0] + sum(w * f for w, f in zip(model.curve[1:], feature, strict=True)), -30), 30)))
        assert math.isclose(got[r.doc_id], want, abs_tol=1e-6)


def test_main_text_is_the_article(spark):
    """op7 on the whole of pages: all that stands in their article element, blanks aside."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth = self.skip = 0
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.found.append(data)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = QUERIES["op7_html_extraction"](spark, SF01).collect()
    assert Counter(r.page_id for r in got) == Counter(pages.keys())
    for r in got:
        plain = Article()
        plain.feed(pages[r.page_id] or "")
        assert "".join(r.text.split()) == "".join("".join(plain.found).split())
        assert r.n_chars == len(r.text) and r.text == r.text.strip()
