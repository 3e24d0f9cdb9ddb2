"""The pipeline, stage by stage, against plain versions on its own input."""

import re
from collections import Counter

import corpus_pipeline as P
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from loam.llm.shared import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), "test"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_have_the_columns_of_documents(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_clean_documents_stay(spark, sf_dir, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert all(after[i] == before[i] for i in after)
    labels = rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = [i for i in before if i in labels and not labels[i].toxic]
    assert sum(i in after for i in clean) / len(clean) > 0.9


def test_common_lines_go(stages):
    before, after = rows(stages[1]), rows(stages[2])
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    held = Counter(k for r in before.values() for k in {key(s) for s in r.text.split("\n")})
    for i, r in before.items():
        assert after[i].text == "\n".join(s for s in r.text.split("\n") if not key(s) or held[key(s)] < 10)
        assert after[i].n_chars == len(after[i].text)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    sets = {}
    for i, r in before.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after) == {find(i) for i in ids}


def test_the_mixture_takes_whole_documents(stages):
    before, after = rows(stages[3]), stages[4].collect()
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and set(times) <= set(before)
    assert all(r == before[r.doc_id] for r in after)
    size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
    assert sum(size[i] * k for i, k in times.items()) <= 1.5 * sum(size.values())


def test_pieces_decode_to_the_mixture(stages):
    import hashlib

    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    assert Counter((r.doc_id, r.text_sha256) for r in stages[5].collect()) == want


AWKWARD = [
    (1, "same line\nown words here", "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n\x0b ", "de", None, 4), (5, "long " * 30_000, "en", "a", 1),
    (None, "no id at all", "en", "a", 12), (None, None, None, None, None), (6, "twin row text", "en", "a", 13), (6, "twin row text", "en", "a", 13), (6, "twin of another source", "en", "b", 22),
    *[(20 + i, f"same line\nfiller number {i}", "en", "c", 5) for i in range(10)],
]


@pytest.fixture(scope="module")
def awkward(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "TEXT", "id", "of", "times", "kept"]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, True) for r in AWKWARD], ", ".join(f"c{i} {t}" for i, t in enumerate("long string string string long int int string int boolean".split()))).toDF(*names)


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_on_awkward_and_empty_tables(name, spark, sf_dir, awkward):
    stage = dict(P.STAGES)[name]
    assert stage(spark, awkward.filter("false"), sf_dir).collect() == []
    got = stage(spark, awkward, sf_dir).collect()
    if name != "sampled pieces":
        assert all(tuple(r.asDict()) == P.COLUMNS for r in got)
    ids = Counter(r.doc_id for r in got)
    if name == "line dedup":
        assert ids == Counter(r[0] for r in AWKWARD)
        text = {r.doc_id: r.text for r in got}
        assert text[1] == "own words here" and text[2] == "" and text[25] == "filler number 5"
    elif name == "mixing to target weights":
        assert not {2, 3, 4} & set(ids)
        words = {r[0]: len(r[1].split()) for r in AWKWARD if r[1]}
        assert max(ids[i] for i in ids if i != 6) <= 2 and all(words[i] for i in ids)
        twins = Counter((r.source, r.text) for r in got if r.doc_id == 6)
        assert twins["a", "twin row text"] in (0, 2, 4) and twins["b", "twin of another source"] in (0, 1, 2)
    else:
        # words of no label score like clean ones; two rows without an id, and unlike texts, all stay
        assert ids == Counter(r[0] for r in AWKWARD)
