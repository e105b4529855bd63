"""The corpus pipeline: stages against what their operators say, and odd rows."""

import collections
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import decontaminate, ngram_join, queries, secret_scan, toxicity


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        after = [r for r in stage(spark, docs, sf).collect()]
        assert list(after[0].asDict()) == names
        ids = {r["doc_id"] for r in after}
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert ids == {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.3").collect()}
        if name == "ngram_join":
            assert ids == {r["component_id"] for r in ngram_join.join(docs, corpus_pipeline.WORDS, corpus_pipeline.SIMILAR).collect()} and len(after) == len(ids)
        if name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert gone and ids == {r["doc_id"] for r in before} - gone
        if name == "secrets":
            assert ids == {r["doc_id"] for r in before} and all(r["n_chars"] == len(r["text"]) for r in after)
        docs = spark.createDataFrame(after, docs.schema)
    made = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in made} == {r["doc_id"] for r in docs.collect()}
    fill = collections.Counter()
    for r in made:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert sorted(made) == sorted(corpus_pipeline.run(spark, sf).collect())


def test_stages_of_odd_and_no_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (None, "x y z", None, None, 5), (None, "x y z", None, None, 5), (3, "one two three four", None, "s", 18), (3, "one two three four", None, "s", 18), (4, "One two three four", None, "s", 18)]
    for data, sizes in ((rows, (7, 5, 5, 5)), ([], (0, 0, 0, 0))):
        docs = spark.createDataFrame(data, schema)
        for (_, stage), n in zip(corpus_pipeline.STAGES[:-1], sizes):
            docs = stage(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == sizes[-1]


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_queries_cover_whole_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_quality", "op2_toxicity", "op4_secret_scan", "op6_ngram_join"):
        got = queries.QUERIES[name](spark, sf)
        assert got.count() == n and got.agg(F.countDistinct("doc_id")).first()[0] == n


def test_near_copies_of_five_words_and_four_fifths_go(spark, sf):
    """The stage against brute force at 5 words and a similarity of 0.8."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = list(rng.choice(words, rng.integers(1, 160)))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    cut = lambda w, n: set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else {tuple(w)}
    five, three = ([cut(t.split(), n) for t in texts] for n in (5, 3))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(five[i] & five[j]) >= 80 * len(five[i] | five[j])]
    assert any(100 * len(three[i] & three[j]) < 90 * len(three[i] | three[j]) for i, j in linked)
    low = list(range(len(texts)))
    for _ in texts:
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicated(spark, docs, sf).collect()) == sorted(set(low))


def test_rows_of_one_doc_id_with_unlike_texts(spark, sf):
    """Each row counts by its own text, in the join and in the stage."""
    say = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    near = say(1) + " end"
    rows = [(5, say(1)), (5, say(2)), (5, say(2)), (7, near), (8, say(2) + " end"), (9, say(3)), (9, near), (4, say(4)), (4, say(4) + " end"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs).collect())
    assert got == sorted([(5, 5, 2), (5, 5, 2), (5, 5, 2), (7, 5, 2), (8, 5, 2), (9, 9, 0), (9, 5, 2), (4, 4, 1), (4, 4, 1), (4, 4, 0)])
    left = [tuple(r) for r in corpus_pipeline.deduplicated(spark, docs, sf).collect()]
    assert sorted((i, t.removesuffix(" end")) for i, t in left) == sorted([(5, say(1)), (5, say(2)), (9, say(3)), (4, say(4)), (4, "")])


def _groups(n, linked):
    low = list(range(n))
    for _ in range(n):
        for i, j in linked:
            low[i] = low[j] = min(low[i], low[j])
    return low


def _brute_pipeline(spark, docs, labels, items):
    """The rows that are packed, worked out pair by pair and pattern by pattern: {doc_id: text}."""
    from test_documents import _naive_match, _semi_global

    # 1. Every entry tried at every place; the learned weights and curve are the model's.
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    left = {}
    for i, text, _, source, _ in docs:
        folded = toxicity.fold(text)
        weights = [w for _, _, w in _naive_match(folded, model.lexicon.entries, model.lexicon.exceptions)]
        n, total = max(1, len(folded.split())), sum(weights)
        x = [math.log1p(max(0.0, total)), max(weights, default=0.0), 100 * total / (n + 20), math.log1p(len(weights)), total / math.sqrt(n + 20), math.log1p(n)]
        if model.score(np.array([x]))[0] < 0.3:
            left[i] = text, source
    # 2. All pairs of sets of five words.
    ids = sorted(left)
    cut = lambda w: set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [cut((left[i][0] or "").lower().split()) for i in ids]
    low = _groups(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    left = {i: left[i] for k, i in enumerate(ids) if low[k] == k}
    # 3. Every window of every item against every whole text.
    windows = []
    for _, t in items:
        f = decontaminate.fold(t)
        windows += [f[c : c + 96] for c in ([0] if len(f) <= 96 else [*range(0, len(f) - 96, 48), len(f) - 96])]
    left = {i: v for i, v in left.items() if not any(_semi_global(w, decontaminate.fold(v[0])) <= decontaminate.budget(len(w)) for w in windows)}
    # 4. Owners and repositories of every value, then the live-looking spans.
    spans, owners, holders = {}, collections.defaultdict(set), collections.defaultdict(set)
    for i, (text, source) in left.items():
        found = []
        for pattern, group, least in secret_scan.KINDS.values():
            for m in re.finditer(pattern, text or "", re.ASCII):
                secret = m[0] if pattern == secret_scan.KINDS["upper"][0] else m[group]
                if len(secret) >= least:
                    found.append((m.start(), m.end(), secret))
                    owners[secret].add(source if source is not None else f"row {i}")
                    holders[secret].add(i)
        spans[i] = found
    live = lambda s: len(owners[s]) < 4 and (len(owners[s]) < 2 or len(holders[s]) < 50)
    out = {}
    for i, (text, _) in left.items():
        at, made = 0, ""
        for start, end, secret in sorted(spans[i]):
            if live(secret):
                if start >= at:
                    made += text[at:start] + "[secret]"
                at = max(at, end)
        out[i] = made + (text or "")[at:]
    return out


def test_run_equals_a_brute_force_pipeline(spark, tmp_path):
    import pandas as pd
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(22)) for i in range(4)]
    shared = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    docs = []
    for i in range(110):
        text = say(int(rng.integers(5, 60)))
        if i % 5 == 1:
            text += " you zzvile thing " + say(3)
        if i % 9 == 4:
            near = docs[-1][1].split()
            near[len(near) // 2 :][:1] = ["changed"]
            text = " ".join(near)
        if i % 13 == 6:
            text = say(10) + ". " + items[i % 4][1].title() + " " + say(5)
        if i % 11 == 7:
            text += f" token = {''.join(rng.choice(list('abcdef'), 12))} "
        if i % 7 == 3:
            text += f" see {shared}."
        docs.append((i, text, None, f"s{i % 6}" if i % 10 else None, len(text)))
    docs += [(200, None, None, None, None), (201, "", None, "s1", 0), (202, "long " * 9000, None, "s2", None)]
    labels = [(i, 1, int(i % 5 == 1 and "zzvile" in docs[i][1])) for i in range(110)]
    for name, rows, columns in (("documents", docs, ["doc_id", "text", "lang", "source", "n_chars"]), ("labels", labels, ["doc_id", "quality", "toxic"]), ("benchmark", items, ["item_id", "text"])):
        pd.DataFrame(rows, columns=columns).astype({"n_chars": "Int64", "lang": "string"} if name == "documents" else {}).to_parquet(tmp_path / f"{name}.parquet")
    want = _brute_pipeline(spark, docs, labels, items)
    assert 40 < len(want) < 100 and any("[secret]" in t for t in want.values())
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for i, text in want.items():
        ids = np.array(slow.encode(text, add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        pieces += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces)
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= 2048
    assert len(used) == -(-sum(p[3] for p in pieces) // 2048)


def test_stages_keep_columns_with_clashing_names(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, set_id long, row_id long, doc long, _place string, score double, keys array<long>, key string, count long, label int"
    rows = [(1, "one two three four five six", None, "s", 27, 9, 9, 9, "x", 0.5, [1], "k", 4, 1), (2, "One two three four five six", None, "s", 27, 8, 8, 8, "x", 0.5, [1], "k", 4, 0), (3, "w " * 300_000, None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("doc_id = 3").count() > 100
