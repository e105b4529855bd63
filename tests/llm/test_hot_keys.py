"""Keys with most of the rows: results are those of a plain join, and rows are dealt to many tasks."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import chat_format, common, packing, quality, secret_scan, url_filter, warc


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "PARTS", 8)


def _largest_share(df, key):
    """The largest part of a frame's rows that one task of a shuffle by `key` and its part would get."""
    counts = [r["n"] for r in df.groupBy(key).agg(F.count("*").alias("n")).collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_in_parts_equal_plain_joins(spark, how):
    rng = np.random.default_rng(0)
    keys = ["hot"] * 300 + [None] * 100 + [f"k{i}" for i in rng.integers(0, 40, 200)]
    rows = spark.createDataFrame(list(enumerate(keys)), "n long, k string")
    unique = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v long")
    got = sorted((tuple(r) for r in common.join_unique(rows, unique, "k", how).select("n", "k", "v").collect()), key=repr)
    assert got == sorted((tuple(r) for r in rows.join(unique, "k", how).select("n", "k", "v").collect()), key=repr)


def test_hot_urls(spark):
    urls = ["http://x.net/"] * 200 + ["no scheme"] * 100 + [None] * 50 + [f"http://a{i}.org/fr/" for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = collections.Counter((r["host"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect())
    assert got == collections.Counter({("x.net", "net/", "block"): 200, ("", None, "allow"): 150, **{(f"a{i}.org", "org/fr/", "allow"): 1 for i in range(30)}})


def test_hot_payloads(spark):
    big = "x" * 3_000_000
    data = [(i, "u", "p" * 1500) for i in range(100)] + [(None, "u", "p" * 1500)] * 30 + [(500, "u", big), (501, "u", big), (502, "u", "tiny")] + [(600 + i, "u", f"{i} " * 600) for i in range(10)]
    read = warc.read(warc.write(spark.createDataFrame(data, "page_id long, url string, html string"))).collect()
    got = collections.Counter((r["record_type"], r["refers_to"]) for r in read)
    assert got == collections.Counter({("revisit", 99): 99 + 30, ("response", None): 1 + 2 + 10, ("revisit", 501): 1})
    whole = next(r for r in read if r["page_id"] == 501)
    assert whole["payload_bytes"] == len(big) and whole["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()


def test_hot_secrets_and_repositories(spark):
    """One value in most documents, of one owner (live), of two owners in many repositories (an example), and of many owners."""
    value = lambda c: f"token={c * 12}"
    data = [(i, value("a"), "s1") for i in range(60)] + [(100 + i, value("b"), f"s{i % 2}") for i in range(60)] + [(200 + i, value("c"), f"s{i % 2}") for i in range(10)] + [(300 + i, value("d"), f"s{i}") for i in range(4)]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert {k: (got[k]["n_live"], got[k]["n_copied"], got[k]["most_repositories"], got[k]["most_owners"]) for k in (0, 100, 200, 300)} == {0: (1, 0, 60, 1), 100: (0, 1, 60, 2), 200: (1, 0, 10, 2), 300: (0, 1, 4, 4)}


def test_a_system_prompt_that_all_chats_share(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "RANGE", 10)
    rows = [(c, 0, "system", "shared prompt") for c in range(120)] + [(c, 1, "user", "hello") for c in range(120)] + [(c, 2, "assistant", f"answer {c % 50}") for c in range(120)]
    nodes, paths, leaves = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 2 + 50 and paths.count() == 50 and leaves.count() == 120
    got = {r["conv_id"]: r["loss_text"] for r in chat_format.read_back(nodes, paths, leaves).collect()}
    assert got == {c: f"answer {c % 50}" for c in range(120)}
    offsets = sorted((r["offset"], len(r["ids"])) for r in nodes.collect())
    assert [o for o, _ in offsets] == np.cumsum([0, *(n for _, n in offsets)])[:-1].tolist()


def test_rows_without_an_id_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    parts = spark.createDataFrame([(None, 0, 600)] * 200, "doc_id long, piece int, length long")
    out = packing.pack(parts)
    assert {r["n"] for r in out.groupBy("sequence_id").agg(F.count("*").alias("n")).collect()} <= {1, 2, 3} and out.select("sequence_id", "offset").distinct().count() == 200
    salted = parts.withColumn("r", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(20)))
    assert _largest_share(salted, "salt") < 0.25


def test_bradley_terry_is_at_its_optimum():
    """Weights where the penalised likelihood of the drawn pairs has no slope, against plain gradient steps."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.5, 1, (80, 3)), rng.normal(-0.3, 1, (60, 3))
    w = quality.bradley_terry(good, bad, pairs=500, ridge=0.05)
    again = np.random.default_rng(7)
    diff = good[again.integers(len(good), size=500)] - bad[again.integers(len(bad), size=500)]
    v = np.zeros(3)
    for _ in range(4000):
        v += 0.5 * (diff.T @ (1 - 1 / (1 + np.exp(-(diff @ v)))) / 500 - 0.05 * v)
    assert np.allclose(w, v, atol=1e-5)


def test_features_of_a_text_by_hand():
    got = dict(zip(quality.FEATURES, quality.features("Ab 12!! ab ab\n--- ab\nAb 12!! ab ab\n")))
    words = "Ab 12!! ab ab --- ab Ab 12!! ab ab".split()
    assert got["sign_only_words"] == pytest.approx(1 / 10) and got["signed_words"] == pytest.approx(2 / 10) and got["top_word"] == pytest.approx(5 / 10)
    assert got["distinct_words"] == pytest.approx(len(set(words)) / 10) and got["repeated_next"] == pytest.approx(2 / 10) and got["distinct_lines"] == pytest.approx(2 / 3)
    assert dict(zip(quality.FEATURES, quality.features("***a ")))["sign_only_words"] == 0.0
