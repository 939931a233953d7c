"""Operator 3 against brute force."""

from itertools import combinations

from callgrove.llm import simhash
from tests.llm import brute
from tests.llm.data import empty, table, texts


def test_triples_cover_every_four_positions():
    triples = simhash.covering_triples(8)
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_copies(spark):
    docs = texts()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(table(spark, docs)).collect()}
    prints = {k: brute.fingerprint(v) for k, v in docs.items()}
    named = brute.components(prints)
    assert got == {k: (f"{prints[k]:016x}", named[k]) for k in docs}
    assert simhash.near_copies(empty(spark)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    docs = texts()
    base = docs[40].split()
    docs |= {200 + k: " ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(100)}
    monkeypatch.setattr(simhash, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, docs)).collect()}
    assert got == brute.components({k: brute.fingerprint(v) for k, v in docs.items()})


def test_chains_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_one_of_each_stays(spark):
    docs = texts()
    df = table(spark, docs)
    kept = [r.doc_id for r in simhash.first_of_each(df.union(df.where("doc_id in (3, 7)"))).collect()]
    assert len(kept) == len(set(kept))
    assert set(kept) >= {k for k in range(40) if k != 3} | {3, 40, 62} and not set(kept) & set(range(41, 62)) and not set(kept) & {63, 64}


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "same text here now"), (None, "same text here now"), (5, "same text here now"), (None, "quite another one")], "doc_id long, text string")
    got = simhash.near_copies(rows).collect()
    assert sorted(r.component_id is None for r in got) == [False, False, False, True]
    assert simhash.first_of_each(rows).count() == 2


def kept(spark, docs):
    return {r.doc_id for r in simhash.first_of_each(table(spark, docs)).collect()}


def test_texts_that_share_only_a_repeated_line_stay(spark):
    line = " ".join(f"line{i}" for i in range(16))
    docs = {k: " ".join([line] * 40 + [f"own{k}x{i}" for i in range(154)]) for k in range(6)}
    assert kept(spark, docs) == set(docs)


def test_every_pair_at_similarity_08_is_found_and_none_below(spark):
    docs, gone = {}, set()
    for n in range(40):  # 4 * n + 4 shingles, and n + 1 (0.8) or n + 2 (below) more
        words = [f"w{n}x{i}" for i in range(4 * n + 8)]
        more = [f"m{n}x{i}" for i in range(n + 2)]
        docs |= {10 * n: " ".join(words), 10 * n + 1: " ".join(words + more[:-1]), 1000 + 10 * n: " ".join(words).upper() + " only", 2000 + 10 * n: " ".join(["v" + w for w in words]), 2001 + 10 * n: " ".join(["v" + w for w in words] + more)}
        gone |= {10 * n + 1, 1000 + 10 * n}
    assert kept(spark, docs) == set(docs) - gone


def test_ties_and_clashing_columns(spark):
    """Rows of one doc_id and text but other columns: the smallest hash stays; internal names may be taken."""
    names = ["gone_id", "gone_key", "other_id", "other_key", "text_key", "fingerprint", "first", "fp_id", "root", "row", "stays", "key"]
    rows = [(1, "a b c d e f g", *[f"{n}{k}" for n in names]) for k in (1, 2, 2)] + [(2, "quite another text of words", *names), (None, "quite another text of words", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for given in (df, df.orderBy("other_id", ascending=False), df.repartition(3, "gone_id")):
        got = simhash.first_of_each(given)
        assert got.columns == df.columns
        assert sorted((r.doc_id, r.root) for r in got.collect()) == sorted((r.doc_id, r.root) for r in simhash.first_of_each(df).collect())
        assert sorted(r.doc_id for r in got.collect()) == [1, 2]
    assert simhash.near_copies(df).count() == len(rows)


def test_stage_links_by_simhash(spark, monkeypatch):
    """Without the postings of least hashes, the SimHash index still gives the pairs of few differing bits, and those alone that hold on the sets."""
    monkeypatch.setattr(simhash, "set_postings", lambda classes: classes.limit(0).selectExpr("fp_id", "0L AS key", "0L AS size"))
    words = [f"w{k * 7919 % 4001}" for k in range(3000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:1500], "other", *words[1501:]])), (3, " ".join(words[::-1])), (4, "a b c d e f"), (5, None), (6, "")]
    assert {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {1, 3, 4, 5}
