"""Merkle manifest against a plain tree, with few leaves a block so that many rounds of the exchange run."""

import hashlib
import zlib

import pytest

from callgrove.llm import merkle
from tests.llm import data


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(groups, fanout):
    """{group: sorted leaves} -> {group: (subroot, [siblings by leaf])}, root; the siblings as one string."""
    def tree(nodes):
        ways = [[] for _ in nodes]
        place = list(range(len(nodes)))
        while len(nodes) > 1:
            for way, at in zip(ways, place, strict=True):
                way += [x for i, x in enumerate(nodes) if i // fanout == at // fanout and i != at]
            nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            place = [p // fanout for p in place]
        return nodes[0], ways

    own = {g: tree(leaves) for g, leaves in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, above = tree([own[g][0] for g in names])
    return {g: (own[g][0], ["".join(w + above[i]) for w in own[g][1]]) for i, g in enumerate(names)}, root


@pytest.mark.parametrize(("fanout", "local", "n"), [(2, 1, 45), (3, 1, 100), (2, 2, 70), (8, 4, 30)])
def test_exchange(spark, fanout, local, n):
    rows = [(g, k, h(f"{g}{k}")) for g, k in [(None, 1), *[("a", k) for k in range(n)], *[("é", k) for k in range(7)], *[("z", 5)] * 3]]
    rows += [(f"g{i}", None, h(str(i))) for i in range(9)]
    groups = {}
    for g, k, leaf in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[2])):
        groups.setdefault(g, []).append(leaf)
    wanted, root = plain(groups, fanout)
    got = merkle.proofs(spark.createDataFrame(rows, "g string, k long, node string").repartition(5), fanout, local).collect()
    said = sorted(((r.g or "", r.node, "".join(s["left"] + s["right"] for s in r.path), r.subroot, r.root) for r in got))
    assert said == sorted((g or "", leaf, wanted[g][1][i], wanted[g][0], root) for g, leaves in groups.items() for i, leaf in enumerate(leaves))
    for r in got:
        node = r.node
        for s in r.path:
            node = h(s["left"], node, s["right"])
        assert node == root


def test_documents(spark):
    docs = [(k, t, "en" if k % 3 else None if k % 2 else "fr", None if k % 5 == 0 else "s", len(t) if t is not None else None) for k, t in data.texts().items()]
    docs += [docs[3], docs[3], (None, "Null ID", "de", "s", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS pos", "2 AS leaf", "3 AS g")
    leaf = lambda d, t: h(*map(field, (d[0], d[3], d[2], d[4], t)))
    groups = {}
    for d in sorted(docs, key=lambda d: (-1 if d[0] is None else d[0], leaf(d, d[1]))):
        groups.setdefault(d[2], []).append(leaf(d, d[1]))
    wanted, root = plain(groups, 8)
    got = merkle.document_manifest(df).collect()
    assert len(got) == len(docs)
    by = {d[0]: d for d in docs}
    for r in got:
        d = by[r.doc_id]
        low = d[1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in d[1])
        assert r.leaf == leaf(d, d[1]) and r.root == root and r.subroot == wanted[d[2]][0] and r.verified == (not low)
        assert r.proof_sha256 in {h(w) for w, x in zip(wanted[d[2]][1], groups[d[2]], strict=True) if x == r.leaf}
    assert not all(r.verified for r in got)


def test_empty(spark):
    assert merkle.document_manifest(data.empty(spark)).count() == 0
