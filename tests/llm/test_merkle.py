"""Merkle manifests against a tree built node by node."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flightline.llm import merkle, queries


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return hashed("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def tree(nodes):
    """The top and, for every node, its runs as (place, run)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for place, members in enumerate(groups[at : at + 3]):
                for i in members:
                    paths[i].append((place, run))
            above.append(hashed("".join(run)))
            joined.append([i for members in groups[at : at + 3] for i in members])
        nodes, groups = above, joined
    return nodes[0], paths


def model(rows):
    rows = [dict(r, leaf=leaf(r, r["text"])) for r in rows]
    for r in rows:
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        r["changed"] = leaf(r, text)
    rows.sort(key=lambda r: ((r["source"] is not None, (r["source"] or "").encode()), (r["doc_id"] is not None, r["doc_id"] or 0), r["leaf"]))
    sources = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r["source"])]
    trees = [tree([r["leaf"] for r in g]) for g in sources]
    root, upper = tree([top for top, _ in trees]) if trees else (None, [])
    out = []
    for group, (subroot, paths), rest in zip(sources, trees, upper, strict=True):
        for r, path in zip(group, paths, strict=True):
            now, siblings = r["changed"], []
            for place, run in path + rest:
                others = run[:place] + run[place + 1 :]
                siblings += others
                now = hashed("".join(run[:place] + [now] + run[place + 1 :]))
            out.append((r["doc_id"], r["leaf"], subroot, root, hashed("".join(siblings)), now, now == root))
    return sorted(out, key=repr)


def result(docs):
    found = merkle.manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof"), "folded_root"
    )
    return sorted(((*r, r.folded_root == r.root) for r in found.collect()), key=repr)


def test_query_equals_the_model(spark, sf_dir, documents):
    want = model([r.asDict() for r in documents.collect()])
    found = queries.op13_merkle(spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert {w[-1] for w in want} == {True, False}


def test_odd_rows_and_an_empty_table(odd, nothing):
    assert result(odd) == model([r.asDict() for r in odd.collect()])
    assert result(nothing) == []


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_many_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    monkeypatch.setattr(merkle, "_POWERS", [3**i for i in range(levels)])
    draw = random.Random(levels)
    names = ["hot"] * 40 + [None, "", "a", "b", "é", "Z", "one"] + [f"s{i}" for i in range(12)]
    rows = [
        {"doc_id": draw.choice([i, i * 10**15, -i]), "text": draw.choice(["x\ny", "\n", None, "z"]), "lang": "en",
         "source": draw.choice(names), "n_chars": draw.choice([None, 3])}
        for i in range(150)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(table) == model(rows)


def test_one_row_is_its_own_root(spark):
    rows = [{"doc_id": 7, "text": None, "lang": None, "source": None, "n_chars": None}]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (found,) = result(table)
    assert found == model(rows)[0] and found[1] == found[2] == found[3] and found[4] == hashed("")
