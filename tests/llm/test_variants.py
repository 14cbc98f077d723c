"""Spelling variants against all pairs and plain counting."""

import collections
import random
import re
import zlib

import pytest

from brute import FOLD
from flightline.llm import queries, variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def counted(rows):
    words = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def grouped(words):
    """All words against all words of nearly the same length."""
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    form, out = {}, []
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out, key=repr)


def found(table):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in table.collect()), key=repr)


def test_query_equals_all_pairs(spark, sf_dir, documents):
    want = grouped(counted([(r.doc_id, r.text) for r in documents.collect()]))
    assert found(queries.op12_variants(spark, sf_dir)) == want
    assert any(w[3] for w in want)


def test_odd_rows_and_an_empty_table(odd, nothing):
    assert found(variants.spelling_variants(odd)) == grouped(counted([(r.doc_id, r.text) for r in odd.collect()]))
    assert found(variants.spelling_variants(nothing)) == []


def test_scan_of_sorted_stretches():
    draw = random.Random(2)
    for _ in range(2_000):
        size, letters = draw.randint(0, 7), "abc"[: draw.randint(1, 3)]
        words = {"".join(draw.choice(letters) for _ in range(size + draw.randint(0, 1))) for _ in range(draw.randint(1, 30))}
        words = sorted(words)
        pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(a) == size and one_edit(a, b)]
        assert sorted(variants.near_in_list(words, size)) == pairs


@pytest.mark.parametrize("limit", [1, 5, 2_000])
def test_large_lists_are_divided_without_losing_a_pair(spark, limit):
    draw = random.Random(limit)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(7, 9))): draw.choice([2, 3, 30, 400]) for _ in range(700)}
    words |= {"prefix" + "".join(draw.choice("ab") for _ in range(6)): draw.choice([2, 50]) for _ in range(60)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = variants.near_pairs(variants.bounded_lists(table, limit)).collect()
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert len(pairs) == len(want) and {(r.word, r.near) for r in pairs} == want
    assert all(r.n == words[r.word] and r.near_n == words[r.near] for r in pairs)
    assert found(variants.group_variants(table)) == grouped(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "abcdefghij": 5_000, "zbcdefgh": 3, "bbcdefgh": 30}
    rows = {r[0]: r for r in found(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert rows["abcdefg"][3:] == ("abcdefgh", 30, "abcdefghij")
    assert rows["zbcdefgh"][3:] == ("abcdefgh", 30, "abcdefghij")
    assert rows["abcdefghij"][2:] == (1, None, None, "abcdefghij")
