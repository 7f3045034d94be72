import re
from collections import defaultdict

from tessera.llm import ngram_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def brute_repeats(rows, k):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        i = 1 << 62 if i is None else i
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (1 << 62 if i is None else i):
                gone[p : p + k] = [True] * k
        out.append((-1 if i is None else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_repeats_as_by_brute_force(docs, rows):
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 13)


def test_shortened_keeps_columns_and_untouched_texts(docs, rows):
    out = substring_dedup.shortened(docs)
    assert out.schema == docs.schema
    got = {(r.doc_id, r.text) for r in out.collect()}
    for i, _, removed, kept in brute_repeats(rows, 13):
        if i >= 0 and removed:
            assert (i, kept) in got
    assert (0, rows[0][1]) in got


def test_no_rows(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0


def brute_components(rows):
    sets = []
    for i, text, *_ in rows:
        w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((-1 if i is None else i, len(x), -1 if i is None else root(i)) for i, x in sets)


def test_components_as_by_brute_force(docs, rows):
    got = ngram_join.near_duplicates(docs).collect()
    key = lambda v: -1 if v is None else v
    mine = sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got)
    theirs = brute_components(rows)
    assert mine == theirs  # rows that repeat an id are one node


def test_rows_that_repeat_an_id_tie_their_classes(spark, docs, rows):
    key = lambda v: -1 if v is None else v
    placed = lambda d: sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in ngram_join.near_duplicates(d).collect())
    assert placed(docs) == brute_components(rows)
    few = [(1, "a b c"), (5, "a b c"), (5, "d e f"), (3, "d e f"), (7, "d e f"), (5, " "), (7, "g h"), (9, "g h"), (8, None)]
    assert placed(spark.createDataFrame(few, "doc_id long, text string")) == brute_components(few)


def test_one_of_each_group_stays(docs, rows):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    roots = defaultdict(set)
    for i, _, root in brute_components(rows):
        roots[root].add(i)
    assert len(ids) == len(set(ids)) and set(ids) <= {min(v) for k, v in roots.items() if k >= 0}


def test_prefix_length_follows_cost():
    import numpy as np

    cheap, dear = np.ones(60), np.full(60, 500.0)
    assert ngram_join.choose_matches(cheap, 200, 150) == 1
    assert ngram_join.choose_matches(dear, 200, 150) > 1
