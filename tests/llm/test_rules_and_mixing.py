import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_counts_as_by_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs, labels).collect())
    want = Counter()
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        cover = {q for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        n = len(w)
        want[(i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)] += 1
    assert got == want


def test_kept_rows_are_whole(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.schema == docs.schema
    judged = quality_rules.judge(docs, labels).where("kept").count()
    assert kept.count() == judged > 0
    assert quality_rules.judge(empty, labels).count() == quality_rules.keep_good(empty, labels).count() == 0


def test_cutoffs_hold_the_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.integers(0, 100, 5000), rng.integers(80, 400, 500)
    bins = lambda x: np.bincount(x, minlength=401)
    cut = quality_rules.choose_cutoff(bins(good), bins(bad), 0.01, 0.001, 10)
    assert cut is not None and (good >= cut).mean() <= 0.01 and (bad >= cut).mean() > 0.8
    assert quality_rules.choose_cutoff(bins(good[:100]), bins(bad), 0.01, 0.001, 10) is None  # too few to be sure
    assert quality_rules.choose_cutoff(bins(good[:0]), bins(bad), 0.01, 0.001, 10) is None


def test_rules_fire_where_labels_separate(spark):
    """Symbols in bad documents only; `big` is certified by itself, `small` and `new` by the pool, `odd` contradicts it."""
    rng = np.random.default_rng(1)
    rows, known = [], []
    for lang, n_good, n_bad in (("big", 1400, 60), ("small", 60, 30), ("new", 0, 20), ("odd", 3, 0)):
        for i in range(n_good + n_bad):
            words = [f"w{x:06}" for x in rng.integers(0, 10**6, 60)]
            if i >= n_good or lang == "odd":
                words[:30] = [w + "##" for w in words[:30]]
            rows.append((len(rows), " ".join(words), lang, int(i < n_good)))
            known += [(rows[-1][0], rows[-1][3])] if lang != "new" else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, want int")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[i].kept == bool(want) for i, _, _, want in rows)
    assert all("symbols" in got[i].reasons for i, _, _, want in rows if not want)
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs, labels).collect()) == [i for i, _, _, want in rows if want]


def test_union_of_rules_is_within_the_risk():
    rng = np.random.default_rng(2)
    bins = lambda x: np.stack([np.bincount(c, minlength=quality_rules.BINS + 1) for c in x])
    good, bad = rng.integers(0, 100, (2, 3000)), rng.integers(90, 200, (2, 300))
    steps = quality_rules.reject_path(bins(good), bins(bad), 10)
    levels = quality_rules.path_levels(steps, 2)
    at = lambda x: np.maximum(levels[0][x[0]], levels[1][x[1]])
    fresh = rng.integers(0, 100, (2, 3000))
    cut = quality_rules.choose_cutoff(*(np.bincount(at(x), minlength=len(steps) + 1) for x in (fresh, bad)), 0.01, 0.01, 10)
    assert cut and (at(rng.integers(0, 100, (2, 50000))) >= cut).mean() <= 0.01 and (at(bad) >= cut).mean() > 0.9


def test_binomial_tail():
    assert quality_rules.binomial_tail(4, 0.5) == pytest.approx([1 / 16, 5 / 16, 11 / 16, 15 / 16, 1])


def fill(sizes):
    """Capping and resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixture(spark, docs, rows, empty):
    got = mixing.sample(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = fill(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s)
    assert sorted(map(str, got)) == sorted(map(str, mixing.sample(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.sample(empty).count() == mixing.mix(empty).count() == 0


def test_words_of_sources_come_near_targets(spark):
    rows = [(i, "w " * (i % 97 + 1), f"s{i % 3}") for i in range(3000)]
    got = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.01)


TOKENIZER = None


def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(docs, rows, empty):
    import zlib

    from tokenizers import Tokenizer

    path = tokenizer()
    own = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 64)):
            mine = np.array(ids[s : s + 64], "<u4")
            want[(i, p, s, len(mine), zlib.crc32(mine.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 1
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    have = np.bincount(np.minimum(rng.lognormal(4 + seed / 2, 1, 5000).astype(int) + 1, 512), minlength=513)
    kinds = packing.plan(have, 512)
    held = np.zeros(513, int)
    for parts, n in kinds:
        assert sum(v * t for v, t in parts) <= 512
        for v, t in parts:
            held[v] += t * n
    assert (held == have).all()
    assert sum(n for _, n in kinds) <= -(-(have * np.arange(513)).sum() // 512) * 1.03 + 2
    assert packing.plan(np.zeros(513, int), 512) == []


URLS = [
    ("HTTP://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    ("http://b.net", "b.net", "", None, "allow"),
    ("http://x.com/q", "x.com", "/q", "com/", "allow"),
    ("http://xcom/q?a", "xcom", "/q", None, "allow"),
    ("http://x.com?/en/", "x.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://bad.org/1", "bad.org", "/1", None, "block"),
    ("http://good.org/1", "good.org", "/1", None, "allow"),
]


def test_url_rules_and_reputation(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)] + [(100 + i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, i % 2) for i in range(80)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_filter.filter_urls(pages.limit(0), outcomes.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.where("page_id >= 100"), outcomes.limit(0)).collect()} == {"allow"}


def test_hosts_without_labels_follow_their_kin(spark):
    rows = [(i, f"http://h{i % 20}.{'bad' if i % 2 else 'good'}.org/{i}") for i in range(400)]
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    fresh = [(1000, "http://new.bad.org/"), (1001, "http://new.good.org/"), (1002, "http://other.org/"), (1003, "http://a.new.io/")]
    pages = spark.createDataFrame(rows + fresh, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert [got[i].verdict for i in range(1000, 1004)] == ["block", "allow", "allow", "allow"]
    assert got[1000].reputation > 0.9 and got[1001].reputation < 0.1
    assert got[1002].reputation == pytest.approx(got[1003].reputation, abs=0.05) == pytest.approx(0.5, abs=0.05)
    labelled = {r.page_id: r for r in url_filter.filter_urls(pages.where("page_id < 1000"), outcomes).collect()}
    assert all(got[i] == labelled[i] for i in range(400))  # judging more hosts changes none of the labelled ones


def test_owners_of_hosts(spark):
    want = {
        "a.foo.co.uk": ("foo.co.uk", "co.uk"), "bar.co.uk:8080": ("bar.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.b.net:80": ("b.net", "net"), "b.net": ("b.net", "net"),
        "10.0.0.1:81": ("10.0.0.1", "10.0.0.1"), "10.9.0.1": ("10.9.0.1", "10.9.0.1"), "[2001:db8::1]:80": ("[2001:db8::1]", "[2001:db8::1]"), "local": ("local", "local"),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    got = rows.select("host", url_filter.domain_of(rows.host).alias("d"), url_filter.suffix_of(rows.host).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in got} == want


def test_beta_quantile():
    q = url_filter.beta_quantile(0.05, np.array([1.0, 2.0, 50.0]), np.array([1.0, 2.0, 1.0]))
    assert q == pytest.approx([0.05, 0.13535, 0.05 ** (1 / 50)], abs=1e-4)


def test_documents_taken_as_by_brute_force(spark, docs, rows):
    """Prefix sums of expected copies along each source's line, one integer boundary after the other."""
    from math import floor

    from tessera.llm import mixing

    table = docs.where("doc_id is not null")
    got = mixing.sample(table, cell_rows=7).select("*", mixing.size_class().alias("class"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(16)).alias("part"), mixing.uniform(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(13)).alias("offset")).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    for source in sizes:
        line = sorted((r for r in got if r.source == source), key=lambda r: (r["class"], r.part, r.size, r.doc_id, tuple(r.tie)))
        for i, r in enumerate(line):
            rate = r.target / sizes[source]
            assert r.copies == max(0, min(2, floor((i + 1) * rate + r.offset) - floor(i * rate + r.offset)))
        assert abs(sum(r.taken for r in line) - line[0].target) <= max(r.size for r in line) * 2


def test_pages_that_repeat_count_once(spark):
    from tessera.llm import url_filter

    pages = [(i, f"http://h{i % 3}.org/d/{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame(pages, "page_id long, url string")
    many = one.unionByName(one).unionByName(one.where("page_id < 9")).withColumn("host", F.lit("x")).withColumn("bad", F.lit(9))
    run = lambda p: {(r.page_id, r.verdict, r.reputation) for r in url_filter.filter_urls(p, url_filter.outcomes_from_labels(p, labels)).collect()}
    assert run(one) == run(many)


def brute_reputations(outcomes):
    """host -> (mean, alpha, beta) by the chain suffix, domain, host, each centred on the one above."""

    def parts(host):
        labels = host.split(".")
        two = ".".join(labels[-2:])
        return (".".join(labels[-3:]), two) if two in url_filter.SUFFIXES else (two, labels[-1])

    def strength(groups):
        spread = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in groups)
        scale = sum(n * (n - 1) * m * (1 - m) for n, b, m in groups)
        rho = spread / scale if scale else None
        return 2.0 if rho is None else max(2.0, min(1000.0, (1 - rho) / max(rho, 1e-9)))

    def add(key):
        out = {}
        for host, bad in outcomes:
            n, b = out.get(key(host), (0, 0))
            out[key(host)] = (n + 1, b + bad)
        return out

    levels = [add(lambda h: parts(h)[1]), add(lambda h: parts(h)[0]), add(lambda h: h)]
    above = [lambda g: None, lambda g: parts("x." + g)[1] if "." in g else g, lambda g: parts(g)[0]]
    total = (sum(b for _, b in outcomes) + 0.5) / (len(outcomes) + 1)
    means, out = {None: total}, {}
    for level, parent in zip(levels, above, strict=True):
        prior = {g: means[parent(g)] for g in level}
        s = strength([(n, b, prior[g]) for g, (n, b) in level.items()])
        out = {g: (prior[g] * s + b, (1 - prior[g]) * s + n - b) for g, (n, b) in level.items()}
        means = {g: a / (a + c) for g, (a, c) in out.items()}
    return {g: (means[g], *out[g]) for g in out}


def test_posterior_chain_as_by_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts = [f"{s}.{d}" for d in ("a.com", "b.com", "c.org", "d.co.uk", "e.co.uk") for s in ("www", "m", "x")]
    rate = dict(zip(hosts, rng.beta(1, 2, len(hosts)), strict=True))
    outcomes = [(h, int(rng.random() < rate[h])) for h in hosts for _ in range(int(rng.integers(1, 60)))]
    got = {r.host: r for r in url_filter.reputations(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    want = brute_reputations(outcomes)
    assert set(got) == set(want)
    x = (np.arange(200000) + 0.5) / 200000
    for host, (mean, a, b) in want.items():
        assert got[host].reputation == pytest.approx(mean, abs=1e-9)
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - max((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)))
        share = np.cumsum(density) / density.sum()
        assert got[host].bound == pytest.approx(x[np.searchsorted(share, 0.05)], abs=1e-4)


def test_cutoffs_as_by_brute_force(spark):
    """The step along the path that each stratum takes, by exact tails and one step after the other."""
    from math import comb

    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(2600):
        good, lang = i % 4 != 0, "en" if i % 13 else "fr"
        marks = 0 if good and rng.random() > 0.004 else int(rng.integers(0, 30))
        docs.append((i, " ".join(f"w{rng.integers(0, 5000)}" for _ in range(60)) + " " + "#" * marks, lang))
        labels.append((i, int(good)))
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    judged = {r.doc_id: r for r in quality_rules.judge(frame, known).collect()}
    plan = {r.doc_id for r in known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(4)) == 0).collect()}
    bins = {r.doc_id: [r[c] for c in quality_rules.RULES] for r in quality_rules.features(frame).select("doc_id", *(quality_rules._bin(c).alias(c) for c in quality_rules.RULES)).collect()}
    good = dict(labels)
    usable = [i for i in good if not judged[i].base_failed]
    counts = np.zeros((2, len(quality_rules.RULES), quality_rules.BINS + 1), np.int64)
    for i in usable:
        if i in plan:
            for r, b in enumerate(bins[i]):
                counts[good[i], r, b] += 1
    steps = quality_rules.reject_path(counts[1], counts[0], 10.0)
    rejected = lambda i, upto: any(bins[i][r] >= b for r, b in steps[:upto])

    def best(ids, share):
        n = [i for i in ids if good[i]]
        top, chosen = 0.0, 0
        for upto in range(1, len(steps) + 1):
            k = sum(rejected(i, upto) for i in n)
            if sum(comb(len(n), j) * 0.01**j * 0.99 ** (len(n) - j) for j in range(k + 1)) > share:
                break
            worth = sum(rejected(i, upto) for i in ids if not good[i]) - 10.0 * k
            if worth > top:
                top, chosen = worth, upto
        return chosen

    tests = [i for i in usable if i not in plan]
    share = 0.05 / 3
    pooled = best(tests, share)
    for lang in ("en", "fr"):
        mine = [i for i in tests if docs[i][2] == lang]
        n = [i for i in mine if good[i]]
        if 0.99 ** len(n) <= share:
            upto = best(mine, share)
        else:
            upto = pooled
            while upto and sum(rejected(i, upto) for i in n) > 0.01 * len(n):
                upto -= 1
        assert upto > 0
        for i in usable:
            if docs[i][2] == lang:
                assert judged[i].kept == (not rejected(i, upto))


def test_other_tokenizers(tmp_path):
    """A byte-level vocabulary, and the usual one without its normaliser: ids are those of whole texts."""
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    usual = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    (tmp_path / "cased.json").write_text(json.dumps(usual | {"normalizer": None}))
    texts = ["Hello World, PARIS again", "", " a  b\n\tc ", "naïve café… ﬁ 1234", "x" * 50, "Über-Maß (1.5%)!", "don't  stop"]
    for path in (public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cased.json"), public_tokenizers.path("byte_bpe_50k.json")):
        whole = Tokenizer.from_file(path)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        got = [ids[a:b].tolist() for ids, first in packing.Encoder(path).texts(pa.array(texts, pa.large_string())) for a, b in zip(first[:-1], first[1:], strict=True)]
        assert got == want, path
