"""Exact Jaccard join of documents on word n-grams, with adaptive multi-match prefixes.

A document's shingles are put in one global order, rarest first. If two sets reach the similarity,
their prefixes of n - ceil(t n) + l shingles share at least l of them, for any l. Longer prefixes
ask for more shared shingles before a pair is verified, so each document takes the l whose estimated
cost, postings read plus candidates verified, is least; a pair uses the smaller l of its two.

Document frequencies cover all documents and come from the block exchange; shingles that are in one
document cannot match and are never sent. Documents with equal sets are one representative. Verification
goes by stars first: each posting list around the document that shares most, then in a few rounds
around members of the list's most common component. What is not connected by then meets in all
pairs across components within a list. Components are therefore those of the whole join, without
a large group ever being expanded into its pairs.

Defined results: null or blank text has an empty set and links with nothing; fewer than k words
make one shingle; rows with the same id are one node; null ids link with nothing and get a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import components
from .runtime import cut, small, text_volume
from .textkernel import LAST, Words, each_words, grams, inside, mix

U = np.uint64
MATCHES = (1, 2, 3, 4)  # the numbers of shared prefix shingles that a document may ask for
POSTINGS = "doc_id long, n int, matches int, shared long, common int, prefix array<struct<token: long, level: int>>, shingles array<long>"


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and where each document's begin."""
    h = words.hashes(lower=True)
    count = np.diff(words.first)
    whole = inside(words.first, k)
    values = [grams(h, k, 11)[whole]]
    rows = [words.doc()[: len(whole)][whole]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            values.append(grams(h, n, 20 + n)[words.first[short]])
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for base, words in each_words(batch["text"]):
                value, first = shingle_sets(words, k)
                size = len(first) - 1
                total = np.zeros((2, len(value) + 1), U)
                for i, salt in enumerate((0x51ED270B, 0x2545F491)):
                    np.cumsum(mix(value ^ U(salt)), out=total[i, 1:])
                a, b = (total[i][first[1:]] - total[i][first[:-1]] for i in range(2))
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].slice(base, size),
                        "n_shingles": pa.array(np.diff(first).astype(np.int64)),
                        "sig_a": pa.array(a.view(np.int64)),
                        "sig_b": pa.array(b.view(np.int64)),
                    }
                )

    return run


def frequency_code(df: np.ndarray) -> np.ndarray:
    """Document frequency in a byte: exact below 64, eight steps a doubling beyond."""
    return np.where(df < 64, df, np.minimum(255, 64 + 8 * np.log2(np.maximum(df, 1) / 64))).astype(np.uint8)


def code_frequency(code: np.ndarray) -> np.ndarray:
    return np.where(code < 64, code, 64 * 2.0 ** ((code.astype(float) - 64) / 8))


def _reply(payloads, lengths):
    key = np.concatenate([np.frombuffer(p[0], np.uint32) for p in payloads])
    count = np.concatenate([np.frombuffer(p[1], np.uint16) for p in payloads]).astype(np.int64)
    _, place = np.unique(key, return_inverse=True)
    code = frequency_code(np.bincount(place, weights=count))[place]
    return [[x.tobytes()] for x in np.split(code, np.cumsum(lengths)[:-1])]


def choose_matches(df: np.ndarray, n: int, least: int) -> int:
    """The l of MATCHES with the least estimated cost, given frequencies in prefix order."""
    base = n - least
    best, chosen = None, 1
    for wanted in MATCHES:
        if wanted > least:
            break
        read = float(np.sum(df[: base + wanted] - 1))
        cost = read + n * read / wanted  # each candidate must be met `wanted` times
        if best is None or cost < best:
            best, chosen = cost, wanted
    return chosen


def postings(docs: DataFrame, reps: DataFrame, k: int, percent: int, volume: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """volume: bytes of text. For each representative that shares a prefix shingle: its prefix (with levels) and whole set."""
    blocks, ranges = X.plan_blocks(volume)
    dealt = X.in_blocks(docs.where(F.col(doc_id).isNotNull()), blocks, doc_id, text, by_row=False)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    chosen = reps.select(block, F.lit(-1).alias("range"), F.lit(None).cast("array<binary>").alias("answer"), "doc_id")

    def sets_of(group: pa.Table, wanted: pa.Table):
        ids, texts = X.ordered(group)
        take = np.isin(ids, wanted["doc_id"].to_numpy())
        for base, words in each_words(texts):
            value, first = shingle_sets(words, k)
            for i in np.flatnonzero(take[base : base + len(first) - 1]):
                if first[i + 1] > first[i]:
                    yield ids[base + i], value[first[i] : first[i + 1]]

    def ask(group: pa.Table, wanted: pa.Table) -> pa.Table:
        values = [v for _, v in sets_of(group, wanted)] if len(group) else []
        key, count = np.unique(np.concatenate(values), return_counts=True) if values else (np.zeros(0, U), np.zeros(0, int))
        columns = [key.astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)]
        return X.send(group["block"][0].as_py() if len(group) else 0, key, columns, ranges)

    asked = dealt.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(ask, X.PAYLOAD)
    told = X.answer(asked, _reply).withColumn("doc_id", F.lit(None).cast("long"))
    both = chosen.unionByName(told.select("block", "range", "answer", "doc_id"))

    def emit(group: pa.Table, side: pa.Table) -> pa.Table:
        out = {n: [] for n in ("doc_id", "n", "matches", "shared", "common", "prefix", "shingles")}
        is_rep = pa.array(side["range"].to_numpy() < 0)
        sets = list(sets_of(group, side.filter(is_rep))) if len(group) else []
        if sets:
            key = np.unique(np.concatenate([v for _, v in sets]))
            answers = X.answers_in_order(side.filter(pc.invert(is_rep)))
            code = np.concatenate([np.frombuffer(a[0], np.uint8) for a in answers])
            for i, v in sets:
                n = len(v)
                least = -(-percent * n // 100)
                c = code[np.searchsorted(key, v)]
                if n * (100 - percent) < percent:
                    continue  # so small that only an equal set is similar, and equal sets are one representative
                order = np.lexsort((v, c))
                df = code_frequency(c[order])
                matches = choose_matches(df, n, least)
                size = n - least + matches
                common = np.count_nonzero(c > 1)
                if common < least:
                    continue  # too many shingles of its own for any partner
                seen = np.flatnonzero(df[:size] > 1)
                if not len(seen):
                    continue
                level = np.maximum(1, seen - (n - least))
                out["doc_id"].append(i)
                out["n"].append(n)
                out["matches"].append(matches)
                out["common"].append(common)
                out["shared"].append(int(np.sum(df - 1)))
                out["prefix"].append([{"token": t, "level": x} for t, x in zip(v[order][seen].view(np.int64).tolist(), level.tolist(), strict=True)])
                out["shingles"].append(v.view(np.int64))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("token", pa.int64()), ("level", pa.int32())])), pa.list_(pa.int64()))
        return pa.table({name: pa.array(x, t) for (name, x), t in zip(out.items(), kinds, strict=True)})

    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(emit, POSTINGS)


def _possible(percent: int):
    """(condition, wanted) for a posting that two documents share.

    Both prefixes are taken at the smaller l. A similar pair of these sizes shares `overlap` shingles,
    at most n - prefix of which lie outside a prefix, so the prefixes share `wanted`, which is l or
    more. Meetings outside those prefixes, of sizes too far apart, of documents that post fewer
    shingles than wanted, or that have fewer shingles in common with any other document than the
    overlap, cannot matter.
    """
    ceil = lambda numerator, denominator: F.floor((numerator + denominator - 1) / denominator)
    x, y = F.col("x_n"), F.col("y_n")
    matches = F.least("x_matches", "y_matches")
    overlap = ceil((x + y) * percent, F.lit(100 + percent))
    wanted = matches + overlap - F.greatest(ceil(x * percent, F.lit(100)), ceil(y * percent, F.lit(100)))
    sizes = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    posted = (F.col("x_posted") >= wanted) & (F.col("y_posted") >= wanted) & (F.col("x_common") >= overlap) & (F.col("y_common") >= overlap)
    return (F.col("x") != F.col("y")) & sizes & (F.col("x_level") <= matches) & (F.col("y_level") <= matches) & posted, wanted


def _meetings(joined: DataFrame, percent: int) -> DataFrame:
    """(x, y, wanted), x < y, for each posting that two documents share."""
    condition, wanted = _possible(percent)
    return joined.where(condition).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), wanted.alias("wanted"))


def _counted(met: DataFrame) -> DataFrame:
    """Pairs that met as often as wanted."""
    return met.groupBy("x", "y").agg(F.count("*").alias("met"), F.max("wanted").alias("wanted")).where("met >= wanted").select("x", "y")


def _verified(pairs: DataFrame, posted: DataFrame, percent: int) -> DataFrame:
    sets = posted.select("doc_id", "n", "shingles")
    one = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("x_n"), F.col("shingles").alias("x_set"))
    two = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("y_n"), F.col("shingles").alias("y_set"))
    both = F.size(F.array_intersect("x_set", "y_set"))
    return pairs.join(one, "x").join(two, "y").where(both * 100 >= (F.col("x_n") + F.col("y_n") - both) * percent).select("x", "y")


ROW = ("n", "matches", "posted", "common", "level")


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select("token", F.col("doc_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in (*ROW, *more)))


ROUNDS, CENTRES = 2, 4


def _lists(posted: DataFrame) -> DataFrame:
    rows = posted.select("doc_id", "n", "matches", "shared", "common", F.size("prefix").alias("posted"), F.explode("prefix").alias("p"))
    return rows.select("doc_id", "n", "matches", "shared", "common", "posted", "p.token", "p.level")


def _placed(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posting rows with their component, and of each list with several components the most common one."""
    grouped = components(found, "x", "y").withColumnRenamed("node", "doc_id")
    placed = rows.join(grouped, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    common = (
        placed.groupBy("token", "component")
        .agg(F.count("*").alias("members"))
        .groupBy("token")
        .agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("token", F.col("top.component").alias("main"))
    )
    return placed, common


def _centre(kept, order):
    return F.min(F.when(kept, F.struct(order.alias("order"), "doc_id", *ROW)))


def _around(centres: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Meetings of a list's centres (column c) with its other rows."""
    centres = centres.where("c is not null").select("token", *(F.col(f"c.{c}").alias("x" if c == "doc_id" else f"x_{c}") for c in ("doc_id", *ROW)))
    return _meetings(centres.join(_side(rows, "y"), "token"), percent)


def links(posted: DataFrame, percent: int) -> DataFrame:
    """(x, y): verified pairs that connect all representatives that the whole join connects.

    Stars first, a few per list, each round around other members of the list's most common
    component: their rows grow with the lists. Only what stays apart then meets pair by pair.
    """
    rows = _lists(posted)
    everyone = F.lit(True)
    first = rows.groupBy("token").agg(_centre(everyone, -F.col("shared")).alias("c"), F.count("*").alias("members")).where("members > 1")
    found = cut(_verified(_counted(_around(first, rows, percent)), posted, percent))
    for r in range(ROUNDS):
        placed, common = _placed(rows, found)
        open_rows = placed.join(common, "token")
        inner = F.col("component") == F.col("main")
        stars = open_rows.groupBy("token").agg(F.array_distinct(F.array(*(_centre(inner, F.xxhash64("doc_id", F.lit(r * CENTRES + i))) for i in range(CENTRES)))).alias("c"))
        met = _around(stars.select("token", F.explode("c").alias("c")), open_rows.where(~inner), percent)
        more = cut(_verified(_counted(met), posted, percent))
        found = found.unionByName(more)
    placed, common = _placed(rows, found)
    tokens = posted.select("doc_id", F.col("prefix.token").alias("tokens"))
    open_rows = placed.join(common, "token").join(tokens, "doc_id")
    minor = _side(open_rows.where("component <> main"), "x", "component", "tokens")
    other = _side(open_rows, "y", "component", "main", "tokens")
    apart = (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("y_main")) | (F.col("x") < F.col("y")))
    condition, wanted = _possible(percent)
    # Counted where they meet, on whole prefixes, and kept at the first shingle that they share.
    shared = F.array_intersect("x_tokens", "y_tokens")
    enough = (F.size(shared) >= wanted) & (shared[0] == F.col("token"))
    met = minor.join(other, "token").where(condition & apart & enough).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    last = _verified(met.distinct(), posted, percent)
    return cut(found.unionByName(last))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for each row of docs."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = cut(plain.mapInArrow(_signatures(k), "doc_id long, n_shingles long, sig_a long, sig_b long"))
    key = ["sig_a", "sig_b", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    reps = cut(classes)
    volume = text_volume(docs, text)
    posted = cut(postings(docs, reps.where("rep is not null").select(F.col("rep").alias("doc_id")), k, percent, volume, doc_id, text))
    # Rows that repeat an id are one node: it ties their classes together.
    several = cut(signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("z")).where("a <> z").select("doc_id"))
    ties = signed.where("n_shingles > 0").join(small(several), "doc_id").select("doc_id", *key).distinct().join(reps, key).where("doc_id <> rep")
    edges = links(posted, percent).select("x", "y").unionByName(ties.select(F.col("rep").alias("x"), F.col("doc_id").alias("y")))
    joined = components(edges, "x", "y")
    placed = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    own = joined.withColumnRenamed("node", "doc_id").join(several, "doc_id").select("doc_id", "component")  # for their rows without words
    out = signed.join(placed, key, "left").join(small(cut(own)), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest id.

    Of rows that repeat an id, the first by text stays; rows without an id all stay.
    """
    placed = near_duplicates(docs, k, percent, doc_id, text)
    stay = cut(placed.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct("*").alias("row"))
    once = rows.join(stay.where("n = 1").select("doc_id"), "doc_id", "left_semi").select("row.*")
    # Ids that repeat: the first by text, as a partial aggregate, so that no id's rows meet in one task.
    several = rows.join(small(stay.where("n > 1").select("doc_id")), "doc_id", "left_semi")
    first = several.groupBy("doc_id").agg(F.min_by("row", F.struct("text")).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.where(F.col(doc_id).isNull()))
