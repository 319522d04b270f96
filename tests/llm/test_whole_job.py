"""Inputs on which the operators once did less than the whole job."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import aligned_lines, count_tree, hashing, heap_counts, queries, stages, substrings, suffix_dedup
from tickerloom.llm.suffix_array import suffix_array

PIECES = P.path("piece_bpe_32k.model")


def brute_components(docs, size, percent):
    """The smallest id of every document's component, by comparing all pairs."""
    sets, root = {}, {d: d for d, _ in docs}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def found_components(spark, docs, size, percent):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in count_tree.component_rows(frame, size, percent).collect()}


def share_a_key(small, large, percent):
    every = np.random.default_rng(large).integers(0, 1 << 63, large).astype(np.uint64)
    return len(np.intersect1d(count_tree.group_keys(every[:small], percent), count_tree.group_keys(every, percent))) > 0


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


@pytest.mark.parametrize("percent", [70, 80, 83, 90])
def test_sets_whose_sizes_lie_classes_apart_share_a_key(percent):
    for large in range(30, 400):
        assert share_a_key(-(-percent * large // 100), large, percent), large


def test_longer_copies_link_over_class_borders(spark):
    """At (5, 80) against all pairs: a document and the same with a quarter more words."""
    sizes = [(38, 47), (56, 70), (68, 85), (80, 100), (82, 102), (120, 150), (175, 218), (304, 380), (60, 76)]
    docs = []
    for k, (small, large) in enumerate(sizes):
        docs += [(2 * k, words(f"a{k}_", small + 4)), (2 * k + 1, words(f"a{k}_", large + 4))]
    want = brute_components(docs, 5, 80)
    assert sum(d != r for d, r in want.items()) == len(sizes) - 1
    assert found_components(spark, docs, 5, 80) == want


@pytest.mark.parametrize("percent", [70, 80, 83, 90, 95])
def test_small_sets_that_link_share_a_key(percent):
    for large in range(1, 60):
        for small in range(-(-percent * large // 100), large):
            assert share_a_key(small, large, percent), (small, large)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_short_texts_that_differ_by_an_end_word_link(spark, size, percent):
    docs = []
    for n in range(3, 62):
        docs += [(10 * n, words(f"b{n}_", n)), (10 * n + 1, words(f"b{n}_", n + 1)), (10 * n + 2, "first " + words(f"b{n}_", n))]
    want = brute_components(docs, size, percent)
    assert sum(d != r for d, r in want.items()) > 80
    assert found_components(spark, docs, size, percent) == want


@pytest.mark.parametrize("text", ["\U0001f600" * 5000, "\u1200\u1208\u1210\u1218\u1228" * 1000, "a\u0301\u0302" * 2000, "word" + "\u20ac\u1200" * 900 + "word"])
def test_long_runs_that_no_entry_joins_are_counted(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counted = heap_counts.PieceCounter(PIECES)
    assert counted.count(text) == len(library.encode(text))
    assert max(map(len, counted.counts)) <= len(text) + 1 and len(counted.counts) < 20


def brute_lines(docs, min_chars=100):
    """Every document without the lines of runs of enough bytes that some document of a smaller id holds."""
    out, split = {}, {d: (t or "").split("\n") for d, t in docs}
    held = {d: [x for x in lines if x.split()] for d, lines in split.items()}
    for doc, lines in split.items():
        ink, gone = [k for k, x in enumerate(lines) if x.split()], set()
        for other in (o for o in held if o < doc):
            runs = {tuple(held[other][i:j]) for i in range(len(held[other])) for j in range(i + 1, len(held[other]) + 1)}
            for i in range(len(ink)):
                for j in range(i, len(ink)):
                    if tuple(lines[k] for k in ink[i : j + 1]) not in runs:
                        break
                    if sum(len(x.encode()) for x in lines[ink[i] : ink[j] + 1]) >= min_chars:
                        gone |= set(range(ink[i], ink[j] + 1))
        out[doc] = (len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def passage(name, lines, width=40):
    return [f"{name} line {k} ".ljust(width, "x") for k in range(lines)]


def test_all_blocks_of_earlier_documents_leave(spark):
    common, second, block = passage("common", 5), passage("second", 4), passage("whole", 3)
    rare = ["a rare line of two documents"]
    docs = [(1, common + ["one"]), (2, ["two"] + rare), (3, second + ["three"])]
    docs += [(100 + i, [f"own {i}"] + common) for i in range(60)] + [(200 + i, [f"other {i}"] + second) for i in range(30)]
    docs += [(300, common + rare), (301, common + ["between"] + second)]
    # a block whose lines, and pairs of lines, have other earliest holders than the whole
    docs += [(10, ["p", *block[:2]]), (11, [*block[1:], "q"]), (12, ["r", *block]), (400, ["s", *block, "t"])]
    # blank lines that hold bytes, and a tail that no run from its first line covers
    docs += [(20, ["u", block[0], "", block[2]]), (401, ["v", block[0], " " * 30, block[2]])]
    docs += [(21, passage("tail", 2, 60) + ["w"]), (22, ["y"] + passage("tail", 2, 60) + ["short last line"]), (402, passage("tail", 2, 60) + ["short last line", "z"])]
    docs = [(d, "\n".join(x)) for d, x in docs] + [(500, None), (501, ""), (502, "\n \n")]
    found = aligned_lines.kept_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_lines(docs)
    assert [want[d][0] for d in (300, 301, 400, 401, 402)] == [5, 9, 3, 3, 3]
    assert {r["doc_id"]: (r["n_removed"], r["kept"]) for r in found} == want


def test_stages_equal_plain_python(spark, texts):
    """Lines, near duplicates at (5, 80) and windows, each on what the one before kept; with planted near copies."""
    docs = sorted(texts)[:60]
    last = docs[-1][0]
    for k, (_, text) in enumerate(docs[:20]):
        w = text.split()
        docs += [(last + 10 * k + 1, " ".join(w[: len(w) - len(w) // 12])), (last + 10 * k + 2, "\n".join([f"own start {k}", *text.split("\n")[1:]]))]
        docs.append((last + 10 * k + 3, f"begins otherwise {k} " + " ".join(w[:70]) + f" ends otherwise {k}"))
    frame = spark.createDataFrame([(d, t, len(t)) for d, t in docs], "doc_id long, text string, n_chars int")

    def kept(out):
        return {r["doc_id"]: r["text"] for r in out.collect()}

    got = kept(stages.without_common_blocks(frame))
    want = {d: t for d, (n, t) in brute_lines(docs).items() if not n or t.split()}
    assert got == want != dict(docs)

    docs = sorted(want.items())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = kept(stages.without_near_duplicates(frame, 5, 80))
    root = brute_components(docs, 5, 80)
    want = {d: t for d, t in docs if root[d] == d}
    assert got == want and len(want) < len(docs)

    docs = sorted(want.items())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    first, want = {}, {}
    for doc, text in docs:
        w = text.split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        if not all(gone) or not w:
            want[doc] = [x for x, g in zip(w, gone) if not g]
    assert {d: t.split() for d, t in kept(stages.without_repeated_windows(frame)).items()} == want
    assert sum(map(len, want.values())) < sum(len(t.split()) for _, t in docs)


def test_sets_of_one_chance_key_make_no_family(spark):
    """Unlike sets that share a key aren't joined by it; near copies are."""
    rng = np.random.default_rng(12)
    base = [rng.integers(0, 2**63, 200).astype(np.uint64) for _ in range(40)]
    near = [np.r_[s[:-4], rng.integers(0, 2**63, 4).astype(np.uint64)] for s in base[:10]]
    rows = []
    for k, s in enumerate([*base, *near]):
        lists = count_tree.class_keys(np.unique(s), 80)
        # one key that all sets have in common, as a group of one frequent shingle would give
        keys = [[7, *hashing.signed(found).tolist()] for found, _ in lists]
        assert all(need > 1 for _, need in lists)
        rows.append((bytes([k]) * 16, keys, [need for _, need in lists], b""))
    sets = spark.createDataFrame(rows, "sig binary, keys array<array<long>>, needs array<int>, shingles binary")
    names = {r["set"]: r["sig"][0] for r in sets.selectExpr("xxhash64(sig) as set", "sig").collect()}
    got = {frozenset((names[r["a"]], names[r["b"]])) for r in count_tree.family_links(sets).where("a <> b").collect()}
    assert {x for pair in got for x in pair} == {*range(10), *range(40, 50)}


def test_unlike_sets_of_a_large_family_are_not_compared(spark, monkeypatch):
    """Sets that share 60 of 100 shingles with all others meet only their near copy in a block."""
    docs, common = [], [f"c{k}" for k in range(60)]
    for p in range(20):
        own = [f"p{p}_{k}" for k in range(40)]
        docs += [(2 * p, " ".join(common + own)), (2 * p + 1, " ".join(common + own[4:] + [f"q{p}_{k}" for k in range(4)]))]
    linker = count_tree._linker

    def of_few(percent):
        each = linker(percent)

        def counted(frame):
            if len(frame) > 4:
                raise ValueError(f"{len(frame)} sets in a block")
            return each(frame)

        return counted

    monkeypatch.setattr(count_tree, "_linker", of_few)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = substrings.keyed(frame)
    signed = count_tree.signatures(frame, 1, 80).cache()
    links = count_tree.set_links(signed, texts, 1, 80, block_rows=10)
    doc = {bytes(r["sig"]): r["doc"] for r in signed.select("sig", "doc").collect()}
    assert {frozenset((doc[bytes(r["a"])], doc[bytes(r["b"])])) for r in links.collect()} == {frozenset((2 * p, 2 * p + 1)) for p in range(20)}


def test_sets_that_link_share_a_rarest_shingle(spark):
    """Against all pairs: pools of words of all frequencies, sets of many sizes, rows of equal id and text."""
    rng = np.random.default_rng(21)
    docs = []
    for k in range(60):
        base = rng.choice(300, int(rng.integers(5, 60)), replace=False).tolist()
        for copy in range(int(rng.integers(1, 4))):
            w = [f"w{x}" if rng.random() > 0.08 else f"z{rng.integers(0, 40)}" for x in base]
            docs.append((10 * k + copy, " ".join(w)))
    docs += docs[:30]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = substrings.keyed(frame)
    links = count_tree.set_links(count_tree.signatures(frame, 1, 80).cache(), texts, 1, 80, block_rows=2)
    root = {bytes(r["node"]): bytes(r["root"]) for r in count_tree.components(links).collect()}
    sig = {r["doc"]: bytes(r["sig"]) for r in count_tree.signatures(frame, 1, 80).collect()}
    want = brute_components(docs, 1, 80)
    got = {d: root.get(s, s) for d, s in sig.items()}
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a, b in combinations(sorted(want), 2))
    assert len(set(want.values())) < len(want)


def test_repeated_starts_side_by_side_are_one_entry(spark):
    """A passage in unlike surroundings brings a few runs of starts, not one entry for each byte."""
    rng = np.random.default_rng(8)
    some = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = some(2000)
    docs = spark.createDataFrame([(k, some(700) + str(k) + passage + str(k) + some(700)) for k in range(3)], "doc_id long, text string")
    found = {r["doc"]: r["starts"] for r in suffix_dedup.repeated_places(docs, 400).collect()}
    for k in range(3):
        starts = sorted(s["start"] + i for s in found[k] for i in range(s["n"]))
        assert sorted(set(starts)) == list(range(701, 2302))
        assert len(found[k]) < 100


def test_starts_of_a_large_anchor_are_settled_in_pieces(spark):
    """Near copies and periodic texts on the hash path: all repeated starts, in few entries."""
    rng = np.random.default_rng(14)
    some = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    width, base = 400, some(2500)
    docs = []
    for k in range(24):
        at = int(rng.integers(0, len(base)))
        docs.append((k, base[:at] + "#" + base[at + 1 :]))
    docs += [(k, some(k * 10) + "all work and no play " * (30 + k) + some(50)) for k in range(24, 28)]
    count = {}
    for _, text in docs:
        for i in range(len(text) - width + 1):
            count[text[i : i + width]] = count.get(text[i : i + width], 0) + 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc"]: r["starts"] for r in suffix_dedup.repeated_places(frame, width, anchor_bytes=1).collect()}
    for doc, text in docs:
        starts = sorted(s["start"] + i for s in found[doc] for i in range(s["n"]))
        assert sorted(set(starts)) == [i for i in range(len(text) - width + 1) if count[text[i : i + width]] > 1]
        assert len(found[doc]) < 0.2 * len(starts)


def test_sets_of_no_family_are_not_shuffled(spark):
    sets = spark.range(4000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("sig"), F.lit(b"12345678").alias("shingles"))
    place = sets.limit(5).select("sig", F.lit(1).alias("family"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        joined = count_tree.placed(sets, place)
        assert len(joined.collect()) == 5
        plans, written = [joined._jdf.queryExecution().executedPlan()], []
        while plans:
            plan = plans.pop()
            if plan.nodeName() == "Exchange":
                written.append(plan.metrics().apply("shuffleRecordsWritten").value())
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
        assert len(written) >= 2 and max(written) < 50
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_suffixes_of_many_symbols():
    """Strings of names as the recursion meets them: many symbols and long repeats."""
    rng = np.random.default_rng(6)
    part = rng.integers(1, 900, 300)
    s = np.r_[part, rng.integers(1, 900, 200), part, part, np.full(100, 5), 0]
    text = s.tolist()
    assert suffix_array(s, 900).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_planted_passages_are_told_by_removed_bytes(spark, tmp_path):
    """Passages of over 50 words: both holders lose one of 400 bytes up, none a shorter one; n_bytes is the whole length for all."""
    rng = np.random.default_rng(3)
    some = lambda n, least, most: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(least, most)))) for _ in range(n))
    long, short = some(60, 7, 12), some(60, 4, 5)
    assert len(long) >= 400 and len(short) < 400
    texts = [f"{some(80, 3, 9)} {x} {some(80, 3, 9)}".replace("  ", " é ") for x in (long, long, short, short, "", "")] + [None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    datas = [(t or "").encode() for t in texts]
    count = {}
    for d in datas:
        for i in range(len(d) - 399):
            count[d[i : i + 400]] = count.get(d[i : i + 400], 0) + 1
    want = {}
    for k, d in enumerate(datas):
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if count[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want[k] = (len(d), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_array_spans(spark, str(tmp_path)).collect()}
    assert got == want
    assert [got[k][1] >= len(long) for k in range(7)] == [True] * 2 + [False] * 5
    assert [got[k][1] for k in range(2, 7)] == [0] * 5
